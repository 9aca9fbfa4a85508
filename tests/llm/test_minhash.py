import random
import re

import numpy as np

from strandline.llm.minhash import near_duplicates, shingles, super_minhash

SCHEMA = "doc_id long, text string, n_shingles string"


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(sets, percent):
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                a_, b_ = sorted((find(a), find(b)))
                up[b_] = a_
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = ["", None, " \n\t", "One Two", "one two", "one", "É x y z", "é x y z", "a\x0bb c d", "A b c d"]
    for _ in range(12):  # chains of edits: neighbours are near, ends are not
        text = rng.choices(vocabulary, k=rng.choice([8, 40, 150, 400]))
        for _ in range(8):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice([0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    base = rng.choices(vocabulary, k=100)  # a large group about one text
    for _ in range(60):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            own[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    rng.shuffle(texts)
    return [(10 + 3 * i, t, "x") for i, t in enumerate(texts)]


def test_brute_force(spark):
    rows = corpus()
    sets = {i: sets_of(t, 3) for i, t, _ in rows}
    want = components(sets, 85)
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), width=3, percent=85).collect()
    assert sorted(tuple(r) for r in found) == sorted((i, len(sets[i]), want[i], i == want[i]) for i, *_ in rows)
    assert len({r["component_id"] for r in found}) < len(rows) - 50


def test_default_of_five_words(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(200)), ""), (2, " ".join(f"w{i}" for i in range(195)), ""), (3, "other words that are quite alone here", "")]
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: 1, 2: 1, 3: 3}


def test_empty_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    found = near_duplicates(spark.createDataFrame([(5, "a b c d", ""), (5, "a b c d", ""), (None, "a b c d", "")], SCHEMA)).collect()
    assert [r["component_id"] for r in found] == [5, 5, 5] and [r["kept"] for r in found].count(True) == 2


def test_rows_without_id_take_no_links_from_others(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(None, " ".join(base), ""), (7, " ".join(base[:198]), ""), (4, " ".join(base[1:]), ""), (None, "a text that stands alone here", "")]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found} == {(None, None, True), (7, 4, False), (4, 4, True)} and len(found) == 4


def test_signature_equals_the_definition_and_estimates():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = np.unique(np.concatenate([common, rng.integers(0, 2**63, 50).astype(np.uint64)])), np.unique(np.concatenate([common, rng.integers(0, 2**63, 50).astype(np.uint64)]))
    both = super_minhash([a, b, a[:3]], 120)
    alone = super_minhash([a], 120)
    assert (both[0] == alone[0]).all() and np.isfinite(both).all()
    assert abs((both[0] == both[1]).mean() - 0.9) < 0.1
    # ranks of one element are a permutation: its values lie in every unit interval once
    assert sorted(super_minhash([a[:1]], 16)[0].astype(int)) == list(range(16))


def test_shingles_of_long_text():
    assert len(shingles("x y " * 100_000, 3, {"x": 1}.__class__(zip([b"x", b"y"], [1, 2])))) == 2


def test_long_sets_go_by_slices(monkeypatch):
    import numpy as np

    from strandline.llm import minhash

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 3, 49, 50, 51, 400, 2000, 7)]
    whole = minhash.super_minhash(sets, 120)
    for at_once in (10, 50, 5000):
        monkeypatch.setattr(minhash, "AT_ONCE", at_once)
        assert np.array_equal(minhash.signatures(sets, 120), whole)
