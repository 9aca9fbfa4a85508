"""The audit against filters applied one by one, in every order."""

import random
import re
from collections import Counter

from strandline.llm.filter_audit import FILTERS, GOOD, OUTCOMES, TOXIC, audit, integers, unpacked
from strandline.llm.filter_audit import ORDERS as ALL

DOCS = "doc_id long, text string, lang string, mask int, part string, n int, digest string, quality int"
LABELS = "doc_id long, quality int, toxic int, text string"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        share = Counter()
        for order in ALL:
            left = [x for x in fails if x[0] == part]
            before = []
            for s, name in enumerate(order):
                gone = [x for x in left if name in x[1]]
                redundant = sum(name in x[1] for x in before)
                left = [x for x in left if name not in x[1]]
                before += gone
                share[name] += len(gone)
                alone = sum(x[0] == part and x[1] == {name} for x in fails)
                out[part, order, s + 1] = [len(left), len(gone), redundant, alone, sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for order in ALL:
            for s, name in enumerate(order):
                out[part, order, s + 1].append(share[name])
    return out


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 1, "x", 2, "y", 3) for d in docs], DOCS).repartition(5), spark.createDataFrame([(*x, "z") for x in labels], LABELS)


def rows(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[k] for k in (*OUTCOMES, "shapley")] for r in df.collect()}


def test_brute_force(spark):
    rng = random.Random(5)
    texts = ["", None, "few words", " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i % 60}" for i in range(100)), "LOUD " * 120, " ".join(f"W{i}" for i in range(150)) + " #", "a|b", "ÄÖ" * 50 + " A" * 30]
    texts += [" ".join(f"v{i}" for i in range(80)) + " x" * 20, "é " * 99, "é " * 100, "y" * 70000 + " $ "]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(160)]
    docs += [docs[3], docs[4], docs[4], (7, "few words", "en"), (7, "few words", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 50, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    assert rows(audit(*frames(spark, docs, labels), salts=3)) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = frames(spark, [], [(1, 1, 1)])
    assert audit(docs, labels).count() == 0
    docs, labels = frames(spark, [(1, "x", "en")], [])
    assert rows(audit(docs, labels)) == brute([(1, "x", "en")], [])


def test_fields_do_not_run_over():
    full = GOOD | TOXIC | (1 << len(FILTERS)) - 1
    n = 2**62
    counts = unpacked(n * integers()[full] + (n - 1) * integers()[full])
    assert set(counts.ravel().tolist()) == {0, 2 * n - 1}
    assert counts[:, 0, OUTCOMES.index("removed")].min() == 2 * n - 1 and counts[:, 1:, OUTCOMES.index("removed")].max() == 0
