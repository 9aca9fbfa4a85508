"""The pipeline's stages, each on what the one before it kept: against brute force, and on awkward rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

from .test_line_dedup import edit
from .test_minhash import components, sets_of
from .test_mixing import filled
from .test_packing import PATH, Tokenizer
from .test_quality import counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, repeats string, place string, component_id string, line string, ids string"
EXTRA = ("kept", "size", "repeats", "place", "component", "line", "ids")


def held(spark, stage, docs, folder):
    """The stage's rows, written and read again as run() does."""
    stage(spark, docs, SF).write.parquet(f"file://{folder}")
    return spark.read.parquet(f"file://{folder}")


def without_repeats(rows):
    """Brute force of the line stage: of equal lines the first stays, of near ones the earlier document's."""
    lines = [(i, n, x.strip(" ")) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    worded = [x for x in lines if x[2].strip(" \t\v\f\r") or len(x[2]) >= 24]
    first = {}
    for i, n, x in sorted(worded):
        first.setdefault(x, (i, n))
    long_ = sorted((x for x in first if len(x) >= 24), key=len)
    near = set()
    for k, x in enumerate(long_):
        for y in long_[k + 1 :]:
            if len(y) - len(x) > 2:
                break
            if sum((a != b) for a, b in zip(x, y)) <= 2 or (len(set(x) ^ set(y)) <= 4 and edit(x, y) <= 2):  # noqa: B905
                assert first[x][0] != first[y][0]  # within a document a hash decides, which is not tested here
                near.add(max(x, y, key=lambda z: first[z]))
    out = {}
    for i, t in rows:
        own = [(n, x) for n, x in enumerate((t or "").split("\n"))]
        left = [x for n, x in own if not (x.strip(" ") in near or first.get(x.strip(" "), (i, n)) != (i, n))]
        if len(left) == len(own):
            out[i] = t
        elif "\n".join(left).strip(" \t\n\v\f\r"):
            out[i] = "\n".join(left)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(p.STAGES)

    docs = held(spark, stages["quality rules"], docs, tmp_path / "1")
    # too few labels here for any cutoff: the base rules alone
    of = {i: counts(t) for i, t in rows.items()}
    want = {i: t for i, t in rows.items() if of[i][0] >= 10 and 100 * of[i][4] <= 20 * of[i][0]}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want and 0 < len(want) < len(rows)

    docs = held(spark, stages["line dedup"], docs, tmp_path / "2")
    want = without_repeats(sorted(want.items()))
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want

    docs = held(spark, stages["near dedup"], docs, tmp_path / "3")
    group = components({i: sets_of(t, 5) for i, t in want.items()}, 80)
    want = {i: t for i, t in want.items() if group[i] == i}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want

    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    docs = held(spark, stages["mixture"], docs, tmp_path / "4")
    taken = [r["doc_id"] for r in docs.collect()]
    assert all(r["text"] == want[r["doc_id"]] for r in docs.collect()) and max(map(taken.count, want)) <= 2
    words = {i: counts(t)[0] for i, t in want.items()}
    sizes = {s: sum(words[i] for i in want if sources[i] == s) for s in set(sources.values())}
    ordered = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    targets = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(ordered)}, 1.5 * sum(sizes.values()), 2.0)
    for s, target in targets.items():
        assert sum(words[i] for i in taken if sources[i] == s) == pytest.approx(target, abs=max(words.values()))

    packed = held(spark, stages["packing"], docs, tmp_path / "5").collect()
    whole = Tokenizer.from_file(PATH)
    lengths = {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert sum(r["length"] for r in packed) == sum(lengths[i] for i in taken)
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert sum(n for _, n in own) <= 1024 and [a for a, _ in sorted(own)] == [sum(n for b, n in own if b < a) for a, _ in sorted(own)]


def awkward():
    words = " ".join(f"w{i}" for i in range(40))
    texts = [
        (1, words, "en", "a"), (1, words, "en", "a"), (2, words, None, None), (None, words, "en", "b"), (None, None, None, None), (3, None, "en", "a"), (4, "", "en", "a"),
        (5, " \n\t\n", "", ""), (6, "\n".join(f"line {i} of a very long text" for i in range(20_000)), "en", "a"), (7, f"{words} end", "zz", "c"), (8, "short", "en", "c"),
    ]
    return [(i, t, lang, source, None, *EXTRA) for i, t, lang, source in texts]


@pytest.mark.parametrize("name", [name for name, _ in p.STAGES])
def test_awkward_rows_and_empty_tables(spark, name):
    stage = dict(p.STAGES)[name]
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0
    found = stage(spark, docs, SF)
    rows = found.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {i for i, *_ in awkward()}
        return
    assert found.columns == docs.columns == empty.columns
    assert all(tuple(r[c] for c in docs.columns[5:]) == EXTRA for r in rows)
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in rows)
    if name == "quality rules":
        assert ids == [-1, 1, 1, 2, 7] or ids == [-1, 1, 1, 2, 6, 7]
    elif name == "line dedup":  # rows without an id lose nothing, and texts without words stay
        assert ids == [-1, -1, 1, 1, 3, 4, 5, 6, 7, 8]
    elif name == "near dedup":  # 2 and 7 are near 1; no shingles, no links
        assert ids.count(1) == 2 and not {2, 7} & set(ids) and {3, 4, 5, 6, 8} <= set(ids)
    else:
        assert set(ids) <= {-1, *range(1, 9)} and found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 8").count() == 0
