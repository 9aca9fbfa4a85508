import random

from pyspark.sql import functions as F

from strandline.llm.common import Scratch
from strandline.llm.line_dedup import banded_distance, block_candidates, finer_keys, key_sizes, keys, may_be_near, repeated_lines, shared_keys, sketch, star_pairs, texts_of, without_ends, without_lines, without_places


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        kind = rng.choice("ids")
        if kind == "i":
            s.insert(at, rng.choice("abcé"))
        elif s and kind == "d":
            del s[min(at, len(s) - 1)]
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("abcé")
    return "".join(s)


def pairs(n, most, alphabet="abcé 𝒳"):
    rng = random.Random(n)
    out = []
    for _ in range(n):
        a = "".join(rng.choices(alphabet, k=rng.randrange(0, most)))
        b = changed(rng, a, rng.randrange(0, 5))
        out.append((a, b) if len(a) <= len(b) else (b, a))
    return out


def test_distance(spark):
    for k in (1, 2, 3):
        rows = [(a, b) for a, b in pairs(300, 40) if len(b) - len(a) <= k]
        df = spark.createDataFrame(rows, "a string, b string")
        arrays = df.select("a", "b", *(F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "")).alias(f"{c}s") for c in "ab"))
        for r in arrays.select("a", "b", banded_distance(F.col("as"), F.col("bs"), k).alias("d")).collect():
            assert r["d"] == min(edit(r["a"], r["b"]), k + 1), (k, r)


def shared(spark, make, rows, drop=frozenset()):
    df = spark.createDataFrame([(i, x, side) for i, r in enumerate(rows) for x, side in zip(r, "ab", strict=True)], "i int, line string, side string")
    own, probed = {}, {}
    for r in make(df).collect():
        assert set(r.asDict()) == {"i", "line", "side", "own", "key"}
        if r["own"] == (r["side"] == "a"):
            (own if r["own"] else probed).setdefault(r["i"], set()).add(r["key"])
    return [bool(own.get(i, set()) & probed.get(i, set())) for i in range(len(rows))]


def test_lines_within_the_threshold_share_a_key(spark):
    for k in (1, 2, 3):
        rows = [(a, b) for a, b in pairs(400, 60) if len(a) >= k + 1 and edit(a, b) <= k]
        assert all(shared(spark, lambda df: keys(df, k), rows))  # noqa: B023


def test_lines_within_the_threshold_share_a_finer_key(spark):
    for k, parts in ((1, 4), (2, 6), (2, 12), (3, 5)):
        rows = [(a, b) for a, b in pairs(300, 60) if len(a) >= k + 1 and edit(a, b) <= k]
        assert len(rows) > 60 and all(shared(spark, lambda df: finer_keys(df, k, parts), rows))  # noqa: B023
    passage = "the same forty characters stand in all of them "
    rng = random.Random(3)
    far = [tuple("".join(rng.choices("abcdefgh", k=40)) + passage + "".join(rng.choices("abcdefgh", k=40)) for _ in "ab") for _ in range(20)]
    assert all(shared(spark, lambda df: keys(df, 2), far)) and not any(shared(spark, lambda df: finer_keys(df, 2, 6), far))


def test_sketches_lose_nothing(spark):
    rows = [(a, b) for a, b in pairs(600, 60) if edit(a, b) <= 2]
    df = spark.createDataFrame(rows, "a string, b string")
    kept = df.where(may_be_near(F.length("a"), sketch(F.col("a")), F.length("b"), sketch(F.col("b")), 2))
    assert len(rows) > 100 and kept.count() == len(rows)


def test_ends_do_not_change_the_distance(spark):
    rows = pairs(400, 70)
    df = spark.createDataFrame([(a, b, a, b) for a, b in rows], "a string, b string, s string, l string")
    found = without_ends(df).collect()
    assert all(edit(r["s"], r["l"]) == edit(r["a"], r["b"]) for r in found)
    assert sum(len(r["s"]) for r in found) < 0.7 * sum(len(r["a"]) for r in found)


def brute(docs, threshold, min_chars):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    lines = [(i, p, x.strip(" ")) for i, t in docs if i is not None for p, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= min_chars]
    first = {}
    for i, p, x in lines:
        first[x] = min(first.get(x, (i, p)), (i, p))
    texts = sorted(first)
    hashes = {r["x"]: r["h"] for r in spark.createDataFrame([(x,) for x in texts] or [("",)], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    order = {x: (first[x][0], hashes[x]) for x in texts}
    near = {y for x in texts for y in texts if x != y and abs(len(x) - len(y)) <= threshold and order[x] < order[y] and edit(x, y) <= threshold}
    return sorted((i, p, x in near) for i, p, x in lines if x in near or (i, p) != first[x])


def test_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randrange(20, 60))) for _ in range(40)]
    docs = []
    for i in range(60):
        own = [changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 6))]
        docs.append((100 - i, "\n".join(own + rng.choice([[], ["  short "], [base[0], base[0] + " "]]))))
    docs += [(200, None), (201, ""), (None, base[0]), (202, base[1] + "\n" + "z" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = brute(docs, 2, 24)
    for options in ({}, {"most_open": 1}, {"most_open": 1, "finer": (4, 8)}, {"finer": ()}):
        removed = repeated_lines(df, threshold=2, min_chars=24, **options)
        assert sorted(tuple(r) for r in removed.collect()) == expected, options


def test_dense_group_against_brute_force(spark, monkeypatch):
    from strandline.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    monkeypatch.setattr(line_dedup, "CANDIDATES", 2)
    docs = [(i, f"the ledger of entry {i * 7919 % 900:03d} was closed by hand") for i in range(160)]
    docs += [(1000 + i, f"shelf {i:05b}{i:05b}{i:05b} of the archive".replace("0", "xy")) for i in range(32)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(docs, 2, 24)
    for options in ({}, {"most_open": 10}):
        assert sorted(tuple(r) for r in repeated_lines(df, **options).collect()) == expected, options


def test_rows_grow_with_the_lines_of_a_shared_passage(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdefgh ", k=30)) + "a passage that all of these lines have in common" + "".join(rng.choices("abcdefgh ", k=30)) for _ in range(800)]
    here = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, line string")
    with Scratch(spark, "test") as scratch:
        all_ = here.select("line", F.xxhash64("line").alias("id"), F.col("doc_id").alias("first"))
        rows = shared_keys(keys(all_, 2).select("key", "id", "first", "own"), scratch)
        texts = texts_of(rows.select("id").distinct(), here, scratch)
        members = rows.join(texts.select("id", "n", "sketch"), "id").withColumn("open", F.lit(True))
        n, sizes = members.count(), key_sizes(members)
        assert n > 800 and star_pairs(members, 2).count() <= n and sizes.agg(F.max("n_open")).first()[0] >= 800
        assert block_candidates(members, sizes, 2, 16).count() < 50
        assert shared_keys(finer_keys(all_, 2, 6).select("key", "id", "first", "own"), scratch).count() < 50
    assert repeated_lines(here.select("doc_id", F.col("line").alias("text"))).count() == 0


def test_ties_repeated_rows_and_clashing_columns(spark):
    line = "one line of text that is long enough to count"
    docs = spark.createDataFrame([(1, line + "\n" + line, "a", 1), (1, line + "\n" + line, "b", 2), (2, line + "!", "c", 3), (2, None, "d", 4)], "doc_id long, text string, line string, id int")
    assert sorted(tuple(r) for r in repeated_lines(docs).collect()) == [(1, 1, False), (2, 0, True)]
    out = without_lines(docs, repeated_lines(docs))
    assert out.columns == docs.columns and sorted((r["id"], r["text"]) for r in out.collect()) == [(1, line), (2, line), (4, None)]


def test_without_lines(spark):
    docs = spark.createDataFrame([(1, "keep this line as it is the first one\nx", 1), (2, "keep this line as it is the first one", 2), (3, "keep this line as it is the first one\nown", 3), (4, None, 4)], "doc_id long, text string, places int")
    out = {r["doc_id"]: r["text"] for r in without_lines(docs, repeated_lines(docs)).collect()}
    assert out == {1: "keep this line as it is the first one\nx", 3: "own", 4: None}


def test_empty(spark):
    assert repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_go_for_equal_lines_only(spark):
    docs = spark.createDataFrame([(1, "Les.\n\n}\nall rights reserved\n\t"), (2, " Les. \n\nLes!\nall rights reserved\n\t"), (3, "Les.\nown\nLes.\n}")], "doc_id long, text string")
    removed = repeated_lines(docs).collect()
    assert sorted(tuple(r) for r in removed) == [(2, 0, False), (2, 3, False), (3, 0, False), (3, 2, False), (3, 3, False)]


def test_places_go_in_time_that_grows_with_lines(spark):
    rng = random.Random(5)
    rows = [([f"x{i}" for i in range(n)], sorted(rng.sample(range(n), k))) for n in (1, 2, 7, 30) for k in {0, 1, n // 2, n}]
    df = spark.createDataFrame(rows, "lines array<string>, places array<int>")
    for r in df.select("lines", "places", without_places(F.col("lines"), F.col("places")).alias("kept")).collect():
        assert r["kept"] == [x for i, x in enumerate(r["lines"]) if i not in r["places"]]
    # half of 400,000 lines: a search of all places for each line would be 4 * 10 ** 10 steps
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(399_999)), lambda i: i.cast("string")), "\n").alias("text"))
    removed = spark.range(0, 400_000, 2).select(F.lit(0).cast("long").alias("doc_id"), F.col("id").cast("int").alias("place"), F.lit(False).alias("near"))
    (left,) = without_lines(docs, removed).collect()
    assert left["text"] == "\n".join(str(i) for i in range(1, 400_000, 2))


def test_template_lines_against_brute_force(spark, monkeypatch):
    from strandline.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rng = random.Random(12)
    field = lambda k: rng.choice([f"{rng.randrange(16**10):010x}", f"{k:05d}", f"{k}", f"{k % 40}é{k % 3}"])
    docs = [(i, f"the parcel with the reference {field(i)} has left the depot and is on its way to you") for i in range(220)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    expected = brute(docs, 2, 24)
    assert 20 < len(expected) < 200
    for most in (8, 40):
        assert sorted(tuple(r) for r in repeated_lines(df, most_open=most).collect()) == expected, most


def test_patterns_are_exact(spark):
    from strandline.llm.line_dedup import patterns

    rng = random.Random(13)
    rests = ["".join(rng.choices("abc", k=rng.randrange(0, 4))) + "\n" + "".join(rng.choices("abc", k=rng.randrange(0, 4))) for _ in range(60)]
    rows = [(1, i, 0, True, 0, r) for i, r in enumerate(rests)] + [(1, i, 0, False, d, r) for i, r in enumerate(rests) for d in range(3)]
    made = patterns(spark.createDataFrame(rows, "key long, id long, first long, own boolean, k_d int, rest string"), 2)
    left, right = (made.where(F.col("own") == own).select("key", F.col("id").alias(name)).distinct() for own, name in ((True, "a"), (False, "b")))
    got = {(r["a"], r["b"]) for r in left.join(right, "key").select("a", "b").distinct().collect()}
    parted = lambda x, y: sum(edit(p, q) for p, q in zip(x.split("\n"), y.split("\n"), strict=True))
    # a probe is as long as its owner, or longer
    want = {(a, b) for a, x in enumerate(rests) for b, y in enumerate(rests) if 0 <= len(y) - len(x) <= 2 and parted(x, y) <= 2}
    assert got == want


def test_what_blocks_hold_grows_with_template_lines(spark, monkeypatch):
    from strandline.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    own, held = line_dedup.block_candidates, []

    def counted(members, sizes, threshold, most):
        each = F.ceil(F.col("n_open") / 16) * F.col("n_all") + F.ceil(F.col("n_all") / 16) * F.col("n_open")
        held.append(sizes.agg(F.sum(each)).first()[0] or 0)
        return own(members, sizes, threshold, most)

    monkeypatch.setattr(line_dedup, "block_candidates", counted)
    rng, sums = random.Random(14), []
    for n in (400, 800, 1600):
        held.clear()
        lines = [f"the parcel with the reference {rng.randrange(16**16):016x} has left the depot and is on its way to your door in the city" for _ in range(n)]
        assert repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), most_open=64).count() == 0
        sums.append(sum(held))
    assert sums[2] < 20 * 1600 and sums[2] < 3 * max(sums[1], 400) < 9 * max(sums[0], 400)
