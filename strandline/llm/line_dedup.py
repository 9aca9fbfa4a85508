"""Line dedup by a segment-partition edit join. DataFrame functions only.

Two lines within threshold edits share one of threshold + 1 segments: the shorter one is cut into segments, and the longer one
is probed at the few places where a segment of a line of that length can stand. What meets is verified by a banded
bit-parallel edit distance.
"""

from __future__ import annotations

from itertools import accumulate, combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, written

#: Ids that may be broadcast (16 bytes each in memory), lines of a block, and candidates that a row gives a line at first.
BROADCAST_IDS, BLOCK, CANDIDATES = 1_000_000, 256, 16


def keys(lines: DataFrame, threshold: int) -> DataFrame:
    """lines (column line and others) with own and key: the hashes of (length, number, text) of segments.

    own: of the line's threshold + 1 segments, the last n % (threshold + 1) of which have one character more. Others: of the
    substrings at which a line of n - d characters, d from 0 to threshold, can share a segment with this one. A segment i of the
    shorter line can be shifted by less than i, and by less than what the segments after it leave: both bounds hold for one of
    the shared segments, so their overlap is enough. Places outside the line give no row.
    """
    parts = threshold + 1
    places = [(0, i, 0, True) for i in range(1, parts + 1)]
    for d in range(threshold + 1):
        for i in range(1, parts + 1):
            places += [(d, i, shift, False) for shift in range(max(-(i - 1), d - (parts - i)), min(i - 1, d + (parts - i)) + 1)]
    # one small expression a row, rather than one large one a line: the compiler leaves large ones alone
    made = ", ".join(f"struct({d} as k_d, {i} as k_i, {shift} as k_shift, {str(own).lower()} as own)" for d, i, shift, own in places)
    rows = lines.withColumn("k_n", F.length("line")).selectExpr("*", f"inline(array({made}))")
    rows = rows.withColumn("k_base", F.expr(f"cast((k_n - k_d) div {parts} as int)")).withColumn("k_cut", F.expr(f"{parts} - pmod(k_n - k_d, {parts})"))
    rows = rows.withColumn("k_at", F.expr("1 + k_shift + k_base * (k_i - 1) + greatest(0, k_i - 1 - k_cut)")).withColumn("k_size", F.expr("k_base + if(k_i > k_cut, 1, 0)"))
    rows = rows.where("k_size >= 1 and k_at >= 1 and k_at + k_size - 1 <= k_n")
    rows = rows.withColumn("key", F.expr("xxhash64(k_n - k_d, k_i, substring(line, k_at, k_size))"))
    return rows.select(*lines.columns, "own", "key")


def finer_keys(lines: DataFrame, threshold: int, parts: int, more: tuple[str, ...] = ()) -> DataFrame:
    """lines (column line and others) with own and key, as keys gives them, but of all segments but threshold of parts ones.

    A line within threshold edits differs from another inside at most threshold segments. Each choice of the segments left out
    gives keys: their edits move what stands after them by -1, 0 or 1 each, and by the difference of the lengths in all. So
    lines that share a key differ inside the segments left out only. What remains is threshold + 1 runs of segments, hashed
    as they are. more: "rest", what is left out, its parts joined by line feeds, and "k_d", by how much the line is the longer one.
    """
    runs, places = range(threshold + 1), set()
    for out in combinations(range(1, parts + 1), threshold):
        bounds = (0, *out, parts + 1)
        empty = [bounds[k] + 1 == bounds[k + 1] for k in runs]
        places.add((0, out, (0,) * (threshold + 1), True))
        for moves in product((-1, 0, 1), repeat=threshold):
            shifts = (0, *accumulate(moves))
            if shifts[-1] >= 0:
                places.add((shifts[-1], out, tuple(0 if e else x for e, x in zip(empty, shifts, strict=True)), False))
    made = ", ".join(
        f"struct({d} as k_d, {str(own).lower()} as own, " + ", ".join([*(f"{e} as k_e{k}" for k, e in enumerate(out)), *(f"{x} as k_s{k}" for k, x in enumerate(shifts))]) + ")" for d, out, shifts, own in sorted(places)
    )
    rows = lines.withColumn("k_n", F.length("line")).selectExpr("*", f"inline(array({made}))").where("k_n >= k_d").withColumn("k_m", F.expr("k_n - k_d"))
    before = lambda e: f"(k_m div {parts} * ({e}) + greatest(0, {e} - {parts} + pmod(k_m, {parts})))"  # noqa: E731  characters of the first e segments
    ends = ["0", *(f"k_e{k}" for k in range(threshold))]
    starts = [f"cast({before(e)} + k_s{k} as int)" for k, e in enumerate(ends)]
    stops = [f"cast({before(f'(k_e{k} - 1)') if k < threshold else 'k_m'} + k_s{k} as int)" for k in runs]
    rows = rows.where(" and ".join(f"{a} >= 0 and {b} <= k_n" for a, b in zip(starts, stops, strict=True)))
    texts = ", ".join(f"substring(line, {a} + 1, {b} - {a})" for a, b in zip(starts, stops, strict=True))
    names = ", ".join(f"k_e{k}" for k in range(threshold))
    rows = rows.withColumn("key", F.expr(f"xxhash64(k_m, {names}, {texts})"))
    if "rest" in more:
        rows = rows.where(" and ".join(f"{starts[k + 1]} >= {stops[k]}" for k in range(threshold)))
        rows = rows.withColumn("rest", F.expr("concat_ws('\n', " + ", ".join(f"substring(line, {stops[k]} + 1, {starts[k + 1]} - {stops[k]})" for k in range(threshold)) + ")"))
    return rows.select(*lines.columns, "own", "key", *more)


def rest_keys(rows: DataFrame, threshold: int) -> DataFrame:
    """key, id, first, own of rows (key, id, first, own, k_d, rest): keys of the rests' own segments, within each key.

    Of a key's lines only what it leaves out differs, so lines within threshold edits have rests within as many, which share a segment.
    """
    drawn = keys(rows.select("id", "first", F.col("own").alias("is_own"), F.col("key").alias("of"), F.col("rest").alias("line")), threshold)
    return drawn.where(F.col("own") == F.col("is_own")).select(F.xxhash64("of", "key").alias("key"), "id", "first", "own").distinct()


def patterns(rows: DataFrame, threshold: int) -> DataFrame:
    """key, id, first, own of rows (key, id, first, own, k_d, rest): a row for each way to take up to threshold characters of the rest
    out or to leave their place open.

    Two rests within threshold edits differ by w characters replaced, x that only the owner has and y that only the probe has, w + x + y
    at most threshold: with those places open, or taken out, they are the same; and rests that agree so are as near. So those that
    share a key here, an owner and a probe, are near, however many they are. Line feeds, which part the rests, stay.
    """
    now = rows.select("key", "id", "first", "own", "k_d", F.col("rest").alias("t"), F.lit(1).alias("at"), F.lit(0).alias("w"), F.lit(0).alias("x"), F.lit("").alias("open"))
    every = now
    for _ in range(threshold):
        each = now.where("at <= length(t)").withColumn("p", F.explode(F.expr("sequence(at, length(t))"))).where("substring(t, p, 1) <> '\n'")
        kept = each.select("key", "id", "first", "own", "k_d", F.expr("concat(substring(t, 1, p - 1), ' ', substring(t, p + 1))").alias("t"), F.expr("p + 1").alias("at"), F.expr("w + 1").alias("w"), "x", F.expr("concat(open, ',', p)").alias("open"))
        out = each.select("key", "id", "first", "own", "k_d", F.expr("concat(substring(t, 1, p - 1), substring(t, p + 1))").alias("t"), F.expr("p").alias("at"), "w", F.expr("x + 1").alias("x"), "open")
        now = kept.union(out)
        every = every.union(now)
    # an owner meets probes that have y more or less characters of their own; a probe knows how many, from the lengths
    sides = F.expr(f"if(own, sequence(x, greatest(x, {threshold} - w - x)), array(x))")
    made = every.withColumn("y", F.explode(sides)).withColumn("o", F.expr("if(own, x, y - k_d)")).where(f"o >= 0 and w + o + y <= {threshold}")
    return made.select(F.xxhash64("key", "w", "o", "y", "t", "open").alias("key"), "id", "first", "own")


def earliest_partners(rows: DataFrame) -> DataFrame:
    """a, b: for each line of rows (key, id, first, own), all pairs of whose owners and probes are near, the first line that it meets, if it is earlier."""
    order = F.struct("first", "id")
    ends = rows.groupBy("key").agg(F.min(F.when(F.col("own"), order)).alias("owner"), F.min(F.when(~F.col("own"), order)).alias("probe")).where("owner is not null and probe is not null")
    met = rows.join(ends, "key").withColumn("other", F.when(F.col("own"), F.col("probe")).otherwise(F.col("owner"))).where(F.col("other") < order)
    return met.groupBy("id").agg(F.min("other").alias("other")).select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b"))


def sketch(line: Column) -> Column:
    """64 bits, each the parity of the pairs of neighbouring characters that hash to it.

    An edit takes away two pairs at most and makes two at most, so lines within k edits differ in at most 4 * k bits.
    """
    bit = lambda a, b: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(a, b), F.lit(64)).cast("int"))
    bits = F.transform(F.array(characters(line)), lambda c: F.aggregate(F.zip_with(c, F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1))), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)))
    return F.element_at(bits, 1)


def may_be_near(n: Column, sketch_: Column, other_n: Column, other_sketch: Column, threshold: int) -> Column:
    """Whether lines of these lengths and sketches may be within threshold edits; most others are told from them by their sketches."""
    return (F.bit_count(sketch_.bitwiseXOR(other_sketch)) <= 4 * threshold) & (F.abs(n - other_n) <= threshold)


def without_ends(pairs: DataFrame, steps: int = 6) -> DataFrame:
    """pairs (columns s and l, s not longer) without most of what s and l begin and end with alike; their distance is the same.

    Halves, quarters and so on of s are compared, down to its length / 2 ** steps.
    """
    pairs = pairs.withColumn("p", F.lit(0))
    for k in range(1, steps + 1):
        h = f"cast(length(s) div {2**k} as int)"
        pairs = pairs.withColumn("p", F.expr(f"p + if(substring(s, p + 1, {h}) = substring(l, p + 1, {h}), {h}, 0)"))
    pairs = pairs.withColumn("s", F.expr("substring(s, p + 1)")).withColumn("l", F.expr("substring(l, p + 1)")).withColumn("p", F.lit(0))
    for k in range(1, steps + 1):
        h = f"cast(length(s) div {2**k} as int)"
        at = lambda x: f"substring({x}, length({x}) - p - {h} + 1, {h})"  # noqa: B023, E731
        pairs = pairs.withColumn("p", F.expr(f"p + if({at('s')} = {at('l')}, {h}, 0)"))
    return pairs.withColumn("s", F.expr("substring(s, 1, length(s) - p)")).withColumn("l", F.expr("substring(l, 1, length(l) - p)")).drop("p")


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two arrays of characters, or threshold + 1 if it is larger; a has at most threshold fewer than b, not more.

    Bit-parallel over a band of 2 * threshold + 1 diagonals: bit r of a word stands for row j - threshold + r of column j, and
    after each column the words move down by one. The score follows the last diagonal of the band while it is inside the
    matrix, then the last row.
    """
    k, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    m, n = F.size(a), F.size(b)
    one = lambda x: F.lit(x).cast("long")
    not_ = lambda x: x.bitwiseXOR(one(full))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def matches(j):  # of column j, from 1
        c, eq = F.get(b, j - 1), one(0)
        for r in range(width):
            eq = eq.bitwiseOR(F.when(F.get(a, j - 1 - k + r) == c, one(1 << r)).otherwise(one(0)))
        return eq

    def column(s, j):
        vp, vn = s["vp"], s["vn"]
        zero = lambda eq: (eq.bitwiseAND(vp) + vp).bitwiseAND(one(full)).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn)

        def finish(d0):
            hp, hn, down = vn.bitwiseOR(not_(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftright(d0, 1)
            row = (m - j + k).cast("int")  # the bit of the last row of the matrix
            at = lambda x: F.call_function("shiftright", x, row).bitwiseAND(one(1))
            score = s["score"] + F.when(j + k <= m, 1 - F.shiftright(d0, width - 1).bitwiseAND(one(1))).otherwise(at(hp) - at(hn))
            return F.struct(hn.bitwiseOR(not_(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"))

        return let(let(matches(j), zero), finish)

    # before the first column every row inside the matrix is one more than the row above
    rising = sum(1 << r for r in range(k, width))
    start = F.struct(one(rising).alias("vp"), one(0).alias("vn"), F.least(m, F.lit(k)).cast("long").alias("score"))
    found = F.aggregate(F.sequence(F.lit(1), n), start, column, lambda s: s["score"])
    return F.when(n == 0, m.cast("long")).otherwise(F.least(found, one(k + 1)))


def characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def occurrences(docs: DataFrame, min_chars: int, near_chars: int) -> DataFrame:
    """doc_id, place and line (without spaces at its ends) of each line of docs that has min_chars characters or more, and a word or near_chars."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("place", "line"))
    return lines.withColumn("line", F.trim("line")).where((F.length("line") >= min_chars) & ((F.length("line") >= near_chars) | (F.trim("line", F.lit(SPACES)) != "")))


def shared_keys(drawn: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of drawn (key, id, first, own) whose key another line has too. Most keys are of one line and go at once."""
    drawn = drawn.repartition("key")
    # every column is asked for, so that this reads the same shuffle as the join below
    shared = drawn.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("first").alias("f"), F.max("own").alias("o"))
    shared = shared.where("low <> high and f is not null and o is not null").select("key")
    return scratch.written(drawn.join(shared, "key"), "keys")


def texts_of(ids: DataFrame, here: DataFrame, scratch: Scratch) -> DataFrame:
    """id, line, first, n, sketch of the lines of here (doc_id, line) that ids (id) name; a hash that two lines share keeps both."""
    ids = scratch.written(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    found = here.withColumn("id", F.xxhash64("line")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    lines = found.groupBy("id", "line").agg(F.min("doc_id").alias("first"))
    return scratch.written(lines.select("id", "line", "first", F.length("line").alias("n"), sketch(F.col("line")).alias("sketch")), "lines")


def star_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """id, a, b: of members (key, id, first, own, n, sketch), for each key's owners the first line that probes it, for its probes the
    first owner, where that is earlier and may be near; id is the later of a and b."""
    order = F.struct("first", "id", "n", "sketch")
    pivots = members.groupBy("key").agg(F.min(F.when(F.col("own"), order)).alias("owner"), F.min(F.when(~F.col("own"), order)).alias("probe"))
    met = members.join(pivots, "key").withColumn("pivot", F.when(F.col("own"), F.col("probe")).otherwise(F.col("owner")))
    met = met.where(F.struct("pivot.first", "pivot.id") < F.struct("first", "id")).where("pivot.id <> id")
    met = met.where(may_be_near(F.col("n"), F.col("sketch"), F.col("pivot.n"), F.col("pivot.sketch"), threshold))
    return met.select("id", F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct()


def key_sizes(members: DataFrame) -> DataFrame:
    """key, n_open (lines that are open), n_all: of the keys where an open line comes after another line."""
    order = F.struct("first", "id")
    sizes = members.groupBy("key").agg(F.sum(F.col("open").cast("long")).alias("n_open"), F.count(F.lit(1)).alias("n_all"), F.min(order).alias("least"), F.max(F.when(F.col("open"), order)).alias("last"))
    return sizes.where("last > least").select("key", "n_open", "n_all")


def block_candidates(members: DataFrame, sizes: DataFrame, threshold: int, most: int | None) -> DataFrame:
    """id, near_to (array of bits, id), more: for the open lines of sizes' keys the earlier lines of a key that may be near, by sketch.

    A key's lines are dealt to blocks of some BLOCK, and a row holds two blocks, so rows grow with lines and blocks, not with
    pairs. Of the candidates that one row finds for a line, those with the most alike sketches are given, at most most of
    them; more says that there are others.
    """
    here = members.join(sizes, "key")
    line = F.struct("id", "first", "own", "n", "sketch")

    def blocks(rows: DataFrame, n: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(name), "id"), F.ceil(F.col(n) / BLOCK))
        return rows.groupBy("key", block.alias(name)).agg(F.collect_list(line).alias(name + "s"))

    cells = blocks(here.where("open"), "n_open", "left").join(blocks(here, "n_all", "right"), "key")

    def candidates(x: Column) -> Column:
        earlier = lambda y: (F.struct(y["first"], y["id"]) < F.struct(x["first"], x["id"])) & (y["own"] != x["own"]) & (y["id"] != x["id"])
        found = F.filter("rights", lambda y: may_be_near(x["n"], x["sketch"], y["n"], y["sketch"], threshold) & earlier(y))
        sorted_ = F.array_sort(F.array_distinct(F.transform(found, lambda y: F.struct(F.bit_count(x["sketch"].bitwiseXOR(y["sketch"])).alias("bits"), y["id"].alias("id")))))
        if most is None:
            return F.struct(x["id"].alias("id"), sorted_.alias("near_to"), F.lit(False).alias("more"))
        return F.element_at(F.transform(F.array(sorted_), lambda all_: F.struct(x["id"].alias("id"), F.slice(all_, 1, most).alias("near_to"), (F.size(all_) > most).alias("more"))), 1)

    return cells.select(F.inline(F.filter(F.transform("lefts", candidates), lambda c: F.size(c["near_to"]) > 0)))


def near_lines(pairs: DataFrame, texts: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """id, id2 (two hashes) of the later line of each of pairs (a, b) that are within threshold edits."""
    one, two = (texts.select(F.col("id").alias(s), F.col("line").alias(f"line_{s}"), F.col("first").alias(f"first_{s}")) for s in "ab")
    both = pairs.join(one, "a").join(two, "b")
    swap = F.length("line_a") > F.length("line_b")
    later = F.struct("first_a", "a") > F.struct("first_b", "b")
    id2 = lambda line: F.xxhash64(F.lit("second"), line)
    both = both.select(
        F.when(swap, F.col("line_b")).otherwise(F.col("line_a")).alias("s"),
        F.when(swap, F.col("line_a")).otherwise(F.col("line_b")).alias("l"),
        F.when(later, F.col("a")).otherwise(F.col("b")).alias("id"),
        F.when(later, id2("line_a")).otherwise(id2("line_b")).alias("id2"),
    ).where(F.length("l") - F.length("s") <= threshold)
    # written twice, else conditions would move below the arrays, and each step would split its line anew
    both = scratch.written(without_ends(both), "close").withColumn("short", characters(F.col("s"))).withColumn("long", characters(F.col("l")))
    both = scratch.written(both.select("id", "id2", banded_distance(F.col("short"), F.col("long"), threshold).alias("edits")), "edits")
    return both.where(F.col("edits") <= threshold).select("id", "id2").distinct()


def near_by_keys(rows: DataFrame, texts: DataFrame, near: DataFrame | None, threshold: int, most_open: int | None, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(near, hot): id, id2 of the lines known to be near an earlier line, those of near and those found by the keys of rows
    (key, id, first, own); and the ids of all lines of keys with more than most_open lines that stay, for which finer keys have to be drawn.

    Lines are compared with their key's first line, then lines that are still open with every earlier line of their keys.
    """
    members = scratch.written(rows.join(texts.select("id", "n", "sketch"), "id"), "members")
    if near is None:
        near = scratch.written(members.select("id", F.col("id").alias("id2")).limit(0), "near")
    stars = star_pairs(members, threshold).join(near.select("id").distinct(), "id", "left_anti").select("a", "b")
    near = scratch.written(near.union(near_lines(stars, texts, threshold, scratch)).distinct(), "near")
    gone = near.select("id", F.lit(False).alias("is_open"))
    state = members.join(gone, "id", "left").withColumn("open", F.coalesce("is_open", F.lit(True))).drop("is_open")
    sizes = scratch.written(key_sizes(state), "sizes")
    hot = None
    if most_open is not None:
        large = sizes.where(F.col("n_open") > most_open).select("key")
        hot = scratch.written(members.join(large, "key", "left_semi").select("id").distinct(), "hot")
        sizes = sizes.where(F.col("n_open") <= most_open)
    found = scratch.written(block_candidates(state, sizes, threshold, CANDIDATES), "candidates")
    for take in (F.slice("near_to", 1, 1), F.slice("near_to", 2, CANDIDATES)):
        pairs = found.join(near.select("id").distinct(), "id", "left_anti").select("id", F.explode(take).alias("other")).select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b"))
        near = scratch.written(near.union(near_lines(pairs.distinct(), texts, threshold, scratch)).distinct(), "near")
    rest = found.where("more").select("id").distinct().join(near.select("id").distinct(), "id", "left_anti")
    rest = scratch.written(rest, "rest")
    if not rest.isEmpty():  # lines with many candidates, none of the most alike ones near: all of them
        state = members.join(rest.withColumn("is_open", F.lit(True)), "id", "left").withColumn("open", F.coalesce("is_open", F.lit(False))).drop("is_open")
        pairs = block_candidates(state, key_sizes(state), threshold, None).select("id", F.explode("near_to").alias("other")).select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b"))
        near = scratch.written(near.union(near_lines(pairs.distinct(), texts, threshold, scratch)).distinct(), "near")
    return near, hot


def near_by_rests(rows: DataFrame, texts: DataFrame, near: DataFrame, threshold: int, parts: int, most_open: int, scratch: Scratch) -> DataFrame:
    """near with what the lines of texts (those of the keys of rows, drawn by parts, that are still large) find by what their keys leave out.

    The rests are short. Their segments tell most apart; where very many lines share even those, the lines meet by patterns, each of
    which holds near lines only, so a line looks at the first of each and no group is compared within itself.
    """
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_open).select("key")
    drawn = finer_keys(texts.select("line", "id", "first"), threshold, parts, ("k_d", "rest"))
    rests = scratch.written(drawn.join(large, "key", "left_semi").select("key", "id", "first", "own", "k_d", "rest"), "rests")
    near, hot = near_by_keys(shared_keys(rest_keys(rests, threshold), scratch), texts, near, threshold, most_open, scratch)
    # rests of few characters may share no segment
    hot = scratch.written(hot.union(rests.where(F.length("rest") <= 2 * threshold + 2).select("id")).distinct(), "hot")
    if hot.isEmpty():
        return near
    met = scratch.written(patterns(rests.join(hot, "id", "left_semi"), threshold), "patterns")
    open_ = scratch.written(earliest_partners(met), "met")
    return scratch.written(near.union(near_lines(open_, texts, threshold, scratch)).distinct(), "near")


def repeated_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 1, near_chars: int = 24, finer: tuple[int, ...] = (6, 12), most_open: int = 1000) -> DataFrame:
    """Lines to remove: doc_id, place (from 0), near (boolean), one row each.

    docs: doc_id (long, not null: other rows have no removals) and text; others are dropped. Lines split at line feeds and
    compared without spaces at their ends; those under min_chars characters, and those without words
    under near_chars, always stay; lines under near_chars (threshold + 1 at least) go for equal lines only. A line goes if the same line stands
    in a document with a smaller doc_id or earlier in its own (near false), or if all its copies are within threshold edits of
    a different line that first stands in a document with a smaller doc_id, or in the same one and is smaller by its hash
    (near true). So of lines alike the first stays, whatever its copies. Repeated rows count as one document.

    Equal lines meet by one aggregate, so a line that stands in a third of all rows is one row per task; different lines meet
    by their segments' hashes. Of the lines of a key each is compared with the first one, so a group of lines alike costs a
    comparison a line; only lines that stay are then compared with the earlier lines of their keys, by sketches, in blocks.
    Where more than most_open lines of a key stay, they share a passage without being alike: their lines are cut into more
    segments (finer), and meet only where all segments but threshold agree. Where keys are still large at the finest, as those of
    lines from one template, their lines meet by what the keys leave out (near_by_rests), so that blocks never hold more than
    most_open lines against as many, and the work grows with lines and the lengths left out. No comparison is left out.
    """
    if near_chars <= threshold:
        raise ValueError("near_chars must be above threshold")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    here = occurrences(docs, min_chars, near_chars)
    long_ = here.where(F.length("line") >= near_chars)
    id_ = F.xxhash64("line")
    with Scratch(docs.sparkSession, "lines") as scratch:
        lines = long_.groupBy("line").agg(F.min("doc_id").alias("first")).select("line", F.xxhash64("line").alias("id"), "first")
        rows = shared_keys(keys(lines, threshold).select("key", "id", "first", "own"), scratch)
        texts = texts_of(rows.select("id").distinct(), long_, scratch)
        near, hot = near_by_keys(rows, texts, None, threshold, most_open if finer else None, scratch)
        for parts in finer:
            if hot.isEmpty():
                break
            again = texts.join(hot, "id", "left_semi")
            rows = shared_keys(finer_keys(again.select("line", "id", "first"), threshold, parts).select("key", "id", "first", "own"), scratch)
            near, hot = near_by_keys(rows, again, near, threshold, most_open, scratch)
        if hot is not None and not hot.isEmpty():
            near = near_by_rests(rows, texts.join(hot, "id", "left_semi"), near, threshold, finer[-1], most_open, scratch)
        near = near.withColumn("near", F.lit(True))
        second = F.xxhash64(F.lit("second"), "line")

        # what is marked: near lines, and lines that stand more than once
        spots = here.select("doc_id", "place", id_.alias("id"), second.alias("id2"))
        twice = spots.groupBy("id", "id2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        marked = near.select("id", "id2", F.lit(None).cast("long").alias("first"), "near").union(twice.select("id", "id2", "first", F.lit(False)))
        marked = written(marked.groupBy("id", "id2").agg(F.max("first").alias("first"), F.max("near").alias("near")), "marked")
    hit = spots.join(marked, ["id", "id2"])
    # in the first document the first place stays; its other places of that line go
    kept_at = hit.where("not near and doc_id = first").groupBy("id", "id2", "doc_id").agg(F.min("place").alias("kept"))
    hit = hit.join(kept_at, ["id", "id2", "doc_id"], "left")
    return hit.where("near or kept is null or place > kept").select("doc_id", "place", "near").distinct()


def removal_lists(removed: DataFrame) -> DataFrame:
    """doc_id, places (sorted), n_near: a row for each document that loses a line; as long as the document has lines."""
    return removed.groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias("places"), F.sum(F.col("near").cast("long")).alias("n_near"))


def without_places(lines: Column, places: Column) -> Column:
    """lines without those at the sorted places (from 0): the runs between places, so the work grows with both and not with their product."""
    # one element, so that a text is split once and not at each place
    parts = F.array(F.struct(lines.alias("lines"), F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines))).alias("ends")))

    def runs(x: Column) -> Column:
        following = lambda end, i: F.coalesce(F.get(x["ends"], i + 1), end + 1)
        return F.flatten(F.transform(x["ends"], lambda end, i: F.slice(x["lines"], end + 2, following(end, i) - end - 1)))

    return F.element_at(F.transform(parts, runs), 1)


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs without the removed lines, in its own columns; a document that loses all its words this way goes.

    A document whose text had no words stays as it is. Rows that repeat a doc_id all lose the places that any of them loses.
    """
    lists = removal_lists(removed).select(F.col("doc_id").alias("__l_id"), F.col("places").alias("__l_places"))
    joined = docs.join(lists, docs["doc_id"] == F.col("__l_id"), "left")
    kept = without_places(F.split(docs["text"], "\n"), F.col("__l_places"))
    text = F.when(F.col("__l_places").isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    wordless = lambda x: F.trim(F.coalesce(x, F.lit("")), F.lit(SPACES)) == ""
    joined = joined.withColumn("__l_text", text).where(F.col("__l_places").isNull() | ~wordless(F.col("__l_text")) | wordless(docs["text"]))
    return joined.select(*(F.col("__l_text").alias(c) if c == "text" else docs[c] for c in docs.columns))
