"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

#: Fixed odd multipliers of a 64-bit mixer and of the places in a shingle.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
#: Words whose hashes a worker remembers, shingles handled at once, and ids that may be broadcast (8 MB).
REMEMBERED, AT_ONCE, BROADCAST_IDS = 200_000, 200_000, 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, width: int, known: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of width words; of all its words together if they are fewer.

    bytes.lower() folds A-Z only, and bytes.split() splits at the six characters of SPACES.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = _mixed(total * _GOLDEN + h[i : i + n])
    return np.unique(total)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (len(sets), m) of non-empty sets.

    An element's ranks are one random permutation of the m places: in step j it goes to the j-th place of its permutation
    with value j + r, r in [0, 1). Steps run over all elements of all sets at once; a set stops as soon as none of its places
    can still fall, that is when its largest value is below the next step's least.
    """
    sizes = np.array([len(s) for s in sets])
    owner, element = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    out = np.full(len(sets) * m, np.inf)
    places = None
    for j in range(m):
        x = _mixed(element + np.uint64((2 * j + 1) * int(_GOLDEN) % 2**64))
        r = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = (j + (_mixed(x) >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        if places is None:
            at, first = k, k
        else:
            rows = np.arange(len(element))
            at = places[rows, k].astype(np.int64)
            places[rows, k] = places[:, j]
        np.minimum.at(out, owner * m + at, r + j)
        going = out.reshape(-1, m).max(1) >= j + 1
        if not going.any():
            break
        stay = going[owner]
        if places is None:
            owner, element, first = owner[stay], element[stay], first[stay]
            places = np.tile(np.arange(m, dtype=np.uint16), (len(element), 1))
            places[np.arange(len(element)), first] = 0
        elif not stay.all():
            owner, element, places = owner[stay], element[stay], places[stay]
    return out.reshape(-1, m)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of non-empty sets, from slices of at most AT_ONCE elements: a set's is the least of its slices', place by place.

    So a text of any length takes the memory of two slices.
    """
    out, group, owners, n = np.full((len(sets), m), np.inf), [], [], 0

    def settle() -> None:
        np.minimum.at(out, owners, super_minhash(group, m))

    for i, s in enumerate(sets):
        for at in range(0, len(s), AT_ONCE):
            group.append(s[at : at + AT_ONCE])
            owners.append(i)
            n += len(group[-1])
            if n >= AT_ONCE:
                settle()
                group, owners, n = [], [], 0
    if group:
        settle()
    return out


def _ids_and_sets(batch: pa.RecordBatch, width: int, known: dict) -> Iterator[tuple[list, list]]:
    """Ids and sets of a batch, some at a time, so that no more than AT_ONCE shingles (or one text's) are in memory."""
    ids, sets, n = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(doc_id.as_py())
        sets.append(shingles(text.as_py() or "", width, known))
        n += len(sets[-1])
        if n >= AT_ONCE:
            yield ids, sets
            ids, sets, n = [], [], 0
    if ids:
        yield ids, sets


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the full set) and buckets (a hash for each band) of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(batches):
        known = _Hashes()
        for batch in batches:
            for ids, sets in _ids_and_sets(batch, width, known):
                full = [s for s in sets if len(s)]
                keys: Iterator = iter(())
                if full:
                    signature = signatures(full, bands * rows).view(np.uint64).reshape(len(full), bands, rows)
                    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(full), 1))
                    for i in range(rows):
                        key = _mixed(key * _GOLDEN + signature[:, :, i])
                    keys = iter(key.view(np.int64).tolist())
                buckets = [next(keys) if len(s) else [] for s in sets]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, map(len, sets), digest, buckets), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, buckets array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and set (sorted hashes of all shingles) of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches):
        known = _Hashes()
        for batch in batches:
            for ids, sets in _ids_and_sets(batch, width, known):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], schema[1].type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, set array<long>")


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ids (doc_id): by a broadcast while they are at most BROADCAST_IDS, by a shuffle beyond."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Only documents of a pair are read again."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    sets = written(full_sets(of_ids(docs, ids), width), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            a, b = batch.column("set_a"), batch.column("set_b")
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                same = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "links")


def across(placed: DataFrame, docs: DataFrame, width: int, percent: int, at_most: int = AT_ONCE) -> DataFrame:
    """Links (a, b) between components of the same star, enough of them to join all components that any link joins.

    placed: pivot, rep, n (its set's size), c (its component): those that met a pivot in a bucket. In a star with several
    components, all members outside the largest one are compared with all members: so is every pair across components. Members
    are dealt to blocks of about at_most shingles, and a task compares two blocks, giving a row only where a link joins two
    components of what it has seen. So rows grow with members and blocks, not with pairs, and memory is that of two blocks.
    """
    sizes = placed.groupBy("pivot", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    stars = sizes.groupBy("pivot").agg(F.max(F.struct("k", "n", "c")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cs")).where("cs > 1")
    blocks = lambda total: F.ceil(total / at_most)
    stars = stars.select("pivot", F.col("most.c").alias("main"), blocks(F.col("n") - F.col("most.n")).alias("lefts"), blocks(F.col("n")).alias("rights"))
    rows = placed.join(stars, "pivot")
    own = lambda count: F.pmod(F.xxhash64("rep"), count)
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    left = rows.where("c <> main").select("pivot", "rep", "c", own(F.col("lefts")).alias("i"), each(F.col("rights")).alias("j"), F.lit(True).alias("left"))
    right = rows.select("pivot", "rep", "c", each(F.col("lefts")).alias("i"), own(F.col("rights")).alias("j"), F.lit(False).alias("left"))
    cells = written(left.union(right), "cells")
    ids = written(cells.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    sets = full_sets(of_ids(docs, ids), width)
    cells = cells.join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        is_left = table.column("left").to_numpy(zero_copy_only=False)
        lefts, rights = table.filter(pa.array(is_left)), table.filter(pa.array(~is_left))
        found: list[tuple[int, int]] = []
        if len(lefts) and len(rights):
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            column = rights.column("set").combine_chunks()
            starts, flat = column.offsets.to_numpy()[:-1], column.flatten().to_numpy()
            starts = starts - column.offsets.to_numpy()[0]
            vocabulary, place = np.unique(flat, return_inverse=True)
            names, of, counts = rights.column("rep").to_pylist(), rights.column("c").to_pylist(), np.diff(np.append(starts, len(flat)))
            here = np.zeros(len(vocabulary), np.int32)
            for x, c, own in zip(lefts.column("rep").to_pylist(), lefts.column("c").to_pylist(), lefts.column("set"), strict=True):
                mine = own.values.to_numpy()
                at = np.searchsorted(vocabulary, mine)
                at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == mine)]
                here[at] = 1
                both = np.add.reduceat(here[place], starts)
                here[at] = 0
                for y in np.flatnonzero(100 * both >= percent * (counts + len(mine) - both)):
                    one, two = find(c), find(of[y])
                    if one != two:
                        up[one] = two
                        found.append((x, names[y]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return written(cells.groupBy("pivot", "i", "j").applyInArrow(compare, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 30, rows: int = 4) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    docs: columns doc_id (long) and text; others are dropped. Documents are linked when their shingle sets have a Jaccard
    similarity of percent / 100 or more; component_id is the smallest doc_id reachable, kept says whether that is the row's own.
    Null and empty texts, and those of white space, have no shingles and are linked with nothing.

    1. Documents with equal sets form a class (one aggregate by digest); its smallest doc_id stands for it from here on.
    2. Representatives meet in the buckets of bands bands of rows values of their SuperMinHash signature. A pair at 0.8 shares no
       bucket of 30 bands of 4 with probability 1e-7, one at 0.85 none of 24 bands of 5 with 8e-7.
    3. In each bucket all are compared with its smallest document, the pivot, on full sets, and the links grouped: a bucket of n
       costs n comparisons. Where those that met a pivot still lie in several components, every pair across them is
       compared as well, inside tasks and by blocks (see across), so no pair of a bucket is left out.

    A third of all rows may be copies of one text: they are one class. Rows that repeat a doc_id with one text are alike in
    every column; a doc_id with several texts is one node whose texts all count. A row without doc_id joins the documents of
    equal sets, and no others; where these have no doc_id either, its component_id is null and it is kept. An empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = written(sketches(docs, width, bands, rows), "sketches")
    classes = drawn.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    classes = written(classes, "classes")
    members = written(classes.where("rep is not null").select("rep", "n", F.explode("buckets").alias("bucket")), "buckets")
    least = members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("pivot"), F.count(F.lit(1)).alias("of")).where("of > 1")
    fits = "100 * least(n_a, n_b) >= {0} * greatest(n_a, n_b)".format(percent)
    stars = members.join(least, "bucket").where("rep > pivot.rep")
    stars = stars.select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b"), F.col("pivot.n").alias("n_a"), F.col("n").alias("n_b"))
    links = confirmed(stars.where(fits).select("a", "b").distinct(), docs, width, percent)
    group = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "groups")

    met = members.join(least, "bucket").select(F.col("pivot.rep").alias("pivot"), "rep", "n").distinct()
    placed = met.join(group, met["rep"] == group["node"], "left").select("pivot", "rep", "n", F.coalesce("component", "rep").alias("c"))
    more = across(placed, docs, width, percent)
    group = written(components(links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v"))), "groups")

    known = drawn.where("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest")
    known = known.join(group, known["rep"] == group["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    lone = drawn.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.union(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
