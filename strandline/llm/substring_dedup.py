"""Substring deduplication: words of windows that start more than once anywhere go, by a count-min prefilter and an exact second pass.

A window is represented in the sketch by its anchor, the least of the hashes of its runs of `gram` words (the first of equal ones).
Equal windows have equal anchors at different places, so the places of an anchor are at least as many as those of any of its windows:
the sketch of anchors overestimates window counts, as one of windows would, with a tenth of the entries. A window is estimated repeated
if every row of the merged sketch counts its anchor twice or more. No repeated window is lost; what the sketch lets through
wrongly, the second pass, which groups windows by 128 bits of their words' hashes, finds single.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that a task hashes at once; a longer document is taken alone.
CHUNK_WORDS = 400_000
#: Candidate windows that a task groups at once.
CHUNK_WINDOWS = 1_500_000
#: Cells of a block, the unit in which partition sketches are shuffled and merged.
BLOCK = 1 << 16
#: Fixed odd bases of the two window hashes, and multipliers of the sketch's rows.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROWS = (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    up, down = np.full(n, base, "u8"), np.full(n, pow(base, -1, 1 << 64), "u8")
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


class Chunk:
    """Several documents' words in a row, as hashes: rows are (document key, words)."""

    def __init__(self, docs: list[tuple], size: int, gram: int):
        self.docs, self.size, self.gram = docs, size, gram
        lengths = np.array([len(w) for _, w in docs], "i8")
        self.begins = np.concatenate([[0], np.cumsum(lengths)])
        self.n = int(self.begins[-1])
        digest = xxhash.xxh3_128_digest
        self.hashes = np.frombuffer(b"".join([digest(w) for _, ws in docs for w in ws]), "<u8").reshape(-1, 2)
        self.of = np.repeat(np.arange(len(docs)), lengths)  # document of each word
        inside = np.zeros(self.n, bool)
        for a, b in zip(self.begins[:-1], self.begins[1:], strict=True):
            inside[a : max(a, b - size + 1)] = True
        self.starts = np.flatnonzero(inside)  # of windows

    def runs(self, side: int, length: int) -> np.ndarray:
        """Hashes of all runs of length words, by the first (0) or second (1) half of the words' hashes."""
        up, down = _powers(BASES[side], self.n + 1)
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(self.hashes[:, side] * down[: self.n])])
        return (sums[length:] - sums[:-length]) * up[: self.n - length + 1]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of each window's anchor, and the hash there."""
        if not len(self.starts):
            return np.zeros(0, "i8"), np.zeros(0, "u8")
        grams = self.runs(0, self.gram)
        at = np.lib.stride_tricks.sliding_window_view(grams, self.size - self.gram + 1)[self.starts].argmin(axis=1) + self.starts
        return at, grams[at]


def _chunks(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[Chunk]:
    """Chunks of the documents with a window; batches are (doc_id, tag, text)."""
    held, n = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_buffer()
            words = text.to_pybytes().split() if text is not None else []  # bytes split at the ASCII spaces only
            if len(words) < size:
                continue
            held.append(((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), words))
            n += len(words)
            if n >= CHUNK_WORDS:
                yield Chunk(held, size, gram)
                held, n = [], 0
    if held:
        yield Chunk(held, size, gram)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(29))) * np.uint64(ROWS[row])) >> np.uint64(64 - bits)).astype("i8")


def _sketch(size: int, gram: int, bits: int):
    """Batches of documents to (block, cells): the partition's sketch, counts saturating at 2, two bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ROWS), 1 << bits), "u1")
        for chunk in _chunks(batches, size, gram):
            at, hashes = chunk.anchors()
            hashes = hashes[np.flatnonzero(np.diff(at, prepend=-1))]  # a place once; places don't decrease
            for row in range(len(ROWS)):
                cells, n = np.unique(_cells(hashes, row, bits), return_counts=True)
                counts[row, cells] = np.minimum(counts[row, cells] + np.minimum(n, 2), 2)
        blocks = counts.reshape(-1, min(BLOCK, 1 << bits))
        used = np.flatnonzero(blocks.any(axis=1))
        for k in range(0, len(used), 64):
            some = used[k : k + 64]
            b = blocks[some]
            packed = b[:, 0::4] | b[:, 1::4] << 2 | b[:, 2::4] << 4 | b[:, 3::4] << 6
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], ["block", "cells"])

    return run


def _unpack(cells: bytes) -> np.ndarray:
    c = np.frombuffer(cells, "u1")
    return np.stack([c & 3, c >> 2 & 3, c >> 4 & 3, c >> 6], axis=1).ravel()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, cells) in the order of blocks to (block, bits): a bit for each cell that the sketches together count twice or more."""
    now, sums = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= 2).tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        for block, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                if now is not None and (sums >= 2).any():
                    yield done()
                now, sums = block, np.zeros(len(cells) * 4, "u1")
            sums = np.minimum(sums + _unpack(cells), 2)
    if now is not None and (sums >= 2).any():
        yield done()


def sketched(rows: DataFrame, size: int, gram: int, most_bits: int) -> tuple[int, np.ndarray]:
    """log2 of the sketch's width, and its bits (row, cell) packed: which cells count twice or more over all rows.

    The width follows the texts' bytes, two cells an anchor, up to 2**most_bits; so the sketch, of which a task holds three bytes a
    cell and the driver three bits, has a fixed bound. Beyond it more windows pass the filter and results stay the same.
    """
    spark = rows.sparkSession
    n = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = n / 6 * 2 / (size - gram + 2)
    bits = int(min(most_bits, max(12, np.ceil(np.log2(2 * anchors + 1)))))
    # a task sketches many splits, so that the sketches together stay smaller than the texts
    tasks = max(spark.sparkContext.defaultParallelism, int(anchors / (1 << bits)))
    parts = rows.coalesce(tasks).mapInArrow(_sketch(size, gram, bits), "block int, cells binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    width = min(BLOCK, 1 << bits) // 8
    out = np.zeros(len(ROWS) << bits >> 3, "u1")
    for r in merged.toLocalIterator():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["bits"], "u1")
    return bits, out


def _candidates(size: int, gram: int, bits: int, shared):
    """Batches of documents to rows of windows estimated repeated: k0, k1, doc_id, tag, place.

    Windows that a chunk holds twice are known to repeat: they leave one row of the key alone, which tells other chunks, and
    their places as ranges (from, to, ...) in a row with a key of its own. So a key has a row a chunk at most.
    """

    def estimated(hashes: np.ndarray) -> np.ndarray:
        seen = np.ones(len(hashes), bool)
        for row in range(len(ROWS)):
            cell = _cells(hashes, row, bits) + (row << bits)
            seen &= (shared.value[cell >> 3] >> (7 - (cell & 7)).astype("u1") & 1).astype(bool)
        return seen

    def grouped(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, k0, k1, of, place = [], *([] for _ in range(4))
        for d, a, b, o, p in held:
            k0.append(a), k1.append(b), of.append(o + len(docs)), place.append(p)
            docs += d
        k0, k1, of, place = (np.concatenate(x) for x in (k0, k1, of, place))
        order = np.lexsort((k1, k0))
        k0, k1, of, place = k0[order], k1[order], of[order], place[order]
        first = np.ones(len(k0), bool)
        first[1:] = (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])
        last = np.append(first[1:], True)
        single, head = first & last, first & ~last
        ids, tags = (pa.array([d[i] for d in docs], pa.int64()) for i in (0, 1))

        def batch(a, b, doc, tag, at, ranges) -> pa.RecordBatch:
            n = len(a)
            none = lambda kind: pa.nulls(n, kind)
            columns = [pa.array(a.view("i8")), pa.array(b.view("i8")), doc if doc is not None else none(pa.int64()), tag if tag is not None else none(pa.int64())]
            columns += [at if at is not None else none(pa.int32()), ranges if ranges is not None else none(pa.list_(pa.int32()))]
            return pa.record_batch(columns, ["k0", "k1", "doc_id", "tag", "place", "ranges"])

        heads, singles = np.flatnonzero(head), np.flatnonzero(single)
        singles = singles[np.lexsort((place[singles], of[singles]))]  # rows of a document together are smaller in the shuffle
        for k in range(0, len(heads), 200_000):
            h = heads[k : k + 200_000]
            yield batch(k0[h], k1[h], None, None, None, None)
        for k in range(0, len(singles), 200_000):
            s = singles[k : k + 200_000]
            at = pa.array(of[s])
            yield batch(k0[s], k1[s], ids.take(at), tags.take(at), pa.array(place[s], pa.int32()), None)
        known = np.flatnonzero(~single)
        if len(known):
            by = np.lexsort((place[known], of[known]))
            o, p = of[known][by], place[known][by]
            new_doc = np.append(True, o[1:] != o[:-1])
            new = new_doc | np.append(True, p[1:] != p[:-1] + 1)
            begin = np.flatnonzero(new)
            pairs = np.stack([p[begin], p[np.append(begin[1:], len(p)) - 1] + 1], axis=1)
            at_doc = np.flatnonzero(new_doc[begin])
            offsets = pa.array(np.append(at_doc, len(begin)) * 2, pa.int32())
            ranges = pa.ListArray.from_arrays(offsets, pa.array(pairs.ravel(), pa.int32()))
            whose = pa.array(o[begin][at_doc])
            own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(f"{ids[i]} {tags[i]}".encode()) for i in whose.to_pylist()), "<u8").reshape(-1, 2)
            yield batch(np.ascontiguousarray(own[:, 0]), np.ascontiguousarray(own[:, 1]), ids.take(whose), tags.take(whose), None, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for chunk in _chunks(batches, size, gram):
            _, hashes = chunk.anchors()
            at = chunk.starts[estimated(hashes)]
            if len(at):
                of = chunk.of[at]
                held.append(([d for d, _ in chunk.docs], chunk.runs(0, size)[at], chunk.runs(1, size)[at], of, at - chunk.begins[of]))
                n += len(at)
            if n >= CHUNK_WINDOWS:
                yield from grouped(held)
                held, n = [], 0
        if held:
            yield from grouped(held)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, place, ranges) to (doc_id, tag, places, ranges): the places of a document that a batch holds, in one row."""
    names = ["doc_id", "tag", "places", "ranges"]
    for batch in batches:
        ranged = batch.filter(batch.column(3).is_valid())
        if ranged.num_rows:
            yield pa.record_batch([ranged.column(0), ranged.column(1), pa.nulls(ranged.num_rows, pa.list_(pa.int32())), ranged.column(3)], names)
        plain = batch.filter(batch.column(2).is_valid())
        if plain.num_rows:
            none = plain.column(0).is_null().to_numpy(zero_copy_only=False)
            doc, tag, place = plain.column(0).fill_null(0).to_numpy(), plain.column(1).to_numpy(), plain.column(2).to_numpy()
            order = np.lexsort((place, tag, doc, none))
            none, doc, tag, place = none[order], doc[order], tag[order], place[order]
            begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (none[1:] != none[:-1])))
            places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(place)), pa.int32()), pa.array(place, pa.int32()))
            yield pa.record_batch([pa.array(doc[begin], pa.int64(), mask=none[begin]), pa.array(tag[begin]), places, pa.nulls(len(begin), pa.list_(pa.int32()))], names)


def _removed(size: int):
    """(doc_id, text, places and ranges of window starts) to what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, gone, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_buffer()
                words = text.to_pybytes().split() if text is not None else []
                n_words.append(len(words))
                found = [np.zeros(0, "i8") if x.values is None else x.values.flatten().to_numpy() for x in (batch.column(2)[i], batch.column(3)[i])]
                pairs = np.concatenate([np.stack([found[0], found[0] + 1], axis=1), found[1].reshape(-1, 2)])
                runs = []
                if len(pairs):
                    pairs = pairs[pairs[:, 0].argsort(kind="stable")]
                    ends = np.maximum.accumulate(pairs[:, 1] + size - 1)  # a range of starts covers words to its last start's window's end
                    new = np.append(True, pairs[1:, 0] > ends[:-1])
                    at = np.flatnonzero(new)
                    runs = np.stack([pairs[at, 0], ends[np.append(at[1:], len(ends)) - 1]], axis=1).tolist()
                if runs:
                    keep, last = [], 0
                    for a, b in runs:
                        keep += words[last:a]
                        last = b
                    words = keep + words[last:]
                gone.append(n_words[-1] - len(words))
                spans.append([{"from": a, "to": b} for a, b in runs])
                kept.append(b" ".join(words))
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_words", "n_removed", "spans", "text"])

    return run


def without_repeats(docs: DataFrame, size: int = 35, gram: int = 16, most_bits: int = 27) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, spans (from, to: words removed), text (words kept, joined by a space).

    docs: doc_id, text; other columns are dropped. A word goes if a window of size words covers it whose words also start elsewhere,
    in the same document or another. Spaces are those of ASCII; words are compared as they are.

    1. Each task sketches its windows' anchors; sketches are merged by blocks of cells into bits of a bounded size (most_bits).
    2. Windows estimated repeated are grouped by 128 bits in one shuffle. A task first groups its own, so a key that many
       documents hold has a row a chunk at most and no partial result depends on a hot key.
    3. Places are gathered by document (a list shorter than its text), and meet the text in a join that Spark can split.

    A null text has no words; a text of fewer than size words keeps all. Rows that repeat doc_id and text repeat each other's windows.
    Rows of null or repeated doc_id are told apart by a 64-bit hash of the text. Empty tables give no rows. A task
    holds one chunk of words, or one longer document.
    """
    if not 0 < gram <= size or most_bits < 3:
        raise ValueError("gram must be within a window, and a row of the sketch has 8 cells at least")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    bits, sketch = sketched(rows, size, gram, most_bits)
    shared = spark.sparkContext.broadcast(sketch)  # len(ROWS) * 2**most_bits bits at most
    found = rows.mapInArrow(_candidates(size, gram, bits, shared), "k0 long, k1 long, doc_id long, tag long, place int, ranges array<int>")
    counted = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k0", "k1")))
    places = counted.where("ranges is not null or (n > 1 and place is not null)").select("doc_id", "tag", "place", "ranges")
    lists = places.mapInArrow(_by_document, "doc_id long, tag long, places array<int>, ranges array<int>")
    lists = lists.groupBy("doc_id", "tag").agg(F.collect_list("places").alias("places"), F.collect_list("ranges").alias("ranges")).withColumnRenamed("doc_id", "__s_doc").withColumnRenamed("tag", "__s_tag")
    joined = rows.join(lists.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__s_doc")) & (F.col("tag") == F.col("__s_tag")), "left")
    return joined.select("doc_id", "text", "places", "ranges").mapInArrow(_removed(size), "doc_id long, n_words long, n_removed long, spans array<struct<from: int, to: int>>, text string")
