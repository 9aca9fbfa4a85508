"""Hard-negative mining: for anchors, the nearest rows of the same label, and rows of other labels that score just below those.

A threshold join in the manner of L2AP over integer vectors. Within a block of anchors and a chunk of rows, inverted lists by groups
of dimensions (strongest first) leave out of each row the last groups, which by the norms of what is left can't lift any pair to the
least threshold; partial scores are accumulated list by list, rows whose partial scores and remaining norms stay below every
anchor's threshold go on the way, and the pairs left get their full score. Thresholds begin high and are lowered, for the windows that
are not yet full, down to the windows' own floors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written

#: Values of a block of anchors, and of a chunk of rows: what a task holds (4 and 16 MB).
BLOCK_CELLS, CHUNK_CELLS = 1 << 19, 1 << 21
#: Rows, and anchors, of one accumulation.
STEP_ROWS, STEP_ANCHORS = 2048, 1024
#: Groups of dimensions; a list is a group's rows.
GROUPS = 4
LEAST = -(1 << 63)


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (floor(scale * x) of each component, as long) of the rows that take part.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, don't. Values beyond a long become its limits.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound).select("vec_id", "label", v.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows, with zeros after the end of shorter ones."""
    rows = column.combine_chunks()
    flat, n = rows.flatten().to_numpy(zero_copy_only=False), len(rows)
    if len(flat) == n * width:
        return flat.reshape(n, width)
    lengths = np.array([len(x) for x in rows], "i8")
    out = np.zeros((n, width), "i8")
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def above(anchors: np.ndarray, low: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (anchor, row, score) whose score is low[anchor] or more."""
    d = anchors.shape[1]
    most = [int(np.abs(x.astype("f8")).max(initial=0)) + 1 for x in (anchors, rows)]
    if most[0] * most[1] * d >= 1 << 53:  # doubles would not hold the sums
        scores = anchors.astype(object) @ rows.astype(object).T if d else np.zeros((len(anchors), len(rows)), object)
        i, j = np.nonzero(scores >= low.astype(object)[:, None])
        return i, j, np.array([min(max(x, LEAST), -LEAST - 1) for x in scores[i, j]], "i8")
    q, y, low = anchors.astype("f8"), rows.astype("f8"), low.astype("f8")
    by = np.argsort(-(y * y).sum(axis=0), kind="stable")
    q, y = q[:, by], y[:, by]
    cuts = [d * g // GROUPS for g in range(GROUPS + 1)]
    slack = 1 + 1e-9
    q_left = np.stack([np.sqrt((q[:, c:] ** 2).sum(axis=1)) for c in cuts]) * slack
    y_left = np.stack([np.sqrt((y[:, c:] ** 2).sum(axis=1)) for c in cuts]) * slack
    # groups from end on stay out of the lists: alone they don't reach the least threshold
    reach = y_left * q_left.max(axis=1, initial=0)[:, None] >= low.min()
    end = np.where(reach, np.arange(1, GROUPS + 2)[:, None], 0).max(axis=0).clip(max=GROUPS)
    at = np.argsort(-end, kind="stable")
    at = at[end[at] > 0]
    scores = np.zeros((len(q), len(at)))
    for g in range(GROUPS):
        listed = int((end[at] > g).sum())  # the first of them: lists are in the order of their ends
        scores[:, :listed] += q[:, cuts[g] : cuts[g + 1]] @ y[at[:listed], cuts[g] : cuts[g + 1]].T
        done = np.minimum(end[at], g + 1)
        fits = (scores + q_left[done].T * y_left[done, at] >= low[:, None]).any(axis=0)
        if fits.mean() < 0.8 if len(at) else False:
            at, scores = at[fits], scores[:, fits]
    i, k = np.nonzero(scores + q_left[end[at]].T * y_left[end[at], at] >= low[:, None])
    j, found = at[k], scores[i, k]
    for g in range(GROUPS):
        part = np.flatnonzero(end[j] == g)
        found[part] += np.einsum("ij,ij->i", q[i[part], cuts[g] :], y[j[part], cuts[g] :])
    keep = found >= low[i]
    return i[keep], j[keep], found[keep].astype("i8")


def _best(group: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group by score, then vec."""
    order = np.lexsort((vec, -score, group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, "i8")
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < k]


def _block_join(width: int, same: bool, k: int):
    """A block of windows against a chunk of rows: the first k rows of each window (anchor and place), from low to high."""
    names, kinds = ("anchor_id", "place", "vec_id", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [tuple(np.zeros(0, "i8") for _ in range(3))]  # window, vec_id, score
        windows = [np.array(x, "i8") for x in (queries["lows"].combine_chunks().flatten(), queries["highs"].combine_chunks().flatten(), queries["places"].combine_chunks().flatten())]
        n = np.array([len(x) for x in queries["lows"]], "i8")
        begin = np.concatenate([[0], np.cumsum(n)])
        if len(n) and rows.num_rows:
            anchors, vectors = _matrix(queries["v"], width), _matrix(rows["v"], width)
            ids, labels = queries["anchor_id"].to_numpy(), queries["label"].to_numpy()
            vec, own = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            least = np.minimum.reduceat(windows[0], begin[:-1])
            for a in range(0, len(n), STEP_ANCHORS):
                for b in range(0, len(vec), STEP_ROWS):
                    i, j, s = above(anchors[a : a + STEP_ANCHORS], least[a : a + STEP_ANCHORS], vectors[b : b + STEP_ROWS])
                    i, j = i + a, j + b
                    fits = ((labels[i] == own[j]) == same) & (ids[i] != vec[j])
                    i, j, s = i[fits], j[fits], s[fits]
                    for t in range(int(n.max())):
                        w = begin[i] + t
                        some = np.flatnonzero(t < n[i])
                        some = some[(windows[0][w[some]] <= s[some]) & (s[some] <= windows[1][w[some]])]
                        some = some[_best(w[some], s[some], vec[j[some]], k)]
                        parts.append((w[some], vec[j[some]], s[some]))
        w, v, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        best = _best(w, s, v, k)
        w, v, s = w[best], v[best], s[best]
        whose = np.repeat(queries["anchor_id"].to_numpy(), n)[w] if len(w) else np.zeros(0, "i8")
        return pa.table([pa.array(x, kind) for x, kind in zip((whose, windows[2][w], v, s), kinds, strict=True)], names)

    return run


def _filled(scratch: Scratch, anchors: DataFrame, windows: DataFrame, rows: DataFrame, lows: list[Column], same: bool, k: int, shape: tuple[int, int, int]) -> DataFrame:
    """anchor_id, place, vec_id, score, rank: the first k of each window (anchor_id, place, high, and the columns that lows name).

    lows: the thresholds, falling to the window's own floor; after each round the windows that are full go out.
    """
    width, blocks, chunks = shape
    out, key = [], ["anchor_id", "place"]
    for n, low in enumerate(lows):
        now = windows.withColumn("low", low)
        own = now.groupBy("anchor_id").agg(F.collect_list(F.struct("low", "high", "place")).alias("w"))
        asked = anchors.join(own, "anchor_id").select("block", "anchor_id", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.col("w.place").alias("places"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = asked.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInArrow(_block_join(width, same, k), "anchor_id long, place int, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))
        best = scratch.written(found.withColumn("rank", rank).where(F.col("rank") <= k), "found")
        if n + 1 == len(lows):
            out.append(best)
            break
        full = best.where(F.col("rank") == k).select(*key)
        out.append(best.join(full, key, "left_semi"))
        windows = scratch.written(windows.join(full, key, "left_anti"), "windows")
        if windows.isEmpty():
            break
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def hard_negatives(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, floor: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v (array of long); other columns are dropped. anchor: which rows are anchors. An anchor's positives are its
    first n_positives other rows of the same label; a positive's negatives the first n_negatives rows of other labels that score from
    floor per cent of the positive's score up to the whole of it. Higher inner products come first, then smaller vec_ids. A
    positive of a negative score has no negatives, as floor per cent of it is more than the whole.

    Anchors and rows are dealt by hashes into blocks and chunks of a bounded size, and meet pair by pair of those, so rows are sent
    once for each block of anchors (some 8,000 of 64 dimensions), and never whole to a task; each pair returns n rows a window at most.

    Rows are other rows if their vec_id differs; of rows that repeat an anchor's vec_id the least by label and vector is the anchor,
    as rows to be found they count each. Shorter vectors count as ended by zeros. Scores beyond a long become its limits. Rows with nulls
    must have gone before (quantised). Empty tables, and anchors without positives or negatives, give no rows.
    """
    spark = rows.sparkSession
    with Scratch(spark, "negatives") as scratch:
        rows = scratch.written(rows.select("vec_id", "label", "v"), "rows")
        chosen = rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
        anchors = scratch.written(chosen.select(F.col("vec_id").alias("anchor_id"), "x.label", "x.v"), "anchors")
        n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()  # two numbers
        blocks = max(1, math.ceil(anchors.count() * max(1, width) / BLOCK_CELLS))
        chunks = max(math.ceil(n * max(1, width) / CHUNK_CELLS), min(n // 1000, spark.sparkContext.defaultParallelism), 1)
        shape = width, blocks, chunks
        anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int"))

        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        windows = anchors.select("anchor_id", F.lit(1).alias("place"), F.lit(-LEAST - 1).alias("high"), square.alias("square"))
        lows = [F.floor(F.col("square") / 2), F.floor(F.col("square") / 4), F.lit(LEAST)]
        near = _filled(scratch, anchors, windows, rows, lows, True, n_positives, shape)
        positives = scratch.written(near.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("high")), "positives")

        part = lambda x: F.ceil(F.col("high").cast("decimal(20,0)") * x / 100).cast("long")
        lows = [part(x) for x in sorted({95, 90, floor}, reverse=True) if x >= floor]
        far = _filled(scratch, anchors, positives.where("high >= 0"), rows, lows, False, n_negatives, shape)
        out = far.join(positives.withColumnRenamed("high", "positive_score"), ["anchor_id", "place"])
        return written(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
