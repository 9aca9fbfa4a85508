"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Counts of a text are made inside its row, so nothing is shuffled but ids and counts of labelled documents, or of all if labels are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, Scratch, words, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules: name and score, of which more is worse. n_lines and n_marks are counted besides COUNTS.
RULES = {
    "symbols": "try_divide(n_symbols, n_words)",
    "marks": "try_divide(n_marks, n_words)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "try_divide(n_repeat_words, n_words)",
    "long_words": "try_divide(word_chars, n_words)",
    "short_words": "try_divide(-word_chars, n_words)",
    "few_words": "cast(-n_words as double)",
}
WINDOW = 5
#: Labels, rows of two numbers, that are sent to every executor.
SMALL = 1_000_000


def with_counts(docs: DataFrame) -> DataFrame:
    """docs (with a column text) and COUNTS, n_lines and n_marks as columns of those names with __q_ before them.

    Null text has no words. Words are compared by 64-bit hashes within one text; lines are compared as they stand.
    """
    q = lambda name: F.col(f"__q_{name}")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__q_text", text).withColumn("__q_w", words(q("text")))
    out = out.withColumn("__q_lines", F.filter(F.split(q("text"), "\n"), lambda x: F.length(F.regexp_replace(x, "^" + SPACE_RUN, "")) > 0))
    out = out.withColumns(
        {
            "__q_n_words": F.size(q("w")).cast("long"),
            "__q_word_chars": F.length(F.array_join(q("w"), "")).cast("long"),
            "__q_n_symbols": F.regexp_count(q("text"), F.lit(r"[#*$%&|<>]")).cast("long"),
            "__q_n_marks": (F.length(q("text")) - F.length(F.replace(q("text"), F.lit("!"), F.lit("")))).cast("long"),
            "__q_n_lines": F.size(q("lines")).cast("long"),
            "__q_n_dup_lines": (F.size(q("lines")) - F.size(F.array_distinct(q("lines")))).cast("long"),
            "__q_h": F.transform(q("w"), lambda x: F.xxhash64(x)),
        }
    )
    # arrays that a lambda reads stand in columns of their own, else each element would make them anew
    starts = F.sequence(F.lit(0), F.size(q("h")) - WINDOW)
    grams = F.transform(starts, lambda i: F.xxhash64(*(F.get(q("h"), i + k) for k in range(WINDOW))))
    out = out.withColumn("__q_grams", F.when(F.size("__q_h") > WINDOW, grams).otherwise(F.array().cast("array<bigint>")))
    # windows that occur twice are equal neighbours of the sorted (hash, place) pairs; the words they cover are their union
    some = F.size(F.array_distinct(q("grams"))) < F.size(q("grams"))
    pairs = F.sort_array(F.transform(q("grams"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("__q_pairs", F.when(some, pairs).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    same = lambda x, j: x["x"].eqNullSafe(F.get(q("pairs"), j)["x"])
    twin = F.transform(q("pairs"), lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
    out = out.withColumn("__q_at", F.sort_array(F.filter(twin, lambda i: i.isNotNull())))
    steps = F.transform(q("at"), lambda i, j: F.when(j > 0, F.least(i - F.get(q("at"), j - 1), F.lit(WINDOW))).otherwise(WINDOW))
    out = out.withColumn("__q_n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))
    # a generator of one row: conditions on counts stay above it, where the counts are made once
    counts = F.array(F.struct(*(q(c).alias(f"__q_{c}") for c in (*COUNTS, "n_marks", "n_lines"))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.inline(counts))


def base_failed() -> Column:
    return (F.col("__q_n_words") < 10) | (100 * F.col("__q_n_repeat_words") > 20 * F.col("__q_n_words"))


def _score(rule: str) -> Column:
    import re

    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"__q_\1", RULES[rule])).cast("double")


def most_errors(n: Column, risk: float, doubt: Column) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= doubt, else null: with k errors among n, Clopper and Pearson's upper
    bound at confidence 1 - doubt is then at most risk. Sums exact terms, kept as logarithms."""
    odds = float(__import__("math").log(risk / (1 - risk)))
    none = float(__import__("math").log(1 - risk))
    start = F.struct((n * F.lit(none)).alias("term"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("best"))

    def step(a, k):
        total = a["sum"] + F.exp(a["term"])
        term = a["term"] + F.log((n - k) / (k + 1)) + F.lit(odds)
        return F.struct(F.coalesce(term, F.lit(float("-inf"))).alias("term"), total.alias("sum"), F.when(total <= doubt, k).otherwise(a["best"]).alias("best"))

    best = F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * F.lit(risk))), start, step, lambda a: a["best"])
    return F.when(best >= 0, best)


def cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, doubt: float = 0.05, max_labels: int | None = None, clear: float = 4.0) -> DataFrame:
    """(stratum, cutoffs): for each stratum a map from a rule to the score from which on it rejects. Rules without one don't reject.

    labels: doc_id and quality (1 good, 0 bad; a doc_id with both counts as good). All of them are joined to their documents,
    or, if max_labels is given, that many at most, those first by a hash of doc_id; those that fail the base rules are left out. Another
    hash of doc_id halves them. Up to SMALL labels go to the documents; more meet counts of all documents, so that no text is shuffled.

    The first half shapes a sequence of joint cutoffs. A rule takes part in a stratum if at some score the share of bad documents
    from there on is above that of good ones by clear standard errors. At level j each rule rejects from its lowest bad document
    on that has at most j good ones of its score or worse; levels go up to risk of the good documents.

    The second half, the holdout, tests them. Level j is admitted while most_errors(good, risk, doubt / strata) good documents or
    fewer are rejected by any rule. Levels are nested, so they form a fixed sequence that needs no further correction, and the
    joint rejection is tested, so rules need none either; strata are corrected by Bonferroni. With probability 1 - doubt, no
    stratum loses more than risk of its good documents. Of the admitted levels that one is taken that rejects most bad documents
    less good ones, the lowest of equals, and none if it rejects no more bad than good ones. Too few labels, none, or no bad ones:
    no cutoffs.
    """
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("__q_good"))
    sample = sample.withColumnRenamed("doc_id", "__q_id")
    if max_labels is not None:
        sample = sample.orderBy(F.xxhash64("__q_id"), "__q_id").limit(max_labels)
    with Scratch(docs.sparkSession, "quality") as scratch:
        sample = scratch.written(sample, "sample")
        held, same = docs.select("doc_id", "text", F.col(stratum).alias("stratum")), F.col("doc_id") == F.col("__q_id")
        if sample.count() <= SMALL:
            held = with_counts(held.join(F.broadcast(sample), same))
        else:
            held = with_counts(held).drop("text").join(sample, same)
        held = held.where(~base_failed()).withColumns({"row": F.monotonically_increasing_id(), "shapes": F.sha2(F.col("doc_id").cast("string"), 256) < "8"})
        held = scratch.written(held.drop("text"), "labelled").withColumnRenamed("__q_good", "good")
        scores = F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*map(_score, RULES)))).alias("rule", "score")
        rows = held.select("row", "stratum", "good", "shapes", scores).where("score is not null")
        key = Window.partitionBy("stratum", "rule")
        worse, better = key.orderBy(F.desc("score")), key.orderBy("score")  # with equals, as frames by value are
        each = {"good": F.when(F.col("shapes"), F.col("good")).otherwise(0), "bad": F.when(F.col("shapes"), 1 - F.col("good")).otherwise(0)}
        at = rows.select("*", *(F.sum(x).over(w).alias(f"{c}_{n}") for c, x in each.items() for n, w in (("from", worse), ("all", key))))
        share = F.try_divide(F.col("good_from") + F.col("bad_from"), F.col("good_all") + F.col("bad_all"))
        error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), "good_all") + F.try_divide(F.lit(1.0), "bad_all")))
        apart = F.try_divide(F.try_divide("bad_from", "bad_all") - F.try_divide("good_from", "good_all"), error)
        at = at.withColumn("clear", F.max(apart).over(key)).where(F.col("clear") >= clear)
        shaping_bad = F.col("shapes") & (F.col("good") == 0)
        at = scratch.written(at.withColumn("level", F.min(F.when(shaping_bad, F.col("good_from"))).over(better)), "levels")
        # the level from which on a holdout document is rejected by any rule
        tested = at.where("not shapes").groupBy("stratum", "row", "good").agg(F.min("level").alias("level"), F.max("good_all").alias("n")).where(F.col("level") <= F.floor(F.col("n") * F.lit(risk)))
        lost = tested.groupBy("stratum", "level").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
        upto = Window.partitionBy("stratum").orderBy("level")
        lost = lost.select("stratum", "level", *(F.sum(c).over(upto).alias(c) for c in ("good", "bad")))
        strata = held.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
        sizes = held.where("not shapes").groupBy(F.col("stratum").alias("s")).agg(F.sum("good").alias("n"))
        sizes = sizes.crossJoin(F.broadcast(strata)).select("s", most_errors(F.col("n"), risk, F.lit(doubt) / F.col("strata")).alias("most"))
        gain = F.col("bad") - F.col("good")  # a good document lost weighs as much as a bad one caught
        admitted = lost.join(sizes, F.col("stratum").eqNullSafe(F.col("s"))).where("good <= most").withColumn("gain", gain).where("gain > 0")
        best = admitted.groupBy(F.col("stratum").alias("s")).agg(F.max_by("level", F.struct("gain", -F.col("level"))).alias("best"))
        cut = at.where(shaping_bad).join(best, F.col("stratum").eqNullSafe(F.col("s"))).where("good_from <= best")
        cut = cut.groupBy("stratum", "rule").agg(F.min("score").alias("score"))
        return written(cut.groupBy("stratum").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "score")))).alias("cutoffs")), "cutoffs")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """docs (doc_id, text, the stratum's column and any others) with __q_ columns: counts, __q_base_failed and __q_kept.

    Texts with under ten words, or of whose words more than a fifth lie in repeated windows, fail the base rules; the others
    are kept unless a rule's score reaches its stratum's cutoff (see cutoffs, which takes the options). A stratum without
    labels, null included, has no cutoffs. Scores are of whole texts. Rows stay as they are, repeated ids too; an empty table
    gives no rows.
    """
    found = cutoffs(docs, labels, stratum, **options).select(F.col("stratum").alias("__q_stratum"), F.col("cutoffs").alias("__q_cutoffs"))
    # a row for each stratum that has cutoffs
    out = with_counts(docs).join(F.broadcast(found), F.col(stratum).eqNullSafe(F.col("__q_stratum")), "left")
    over = [F.coalesce(_score(rule) >= F.element_at("__q_cutoffs", F.lit(rule)), F.lit(False)) for rule in RULES]
    out = out.withColumn("__q_base_failed", base_failed())
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return out.withColumn("__q_kept", ~F.col("__q_base_failed") & ~rejected).drop("__q_stratum", "__q_cutoffs")
