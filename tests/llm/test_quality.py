import math
import random
import re

from pyspark.sql import functions as F

from strandline.llm.quality import COUNTS, RULES, cutoffs, judged, most_errors, with_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n", "a", "a b c d e", "a a a a a a a", "x y z\n x y z\nx y z\n", "#*$%&|<> \x0b\x0c é𝒳", "\xa0  ", "a b c d e a b c d e f a b c d"]
    texts += ["".join(rng.choices(["a ", "b ", "c", "\n", "# ", "é "], k=rng.randrange(0, 80))) for _ in range(200)] + ["w1 w2 w3 " * 20000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    found = with_counts(df).collect()
    for r in found:
        assert tuple(r[f"__q_{c}"] for c in COUNTS) == counts(texts[r["doc_id"]]), repr(texts[r["doc_id"]][:50])


def test_most_errors(spark):
    cases = [(n, risk, doubt) for n in (0, 1, 50, 400, 3000) for risk in (0.01, 0.05) for doubt in (0.05, 0.001)]
    for n, risk, doubt in cases:
        total, best = 0.0, None
        for k in range(int(n * risk) + 2):
            total += math.comb(n, k) * risk**k * (1 - risk) ** (n - k)
            if total <= doubt and k <= math.ceil(n * risk):
                best = k
        got = spark.range(1).select(most_errors(F.lit(n).cast("long"), risk, F.lit(doubt)).alias("k")).first()["k"]
        assert got == best, (n, risk, doubt)


def labelled(n, junk):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        own = " ".join(f"word{rng.randrange(10**6)}{'###' if bad and junk else ''}" for _ in range(30))
        docs.append((i, own, "en"))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_cutoffs_catch_junk_and_keep_good(spark):
    docs, labels = labelled(2500, True)
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    (row,) = cutoffs(d, y).collect()
    assert "symbols" in row["cutoffs"]
    found = {r["doc_id"]: r["__q_kept"] for r in judged(d, y).collect()}
    assert all(found[i] == bool(q) for i, q in labels)


def test_too_few_labels_reject_nothing(spark):
    docs, labels = labelled(100, True)
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    assert cutoffs(d, y).count() == 0
    assert judged(d, y).where("not __q_kept").count() == 0
    assert judged(d.limit(0), y.limit(0)).count() == 0


def test_labels_that_say_nothing_cost_no_good_documents(spark):
    docs, labels = labelled(3000, False)
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    lost = judged(d, y).where("not __q_kept").join(y.where("quality = 1"), "doc_id").count()
    assert lost <= 0.05 * 2400
    assert len(RULES) == 7


def by_hand(rows, risk=0.05, doubt=0.05, clear=4.0):
    """cutoffs of rows (stratum, good, shapes, {rule: score}), by loops over all levels."""
    strata, found = {r[0] for r in rows}, {}
    for s in strata:
        shaping = [(good, score) for t, good, shapes, score in rows if t == s and shapes]
        holdout = [(good, score) for t, good, shapes, score in rows if t == s and not shapes]
        n, m = sum(g for g, _ in shaping), sum(1 - g for g, _ in shaping)
        good = sum(g for g, _ in holdout)
        if not (n and m and good):
            continue
        tail, most = 0.0, None
        for k in range(math.ceil(good * risk) + 1):
            tail += math.comb(good, k) * risk**k * (1 - risk) ** (good - k)
            most = k if tail <= doubt / len(strata) else most
        ladders = {}
        for rule in RULES:
            apart, steps = 0.0, []
            for x in {score[rule] for _, score in shaping}:
                g, b = (sum(1 for q, score in shaping if q == want and score[rule] >= x) for want in (1, 0))
                share = (g + b) / (n + m)
                if 0 < share < 1:
                    apart = max(apart, (b / m - g / n) / math.sqrt(share * (1 - share) * (1 / n + 1 / m)))
                if any(not q and score[rule] == x for q, score in shaping):
                    steps.append((x, g))
            if apart >= clear:
                ladders[rule] = steps
        best = None
        for j in range(int(n * risk) + 1):
            cuts = {rule: min(x for x, g in steps if g <= j) for rule, steps in ladders.items() if any(g <= j for _, g in steps)}
            out = [q for q, score in holdout if any(score[rule] >= x for rule, x in cuts.items())]
            lost, caught = sum(out), len(out) - sum(out)
            if most is None or lost > most:
                break
            gain = caught - lost
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, cuts
        if best:
            found[s] = best[1]
    return found


def noisy(n, seed, strata):
    """Documents of which bad ones have more symbols, marks or long words than good ones, but not all, and some good ones have them too."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 40))]
        kind = rng.randrange(4) if bad else (rng.randrange(4) if rng.random() < 0.03 else 3)
        w = [x + ("#", "!", "x" * 6, "")[kind] * (rng.random() < 0.5) for x in w]
        docs.append((i, " ".join(w), rng.choice(strata)))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_cutoffs_equal_a_walk_over_all_levels(spark):
    import hashlib

    for seed, strata in ((1, ["en"]), (2, ["en", None, "de", "en"])):
        docs, labels = noisy(1500, seed, strata)
        d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
        rows = []
        for (i, text, lang), (_, good) in zip(docs, labels):
            n, chars, symbols, dup, repeats = counts(text)
            lines = max(1, len([x for x in text.split("\n") if WORD.search(x)]))
            score = {"symbols": symbols / n, "marks": text.count("!") / n, "dup_lines": dup / lines, "repeats": repeats / n, "long_words": chars / n, "short_words": -chars / n, "few_words": float(-n)}
            rows.append((lang, good, hashlib.sha256(str(i).encode()).hexdigest() < "8", score))
        want = by_hand(rows)
        assert want
        assert {r["stratum"]: r["cutoffs"] for r in cutoffs(d, y).collect()} == want


def test_three_hundred_good_labels_suffice(spark):
    docs, labels = labelled(375, True)
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r["doc_id"]: r["__q_kept"] for r in judged(d, y).collect()}
    assert all(not found[i] for i, q in labels if not q)
    assert sum(not found[i] for i, q in labels if q) <= 15


def test_all_labels_count_whether_few_or_many(spark, monkeypatch):
    import inspect

    from strandline.llm import quality

    assert inspect.signature(cutoffs).parameters["max_labels"].default is None
    docs, labels = labelled(1500, True)
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    few = cutoffs(d, y).collect()
    monkeypatch.setattr(quality, "SMALL", 0)
    assert few and cutoffs(d, y).collect() == few
