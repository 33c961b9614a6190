"""Quality rules: fixed base rules, then a log-likelihood ratio of hashed n-grams.

Each text becomes a bag of hashed n-grams: every word, and every word with the next one (the last word alone once more), so
that the order of words counts. Two multinomials over the buckets are counted, one over all documents and one over the
trusted ones. A text's verdict is the mean over its n-grams of log(trusted / raw), held in whole millionths so that sums
do not depend on the order of rows.

Everything is a DataFrame expression. Counting sends at most one row per bucket and task, and what reaches the driver is
one number per bucket (`buckets` of them, whatever the input), put into the plan as a constant array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrow.llm.common import let, words

BUCKETS = 10_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Mean log ratio in nats below which a text goes: its n-grams are then clearly rarer among trusted texts.
THRESHOLD = -0.1
SCALE = 1_000_000


def bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def grams(word: Column, after: Column, buckets: int) -> tuple[Column, Column]:
    """Buckets of a word and of the pair it makes with the next; after: null behind the last."""
    return bucket(F.xxhash64(word), buckets), bucket(F.xxhash64(word, after), buckets)


def following(w: Column) -> Column:
    """Structs of every word and the one after it."""
    return F.transform(w, lambda x, i: F.struct(x.alias("w"), F.get(w, i + 1).alias("after")))


def features(text: Column, ratios: Column, buckets: int = BUCKETS) -> Column:
    """Struct of the counts of a text, see `quality_rules`, and total, the sum of its n-grams' log ratios."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        steps = F.when(F.size(w) < WINDOW, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(w) - WINDOW))
        return let(hashes, lambda h: F.transform(steps, lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])))

    def repeated(h: Column) -> Column:
        """Words covered by windows that occur twice or more; h: the windows' hashes in order."""
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(
            ranked,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["h"] == x["h"]))),
                    lambda x: x["i"],
                )
            ),
        )
        span = let(
            again,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(p[F.least(k + 1, F.size(p) - 1)] - x, F.lit(WINDOW))).otherwise(F.lit(WINDOW))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(span)

    counts = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.aggregate(following(w), F.lit(0).cast("long"), lambda a, x: a + sum(ratios[b] for b in grams(x["w"], x["after"], buckets))).alias("total"),
            let(windows(w), repeated).alias("n_repeat_words"),
        ),
    )
    return F.struct(
        counts.alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """log(trusted / raw) of every bucket in millionths, from one added count in each.

    trusted: doc_id of the trusted documents. Repeated ids in trusted count once. One pass over the texts.
    """
    marked = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().withColumn("_t", F.lit(1))
    # Merged at every size: the trusted ids grow with the documents, so they are never sent to all tasks.
    joined = docs.select("doc_id", "text").join(marked.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    each = joined.select(F.coalesce("_t", F.lit(0)).cast("long").alias("t"), F.explode(let(words(F.col("text")), following)).alias("x"))
    both = each.select("t", F.explode(F.array(*grams(F.col("x.w"), F.col("x.after"), buckets))).alias("b"))
    counts = both.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets
    for row in counts:
        raw[row["b"]] += row["raw"]
        target[row["b"]] += row["target"]
    all_raw, all_target = sum(raw), sum(target)
    return [round(SCALE * (math.log(t / all_target) - math.log(r / all_raw))) for r, t in zip(raw, target, strict=True)]


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, base_failed, llr (mean log ratio in millionths, null without words) and kept.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal to an earlier line),
    n_repeat_words (words in windows of five that occur twice or more). base_failed: fewer than 10 words, or over 20% of
    the words in repeated windows. kept: the base rules hold and llr is threshold or more.

    A null or empty text has no word and fails. Repeated rows are judged each; ties cannot occur. Columns of docs with
    names of the result are replaced. No documents: no rows. No trusted documents: all ratios follow the added counts.
    """
    ratios = F.lit(log_ratios(docs, trusted, buckets))
    # The caller's columns travel in one of their own, whatever they are called.
    judged = docs.select(F.struct(*docs.columns).alias("row"), features(F.col("text"), ratios, buckets).alias("f"))
    f = F.col("f")
    results = {
        "n_words": f["words"]["n_words"],
        "word_chars": f["words"]["word_chars"],
        "n_symbols": f["n_symbols"],
        "n_dup_lines": f["n_dup_lines"],
        "n_repeat_words": f["words"]["n_repeat_words"],
        "llr": F.when(f["words"]["n_words"] > 0, F.floor(f["words"]["total"] / (2 * f["words"]["n_words"]))),
    }
    names = {*results, "base_failed", "kept"}
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in names]
    out = judged.select(*own, *(value.alias(name) for name, value in results.items()))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= round(threshold * SCALE), F.lit(False))
    return out.withColumn("base_failed", failed).withColumn("kept", kept)
