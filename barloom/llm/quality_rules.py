"""Quality rules: surface statistics, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets. Two multinomials over the buckets, one of a trusted target
(documents known to be good) and one of the raw corpus, give every bucket a log ratio; a document's score is
the mean log ratio of its n-grams. The target's counts are smoothed towards the raw corpus, log((good + k) /
(raw * G / R + k)) for totals G and R, so n-grams as usual in both score 0 however much is labelled. Ratios are rounded to whole millionths before they are summed, so a
score doesn't depend on the order of summation and the threshold decides every document the same way
each time. All of it is built-in expressions; the only rows shuffled are texts (once, to meet the trusted
ids) and one row per bucket and task.

Defined results: null text is an empty text; a text without words has score null and fails the base rules;
a trusted set without words gives every bucket the ratio 0, so the base rules alone decide; repeated rows are scored as they are; null doc_ids are never trusted; only doc_id and text
(labels: doc_id, quality) are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import let, words

#: Buckets per family (words, word pairs), a prime; the weights take 2 * BUCKETS longs, about 1 MB.
BUCKETS = 65521
#: Multiplier that makes a pair's hash depend on the order of its words.
PAIR = 1000003
#: k, in occurrences.
SMOOTHING = 1.0
#: Mean log ratio per n-gram from which a document is kept.
THRESHOLD = -0.3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.crc32(x.cast("binary")))


def _pairs(h: Column) -> Column:
    """The bucket of every two neighbouring words."""
    return F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.lit(BUCKETS) + (a * PAIR + b) % BUCKETS)


def repeated_words(w: Column, h: Column) -> Column:
    """Words within windows of 8 words that occur twice or more; h: the words' hashes.

    Texts whose windows all hash apart have none; only the others compare the words themselves.
    """
    last = F.size(h) - WINDOW
    keys = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def counted(windows: Column) -> Column:
        # windows: sorted (words, position); those equal to a neighbour, by position, cover 8 words less overlaps
        same = F.filter(windows, lambda p, i: (p["t"] == F.get(windows, i - 1)["t"]) | (p["t"] == F.get(windows, i + 1)["t"]))
        at = F.sort_array(F.transform(same, lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    exact = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("t"), i.alias("i"))))
    repeats = let(keys, lambda k: F.size(F.array_distinct(k)) < F.size(k))
    return F.when(last < 1, 0).when(repeats, let(exact, counted)).otherwise(0).cast("long")


def base_statistics(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the base columns, base_failed, hashes (of the words) and columns to carry along for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(*also, "doc_id", text.alias("text"), words(F.col("text")).alias("w"))
    hashed = split.select(*also, "doc_id", "text", "w", _hashes(F.col("w")).alias("hashes"))
    counted = hashed.select(
        *also,
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w"), F.col("hashes")).alias("n_repeat_words"),
        "hashes",
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row, weights: the log ratio in millionths of every bucket, of words then of pairs.

    trusted: the doc_ids of the target documents, whose texts are in docs.
    """
    known = trusted.select(F.col("doc_id").alias("_trusted")).filter("_trusted is not null").distinct().hint("merge")  # the same plan at every size
    marked = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_trusted"), "left").select(F.col("_trusted").isNotNull().cast("long").alias("good"), _hashes(words(F.col("text"))).alias("h"))
    grams = F.concat(F.transform("h", lambda x: x % BUCKETS), _pairs(F.col("h")))
    counts = marked.select("good", F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.sum("good").alias("good"), F.count("*").alias("raw"))
    spark = docs.sparkSession
    every = spark.range(2 * BUCKETS).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("raw", F.lit(0)).alias("raw"))
    row = every.agg(F.sum("good").alias("good"), F.sum("raw").alias("raw"), F.sort_array(F.collect_list(F.struct("bucket", "good", "raw"))).alias("counts"))
    # what the target would have of a bucket if it were like the raw corpus
    alike = lambda c: c["raw"].cast("double") * F.col("good").cast("double") / F.greatest(F.col("raw"), F.lit(1)).cast("double")
    return row.select(F.transform("counts", lambda c: F.round(F.log((c["good"] + F.lit(SMOOTHING)) / (alike(c) + F.lit(SMOOTHING))) * 1e6).cast("long")).alias("weights"))


def _total(h: Column, weights: Column) -> Column:
    """The sum of the weights of all words and pairs."""
    start = F.struct(F.lit(-1).cast("long").alias("before"), F.lit(0).cast("long").alias("sum"))
    pair = lambda a, x: F.when(a["before"] < 0, F.lit(0).cast("long")).otherwise(F.get(weights, (F.lit(BUCKETS) + (a["before"] * PAIR + x) % BUCKETS).cast("int")))
    return F.aggregate(h, start, lambda a, x: F.struct(x.alias("before"), (a["sum"] + F.get(weights, (x % BUCKETS).cast("int")) + pair(a, x)).alias("sum")), lambda a: a["sum"])


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, *also: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, and columns to carry along."""
    scored = base_statistics(docs, *also).withColumn("weights", bucket_weights(docs, trusted).scalar())
    scored = scored.withColumn("total", _total(F.col("hashes"), F.col("weights"))).withColumn("grams", 2 * F.col("n_words") - 1)
    score = F.when(F.col("n_words") > 0, F.col("total") / F.col("grams") / 1e6)
    verdict = F.col("total") >= F.lit(round(threshold * 1e6)) * F.col("grams")
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), score.alias("score"), *also)


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept. Every row is judged where it is read; none is shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    told = quality_rules(rows, trusted, threshold, "_row")
    # not a filter: that would move below the projections and work the statistics out once for each use
    return told.select(F.inline(F.when(F.col("kept"), F.array("_row"))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1").select("doc_id")
