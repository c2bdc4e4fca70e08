"""Quality rules: base counts, and a hashed n-gram likelihood ratio, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stage
from .common import WORD, checked_broadcast, words

#: Steps per unit of score in the histogram that the threshold is read from.
SCORE_STEPS = 1000
#: Window length, in words, of the repetition rule.
WINDOW = 5


def _hashed_words(rows: DataFrame) -> DataFrame:
    """Add ``own_words`` of the text, and ``hashes``, which all windows and features are made of."""
    return rows.withColumn("own_words", words(F.col("text"))).withColumn("hashes", F.transform("own_words", lambda w: F.xxhash64(w)))


def _with_features(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per feature: every word and every pair of neighbours, hashed into ``buckets``."""
    pairs = F.transform("hashes", lambda h, i: F.xxhash64(h, F.get("hashes", i + 1)))
    featured = rows.withColumn("features", F.concat("hashes", pairs)).drop("hashes", "text")
    return featured.withColumn("feature", F.explode_outer("features")).drop("features").withColumn("bucket", F.pmod("feature", F.lit(buckets)))


def ngram_weights(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, weight): log ratio of the target and the raw multinomial, one added per bucket.

    ``trusted`` holds the doc_id of the target documents; the raw counts cover every document.
    Counts are summed before they move: a task sends at most one row per bucket.
    """
    target = trusted.select("doc_id").distinct().withColumn("target", F.lit(1))
    flagged = docs.select("doc_id", "text").join(checked_broadcast(stage(target, "trusted")), "doc_id", "left").drop("doc_id")
    counted = (
        _with_features(_hashed_words(flagged).drop("own_words"), buckets)
        .filter("bucket is not null")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    )
    all_buckets = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    filled = stage(all_buckets.join(counted, "bucket", "left").na.fill(0), "buckets")
    raw, wanted = filled.agg(F.sum("raw"), F.sum("target")).first()
    ratio = F.log((F.col("target") + 1) / F.lit(wanted + buckets)) - F.log((F.col("raw") + 1) / F.lit(raw + buckets))
    return stage(filled.select("bucket", F.round(ratio, 9).alias("weight")), "weights")


def with_base_counts(rows: DataFrame) -> DataFrame:
    """Add hashes, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``; nulls count as empty.

    Words inside repeated windows are found from the sorted window hashes of the one text; only
    texts in which some window occurs twice are sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    rows = _hashed_words(rows).withColumn("own_lines", worded)
    n = F.size("own_words")
    none = F.array().cast("array<bigint>")
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice("hashes", i + 1, WINDOW)))
    rows = rows.withColumn("windows", F.when(n >= WINDOW, windows).otherwise(none))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(nothing))

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get("placed", k - 1)["h"], F.get("placed", k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    rows = rows.withColumn("starts", F.array_sort(F.transform(F.filter("placed", twice), lambda x: x["i"])))
    step = lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW)))
    repeated = F.aggregate(F.transform("starts", step), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "*",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("own_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    ).drop("own_words", "own_lines", "windows", "placed", "starts")


def rate_quality(
    docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, lost: float = 0.001, margin: float = 0.05, min_words: int = 10, most_repeated: int = 20
) -> DataFrame:
    """Base counts, a score and a verdict for every row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score and kept. The score is the mean log ratio, over words and pairs of neighbours, between a
    multinomial of the trusted documents (``trusted.doc_id``) and one of the whole corpus. A fifth of
    the trusted, by a checksum of doc_id, is kept from the multinomial: a document scores higher
    where its own words were counted, so only these show what a clean document scores. A row is
    kept if it passes the base rules and reaches the score that all but the share ``lost`` of that
    fifth (those passing the base rules) reach, less ``margin``. The threshold is read from a
    histogram of fixed step, so it does not depend on partitions.

    Nulls: a null text is empty and fails; a null doc_id is never trusted. Without trusted
    documents the base rules alone decide. Rows repeated are rated one by one. An empty table gives
    no rows. Other columns are ignored.
    """
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    weights = ngram_weights(docs, trusted.filter(~apart), buckets)
    rows = with_base_counts(docs.select("doc_id", "text").withColumn("row_no", F.monotonically_increasing_id()))
    keys = [c for c in rows.columns if c not in ("text", "hashes")]
    scored = (
        _with_features(rows, buckets)
        .join(F.broadcast(weights), "bucket", "left")  # a fixed number of buckets
        .groupBy(*keys)
        .agg(F.round(F.coalesce(F.avg("weight"), F.lit(0.0)), 6).alias("score"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    thin = stage(scored.withColumn("base_failed", failed), "scores")
    steps = F.floor(F.col("score") * SCORE_STEPS)
    reference = (
        thin.filter("not base_failed").filter(apart).join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy(steps.alias("step")).count().orderBy("step").collect()
    )  # one row per histogram step
    lowest, allowed = None, lost * sum(r["count"] for r in reference)
    for r in reference:
        if r["count"] > allowed:
            lowest = r["step"] / SCORE_STEPS - margin
            break
        allowed -= r["count"]
    passed = F.lit(True) if lowest is None else F.col("score") >= F.lit(lowest)
    return thin.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passed).alias("kept"), "score"
    )
