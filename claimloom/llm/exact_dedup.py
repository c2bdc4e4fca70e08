"""Exact duplicates by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stage
from .common import apart_from, checked_broadcast, lower_ascii


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _refined(docs: DataFrame, prefix: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their (length, prefix) key, and the keys that more than one row has.

    Lower-casing A-Z changes no length, so lengths need no text work; the prefix is hashed only
    for lengths that occur twice.
    """
    length = F.octet_length(_text())
    lengths = stage(docs.groupBy(length.alias("length")).count().filter("count > 1").select("length"), "lengths")
    head = F.xxhash64(F.col("length"), lower_ascii(F.substring(_text(), 1, prefix)))
    repeated = (
        docs.select(_text().alias("text"), length.alias("length"))
        .join(checked_broadcast(lengths), "length", "left_semi")
        .groupBy(head.alias("prefix_key"))
        .count()
        .filter("count > 1")
        .select("prefix_key")
    )
    key = F.xxhash64(length, lower_ascii(F.substring(_text(), 1, prefix)))
    return docs.withColumn("prefix_key", key), stage(repeated, "prefixes")


def exact_duplicates(docs: DataFrame, prefix: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Rows are grouped by byte length, then
    by a hash of the first ``prefix`` characters, and only rows that still share a group have
    their full text hashed and grouped by it. ``digest_all`` fills text_sha256 for every row;
    without it the column is null where an earlier step told the row apart.

    Of a group the row with the largest doc_id stays; a null id loses to any other, and of rows
    with equal text and id exactly one stays. A null text counts as empty. An empty table gives
    no rows. Other columns are ignored.
    """
    rows, repeated = _refined(docs.select("doc_id", "text"), prefix)
    full = F.sha2(lower_ascii(_text()), 256)
    keys = repeated.withColumn("shared", F.lit(True))
    if digest_all:  # hashed before the join, so no text moves
        flagged = rows.select("doc_id", "prefix_key", full.alias("digest")).join(keys, "prefix_key", "left")
    else:
        flagged = rows.join(checked_broadcast(keys), "prefix_key", "left").withColumn("digest", F.when(F.col("shared"), full))
    thin = stage(
        flagged.select("doc_id", F.coalesce("shared", F.lit(False)).alias("shared"), "digest", F.monotonically_increasing_id().alias("row_no")),
        "digests",
    )
    shared = thin.filter("shared")
    groups = stage(
        shared.groupBy("digest").agg(F.max(F.struct("doc_id", "row_no")).alias("best"), F.count("*").alias("group_size")),
        "copies",
    )
    inside = shared.join(groups, "digest").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    alone = thin.filter("not shared").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256")
    )
    return inside.unionByName(alone)


@apart_from("doc_id", "text")
def drop_duplicates(docs: DataFrame, prefix: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only the (id, digest) pairs that go are matched against the texts. Rows repeated with the
    same id and text are told apart by nothing, so any one of them stays.
    """
    marked, repeated = _refined(docs.select("doc_id", "text"), prefix)
    full = F.sha2(lower_ascii(_text()), 256)
    keys = repeated.withColumn("shared", F.lit(True))
    pairs = stage(
        marked.join(checked_broadcast(keys), "prefix_key", "left_semi").groupBy("doc_id", full.alias("digest")).agg(F.count("*").alias("n")),
        "digests",
    )
    best = stage(pairs.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")).filter("group_size > 1"), "copies")
    losers = stage(
        pairs.join(best, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_lose_id"), F.col("digest").alias("_lose_digest")),
        "losers",
    )
    key = F.xxhash64(F.octet_length(_text()), lower_ascii(F.substring(_text(), 1, prefix)))
    shared = keys.select(F.col("prefix_key").alias("_prefix_key"), F.col("shared").alias("_shared"))
    own = list(docs.columns)
    rows = docs.withColumn("_prefix_key", key).join(checked_broadcast(shared), "_prefix_key", "left")
    rows = rows.withColumn("_digest", F.when(F.col("_shared"), full))
    same = rows["doc_id"].eqNullSafe(F.col("_lose_id")) & (rows["_digest"] == F.col("_lose_digest"))
    rows = rows.join(checked_broadcast(losers), same, "left_anti")
    twins = stage(pairs.filter("n > 1").select(F.col("doc_id").alias("_twin_id"), F.col("digest").alias("_twin_digest")), "twins")
    if twins.isEmpty():
        return rows.select(*own)
    twin = rows["doc_id"].eqNullSafe(F.col("_twin_id")) & (rows["_digest"] == F.col("_twin_digest"))
    single = rows.join(checked_broadcast(twins), twin, "left_anti").select(*own)
    merged = rows.join(checked_broadcast(twins), twin, "left_semi").dropDuplicates(["doc_id", "_digest"]).select(*own)
    return single.unionByName(merged)
