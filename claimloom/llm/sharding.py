"""Shards of near equal bytes by histogram sort, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stage

_BITS = 62  # keys are non-negative, so interval arithmetic stays inside a long


@dataclass
class _Search:
    """One splitter: where its byte target lies between two key boundaries."""

    target: float
    low: int = 0
    high: int = 1 << _BITS
    below: int = 0  # exact bytes below ``low``
    group: int | None = None  # the text key this search is confined to
    found: int | None = None
    stuck: bool = False


@dataclass(frozen=True)
class ShardPlan:
    """Splitters as (text key, row key); shard s holds the rows from splitter s - 1 up to splitter s."""

    splitters: list[tuple[int, int]] = field(default_factory=list)
    total_bytes: int = 0
    rounds: int = 0

    def shard(self, text_key: Column, row_key: Column) -> Column:
        """Number of splitters at or below a row."""
        out = F.lit(0)
        for group, row in self.splitters:
            above = (text_key > F.lit(group)) | ((text_key == F.lit(group)) & (row_key >= F.lit(row)))
            out = out + above.cast("int")
        return out


def keyed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` replaced by doc_id, text, size, text_crc32 and the two sort keys.

    Equal texts share ``text_key`` and so lie together in the sort order; ``row_key`` orders them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        "text",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - _BITS).alias("text_key"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - _BITS).alias("row_key"),
    )


def _round(rows: DataFrame, key: str, searches: list[_Search], probes: int, slack: float) -> None:
    """Count the bytes between ``probes`` boundaries of every open interval and narrow each search."""
    spans = sorted({(s.group if s.group is not None else -1, s.low, s.high) for s in searches})
    cell = F.lit(None).cast("long")
    steps = {}
    for i, (group, low, high) in enumerate(spans):
        step = steps[i] = max(1, -(-(high - low) // probes))
        inside = (F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high))
        if group >= 0:
            inside &= F.col("text_key") == F.lit(group)
        cell = F.when(inside, F.lit(i * probes) + F.expr(f"({key} - {low}L) div {step}L")).otherwise(cell)
    counted = (
        rows.groupBy(cell.alias("cell"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
        .filter("cell is not null")
        .collect()  # at most one row per probe
    )
    bins: dict[int, list] = {}
    for r in counted:
        bins.setdefault(r.cell // probes, []).append((r.cell % probes, r.bytes, r.n, r.first, r.last))
    place = {span: i for i, span in enumerate(spans)}
    for s in searches:
        i = place[(s.group if s.group is not None else -1, s.low, s.high)]
        step, before = steps[i], s.below
        s.found = s.high  # beyond every row, unless a cell crosses the target
        for number, size, n, first, last in sorted(bins.get(i, [])):
            if before + size < s.target:
                before += size
                continue
            low, high = s.low + number * step, min(s.high, s.low + (number + 1) * step)
            under, over = s.target - before, before + size - s.target
            s.found = None
            if min(under, over) <= slack:
                s.found = low if under <= over else high
            elif n == 1 or first == last and s.group is not None:
                s.found = first if under <= over else first + 1  # one row, or rows no key tells apart
            elif first == last:
                s.low, s.high, s.below, s.stuck = first, first + 1, before, True
            else:
                s.low, s.high, s.below = max(low, first), min(high, last + 1), before
            break


def plan_shards(rows: DataFrame, shards: int, tolerance: float, probes: int = 128) -> ShardPlan:
    """Find splitters by refining probes until each lies within ``tolerance`` of its target.

    ``rows`` has size, text_key and row_key and should be a written table: every round reads it
    once and returns at most one count per probe. The first search runs on the text key, so equal
    texts stay in one shard; only a group heavier than the tolerance is searched again by row key
    and cut. A splitter that cannot meet the tolerance because one row is too large goes to the
    nearer side of that row.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return ShardPlan()
    searches = [_Search(total * i / shards) for i in range(1, shards)]
    slack, rounds = tolerance * total / shards, 0
    while open_ := [s for s in searches if s.found is None and not s.stuck]:
        _round(rows, "text_key", open_, probes, slack)
        rounds += 1
    heavy = [s for s in searches if s.stuck]
    for s in heavy:
        s.group, s.low, s.high, s.stuck = s.low, 0, 1 << _BITS, False
    while open_ := [s for s in heavy if s.found is None]:
        _round(rows, "row_key", open_, probes, slack)
        rounds += 1
    splitters = [(s.found, 0) if s.group is None else (s.group, s.found) for s in searches]
    return ShardPlan(sorted(splitters), total, rounds)


def histogram_shards(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, slices: int = 64) -> DataFrame:
    """Assign every row to one of ``shards`` shards of near equal bytes, with a gapless slot in it.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32, shard and
    slot. Only these narrow columns move, in one exchange on (shard, slice of the row key); slots
    run over the slices and, in a slice, in sort order. A slice is a fixed part of the hash range,
    so copies of one text spread over all slices.

    Nulls: a null text counts as empty; null ids share a row key. Repeated rows (same id and text)
    cannot be told apart and stay in one shard. An empty table gives no rows. Other columns are
    ignored.
    """
    rows = stage(keyed(docs).drop("text"), "shard-keys")
    plan = plan_shards(rows, shards, tolerance)
    placed = rows.withColumn("shard", plan.shard(F.col("text_key"), F.col("row_key"))).withColumn(
        "slice", F.expr(f"row_key div {(1 << _BITS) // slices}L")
    )
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # shards x slices rows at most
    offsets = (
        placed.groupBy("shard", "slice").count().select("shard", "slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "slice").orderBy("text_key", "row_key", "doc_id")
    return (
        placed.withColumn("number", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number")).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.002, files: int = 4) -> ShardPlan:
    """Write doc_id and text as Parquet under ``path/shard=N``, moving each text once."""
    rows = keyed(docs)
    plan = plan_shards(stage(rows.drop("text"), "shard-keys"), shards, tolerance)
    part = F.pmod("row_key", F.lit(files))
    (
        rows.withColumn("shard", plan.shard(F.col("text_key"), F.col("row_key")))
        .repartition(shards * files, "shard", part)
        .sortWithinPartitions("shard", "text_key", "row_key")
        .select("doc_id", "text", "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
    return plan
