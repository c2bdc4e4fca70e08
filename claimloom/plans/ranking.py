"""Global positions and running totals without a one-task window over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def with_global_position(
    df: DataFrame,
    order_by: list[Column],
    position: str = "position",
    weight: str | None = None,
    total_before: str = "total_before",
) -> DataFrame:
    """Add the 1-based position of each row in ``order_by`` order and, with ``weight``,
    the sum of the weights of all earlier rows.

    ``order_by`` must end in a unique key: then range partitioning can split any hot
    value. The rows are range partitioned, sorted and staged once; only one summary row
    per partition meets in a single window.
    """
    ordered = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _ROW_BITS))
        .withColumn("_row", F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_id")
    )
    staged = stage(ordered, "ranked")
    weight_sum = F.sum(weight) if weight else F.lit(0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_part")
        .agg(F.count("*").alias("_n"), weight_sum.alias("_w"))
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_weight_before"),
        )
    )
    # one row per range partition: bounded by spark.sql.shuffle.partitions
    joined = staged.join(F.broadcast(offsets), "_part")
    out = joined.withColumn(position, F.col("_rows_before") + F.col("_row") + 1)
    if weight:
        within = (
            Window.partitionBy("_part")
            .orderBy("_row")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        out = out.withColumn(
            total_before,
            F.col("_weight_before") + F.coalesce(F.sum(weight).over(within), F.lit(0)),
        )
    return out.drop("_part", "_row", "_rows_before", "_weight_before")
