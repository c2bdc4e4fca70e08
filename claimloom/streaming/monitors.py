"""The monitors over streams of claims and relations.

Both run with the available-now trigger or continuously; state lives in the query's
checkpoint and in tables under the shared folder, so a lost executor or a restart
continues where the last finished batch ended.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.monitoring import search_hits
from ..plans.lineage import fresh_path


def read_table_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files, with the batch table's schema.

    A stream reads folders; a table that is one file is its folder narrowed to that name.
    """
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(location).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", location.getName()).parquet(location.getParent().toString())


def run_available(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> None:
    """Append everything available to a Parquet table and stop."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.start().awaitTermination()


def new_hit_stream(claims: DataFrame, searches: DataFrame, late: str = "7 days") -> DataFrame:
    """First appearance of each (search, claim) on a stream of search candidates.

    ``claims`` carries ``seen_at``; pairs are remembered for as long as the watermark
    reaches, which bounds the state.
    """
    hits = search_hits(claims, searches).withWatermark("seen_at", late)
    return hits.dropDuplicatesWithinWatermark(["search_id", "claim_id"])


def run_new_hits(spark: SparkSession, claims: DataFrame, searches: DataFrame, late: str = "7 days") -> DataFrame:
    """Run the hit stream over what is available and return the hits as a table."""
    out, state = fresh_path(spark, "hits"), fresh_path(spark, "hits-state")
    stream = new_hit_stream(claims, searches, late)
    run_available(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


class SnapshotMonitor:
    """Stance counts and retraction of watched members as keyed state, with alerts for what a batch brings.

    The state of a member is three values; a batch reads and writes those of the members that it
    touches and no others. Spark commits state and output of a batch together, so a retried batch
    neither counts nor alerts twice. A retraction alerts once, however often it is reported.
    """

    OUT = "set_id string, work_id string, alert_type string, gained long, support long, contradict long, retracted boolean"
    STATE = "support long, contradict long, retracted boolean"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def changes(self, stream: DataFrame) -> DataFrame:
        """One row per alert, and one without alert per touched member, with the member's new totals.

        ``stream``: set_id, work_id, stance, retracted; a null stance or retraction says nothing.
        """
        return (
            stream.filter("set_id is not null and work_id is not null")
            .select("set_id", "work_id", "stance", "retracted")
            .groupBy("set_id", "work_id")
            .applyInPandasWithState(_advance, self.OUT, self.STATE, "append", "NoTimeout")
        )

    def run(self, stream: DataFrame) -> None:
        """Take in all that is available and stop; a later run goes on from there."""
        run_available(self.changes(stream), f"{self.root}/changes", f"{self.root}/state")

    def alerts(self) -> DataFrame:
        """set_id, work_id, alert_type, gained of all alerts so far."""
        return self.spark.read.schema(self.OUT).parquet(f"{self.root}/changes").filter("alert_type <> ''").select("set_id", "work_id", "alert_type", "gained")

    def latest(self) -> DataFrame:
        """The newest totals of every member; totals never fall, so the largest are the newest."""
        rows = self.spark.read.schema(self.OUT).parquet(f"{self.root}/changes")
        return rows.groupBy("set_id", "work_id").agg(F.max("support").alias("support"), F.max("contradict").alias("contradict"), F.bool_or("retracted").alias("retracted"))


def _advance(key: tuple[str, str], parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A member's rows of one batch, a part at a time, added to its totals."""
    support, contradict, retracted = state.get if state.exists else (0, 0, False)
    before = (support, contradict, retracted)
    for part in parts:
        support += int((part["stance"] == "support").sum())
        contradict += int((part["stance"] == "contradict").sum())
        retracted = retracted or bool(part["retracted"].eq(True).any())
    state.update((support, contradict, retracted))
    alerts = [("new_support", support - before[0]), ("new_contradict", contradict - before[1]), ("retraction", int(retracted) - int(before[2])), ("", 0)]
    rows = [(*key, kind, gained, support, contradict, retracted) for kind, gained in alerts if gained or not kind]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SnapshotMonitor.OUT.split(", ")])
