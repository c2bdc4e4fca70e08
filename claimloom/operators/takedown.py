"""Takedowns: records stay, their content goes, in every table that was derived from it.

A store is a folder of tables in buckets of their key, with a manifest that says which files are
current. A change writes new files for the touched buckets only, and becomes visible in one step,
when its manifest version is written last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.keys import possibly_in
from ..plans.lineage import COMPRESSION, stage

_MANIFEST = "version long, table string, bucket int, path string"
#: Columns every stored table has beside its own.
MARKS = "tombstone_id string, removed_reason string"


@dataclass(frozen=True)
class Dependent:
    """How a table hangs on removed works.

    ``key`` names its rows, ``parent`` the column with the key of ``of`` (the work itself, or
    another table) and ``content`` the columns to blank.
    """

    key: str
    parent: str
    of: str
    content: tuple[str, ...]


def standing_takedowns(tombstones: DataFrame) -> DataFrame:
    """(work_id, tombstone_id, removed_reason): works whose latest tombstone removes them.

    ``tombstones``: tombstone_id, work_id, action (remove or lift), reason, requested_at. They are
    merged in the order of request and id, whatever order they come in; repeats change nothing.
    """
    latest = F.max_by(F.struct("action", "tombstone_id", "reason"), F.struct("requested_at", "tombstone_id"))
    last = tombstones.filter("work_id is not null and requested_at is not null and tombstone_id is not null").groupBy("work_id").agg(latest.alias("last"))
    return last.filter("last.action = 'remove'").select("work_id", "last.tombstone_id", F.col("last.reason").alias("removed_reason"))


def touched_keys(takedowns: DataFrame, tables: dict[str, DataFrame], dependents: dict[str, Dependent]) -> dict[str, DataFrame]:
    """For each table the keys of its rows that hang on a removed work, with tombstone_id and removed_reason.

    Follows the chain of tables from the removed works down, so only few rows join at each step. A
    row that hangs on several removed works bears the smallest tombstone_id.
    """
    known = {"work": stage(takedowns.withColumnRenamed("work_id", "_parent"), "takedown")}
    out: dict[str, DataFrame] = {}
    for name, d in dependents.items():
        rows = tables[name].select(F.col(d.key).alias("_key"), F.col(d.parent).alias("_parent"))
        near = possibly_in(rows, "_parent", known[d.of].select("_parent")).filter("_possible").drop("_possible")
        hit = near.join(known[d.of], "_parent").groupBy("_key").agg(F.min(F.struct("tombstone_id", "removed_reason")).alias("mark"))
        out[name] = stage(hit.select("_key", "mark.*"), "takedown")
        known[name] = out[name].withColumnRenamed("_key", "_parent")
    return out


def blank_content(table: DataFrame, keys: DataFrame, dependent: Dependent) -> DataFrame:
    """The rows of ``table``, with the content of those in ``keys`` null and their tombstone beside it.

    Content that an earlier takedown has blanked stays blank, and its tombstone stays. Rows that a filter
    of the keys rules out stay where they are; only the others are exchanged.
    """
    had = {c.split()[0]: c.split()[1] for c in MARKS.split(", ")}
    rows = table.withColumns({c: F.lit(None).cast(kind) for c, kind in had.items() if c not in table.columns})
    new = keys.select(F.col("_key").alias(dependent.key), F.col("tombstone_id").alias("_new_id"), F.col("removed_reason").alias("_new_reason"))
    near = possibly_in(rows, dependent.key, keys.select("_key"))
    rest = near.filter("not _possible").withColumns({c: F.lit(None).cast("string") for c in ("_new_id", "_new_reason")})
    joined = near.filter("_possible").join(new, dependent.key, "left").unionByName(rest)
    gone = F.col("tombstone_id").isNotNull() | F.col("_new_id").isNotNull()
    kept = {c: F.when(~gone, F.col(c)) for c in dependent.content}
    first = F.col("tombstone_id").isNull()
    marks = {"removed_reason": F.when(first, F.col("_new_reason")).otherwise(F.col("removed_reason")), "tombstone_id": F.coalesce("tombstone_id", "_new_id")}
    return joined.withColumns({**kept, **marks}).select(*rows.columns)


# --- store -------------------------------------------------------------------------------------


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _publish(spark: SparkSession, folder: str, rows: list[tuple]) -> None:
    """One small file; readers see a version once its commit is done."""
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def current_version(spark: SparkSession, folder: str) -> int:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").agg(F.max("version")).first()[0]


def _entries(spark: SparkSession, folder: str, version: int | None = None) -> list[tuple[str, int, str]]:
    """(table, bucket, path) of a version; as many as there are buckets."""
    version = current_version(spark, folder) if version is None else version
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").filter(F.col("version") == version)
    return sorted((r.table, r.bucket, r.path) for r in rows.collect())


def create_store(spark: SparkSession, folder: str, tables: dict[str, DataFrame], dependents: dict[str, Dependent], buckets: int = 16) -> None:
    """Write the first version of all tables, in ``buckets`` by hash of their key."""
    rows = []
    for name, table in tables.items():
        marked = table.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in MARKS.split(", ") if c.split()[0] not in table.columns})
        spread = marked.withColumn("bucket", _bucket(dependents[name].key, buckets))
        spread.write.option("compression", COMPRESSION).partitionBy("bucket").parquet(f"{folder}/{name}/v0")  # each task a file a bucket: no exchange, no task with a whole bucket
        written = spark.read.schema(spread.schema).parquet(f"{folder}/{name}/v0")
        spread.limit(0).drop("bucket").write.parquet(f"{folder}/{name}/empty")  # its columns, should it have no rows
        rows += [(0, name, b, f"{folder}/{name}/v0/bucket={b}") for b in _values(written, "bucket")] + [(0, name, -1, f"{folder}/{name}/empty")]
    _publish(spark, folder, rows)


def _values(frame: DataFrame, column: str) -> list:
    return sorted(r[0] for r in frame.select(column).distinct().collect())  # at most one a bucket


def read_table(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the current or a given version."""
    paths = [path for table, _, path in _entries(spark, folder, version) if table == name]
    empty = next(p for p in paths if p.endswith("/empty"))
    return spark.read.schema(spark.read.parquet(empty).schema).parquet(*paths)


def apply_takedowns(spark: SparkSession, folder: str, tombstones: DataFrame, dependents: dict[str, Dependent], buckets: int = 16) -> int:
    """Blank all that hangs on removed works, and return the version that is current then.

    Only buckets with a row still to be blanked are rewritten. Where none has, as in a replay, no
    version is made. A run that fails before its manifest is written leaves the store as it was,
    and files under a number that the next run takes anew.
    """
    entries = _entries(spark, folder)
    tables = {name: read_table(spark, folder, name) for name in dependents}
    keys = touched_keys(standing_takedowns(tombstones), tables, dependents)
    version, rows = current_version(spark, folder), {(name, b): path for name, b, path in entries}
    changed = False
    for name, d in dependents.items():
        own = possibly_in(tables[name].filter("tombstone_id is null").select(F.col(d.key).alias("_key")), "_key", keys[name].select("_key"))
        still = own.filter("_possible").join(keys[name], "_key", "left_semi")
        touched = _values(still.withColumn("bucket", _bucket("_key", buckets)), "bucket")
        if touched:  # one job for all of them
            path = f"{folder}/{name}/v{version + 1}"
            part = spark.read.schema(tables[name].schema).parquet(*(rows[name, b] for b in touched))
            blanked = blank_content(part, keys[name], d).withColumn("bucket", _bucket(d.key, buckets))
            blanked.write.mode("overwrite").option("compression", COMPRESSION).partitionBy("bucket").parquet(path)
            rows |= {(name, b): f"{path}/bucket={b}" for b in touched}
            changed = True
    if not changed:
        return version
    _publish(spark, folder, [(version + 1, name, b, path) for (name, b), path in rows.items()])
    return version + 1


def vacuum(spark: SparkSession, folder: str) -> list[str]:
    """Delete the files that only earlier versions name, which still hold what was taken down, and return their paths."""
    from pyarrow import fs

    current = {path for _, _, path in _entries(spark, folder)}
    named = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("path").distinct().collect()
    stale = sorted(r.path for r in named if r.path not in current)
    for path in stale:
        store, plain = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        if store.get_file_info(plain).type == fs.FileType.Directory:
            store.delete_dir(plain)
    return stale
