"""Materialising intermediate results where a lost executor cannot lose them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Of staged files: ids and texts take about two thirds of what the default leaves of them.
COMPRESSION = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one ``spark.checkpoint.dir`` names.

    Where the setting is missing, as in tests, local mode gets a temporary folder that goes when
    the process ends; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="claimloom-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
        configured = spark.sparkContext.getCheckpointDir()
    return f"{configured.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Remove what this application has staged; call it when no result is read any more."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if ":" in (folder := shared_folder(spark)) else (fs.LocalFileSystem(), folder)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, fixes non-deterministic choices (sampled range bounds), and gives
    the next step real sizes to plan with.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_distinct(df: DataFrame, label: str) -> DataFrame:
    """The distinct rows of ``df``, made once: what a loop starts from and counts."""
    return stage(df.distinct(), label)
