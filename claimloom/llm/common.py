"""What the operators of this package share: words, ASCII case, and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import string
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^ \t-\r]+"

#: A key table is broadcast by hint only up to this many rows; beyond it the join is left to Spark.
BROADCAST_KEYS = 500_000


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def checked_broadcast(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Hint a broadcast of a staged key table after counting it; above ``limit`` rows Spark shuffles."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def lowest_count(counted: DataFrame, limit: int, least: int = 1) -> int | None:
    """The count from which at most ``limit`` rows of a table with counts ``n`` are left; None if no class fits.

    The cut is read from a histogram of fixed size: one class per count up to 4096, then 64 per
    doubling.
    """
    step = F.when(F.col("n") <= 4096, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 4096)
    classes = counted.filter(F.col("n") >= least).groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("lowest")).collect()
    cut, room = None, limit
    for r in sorted(classes, key=lambda r: -r["step"]):
        room -= r["rows"]
        if room < 0:
            break
        cut = r["lowest"]
    return cut


def apart_from(*used: str) -> Callable:
    """For functions that return rows of their first argument: its other columns go by neutral names inside.

    So no column of a caller meets a name that the function or a join makes up; ``used`` are the
    columns the function reads. Names and order come back as they were.
    """

    def wrap(apply: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(apply)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            names = docs.columns
            inside = docs.toDF(*(c if c in used else f"extra{i}" for i, c in enumerate(names)))
            return apply(inside, *args, **kwargs).toDF(*names)

        return run

    return wrap


def give_back() -> None:
    """Hand memory that earlier work of this worker has freed back to the system; a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)
