"""Review: agreement of annotators, and a queue in one order that is read page by page."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans.lineage import stage
from ..plans.ranking import with_global_position

#: Smallest values whose cumulative Poisson(1) share a uniform number reaches; beyond twelve the share is 1 to 10 digits.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def label_pairs(annotations: DataFrame) -> DataFrame:
    """(task, item_id, first, second): labels of two annotators on one item, the smaller annotator first.

    ``annotations``: task, item_id, annotator, label. Rows without a label are left out; of several
    labels of one annotator the largest counts. An item with more annotators gives its two smallest.

    The rows of an item meet once; what follows needs no other exchange.
    """
    given = annotations.select("task", "item_id", "annotator", "label").dropna().repartition("task", "item_id")
    known = given.groupBy("task", "item_id", "annotator").agg(F.max("label").alias("label"))
    place = F.row_number().over(Window.partitionBy("task", "item_id").orderBy("annotator"))
    two = known.withColumn("_place", place).filter("_place <= 2").groupBy("task", "item_id")
    of = lambda i: F.max(F.when(F.col("_place") == i, F.col("label")))
    return two.agg(of(1).alias("first"), of(2).alias("second")).filter("second is not null")


def _cells(pairs: DataFrame) -> DataFrame:
    """Items per task and two labels, counted once for all that is read from them."""
    return stage(pairs.groupBy("task", "first", "second").agg(F.count("*").alias("n")), "cells")


def _kappa(cells: DataFrame, by: list[str]) -> DataFrame:
    """Observed and expected agreement and kappa of weighted contingency cells (first, second, n)."""
    marginal = lambda side: cells.groupBy(*by, F.col(side).alias("label")).agg(F.sum("n").alias(side))
    expected = marginal("first").join(marginal("second"), [*by, "label"]).groupBy(*by).agg(F.sum(F.col("first").cast("double") * F.col("second")).alias("both"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("items"), F.sum(F.when(F.col("first") == F.col("second"), F.col("n")).otherwise(0)).alias("same"))
    n = F.col("items").cast("double")
    rated = totals.join(expected, by, "left").select(*by, "items", (F.col("same") / n).alias("observed"), (F.coalesce("both", F.lit(0.0)) / (n * n)).alias("expected"))
    return rated.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """Per task: items, observed, expected, kappa; kappa is null where both always gave one and the same label."""
    return _kappa(_cells(pairs), ["task"])


def disagreements(pairs: DataFrame) -> DataFrame:
    """Per task and unequal pair of labels: items and share of all items, whichever annotator gave which."""
    cells = _cells(pairs)
    totals = cells.groupBy("task").agg(F.sum("n").alias("_all"))
    unequal = cells.filter("first <> second").select("task", F.least("first", "second").alias("label"), F.greatest("first", "second").alias("other_label"), "n")
    counts = unequal.groupBy("task", "label", "other_label").agg(F.sum("n").alias("items"))
    return counts.join(totals, "task").select("task", "label", "other_label", "items", (F.col("items") / F.col("_all")).alias("share"))


def poisson_weight(item: Column, replicate: Column, seed: int) -> Column:
    """How often a replicate draws an item: Poisson(1), from a uniform number that is a checksum of both and the seed."""
    uniform = F.crc32(F.concat_ws(":", F.lit(str(seed)), item.cast("string"), replicate.cast("string"))) / F.lit(2.0**32)
    return sum(((uniform >= edge).cast("long") for edge in _POISSON), F.lit(0).cast("long"))


#: Weights a task holds at a time, and the counts it keeps before it gives them on.
_BLOCK = 1 << 21


def _after(crcs: np.ndarray, length: int) -> np.ndarray:
    """The part of a checksum that it brings into that of a text longer by ``length`` bytes; the rest only depends on those."""
    zeros = bytes(length)
    step = lambda crc: zlib.crc32(zeros, crc) ^ zlib.crc32(zeros)
    out = np.zeros(len(crcs), np.uint32)
    for shift in (0, 8, 16, 24):
        out ^= np.array([step(byte << shift) for byte in range(256)], np.uint32)[(crcs >> shift) & 255]
    return out


def _drawn(batches: Iterator[pa.RecordBatch], replicates: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sums of `poisson_weight` per task, label pair and replicate, from rows of task, first, second and ``crc``.

    ``crc`` is the checksum up to the number of the replicate, which a table look-up and one exclusive
    or carry on, so no text is made for an item and a replicate.
    """
    numbers = [str(i).encode() for i in range(1, replicates + 1)]
    tails = np.array([zlib.crc32(number) for number in numbers], np.uint32)
    edges = [np.uint32(edge) for edge in (math.ceil(share * 2**32) for share in _POISSON) if edge < 2**32]
    sums: dict[tuple, np.ndarray] = {}

    def given_on():
        for key, counts in sums.items():
            drawn = np.flatnonzero(counts)
            columns = [pa.array([value] * len(drawn), schema.field(i).type) for i, value in enumerate(key)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(drawn + 1, pa.int32()), pa.array(counts[drawn], pa.int64())], schema=schema)
        sums.clear()

    for batch in batches:
        labels = [pc.dictionary_encode(batch.column(i), null_encoding="encode") for i in range(3)]
        codes = np.zeros(batch.num_rows, np.int64)
        for column in labels:
            codes = codes * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        crcs = batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint32)[order]
        codes = codes[order]
        values = [column.dictionary.to_pylist() for column in labels]
        rows = max(1, _BLOCK // replicates)
        for at in range(0, len(codes), rows):
            part = crcs[at : at + rows]
            carried = {length: _after(part, length) for length in {len(number) for number in numbers}}
            crc = np.stack([carried[len(number)] for number in numbers], axis=1) ^ tails
            weights = np.zeros(crc.shape, np.uint8)
            for edge in edges:
                weights += crc >= edge
            starts = np.flatnonzero(np.diff(codes[at : at + rows], prepend=-1))
            for code, counts in zip(codes[at + starts], np.add.reduceat(weights, starts, axis=0, dtype=np.int64)):
                key = []
                for known in reversed(values):
                    code, i = divmod(int(code), len(known))
                    key.insert(0, known[i])
                key = tuple(key)
                sums[key] = sums[key] + counts if key in sums else counts
            if len(sums) * replicates > _BLOCK:
                yield from given_on()
    yield from given_on()


def kappa_interval(pairs: DataFrame, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Per task: kappa_low and kappa_high, the bootstrap interval of Cohen's kappa.

    Every replicate draws each item a Poisson number of times, which for many items is the
    multinomial bootstrap and needs no second look at the data. An item is one row however many
    replicates there are; only counts of label pairs per replicate are shuffled. The bounds are
    order statistics of the replicates' kappas; seed, task and item ids decide them.
    """
    item = F.concat_ws("/", "task", "item_id")
    begun = pairs.select("task", "first", "second", F.crc32(F.concat_ws(":", F.lit(str(seed)), item, F.lit(""))).alias("crc"))
    fields = [*begun.schema.fields[:3], StructField("replicate", IntegerType()), StructField("n", LongType())]
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    plain = to_arrow_schema(schema)
    drawn = begun.mapInArrow(lambda batches: _drawn(batches, replicates, plain), schema)
    cells = stage(drawn.groupBy("task", "replicate", "first", "second").agg(F.sum("n").alias("n")), "cells")
    kappas = _kappa(cells, ["task", "replicate"]).filter("kappa is not null")
    ordered = kappas.groupBy("task").agg(F.sort_array(F.collect_list("kappa")).alias("k"))  # one a replicate
    at = lambda share: F.col("k")[F.floor(F.lit(share) * (F.size("k") - 1) + 0.5).cast("int")]
    tail = (1 - level) / 2
    return ordered.select("task", at(tail).alias("kappa_low"), at(1 - tail).alias("kappa_high"))


# --- queue -------------------------------------------------------------------------------------

_PRIORITIES = {
    "confidence": lambda: [F.asc_nulls_first("confidence"), F.desc("contested"), F.desc("value")],
    "contested": lambda: [F.desc("contested"), F.asc_nulls_first("confidence"), F.desc("value")],
    "value": lambda: [F.desc("value"), F.desc("contested"), F.asc_nulls_first("confidence")],
}


def review_queue(items: DataFrame, first: str = "confidence") -> DataFrame:
    """``items`` with their ``position`` (from 1) in one order: least sure, contested, or high value first.

    ``items``: assertion_id (unique), confidence, contested, value. ``first`` names the leading
    priority; the others break its ties, the id the rest. An item without confidence is the least
    sure; contested and value count as no and 0 where null. The rows are ranged once, so a value
    that all items share is split like any other, and every later page is a filter.
    """
    if first not in _PRIORITIES:
        raise ValueError(f"unknown priority {first}")
    known = items.select("assertion_id", "confidence", F.coalesce("contested", F.lit(False)).alias("contested"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    return with_global_position(known, [*_PRIORITIES[first](), F.asc("assertion_id")])


def queue_page(queue: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of a queue, without any other page."""
    return queue.filter((F.col("position") > number * size) & (F.col("position") <= (number + 1) * size))


def queue_after(queue: DataFrame, assertion_id: str, size: int) -> DataFrame:
    """The ``size`` items behind an item, wherever it now stands; none if it is not in the queue."""
    place = queue.filter(F.col("assertion_id") == assertion_id).agg(F.max("position")).scalar()
    return queue.filter((F.col("position") > place) & (F.col("position") <= place + size))
