"""How a cohort was selected, what it links, and how complete its records are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bibliometrics import named_authorships


def filter_funnel(records: DataFrame, steps: list[tuple[str, str, Column]]) -> DataFrame:
    """step, stage, criterion, entered, excluded, passed of ordered filters, from one reading of the records.

    ``steps``: (stage, criterion, condition); a null condition excludes. A record gets a bit mask of
    all conditions; the number of trailing ones tells the step that excludes it, so a
    table of as many rows as steps holds all counts. Step 0 is the identification of all records.
    """
    mask = F.lit(0)
    for i, (_, _, condition) in enumerate(steps):
        mask = mask + F.when(F.coalesce(condition, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
    lowest_zero = F.bitwise_not("mask").bitwiseAND(F.col("mask") + 1)  # the bits below it are the steps passed
    failed = records.select(mask.cast("long").alias("mask")).groupBy(F.bit_count(lowest_zero - 1).alias("at")).agg(F.count("*").alias("n"))
    names = [(0, "identification", "all records"), *((i + 1, s, c) for i, (s, c, _) in enumerate(steps))]
    table = records.sparkSession.createDataFrame(names, "step int, stage string, criterion string")
    counts = failed.agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("counts"))  # one row a step
    left = lambda step: F.expr(f"aggregate(map_entries(counts), 0L, (s, e) -> s + case when e.key >= {step} then e.value else 0L end)")
    joined = table.withColumn("counts", counts.scalar())
    entered = left("step - 1") if steps else left("0")
    return joined.select(
        "step", "stage", "criterion", F.when(F.col("step") == 0, left("0")).otherwise(entered).alias("entered"),
        F.when(F.col("step") == 0, F.lit(0).cast("long")).otherwise(entered - left("step")).alias("excluded"), left("step").alias("passed"),
    )


def field_values(works: DataFrame, authorships: DataFrame, countries: DataFrame, words: DataFrame, references: DataFrame, field: str) -> DataFrame:
    """(work_id, value) of one field of the works, each value once: authors, sources, countries, words or references."""
    made = {
        "authors": lambda: named_authorships(authorships).select("work_id", F.col("name").alias("value")),
        "sources": lambda: works.select("work_id", F.trim("venue").alias("value")),
        "countries": lambda: countries.select("work_id", F.col("country").alias("value")),
        "words": lambda: words.select("work_id", F.col("word").alias("value")),
        "references": lambda: references.select(F.col("citing_work_id").alias("work_id"), F.col("cited_work_id").alias("value")),
    }
    rows = made[field]().filter("value is not null and value <> ''").distinct()
    return rows.join(works.select("work_id"), "work_id", "left_semi")


def linked_fields(left: DataFrame, middle: DataFrame, right: DataFrame, top: int | None = None) -> DataFrame:
    """side, value, next_value, works: how many works link a value of one field with one of the next.

    The three fields are (work_id, value) as from ``field_values``; side is ``left`` for links from
    the left to the middle field and ``right`` for those on to the right. With ``top`` only links
    between the ``top`` values of each field, by works and then value, are counted, exactly.
    """

    def leading(rows: DataFrame) -> DataFrame:
        if top is None:
            return rows
        best = rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top).select("value")
        return rows.join(F.broadcast(best), "value", "left_semi")  # at most ``top`` rows

    def links(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
        both = a.join(b.withColumnRenamed("value", "next_value"), "work_id")
        return both.groupBy("value", "next_value").agg(F.count("*").alias("works")).select(F.lit(side).alias("side"), "value", "next_value", "works")

    one, two, three = (leading(f) for f in (left, middle, right))
    return links(one, two, "left").unionByName(links(two, three, "right"))


def completeness(records: DataFrame) -> DataFrame:
    """field, records, missing, missing_share, rating of every column, from one reading.

    A string of white space only, an empty array and NaN are missing. Ratings: complete, excellent (under 0.1
    missing), good (under 0.2), acceptable (under 0.5), poor, and completely missing.
    """

    def absent(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "string":
            return c.isNull() | (F.trim(c) == "")
        if kind.startswith(("array", "map")):
            return c.isNull() | (F.size(c) <= 0)
        return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()

    counted = records.agg(F.count("*").alias("_n"), *(F.count_if(absent(c, k)).alias(f"_{i}") for i, (c, k) in enumerate(records.dtypes)))
    entries = [F.struct(F.lit(c).alias("field"), F.col("_n").alias("records"), F.col(f"_{i}").alias("missing")) for i, c in enumerate(records.columns)]
    rows = counted.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    share = F.coalesce(F.try_divide(F.col("missing"), F.col("records")), F.lit(0.0))
    s = F.col("missing_share")
    rating = (
        F.when(s == 0, "complete").when(s == 1, "completely missing").when(s < 0.1, "excellent").when(s < 0.2, "good").when(s < 0.5, "acceptable").otherwise("poor")
    )
    return rows.withColumn("missing_share", share).withColumn("rating", rating)
