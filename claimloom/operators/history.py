"""Histories of a cohort: direct-citation history, reference-year spectra, and logistic life cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stage

# --- historiograph ---------------------------------------------------------------------------


def local_citation_scores(works: DataFrame, pairs: DataFrame) -> DataFrame:
    """The works of a cohort with ``local_citations``, the citations from inside the cohort."""
    ids = works.select("work_id")
    inside = pairs.select("citing_work_id", "cited_work_id").distinct().join(ids.withColumnRenamed("work_id", "citing_work_id"), "citing_work_id", "left_semi")
    counts = inside.groupBy(F.col("cited_work_id").alias("work_id")).agg(F.count("*").alias("local_citations"))
    return works.join(counts, "work_id", "left").fillna(0, "local_citations")


def historiograph(works: DataFrame, pairs: DataFrame, per_year: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (work_id, title, year, local_citations, rank) and edges of the history of a cohort.

    Each year's ``per_year`` works with most local citations stay, ties to the smaller id; works
    without a year or never cited inside stand in no history. An edge leads from a citing to a
    cited node and never forward in time.
    """
    scored = local_citation_scores(works, pairs).filter("year is not null and local_citations > 0")
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("local_citations"), "work_id"))
    nodes = stage(scored.withColumn("rank", rank).filter(F.col("rank") <= per_year).select("work_id", "title", "year", "local_citations", "rank"), "nodes")
    end = lambda side: nodes.select(F.col("work_id").alias(f"{side}_work_id"), F.col("year").alias(f"{side}_year"))
    edges = pairs.select("citing_work_id", "cited_work_id").distinct().join(end("citing"), "citing_work_id").join(end("cited"), "cited_work_id")
    return nodes, edges.filter("citing_year >= cited_year")


# --- reference years ------------------------------------------------------------------------


def reference_spectrum(references: DataFrame, reach: int = 2) -> DataFrame:
    """year, references, median, deviation: cited references by their year, against the median of the years around.

    ``references``: cited_year, one row per reference; rows without a year are left out. Years
    without references count 0; the window of ``reach`` years to either side is cut at the ends.
    The histogram is first made, so what is windowed has one row a year.
    """
    counts = references.filter("cited_year is not null").groupBy("cited_year").agg(F.count("*").alias("n"))
    span = counts.agg(F.min("cited_year").alias("low"), F.max("cited_year").alias("high")).filter("low is not null")
    dense = span.select(F.explode(F.sequence("low", "high")).alias("cited_year")).join(counts, "cited_year", "left").fillna(0, "n")
    around = Window.orderBy("cited_year").rowsBetween(-reach, reach)
    near = dense.withColumn("near", F.sort_array(F.collect_list("n").over(around)))
    middle = F.expr("(near[(size(near) - 1) div 2] + near[size(near) div 2]) / 2.0D")
    return near.select(F.col("cited_year").alias("year"), F.col("n").alias("references"), middle.alias("median")).withColumn("deviation", F.col("references") - F.col("median"))


def reference_classes(citations: DataFrame, min_citations: int = 1, early: int = 3) -> DataFrame:
    """cited_work_id, cited_year, citations, sequence, class of every reference cited ``min_citations`` times.

    ``citations``: cited_work_id, cited_year, citing_year. ``sequence`` has a sign for each citing
    year from the cited year (or the first citing year) to the last of the corpus: + where the
    reference is cited over one standard deviation more than all references of its year are on
    average, - for as much less, else 0. Of the classes the first that holds counts: ``sleeping
    beauty`` (below average in each of the ``early`` first years, above in a later one), ``hot
    paper`` (above in one of them, and in none of the years after that), ``life cycle`` (above
    somewhere, later below), ``constant performer`` (never below), else ``other``.
    """
    rows = citations.filter("cited_year is not null and citing_year is not null and citing_year >= cited_year")
    per = rows.groupBy("cited_work_id", "cited_year", "citing_year").agg(F.count("*").alias("n"))
    kept = per.groupBy("cited_work_id", "cited_year").agg(F.sum("n").alias("citations"))
    ends = per.agg(F.min("citing_year").alias("low"), F.max("citing_year").alias("high"))
    cohort = kept.groupBy("cited_year").agg(F.count("*").alias("size"))
    year = per.groupBy("cited_year", "citing_year").agg(F.sum("n").alias("sum"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    # years in which a reference is not cited count as 0 in its cohort's mean
    mean = F.col("sum") / F.col("size")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("size") - mean * mean, F.lit(0.0)))
    norms = year.join(cohort, "cited_year").groupBy("cited_year").agg(F.map_from_entries(F.collect_list(F.struct("citing_year", F.struct(mean.alias("mean"), spread.alias("spread")).alias("norm")))).alias("norms"))
    counts = per.groupBy("cited_work_id", "cited_year").agg(F.map_from_entries(F.collect_list(F.struct("citing_year", "n"))).alias("counts"))
    joined = kept.filter(F.col("citations") >= min_citations).join(counts, ["cited_work_id", "cited_year"]).join(F.broadcast(norms), "cited_year")  # one row a year
    joined = joined.withColumn("low", F.greatest("cited_year", ends.select("low").scalar())).withColumn("high", ends.select("high").scalar())
    sign = """array_join(transform(sequence(low, high), y -> case
        when norms[y] is null then '0'
        when coalesce(counts[y], 0) > norms[y].mean + norms[y].spread then '+'
        when coalesce(counts[y], 0) < norms[y].mean - norms[y].spread then '-' else '0' end), '')"""
    seq = F.col("sequence")
    named = (
        F.when(seq.rlike(rf"^-{{{early}}}.*\+"), "sleeping beauty")
        .when(seq.rlike(rf"^.{{0,{early - 1}}}\+") & ~seq.rlike(rf"^.{{{early},}}\+"), "hot paper")
        .when(seq.rlike(r"\+.*-"), "life cycle")
        .when(~seq.contains("-"), "constant performer")
        .otherwise("other")
    )
    return joined.withColumn("sequence", F.expr(sign)).select("cited_work_id", "cited_year", "citations", "sequence", named.alias("class"))


# --- life cycle -------------------------------------------------------------------------------

_STATE = "capacity midpoint scale".split()


def _solved(a: list[list[Column]], g: list[Column]) -> list[Column]:
    """The solution of three linear equations, by determinants."""

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    whole = det(a)
    return [F.try_divide(det([[g[r] if c == i else a[r][c] for c in range(3)] for r in range(3)]), whole) for i in range(3)]


def _series(production: DataFrame) -> DataFrame:
    """field, year, documents, total: dense years of each field with the running total."""
    counts = production.filter("year is not null").groupBy("field", "year").agg(F.sum("documents").alias("documents"))
    span = counts.groupBy("field").agg(F.min("year").alias("low"), F.max("year").alias("high"))
    dense = span.select("field", F.explode(F.sequence("low", "high")).alias("year")).join(counts, ["field", "year"], "left").fillna(0, "documents")
    return dense.withColumn("total", F.sum("documents").over(Window.partitionBy("field").orderBy("year")).cast("double"))


def life_cycle(production: DataFrame, rounds: int = 40) -> DataFrame:
    """field, years, total, capacity, midpoint, duration, rmse, r2, stage: a logistic curve fitted to each field's totals.

    ``production``: field, year, documents. The running total follows
    ``capacity / (1 + exp(-(year - midpoint) / scale))``; ``duration`` (ln 81 times scale) is the
    time from a tenth to nine tenths of the capacity. The least squares are found by damped
    Gauss-Newton steps: a round sums residuals and derivatives of all fields in one aggregation
    and solves each field's three equations in columns; a step that makes the fit worse is taken
    back and damped more. Fields with fewer than four years have null parameters. The stage is
    emergence below a tenth of the capacity, growth below half, maturity below nine tenths, else
    saturation.
    """
    series = stage(_series(production), "series")
    start = series.groupBy("field").agg(F.count("*").alias("years"), F.max("total").alias("total"), F.min("year").alias("low"), F.max("year").alias("high"))
    half = series.join(start.select("field", (F.col("total") * 0.55).alias("half")), "field").filter(F.col("total") >= F.col("half"))
    half = half.groupBy("field").agg(F.min("year").cast("double").alias("midpoint"))
    zero = [F.lit(0.0).alias(c) for c in ("a00", "a01", "a02", "a11", "a12", "a22", "g0", "g1", "g2")]
    state = start.filter("years >= 4").join(half, "field").select(
        "field", *(F.lit(0.0).alias(c) for c in _STATE), F.lit(float("inf")).alias("loss"), F.lit(0.001).alias("damping"),
        (F.col("total") * 1.1).alias("try_capacity"), F.col("midpoint").alias("try_midpoint"), F.greatest((F.col("high") - F.col("low")) / 6.0, F.lit(0.5)).alias("try_scale"), *zero,
    )
    sums = "a00 a01 a02 a11 a12 a22 g0 g1 g2".split()
    for _ in range(rounds):
        x = (F.col("year") - F.col("try_midpoint")) / F.col("try_scale")
        share = 1 / (1 + F.exp(F.greatest(F.least(-x, F.lit(500.0)), F.lit(-500.0))))
        slope = F.col("try_capacity") * share * (1 - share) / F.col("try_scale")
        d = [share, -slope, -slope * x]
        points = series.join(state.select("field", *(f"try_{c}" for c in _STATE)), "field")
        points = points.select("field", (F.col("total") - F.col("try_capacity") * share).alias("r"), *(c.alias(f"d{i}") for i, c in enumerate(d)))
        product = lambda p, q: F.sum(F.col(p) * F.col(q))
        tried = points.groupBy("field").agg(
            product("r", "r").alias("new_loss"), *(product(f"d{i}", f"d{j}").alias(f"new_a{i}{j}") for i in range(3) for j in range(i, 3)), *(product(f"d{i}", "r").alias(f"new_g{i}") for i in range(3))
        )
        better = F.col("new_loss") < F.col("loss")
        moved = state.join(tried, "field").select(
            "field",
            *(F.when(better, F.col(f"try_{c}")).otherwise(F.col(c)).alias(c) for c in _STATE),
            F.when(better, F.col("new_loss")).otherwise(F.col("loss")).alias("loss"),
            F.when(better, F.greatest(F.col("damping") / 5, F.lit(1e-12))).otherwise(F.least(F.col("damping") * 7, F.lit(1e12))).alias("damping"),
            *(F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in sums),
        )
        a = [[F.col(f"a{min(i, j)}{max(i, j)}") * ((1 + F.col("damping")) if i == j else F.lit(1.0)) for j in range(3)] for i in range(3)]
        step = [F.coalesce(s, F.lit(0.0)) for s in _solved(a, [F.col(f"g{i}") for i in range(3)])]
        low = (F.lit(1e-6), F.lit(-1e6), F.lit(0.02))
        state = stage(moved.select("*", *(F.greatest(F.col(c) + s, least).alias(f"try_{c}") for c, s, least in zip(_STATE, step, low, strict=True))), "fit")
    spread = series.groupBy("field").agg(F.count("*").alias("n"), F.var_pop("total").alias("variance"))
    fitted = state.join(spread, "field").select(
        "field", "capacity", "midpoint", (F.col("scale") * math.log(81)).alias("duration"), F.sqrt(F.col("loss") / F.col("n")).alias("rmse"),
        (1 - F.try_divide(F.col("loss"), F.col("n") * F.col("variance"))).alias("r2"),
    )
    reached = F.col("total") / F.col("capacity")
    named = F.when(reached < 0.1, "emergence").when(reached < 0.5, "growth").when(reached < 0.9, "maturity").when(reached.isNotNull(), "saturation")
    return start.select("field", "years", "total").join(fitted, "field", "left").withColumn("stage", named)


def life_cycle_curve(production: DataFrame, fitted: DataFrame, forecast_years: int = 0) -> DataFrame:
    """field, year, observed, fitted: running totals beside the curve, and ``forecast_years`` more of the curve."""
    series = _series(production)
    last = series.groupBy("field").agg(F.max("year").alias("last"))
    more = last.select("field", F.explode(F.sequence(F.col("last") + 1, F.col("last") + forecast_years)).alias("year")) if forecast_years else None
    points = series.select("field", "year", F.col("total").alias("observed"))
    points = points if more is None else points.unionByName(more, allowMissingColumns=True)
    curve = F.col("capacity") / (1 + F.exp(-(F.col("year") - F.col("midpoint")) / (F.col("duration") / math.log(81))))
    return points.join(fitted.filter("capacity is not null"), "field").select("field", "year", "observed", curve.alias("fitted"))
