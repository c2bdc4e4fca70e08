"""Cohorts and bibliometric indicators over works, authorships, venues and countries.

``authorships(work_id, author)`` holds one row per author slot and
``affiliations(work_id, affiliation)`` one row per affiliation; ``long_form`` derives them
from array columns. ``degrees(work_id, citation_count)`` is the *global* in-degree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import author_key, strip
from ..functions.values import parse_country
from ..plans.ranking import with_global_position

def long_form(works: DataFrame, array_column: str, name: str) -> DataFrame:
    return works.select("work_id", F.explode(array_column).alias(name))


def first_k(ordered: DataFrame, k: int | None) -> DataFrame:
    """The first ``k`` rows, or all."""
    return ordered if k is None else ordered.limit(k)


# --- cohorts -----------------------------------------------------------------------------


def cohort(
    works: DataFrame,
    ids: DataFrame | None = None,
    min_year: int | None = None,
    max_year: int | None = None,
) -> DataFrame:
    """The works in ``ids`` (all works when None; none when it is empty) within the year
    bounds; an unknown year fails as soon as a bound is given."""
    out = works if ids is None else works.join(ids.select("work_id"), "work_id", "left_semi")
    if min_year is not None:
        out = out.filter(F.col("year") >= min_year)
    if max_year is not None:
        out = out.filter(F.col("year") <= max_year)
    return out


def saved_set_members(
    sets: DataFrame, members: DataFrame, kind: str, set_id: str, owner_id: str
) -> DataFrame:
    """Member ids of one saved set, empty unless the owner matches."""
    mine = sets.filter(
        (F.col("kind") == kind) & (F.col("set_id") == set_id) & (F.col("owner_id") == owner_id)
    )
    return members.join(mine.select("kind", "set_id"), ["kind", "set_id"], "left_semi").select("work_id").distinct()


def members_per_set(sets: DataFrame, members: DataFrame) -> DataFrame:
    counts = members.groupBy("kind", "set_id").agg(F.count("*").alias("member_count"))
    return sets.join(counts, ["kind", "set_id"], "left").withColumn(
        "member_count", F.coalesce("member_count", F.lit(0))
    )


# --- corpus summary ----------------------------------------------------------------------


def named_authorships(authorships: DataFrame) -> DataFrame:
    """Author slots with a non-blank name, with key and trimmed name."""
    return authorships.select(
        "work_id", author_key(F.col("author")).alias("author_key"), strip(F.col("author")).alias("name")
    ).filter(F.col("name") != "")


def annual_production(works: DataFrame) -> DataFrame:
    """Documents per year, dense between the first and the last year."""
    counts = works.filter(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("n"))
    span = counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).filter(F.col("lo").isNotNull())
    years = span.select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return years.join(counts, "year", "left").select(
        "year", F.coalesce("n", F.lit(0)).alias("document_count")
    )


def growth_rate(works: DataFrame) -> DataFrame:
    """Compound annual growth in percent between first and last year; null on one year."""
    counts = works.filter(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("n"))
    ends = counts.agg(
        F.min("year").alias("lo"),
        F.max("year").alias("hi"),
        F.min_by("n", "year").alias("first"),
        F.max_by("n", "year").alias("last"),
    )
    span = F.col("hi") - F.col("lo")
    return ends.select(
        F.when(span > 0, (F.pow(F.col("last") / F.col("first"), F.lit(1.0) / span) - 1) * 100).alias(
            "annual_growth_rate"
        )
    )


def corpus_summary(works: DataFrame, authorships: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row of descriptive counts over a cohort."""
    slots = named_authorships(authorships)
    per_work = slots.groupBy("work_id").agg(F.count("*").alias("slots"))
    venue = F.nullif(strip(F.col("venue")), F.lit(""))
    base = works.join(per_work, "work_id", "left").join(degrees, "work_id", "left")
    main = base.agg(
        F.count("*").alias("document_count"),
        F.coalesce(F.sum("slots"), F.lit(0)).alias("author_appearances"),
        F.count_if(F.col("slots") == 1).alias("single_authored_count"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.count_if(F.col("year").isNull()).alias("documents_without_year"),
        F.coalesce(F.sum("citation_count"), F.lit(0)).alias("total_citations"),
    )
    sources = works.select(venue.alias("v")).filter(F.col("v").isNotNull()).distinct().agg(
        F.count("*").alias("source_count")
    )
    people = (
        slots.join(works.select("work_id"), "work_id", "left_semi")
        .select("author_key")
        .distinct()
        .agg(F.count("*").alias("author_count"))
    )
    per_document = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("document_count")), F.lit(0.0))
    return main.select(
        "*",
        sources.scalar().alias("source_count"),
        people.scalar().alias("author_count"),
        per_document("author_appearances").alias("co_authors_per_doc"),
        per_document("total_citations").alias("avg_citations_per_doc"),
    )


def top_cited(works: DataFrame, degrees: DataFrame, k: int | None = None) -> DataFrame:
    """Most cited works of the cohort; uncited ones never appear."""
    cited = works.join(degrees, "work_id").filter(F.col("citation_count") > 0)
    ordered = cited.orderBy(F.desc("citation_count"), F.coalesce("title", F.lit("")), "work_id")
    return first_k(ordered, k).select("work_id", "title", "year", "citation_count")


def top_authors(works: DataFrame, authorships: DataFrame, k: int | None = None) -> DataFrame:
    documents = author_works(works, authorships).groupBy("author_key").agg(
        F.min("name").alias("name"), F.count("*").alias("document_count")
    )
    return first_k(documents.orderBy(F.desc("document_count"), "author_key"), k).select("name", "document_count")


def top_sources(works: DataFrame, k: int | None = None) -> DataFrame:
    venues = works.select(strip(F.col("venue")).alias("source")).filter(F.col("source") != "")
    counted = venues.groupBy("source").agg(F.count("*").alias("document_count"))
    return first_k(counted.orderBy(F.desc("document_count"), "source"), k)


# --- productivity and impact --------------------------------------------------------------


def author_works(works: DataFrame, authorships: DataFrame) -> DataFrame:
    """Distinct (author, work) with a deterministic display name."""
    return (
        named_authorships(authorships)
        .join(works.select("work_id"), "work_id", "left_semi")
        .groupBy("author_key", "work_id")
        .agg(F.min("name").alias("name"))
    )


def impact(group_works: DataFrame, key: str, degrees: DataFrame, *extra: Column) -> DataFrame:
    """Documents, citations and h-index per group.

    Works are first counted per (group, citation count). A group with ``c`` distinct counts
    holds more than ``c*c/2`` citations, so even a group with a third of all works shrinks
    to a short list before the cumulative window: h is the largest ``min(count, works with
    at least that count)``.
    """
    from pyspark.sql import Window

    counted = group_works.join(degrees, "work_id", "left").withColumn(
        "citation_count", F.coalesce("citation_count", F.lit(0))
    )
    histogram = counted.groupBy(key, "citation_count").agg(F.count("*").alias("n"), *extra)
    at_least = Window.partitionBy(key).orderBy(F.desc("citation_count")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    carried = [c for c in histogram.columns if c not in (key, "citation_count", "n")]
    return (
        histogram.withColumn("reach", F.sum("n").over(at_least))
        .groupBy(key)
        .agg(
            F.sum("n").alias("document_count"),
            F.sum(F.col("n") * F.col("citation_count")).alias("citation_count"),
            F.max(F.least("citation_count", "reach")).alias("h_index"),
            *[F.min(c).alias(c) for c in carried],
        )
    )


def author_metrics(works: DataFrame, authorships: DataFrame, degrees: DataFrame) -> DataFrame:
    """Per author: documents, citations, h-index."""
    return impact(
        author_works(works, authorships), "author_key", degrees, F.min("name").alias("name")
    )


def ranked_authors(metrics: DataFrame, k: int | None = None) -> DataFrame:
    ordered = metrics.orderBy(F.desc("document_count"), F.desc("h_index"), F.desc("citation_count"), "author_key")
    return first_k(ordered, k)


def lotka_points(works: DataFrame, authorships: DataFrame) -> DataFrame:
    """Number of authors for each number of documents."""
    documents = author_works(works, authorships).groupBy("author_key").agg(F.count("*").alias("documents"))
    return documents.groupBy("documents").agg(F.count("*").alias("authors"))


def lotka_fit(points: DataFrame) -> DataFrame:
    """Exponent and constant of the log-log fit; null below two productivity levels."""
    x, y = F.log10("documents"), F.log10("authors")
    fitted = points.agg(
        F.count("*").alias("levels"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )
    enough = F.col("levels") >= 2
    return fitted.select(
        "levels",
        F.when(enough, -F.col("slope")).alias("exponent"),
        F.when(enough, F.pow(F.lit(10.0), F.col("intercept"))).alias("constant"),
    )


def source_metrics(works: DataFrame, degrees: DataFrame) -> DataFrame:
    """Per venue: documents, citations, h-index and Bradford zone."""
    venues = works.select("work_id", strip(F.col("venue")).alias("source")).filter(F.col("source") != "")
    return bradford_zones(impact(venues, "source", degrees))


def bradford_zones(sources: DataFrame) -> DataFrame:
    """Zone 1-3 by where the middle of a venue's documents falls among thirds of all.

    Venues are ordered by documents descending, then name.
    """
    ranked = with_global_position(
        sources, [F.desc("document_count"), F.col("source")], "position", "document_count", "articles_before"
    )
    total = ranked.agg(F.sum("document_count")).scalar()
    middle = F.col("articles_before") + F.col("document_count") / 2
    zone = F.when(middle <= total / 3, 1).when(middle <= 2 * total / 3, 2).otherwise(3)
    return ranked.withColumn("zone", zone).drop("position", "articles_before")


def bradford_summary(zoned: DataFrame) -> DataFrame:
    """Venues and articles per zone; all three zones appear."""
    spark = zoned.sparkSession
    zones = spark.range(1, 4).select(F.col("id").cast("int").alias("zone"))
    counts = zoned.groupBy("zone").agg(
        F.count("*").alias("source_count"), F.sum("document_count").alias("article_count")
    )
    return zones.join(counts, "zone", "left").na.fill(0, ["source_count", "article_count"])


# --- countries ------------------------------------------------------------------------------


def work_countries(affiliations: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Distinct countries of each work; the array is bounded by the country table."""
    located = affiliations.select("work_id", parse_country(F.col("affiliation"), table).alias("country"))
    return (
        located.filter(F.col("country").isNotNull())
        .groupBy("work_id")
        .agg(F.collect_set("country").alias("countries"))
    )


def country_metrics(countries: DataFrame) -> DataFrame:
    """Single- and multi-country publications per country, most productive first."""
    rows = countries.select(F.explode("countries").alias("country"), (F.size("countries") > 1).alias("multi"))
    return (
        rows.groupBy("country")
        .agg(
            F.count("*").alias("document_count"),
            F.count_if(~F.col("multi")).alias("single_country"),
            F.count_if(F.col("multi")).alias("multi_country"),
        )
        .withColumn("mcp_ratio", F.col("multi_country") / F.col("document_count"))
        .orderBy(F.desc("document_count"), "country")
    )


def international_share(countries: DataFrame) -> DataFrame:
    """Documents with a known country and the percentage with several; null when none."""
    return countries.agg(
        F.count("*").alias("documents_with_country"),
        F.try_divide(F.count_if(F.size("countries") > 1) * 100.0, F.count("*")).alias("international_pct"),
    )
