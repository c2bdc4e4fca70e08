"""Citation pairs, degrees, tallies of how work is cited, and the per-paper report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import spread_nulls


def usable_pairs(edges: DataFrame) -> DataFrame:
    """Both ends present, no self-citation."""
    citing, cited = F.col("citing_work_id"), F.col("cited_work_id")
    return edges.filter(citing.isNotNull() & cited.isNotNull() & (citing != cited))


def mention_pairs(mentions: DataFrame, passages: DataFrame, versions: DataFrame) -> DataFrame:
    """Edges implied by in-text mentions: mention to passage to version to citing work."""
    return (
        mentions.filter(F.col("cited_work_id").isNotNull())
        .join(passages.select("passage_id", "paper_version_id"), "passage_id")
        .join(
            versions.select(
                F.col("version_id").alias("paper_version_id"), F.col("work_id").alias("citing_work_id")
            ),
            "paper_version_id",
        )
        .select(
            "citing_work_id",
            "cited_work_id",
            F.lit("extracted").alias("source"),
            F.lit(None).cast("boolean").alias("is_influential"),
        )
    )


def citation_pairs(*edge_sets: DataFrame) -> DataFrame:
    """One row per (citing, cited): sorted source names and three-valued influence."""
    columns = ["citing_work_id", "cited_work_id", "source", "is_influential"]
    edges = edge_sets[0].select(*columns)
    for more in edge_sets[1:]:
        edges = edges.unionByName(more.select(*columns))
    return (
        usable_pairs(edges)
        .groupBy("citing_work_id", "cited_work_id")
        .agg(
            F.sort_array(F.collect_set("source")).alias("sources"),
            F.max("is_influential").alias("is_influential"),
        )
    )


def citation_in_degree(*edge_sets: DataFrame) -> DataFrame:
    """``(work_id, citation_count)`` over distinct pairs of all edge sets."""
    pairs = edge_sets[0].select("citing_work_id", "cited_work_id")
    for more in edge_sets[1:]:
        pairs = pairs.unionByName(more.select("citing_work_id", "cited_work_id"))
    return (
        usable_pairs(pairs)
        .distinct()
        .groupBy(F.col("cited_work_id").alias("work_id"))
        .agg(F.count("*").alias("citation_count"))
    )


def citation_degrees(works: DataFrame, pairs: DataFrame) -> DataFrame:
    """Global cited-by and reference counts of every work, 0 when none.

    Both counts come from one aggregation over the pairs seen from either end.
    """
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("cited_work_id").alias("work_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("citing_work_id").alias("work_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    counts = ends.groupBy("work_id").agg(
        F.sum("i").alias("cited_by_count"), F.sum("o").alias("reference_count")
    )
    return works.join(counts, "work_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("cited_by_count", "reference_count")}
    )


def incoming_relations(relations: DataFrame, claim_works: DataFrame) -> DataFrame:
    """Relations keyed by the work they cite, directly or through a target claim.

    ``claim_works`` maps ``interpretation_id`` to ``work_id`` (superseded ones included).
    Each relation joins once and then yields its one or two distinct works, so neither an
    OR join nor a dedup shuffle is needed. Relations without a target are scattered by the works
    they name, so that their long ids need not travel where nobody reads them.
    """
    target = claim_works.select(
        F.col("interpretation_id").alias("_target"), F.col("work_id").alias("_target_work")
    )
    by = ("citing_work_id", "cited_work_id") if "citing_work_id" in relations.columns else ("assertion_id",)
    keyed = relations.withColumn("_target", spread_nulls(F.col("target_interpretation_id"), *map(F.col, by)))
    works = F.array_distinct(F.array_compact(F.array("cited_work_id", "_target_work")))
    return (
        keyed.join(target, "_target", "left")
        .withColumn("subject_id", F.explode(works))
        .drop("_target", "_target_work")
    )


def relations_to_claims(relations: DataFrame) -> DataFrame:
    """Relations keyed by the claim they resolved to."""
    return relations.filter(F.col("target_interpretation_id").isNotNull()).withColumn(
        "subject_id", F.col("target_interpretation_id")
    )


_DIMENSIONS = ("stance", "function", "resolution", "section")


def tallies(statements: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(subject_id, dimension, value, n)`` in one pass of grouping sets.

    The statements of a subject meet before they are copied once a grouping set, so its counts are
    nearly done when they are exchanged; a rebalance splits hot subjects where a join would not.
    A null stance or function is no bucket; a null section counts as ``unspecified``.
    ``total`` and ``abstained`` (neither stance nor function) come as dimensions too.
    """
    dims = [*_DIMENSIONS, *extra]
    rows = statements.select(
        "subject_id",
        "stance",
        "function",
        "resolution",
        F.when(F.col("section") != "", F.col("section")).otherwise("unspecified").alias("section"),
        *[F.col(c).cast("string").alias(c) for c in extra],
    )
    sets = [["subject_id", d] for d in dims] + [["subject_id"]]
    grouped = rows.hint("rebalance", "subject_id").groupingSets(sets, "subject_id", *dims).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("n"),
        F.count_if(F.col("stance").isNull() & F.col("function").isNull()).alias("abstained"),
    )
    full = (1 << len(dims)) - 1
    own_bit = {d: full & ~(1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    dimension = F.when(F.col("gid") == full, "total")
    value: Column = F.when(F.col("gid") == full, "all")
    for d, gid in own_bit.items():
        dimension = dimension.when(F.col("gid") == gid, d)
        value = value.when(F.col("gid") == gid, F.col(d))
    cells = grouped.select("subject_id", dimension.alias("dimension"), value.alias("value"), "n", "abstained")
    both = F.array(
        F.struct("dimension", "value", "n"),
        F.struct(
            F.when(F.col("dimension") == "total", "abstained").alias("dimension"),
            F.lit("all").alias("value"),
            F.col("abstained").alias("n"),
        ),
    )
    return (
        cells.select("subject_id", F.explode(both).alias("c"))
        .select("subject_id", "c.*")
        .filter(F.col("dimension").isNotNull() & F.col("value").isNotNull())
    )


def member_tallies(tally_rows: DataFrame, members: DataFrame) -> DataFrame:
    """Tallies summed over the members of each saved set."""
    return (
        members.select("set_id", F.col("work_id").alias("subject_id"))
        .join(tally_rows, "subject_id")
        .groupBy("set_id", "dimension", "value")
        .agg(F.sum("n").alias("n"))
    )


def stance_counts(statements: DataFrame, earlier: Column | None = None) -> DataFrame:
    """Support and contradict counts per subject.

    With ``earlier``, also of the statements it holds for, as ``support_then`` and
    ``contradict_then``: two states from one reading.
    """
    sides = ("support", "contradict")
    counts = [F.count_if(F.col("stance") == c).alias(c) for c in sides]
    if earlier is not None:
        counts += [F.count_if((F.col("stance") == c) & earlier).alias(f"{c}_then") for c in sides]
    return statements.groupBy("subject_id").agg(*counts)


# --- per-paper report -------------------------------------------------------------------


def statement_filter(
    section: str | None = None,
    function: str | None = None,
    stance: str | None = None,
    resolution: str | None = None,
    min_year: int | None = None,
    max_year: int | None = None,
) -> Column:
    """Conjunction of the given bounds; the section is compared case-sensitively and an
    unknown year fails any year bound."""
    keep = F.lit(True)
    if section:
        keep = keep & (F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("unspecified")) == section)
    for name, wanted in (("function", function), ("stance", stance), ("resolution", resolution)):
        if wanted:
            keep = keep & F.coalesce(F.col(name) == wanted, F.lit(False))
    if min_year is not None:
        keep = keep & F.coalesce(F.col("year") >= min_year, F.lit(False))
    if max_year is not None:
        keep = keep & F.coalesce(F.col("year") <= max_year, F.lit(False))
    return keep


def report_facets(statements: DataFrame) -> DataFrame:
    """Facet counts of all statements of a paper, citing year included."""
    return tallies(statements, extra=("year",)).filter(~F.col("dimension").isin("total", "abstained"))


def report_timeline(statements: DataFrame) -> DataFrame:
    """Statements and distinct citing works by year."""
    per_work = (
        statements.filter(F.col("year").isNotNull() & F.col("citing_work_id").isNotNull())
        .groupBy("subject_id", "year", "citing_work_id")
        .agg(F.count("*").alias("n"))
    )
    return per_work.groupBy("subject_id", "year").agg(
        F.sum("n").alias("statement_count"), F.count("*").alias("citing_work_count")
    )


def report_conflicts(statements: DataFrame) -> DataFrame:
    """Supporting, contradicting and other statements, and citing works that do both."""
    per_work = statements.groupBy("subject_id", "citing_work_id").agg(
        F.count_if(F.col("stance") == "support").alias("s"),
        F.count_if(F.col("stance") == "contradict").alias("c"),
        F.count("*").alias("n"),
    )
    both = (F.col("s") > 0) & (F.col("c") > 0) & F.col("citing_work_id").isNotNull()
    return (
        per_work.groupBy("subject_id")
        .agg(
            F.sum("s").alias("supporting_statements"),
            F.sum("c").alias("contradicting_statements"),
            F.sum(F.col("n") - F.col("s") - F.col("c")).alias("neutral_or_unclear_statements"),
            F.count_if(both).alias("conflicting_citing_work_count"),
        )
        .withColumn(
            "has_conflicting_stances",
            (F.col("supporting_statements") > 0) & (F.col("contradicting_statements") > 0),
        )
    )


def paper_report(statements: DataFrame, **bounds) -> dict[str, DataFrame]:
    """Facets over all statements; tallies, timeline and conflicts over the filtered ones."""
    kept = statements.filter(statement_filter(**bounds))
    return {
        "facets": report_facets(statements),
        "tallies": tallies(kept),
        "timeline": report_timeline(kept),
        "conflicts": report_conflicts(kept),
    }
