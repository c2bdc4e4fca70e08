"""Claim views, revision heads, search with facets, reviews, scores and cluster views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import strip
from ..functions.values import certainty_score
from ..plans.keys import digest


# --- evidence chain ------------------------------------------------------------------------


def claims_flat(
    interpretations: DataFrame,
    occurrences: DataFrame,
    passages: DataFrame,
    versions: DataFrame,
    works: DataFrame,
) -> DataFrame:
    """Interpretation with its occurrence, passage evidence and work: the read model most
    queries start from.

    Versions meet their works first, so that passages, which are many more, move once.
    """
    issued = versions.select(F.col("version_id").alias("paper_version_id"), "work_id").join(
        works.select("work_id", "title", "venue", "year"), "work_id"
    )
    own = [c for c in passages.columns if c != "paper_version_id"]
    source = passages.join(issued, "paper_version_id").select("work_id", *own, "title", "venue", "year")
    return (
        interpretations.withColumnRenamed("claim_occurrence_id", "occurrence_id")
        .join(occurrences, "occurrence_id")
        .join(source, "passage_id")
    )


def claim_works(
    interpretations: DataFrame, occurrences: DataFrame, passages: DataFrame, versions: DataFrame
) -> DataFrame:
    """``(interpretation_id, work_id)`` over all interpretations, superseded ones included."""
    return (
        interpretations.select("interpretation_id", F.col("claim_occurrence_id").alias("occurrence_id"))
        .join(occurrences.select("occurrence_id", "passage_id"), "occurrence_id")
        .join(passages.select("passage_id", "paper_version_id"), "passage_id")
        .join(versions.select(F.col("version_id").alias("paper_version_id"), "work_id"), "paper_version_id")
        .select("interpretation_id", "work_id")
    )


def lookup(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of any evidence table whose key is among ``wanted`` (one column named as key)."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def relations_of(
    relations: DataFrame,
    stance: str | None = None,
    resolution: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Relations restricted by any of stance, resolution and status."""
    for name, value in (("stance", stance), ("resolution", resolution), ("status", status)):
        if value is not None:
            relations = relations.filter(F.col(name) == value)
    return relations


# --- revisions ---------------------------------------------------------------------------------


def revision_heads(interpretations: DataFrame) -> DataFrame:
    """Interpretations nobody lists as a parent."""
    parents = interpretations.select(F.explode("parent_interpretation_ids").alias("interpretation_id"))
    return interpretations.join(parents.distinct(), "interpretation_id", "left_anti")


def head_per_occurrence(interpretations: DataFrame) -> DataFrame:
    """One interpretation per occurrence: the earliest head, or the latest row when a cycle
    leaves no head.

    Two ordered aggregates instead of a window, so partial aggregation shrinks an
    occurrence with very many interpretations before the shuffle.
    """
    parents = interpretations.select(F.explode("parent_interpretation_ids").alias("interpretation_id"))
    marked = interpretations.join(
        parents.distinct().withColumn("_listed", F.lit(True)), "interpretation_id", "left"
    )
    order = F.struct("created_at", "interpretation_id")
    chosen = marked.groupBy("claim_occurrence_id").agg(
        F.min(F.when(F.col("_listed").isNull(), order)).alias("head"), F.max(order).alias("last")
    )
    return chosen.select(
        F.col("claim_occurrence_id").alias("occurrence_id"),
        F.coalesce("head", "last")["interpretation_id"].alias("interpretation_id"),
        F.col("head").isNull().alias("in_cycle"),
    )


def relation_status(relations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Status after revisions: a material revision of the target makes the relation
    ``stale_pending_review``. ``revisions`` holds ``parent_interpretation_ids`` and
    ``is_material``."""
    revised = (
        revisions.filter("is_material")
        .select(F.explode("parent_interpretation_ids").alias("target_interpretation_id"))
        .distinct()
        .withColumn("_stale", F.lit(True))
    )
    target_known = relations.filter(F.col("target_interpretation_id").isNotNull())
    untargeted = relations.filter(F.col("target_interpretation_id").isNull())
    marked = target_known.join(revised, "target_interpretation_id", "left")
    updated = marked.withColumn(
        "status", F.when(F.col("_stale"), "stale_pending_review").otherwise(F.col("status"))
    ).drop("_stale")
    return updated.unionByName(untargeted)


def reviewed_status(relations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Status after reviews: the latest accept or reject label decides."""
    label = F.lower(F.col("label"))
    outcome = F.when(label.isin("accept", "accepted"), "accepted").when(
        label.isin("reject", "rejected"), "rejected"
    )
    latest = (
        reviews.filter(F.col("subject_type") == "RelationAssertion")
        .select(F.col("subject_id").alias("assertion_id"), outcome.alias("outcome"), "decided_at", "review_id")
        .filter(F.col("outcome").isNotNull())
        .groupBy("assertion_id")
        .agg(F.max_by("outcome", F.struct("decided_at", "review_id")).alias("outcome"))
    )
    return (
        relations.join(latest, "assertion_id", "left")
        .withColumn("status", F.coalesce("outcome", "status"))
        .drop("outcome")
    )


def current_memberships(log: DataFrame) -> DataFrame:
    """Last status per (cluster, claim) of an append-only membership log."""
    latest = log.groupBy("cluster_id", "interpretation_id").agg(
        F.max_by(F.struct("status", "membership_confidence"), F.struct("recorded_at", "status")).alias("m")
    )
    return latest.select("cluster_id", "interpretation_id", "m.*")


def human_claims(
    submissions: DataFrame, occurrences: DataFrame, passages: DataFrame, run_id: str = "human-authored"
) -> tuple[DataFrame, DataFrame]:
    """New occurrences and interpretations for claims people add.

    A submission names an occurrence, or a passage that then gets an occurrence spanning
    its whole text. Returns (new occurrences, new interpretations).
    """
    from ..functions.identifiers import derived_id

    given = submissions.filter(F.col("occurrence_id").isNotNull()).join(
        occurrences.select("occurrence_id"), "occurrence_id", "left_semi"
    )
    on_passage = (
        submissions.filter(F.col("occurrence_id").isNull())
        .drop("occurrence_id")
        .join(passages.select("passage_id", F.length("verbatim_text").alias("span_end")), "passage_id")
        .withColumn("occurrence_id", derived_id("occ", F.col("submission_id"), F.col("passage_id")))
    )
    created = on_passage.select(
        "occurrence_id",
        "passage_id",
        F.lit(0).alias("span_start"),
        "span_end",
        F.lit("other").alias("occurrence_type"),
        F.lit(run_id).alias("extraction_run_id"),
    )
    columns = ["submission_id", "occurrence_id", "normalized_text", "author_id"]
    claims = given.select(*columns).unionByName(on_passage.select(*columns))
    interpretations = claims.select(
        derived_id("int", F.col("submission_id"), F.col("occurrence_id")).alias("interpretation_id"),
        F.col("occurrence_id").alias("claim_occurrence_id"),
        strip(F.col("normalized_text")).alias("normalized_text"),
        F.array().cast("array<string>").alias("parent_interpretation_ids"),
        "author_id",
        F.lit(run_id).alias("extraction_run_id"),
    )
    return created, interpretations


# --- search ------------------------------------------------------------------------------------------


def relation_values(relations: DataFrame) -> DataFrame:
    """Distinct functions, stances and resolutions per citing occurrence (enum-bounded)."""
    return relations.groupBy(F.col("citing_occurrence_id").alias("occurrence_id")).agg(
        *[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("function", "stance", "resolution")]
    )


def search_candidates(
    claims: DataFrame,
    relations: DataFrame,
    q: str = "",
    min_year: int | None = None,
    max_year: int | None = None,
) -> DataFrame:
    """Claims matching text and year, with the values of their relations.

    The text matches literally, case-insensitively, in the claim or in its passage.
    """
    term = q.strip().lower()
    if term:
        claims = claims.filter(
            F.lower("normalized_text").contains(term) | F.lower("verbatim_text").contains(term)
        )
    if min_year is not None:
        claims = claims.filter(F.col("year") >= min_year)
    if max_year is not None:
        claims = claims.filter(F.col("year") <= max_year)
    section = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("unspecified"))
    empty = F.array().cast("array<string>")
    return (
        claims.join(relation_values(relations), "occurrence_id", "left")
        .withColumn("section_facet", section)
        .withColumns({c: F.coalesce(c, empty) for c in ("functions", "stances", "resolutions")})
    )


def claim_facets(candidates: DataFrame) -> DataFrame:
    """Facet counts of claims before any categorical filter."""

    def cell(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("dimension"), value.alias("value"))

    cells = F.concat(
        F.array(cell("section", F.col("section_facet"))),
        F.transform("functions", lambda v: cell("function", v)),
        F.transform("stances", lambda v: cell("stance", v)),
        F.transform("resolutions", lambda v: cell("resolution", v)),
    )
    return (
        candidates.select(F.explode(cells).alias("c"))
        .groupBy("c.dimension", "c.value")
        .agg(F.count("*").alias("n"))
    )


def facet_filter(
    candidates: DataFrame,
    section: str | None = None,
    function: str | None = None,
    stance: str | None = None,
    resolution: str | None = None,
) -> DataFrame:
    """Claims with at least one relation of each wanted value; section is trimmed and
    case-insensitive."""
    if section is not None:
        candidates = candidates.filter(F.lower("section_facet") == section.strip().lower())
    for column, value in (("functions", function), ("stances", stance), ("resolutions", resolution)):
        if value is not None:
            candidates = candidates.filter(F.array_contains(column, value))
    return candidates


def search_page(matched: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """One page, most recent first, then title, text and id."""
    return (
        matched.orderBy(
            F.desc(F.coalesce("year", F.lit(0))),
            F.lower(F.coalesce("title", F.lit(""))),
            F.lower("normalized_text"),
            "interpretation_id",
        )
        .offset(max(0, offset))
        .limit(limit)
    )


# --- scores and clusters --------------------------------------------------------------------------------


def model_agreement(interpretations: DataFrame) -> DataFrame:
    """Other interpretations of the same occurrence."""
    return interpretations.groupBy("claim_occurrence_id").agg(
        (F.count("*") - 1).alias("model_agreement")
    )


def corroboration(memberships: DataFrame, claim_work: DataFrame) -> DataFrame:
    """Other works in the claim's first active cluster."""
    active = memberships.filter(F.col("status") == "active")
    first = active.groupBy("interpretation_id").agg(F.min("cluster_id").alias("cluster_id"))
    works = (
        active.join(claim_work, "interpretation_id")
        .select("cluster_id", "work_id")
        .distinct()
        .groupBy("cluster_id")
        .agg((F.count("*") - 1).alias("literature_corroboration"))
    )
    return first.join(works, "cluster_id", "left").select(
        "interpretation_id", F.coalesce("literature_corroboration", F.lit(0)).alias("literature_corroboration")
    )


def claim_scores(
    interpretations: DataFrame,
    relations: DataFrame,
    reviews: DataFrame,
    memberships: DataFrame,
    claim_work: DataFrame,
) -> DataFrame:
    """Separate score components per claim; they are never blended.

    ``interpretations`` carries ``certainty``; link and stance confidence are null when the
    occurrence has no relation. Ids meet by their digests; only the claim's own id moves whole.
    """
    interpretations = interpretations.select("interpretation_id", digest("interpretation_id").alias("_id"), digest("claim_occurrence_id").alias("claim_occurrence_id"), "certainty")
    memberships = memberships.select(digest("interpretation_id").alias("interpretation_id"), "cluster_id", "status")
    claim_work = claim_work.select(digest("interpretation_id").alias("interpretation_id"), "work_id")
    best = relations.groupBy(digest("citing_occurrence_id").alias("claim_occurrence_id")).agg(
        F.max(F.coalesce("target_link_score", F.lit(0.0))).alias("target_link_confidence"),
        F.max(F.coalesce(F.array_max(F.map_values("stance_distribution")), F.lit(0.0))).alias("stance_confidence"),
    )
    reviewed = (
        reviews.select(digest("subject_id").alias("_id"))
        .distinct()
        .withColumn("review_status", F.lit(1.0))
    )
    return (
        interpretations.join(best, "claim_occurrence_id", "left")
        .join(model_agreement(interpretations), "claim_occurrence_id", "left")
        .join(reviewed, "_id", "left")
        .join(corroboration(memberships, claim_work).withColumnRenamed("interpretation_id", "_id"), "_id", "left")
        .select(
            "interpretation_id",
            certainty_score(F.col("certainty")).alias("extraction_fidelity"),
            F.bround("target_link_confidence", 3).alias("target_link_confidence"),
            F.bround("stance_confidence", 3).alias("stance_confidence"),
            F.coalesce("review_status", F.lit(0.0)).alias("review_status"),
            F.coalesce("model_agreement", F.lit(0)).cast("double").alias("model_agreement"),
            F.coalesce("literature_corroboration", F.lit(0)).cast("double").alias("literature_corroboration"),
        )
    )


def cluster_members(memberships: DataFrame, interpretations: DataFrame, relations: DataFrame) -> DataFrame:
    """Members (removed ones too) with the stance of their first relation."""
    dominant = relations.groupBy(F.col("citing_occurrence_id").alias("claim_occurrence_id")).agg(
        F.min_by("stance", "assertion_id").alias("stance")
    )
    return (
        memberships.join(
            interpretations.select("interpretation_id", "claim_occurrence_id", "normalized_text"), "interpretation_id"
        )
        .join(dominant, "claim_occurrence_id", "left")
    )


def cluster_conflicts(members: DataFrame) -> DataFrame:
    """Member count and whether members take more than one decided stance."""
    decided = F.when(~F.col("stance").isin("neutral", "unclear"), F.col("stance"))
    return (
        members.groupBy("cluster_id")
        .agg(F.count("*").alias("member_count"), F.count_distinct(decided).alias("decided_stances"))
        .select("cluster_id", "member_count", (F.col("decided_stances") > 1).alias("conflicting_stances"))
    )
