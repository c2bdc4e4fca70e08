"""Citation and claim graphs: induced views, neighbourhoods, traces, snowballing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import author_node_id, strip
from ..functions.values import knowledge_sources, predicate_label
from ..plans.lineage import stage
from ..plans.ranking import with_global_position
from .citations import citation_degrees
from .claims import head_per_occurrence

# --- induced views -------------------------------------------------------------------------


def first_papers(works: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Up to ``limit`` works (or all) by title and id, and a one-row ``truncated`` flag."""
    if limit is None:
        return works, works.sparkSession.createDataFrame([(False,)], "truncated boolean")
    ordered = works.orderBy(F.asc_nulls_last("title"), "work_id")
    flag = works.agg((F.count("*") > limit).alias("truncated"))
    return ordered.limit(limit), flag


def induced_edges(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with both ends among the nodes."""
    ids = nodes.select("work_id")
    return pairs.join(ids.withColumnRenamed("work_id", "citing_work_id"), "citing_work_id", "left_semi").join(
        ids.withColumnRenamed("work_id", "cited_work_id"), "cited_work_id", "left_semi"
    )


def paper_nodes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes with global citation degrees; a bounded node set is counted map-side."""
    ids = nodes.select("work_id")
    touching = pairs.join(ids.withColumnRenamed("work_id", "citing_work_id"), "citing_work_id", "left_semi").unionByName(
        pairs.join(ids.withColumnRenamed("work_id", "cited_work_id"), "cited_work_id", "left_semi")
    )
    # a pair with both ends among the nodes comes twice
    return citation_degrees(nodes, touching.select("citing_work_id", "cited_work_id").distinct())


def author_edges(works: DataFrame, authorships: DataFrame) -> DataFrame:
    """One ``authored`` edge per author and work, with the author node id and label."""
    return (
        authorships.join(works.select("work_id"), "work_id", "left_semi")
        .select(author_node_id(F.col("author")).alias("author_id"), strip(F.col("author")).alias("label"), "work_id")
        .groupBy("author_id", "work_id")
        .agg(F.min("label").alias("label"))
    )


def paper_envelope(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables in one shape: id, type, label and a data struct."""
    node_rows = nodes.select(
        F.col("work_id").alias("id"),
        F.lit("paper").alias("type"),
        F.coalesce("title", "work_id").alias("label"),
        F.struct("year", "cited_by_count", "reference_count").alias("data"),
    )
    edge_rows = edges.select(
        F.concat(F.lit("cites:"), "citing_work_id", F.lit("->"), "cited_work_id").alias("id"),
        F.col("citing_work_id").alias("source"),
        F.col("cited_work_id").alias("target"),
        F.lit("cites").alias("type"),
        F.struct("sources", "is_influential").alias("data"),
    )
    return node_rows, edge_rows


# --- neighbourhoods ----------------------------------------------------------------------------


def neighborhoods(
    centers: DataFrame, pairs: DataFrame, depth: int = 1, max_nodes: int | None = None
) -> DataFrame:
    """``(center, work_id, hop, truncated)`` within ``depth`` hops, either direction.

    At most ``max_nodes`` per center (or all), kept by (hop, id). A center has then visited fewer
    than ``max_nodes`` works, so the ``2 * max_nodes`` smallest neighbours of any work
    always contain every neighbour that can still be chosen: hubs shrink to that before
    any join, with the same result. A single hop reads the neighbours of the centers alone.
    """
    both = pairs.select(F.col("citing_work_id").alias("src"), F.col("cited_work_id").alias("dst")).unionByName(
        pairs.select(F.col("cited_work_id").alias("src"), F.col("citing_work_id").alias("dst"))
    )
    if depth == 1:
        starts = stage(centers.select(F.col("work_id").alias("src")).distinct(), "starts")  # its size lets Spark choose the join
        both = both.join(starts, "src", "left_semi")
    both = both.distinct()
    if max_nodes is not None:
        smallest = Window.partitionBy("src").orderBy("dst")
        both = both.withColumn("_r", F.row_number().over(smallest)).filter(F.col("_r") <= 2 * max_nodes).drop("_r")
    adjacency = stage(both, "adjacency")
    visited = centers.select(F.col("work_id").alias("center"), "work_id", F.lit(0).alias("hop"), F.lit(False).alias("cut"))
    frontier = visited
    for hop in range(1, depth + 1):
        reached = (
            adjacency.join(frontier.select("center", F.col("work_id").alias("src")), "src")
            .select("center", F.col("dst").alias("work_id"))
            .distinct()
            .join(visited.select("center", "work_id"), ["center", "work_id"], "left_anti")
        )
        if max_nodes is None:
            frontier = stage(reached.select("center", "work_id", F.lit(hop).alias("hop"), F.lit(False).alias("cut")), "hop")
            visited = visited.unionByName(frontier)
            continue
        by_id = Window.partitionBy("center").orderBy("work_id")
        room = visited.groupBy("center").agg((max_nodes - F.count("*")).alias("room"))
        ranked = (
            reached.withColumn("_r", F.row_number().over(by_id))
            .filter(F.col("_r") <= max_nodes + 1)
            .join(room, "center")
        )
        frontier = stage(
            ranked.filter(F.col("_r") <= F.col("room") + 1).select(
                "center", "work_id", F.lit(hop).alias("hop"), (F.col("_r") > F.col("room")).alias("cut")
            ),
            "hop",
        )
        visited = visited.unionByName(frontier)
        frontier = frontier.filter(~F.col("cut"))
        # a cut center stops growing
        stopped = visited.filter("cut").select("center").distinct()
        frontier = frontier.join(stopped, "center", "left_anti")
        visited = visited if hop == depth else stage(visited, "visited")
    flags = visited.groupBy("center").agg(F.bool_or("cut").alias("truncated"))
    return visited.filter(~F.col("cut")).drop("cut").join(flags, "center")


def neighborhood_edges(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges inside each center's node set."""
    ends = nodes.select("center", "work_id")
    return pairs.join(ends.withColumnRenamed("work_id", "citing_work_id"), "citing_work_id").join(
        ends.withColumnRenamed("work_id", "cited_work_id"), ["center", "cited_work_id"], "left_semi"
    )


# --- claims ----------------------------------------------------------------------------------------


def claim_network(relations: DataFrame, interpretations: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges from the head claim of the citing occurrence to the resolved target claim.

    With ``limit``, edges in assertion order up to the one that brings the ``limit``-th
    distinct claim: the cut is the last of the ``limit`` earliest first appearances.
    """
    heads = head_per_occurrence(interpretations).select(
        F.col("occurrence_id").alias("citing_occurrence_id"), F.col("interpretation_id").alias("source_claim_id")
    )
    targets = interpretations.select(F.col("interpretation_id").alias("target_interpretation_id"))
    edges = (
        relations.filter(
            (F.col("resolution") == "claim_resolved") & F.col("target_interpretation_id").isNotNull()
        )
        .join(heads, "citing_occurrence_id")
        .join(targets, "target_interpretation_id", "left_semi")
        .select(
            "assertion_id",
            "source_claim_id",
            F.col("target_interpretation_id").alias("target_claim_id"),
            "function",
            "stance",
            "status",
        )
    )
    if limit is None:
        return edges
    ends = edges.select(
        "assertion_id", F.explode(F.array("source_claim_id", "target_claim_id")).alias("claim")
    )
    first = ends.groupBy("claim").agg(F.min("assertion_id").alias("seen"))
    cut = first.orderBy("seen", "claim").limit(max(1, limit)).agg(F.max("seen")).scalar()
    return edges.filter(F.col("assertion_id") <= cut)


def one_hop_trace(
    claims: DataFrame, relations: DataFrame, interpretations: DataFrame, works: DataFrame, passages: DataFrame
) -> DataFrame:
    """Per claim and relation of its occurrence: target claim, target paper and evidence.

    A hop that only reached the paper is marked ``paper_level``.
    """
    target_claims = interpretations.select(
        F.col("interpretation_id").alias("target_interpretation_id"),
        F.col("normalized_text").alias("target_claim_text"),
    )
    target_works = works.select(F.col("work_id").alias("cited_work_id"), F.col("title").alias("target_title"))
    evidence = passages.select(
        F.col("passage_id").alias("evidence_passage_id"),
        F.col("section").alias("evidence_section"),
        F.col("verbatim_text").alias("evidence_text"),
    )
    resolved = F.when(F.col("resolution") == "claim_resolved", F.col("target_interpretation_id"))
    from ..plans.skew import spread_nulls

    hops = (
        claims.select("interpretation_id", F.col("claim_occurrence_id").alias("citing_occurrence_id"))
        .join(relations.drop("section"), "citing_occurrence_id")
        .withColumn("target_interpretation_id", spread_nulls(resolved, F.col("assertion_id")))
        .withColumn("_cited", F.col("cited_work_id"))
        .withColumn("cited_work_id", spread_nulls(F.col("cited_work_id"), F.col("assertion_id")))
    )
    return (
        hops.join(target_claims, "target_interpretation_id", "left")
        .join(target_works, "cited_work_id", "left")
        .join(evidence, "evidence_passage_id", "left")
        .select(
            "interpretation_id",
            "assertion_id",
            "function",
            "stance",
            "resolution",
            "target_link_score",
            F.when(F.col("target_claim_text").isNotNull(), F.col("target_interpretation_id")).alias("target_claim_id"),
            "target_claim_text",
            F.when(F.col("target_title").isNotNull(), F.col("_cited")).alias("target_work_id"),
            "target_title",
            "evidence_section",
            "evidence_text",
            (F.col("resolution") == "paper_resolved").alias("paper_level"),
        )
    )


# --- entities ------------------------------------------------------------------------------------------


def ground_terms(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(interpretation_id, role, term)`` with curie, label and types where the lexicon
    knows the term."""
    return terms.withColumn("_t", F.lower("term")).join(
        lexicon.select(F.lower("term").alias("_t"), "curie", "label", "types").dropDuplicates(["_t"]), "_t", "left"
    ).drop("_t")


def replace_groundings(stored: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """Stored rows of the same claims and source give way to the fresh ones."""
    redone = fresh.select("interpretation_id").distinct().withColumn("grounding_source", F.lit(source))
    kept = stored.join(redone, ["interpretation_id", "grounding_source"], "left_anti")
    return kept.unionByName(fresh.withColumn("grounding_source", F.lit(source)).select(kept.columns))


def entity_pairs(groundings: DataFrame) -> DataFrame:
    """Unordered pairs of a claim's grounded entities.

    A claim has one term per entity role, so its list and its pairs are bounded by the
    number of roles.
    """
    per_claim = (
        groundings.filter(F.col("curie").isNotNull())
        .groupBy("interpretation_id")
        .agg(F.sort_array(F.collect_set("curie")).alias("c"))
    )
    pairs = F.flatten(
        F.transform(
            F.col("c"),
            lambda left, i: F.transform(
                F.slice(F.col("c"), i + 2, F.size("c")), lambda right: F.struct(left.alias("left"), right.alias("right"))
            ),
        )
    )
    return per_claim.select("interpretation_id", F.explode(pairs).alias("p")).select("interpretation_id", "p.*")


def corroborating_edges(groundings: DataFrame, kg_edges: DataFrame) -> DataFrame:
    """Knowledge-graph edges between entities of one claim, either direction, once each."""
    ends = lambda a, b: F.struct(F.col(a).alias("subject"), F.col(b).alias("object"))
    both = F.explode(F.array(ends("left", "right"), ends("right", "left")))
    directed = entity_pairs(groundings).select("interpretation_id", both.alias("e")).select("interpretation_id", "e.*")
    predicate = F.coalesce(F.nullif(F.col("predicate"), F.lit("")), F.lit("biolink:related_to"))
    return (
        kg_edges.withColumn("predicate", predicate)
        .join(directed, ["subject", "object"])
        .dropDuplicates(["interpretation_id", "subject", "predicate", "object"])
        .select(
            "interpretation_id",
            "subject",
            "predicate",
            "object",
            predicate_label(F.col("predicate")).alias("label"),
            knowledge_sources(F.col("sources")).alias("k"),
        )
        .select("interpretation_id", "subject", "predicate", "object", "label", "k.*")
    )


def claim_entity_edges(groundings: DataFrame) -> DataFrame:
    """``grounds`` edges from a claim to its entities."""
    return groundings.filter(F.col("curie").isNotNull()).select(
        F.concat(F.lit("grounds:"), "interpretation_id", F.lit("->"), "curie").alias("id"),
        F.col("interpretation_id").alias("source"),
        F.col("curie").alias("target"),
        F.lit("grounds").alias("type"),
        F.col("role").alias("label"),
    )


# --- snowball --------------------------------------------------------------------------------------------


def capped_references(links: DataFrame, per_paper: int | None = None) -> DataFrame:
    """The first ``per_paper`` references of each paper by list position, or all."""
    if per_paper is None:
        return links
    order = Window.partitionBy("citing_work_id").orderBy("position")
    return links.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_paper).drop("_r")


def snowball(
    seeds: DataFrame, links: DataFrame, target_size: int | None = None, refs_per_paper: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first corpus of up to ``target_size`` works (or all reachable) along reference lists.

    ``seeds(work_id, position)``; ``links(citing_work_id, cited_work_id, position)`` with
    resolved ids. Works join in order of (level, parent, list position); the walk stops at
    the reference that completes the corpus, and edges up to that reference are kept. All
    seeds belong to it. Returns works ``(work_id, level, ordinal)`` and edges. Each level is
    numbered by range partitions, so no level meets in one task.
    """
    refs = capped_references(links, refs_per_paper)
    first = seeds.groupBy("work_id").agg(F.min("position").alias("position"))
    numbered = with_global_position(first, [F.col("position"), F.col("work_id")], "ordinal")
    corpus = stage(numbered.select("work_id", F.lit(0).alias("level"), F.col("ordinal").cast("long").alias("ordinal")), "corpus")
    edges = None
    size, level, frontier = corpus.count(), 0, corpus
    while target_size is None or size < target_size:
        level += 1
        walked = stage(
            refs.join(
                frontier.select(F.col("work_id").alias("citing_work_id"), "ordinal"), "citing_work_id"
            ).select("citing_work_id", "cited_work_id", "position", F.struct("ordinal", "position").alias("at")),
            "walked",
        )
        first_seen = walked.groupBy("cited_work_id").agg(F.min("at").alias("at"))
        fresh = (
            first_seen.withColumnRenamed("cited_work_id", "work_id")
            .join(corpus.select("work_id"), "work_id", "left_anti")
            .select("work_id", F.col("at.ordinal").alias("parent"), "at.position")
        )
        placed = with_global_position(fresh, [F.col("parent"), F.col("position"), F.col("work_id")], "place")
        if target_size is not None:
            placed = placed.filter(F.col("place") <= target_size - size)
        frontier = stage(
            placed.select(
                "work_id", F.lit(level).alias("level"), (F.col("place") + size).cast("long").alias("ordinal"),
                F.struct(F.col("parent").alias("ordinal"), "position").alias("at"),
            ),
            "level",
        )
        added = frontier.count()
        size += added
        if target_size is not None and size >= target_size:
            stop = frontier.agg(F.max("at")).scalar()
            walked = walked.filter(F.col("at") <= stop)
        step = walked.filter("citing_work_id <> cited_work_id").select("citing_work_id", "cited_work_id").distinct()
        edges = step if edges is None else edges.unionByName(step)
        frontier = frontier.drop("at")
        corpus = corpus.unionByName(frontier)
        if not added:
            break
    if edges is None:
        edges = refs.select("citing_work_id", "cited_work_id").limit(0)
    return corpus, edges
