"""Per-stage scoring of extracted evidence against a gold set; tables in, tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import strip
from ..functions.lexicons import COVERAGES
from ..functions.values import precision_recall_f1, ratio
from ..plans.keys import digest
from ..plans.ranking import with_global_position

# --- metric primitives ------------------------------------------------------------------------


def confusion_matrix(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``(gold, <one count per label>)`` over the closed label set, zero-filled."""
    spark = pairs.sparkSession
    rows = spark.createDataFrame([(v,) for v in labels], "gold string")
    counts = pairs.filter(F.col("predicted").isin(*labels)).groupBy("gold").pivot("predicted", list(labels)).count()
    return rows.join(F.broadcast(counts), "gold", "left").na.fill(0, list(labels))


def per_class_prf(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Precision, recall, F1 and support per label; labels outside the set count against
    the ones inside but get no row."""
    right = F.col("gold") == F.col("predicted")
    ends = pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n")).select(
        F.explode(
            F.array(
                F.struct(
                    F.col("gold").alias("label"),
                    F.when(right, F.col("n")).otherwise(0).alias("tp"),
                    F.lit(0).cast("long").alias("fp"),
                    F.when(right, 0).otherwise(F.col("n")).alias("fn"),
                    F.col("n").alias("support"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("long").alias("tp"),
                    F.when(right, 0).otherwise(F.col("n")).alias("fp"),
                    F.lit(0).cast("long").alias("fn"),
                    F.lit(0).cast("long").alias("support"),
                ),
            )
        ).alias("e")
    ).select("e.*")
    sums = ends.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])
    rows = pairs.sparkSession.createDataFrame([(v,) for v in labels], "label string")
    full = rows.join(F.broadcast(sums), "label", "left").na.fill(0)
    return full.select(
        "label", *precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")), "support"
    )


def macro_f1(per_class: DataFrame) -> DataFrame:
    """Mean F1 over the labels that occur in the gold data."""
    return per_class.agg(
        F.bround(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)), 4).alias("macro_f1")
    )


def calibration_bins(scored: DataFrame, bins: int = 5) -> DataFrame:
    """Mean confidence and accuracy per right-closed confidence bin.

    ``scored(confidence, correct)``.
    """
    number = F.greatest(F.ceil(F.col("confidence") * bins), F.lit(1)).cast("int")
    return scored.groupBy(number.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
    )


def expected_calibration_error(scored: DataFrame, bins: int = 5) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return calibration_bins(scored, bins).agg(
        F.coalesce(F.sum(gap) / F.sum("n"), F.lit(0.0)).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )


def risk_coverage(scored: DataFrame, coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """Error rate among the most confident share of answers; ties by id.

    ``scored(item_id, confidence, correct)``. Positions come from a range-partitioned sort,
    so a confidence that most rows share is still split over tasks.
    """
    ranked = with_global_position(
        scored.select("item_id", "confidence", "correct"), [F.desc("confidence"), F.col("item_id")]
    )
    n = ranked.agg(F.count("*")).scalar()
    sums = ranked.withColumn("_n", n).agg(
        F.max("_n").alias("n"),
        *[
            F.count_if((F.col("position") <= F.greatest(F.bround(F.col("_n") * c), F.lit(1))) & ~F.col("correct")).alias(f"e{i}")
            for i, c in enumerate(coverages)
        ],
    )
    points = [
        F.struct(
            F.lit(c).alias("coverage"),
            F.coalesce(F.col(f"e{i}") / F.greatest(F.bround(F.col("n") * c), F.lit(1)), F.lit(0.0)).alias("risk"),
        )
        for i, c in enumerate(coverages)
    ]
    return sums.select(F.explode(F.array(*points)).alias("p")).select("p.*")


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of rows whose gold target is among the first ``k``; a null rank is a miss."""
    return ranks.agg(
        *[
            F.coalesce(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), F.lit(0.0)).alias(f"recall_at_{k}")
            for k in ks
        ]
    )


def _pair_count(signatures: DataFrame, groups: str) -> Column:
    """Number of item pairs that share at least one group.

    Items with the same group list form one signature and are counted, not paired; only
    different signatures that meet in a group are joined, which for plain partitions are
    none.
    """
    rows = signatures.filter(F.size(groups) > 0).groupBy(groups).agg(F.sum("n").alias("n"))
    within = rows.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).scalar()
    named = rows.withColumn("s", F.to_json(F.col(groups)))
    spread = named.filter(F.size(groups) > 1).select("s", "n", F.explode(groups).alias("g"))
    plain = named.filter(F.size(groups) == 1).select("s", "n", F.col(groups)[0].alias("g"))
    # a pair of different signatures needs one with several groups
    a = spread.select(F.col("s").alias("sa"), F.col("n").alias("na"), "g")
    b = spread.unionByName(plain).select(F.col("s").alias("sb"), F.col("n").alias("nb"), "g")
    met = a.join(b, "g").filter(F.col("sa") != F.col("sb")).select(
        F.least("sa", "sb").alias("x"), F.greatest("sa", "sb").alias("y"), (F.col("na") * F.col("nb")).alias("p")
    )
    across = met.distinct().agg(F.coalesce(F.sum("p"), F.lit(0))).scalar()
    return (within + across).cast("long")


def pair_prf(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairwise precision, recall and F1 of a clustering, from group sizes.

    ``gold(item, group)``, ``predicted(item, group)``; only items present in both count.
    Equals counting the pairs one by one, overlapping groups included, without forming
    them.
    """
    g = gold.groupBy("item").agg(F.sort_array(F.collect_set("group")).alias("g"))
    p = predicted.groupBy("item").agg(F.sort_array(F.collect_set("group")).alias("p"))
    empty = F.array().cast("array<string>")
    items = g.join(p, "item", "full").select(
        F.coalesce("g", empty).alias("g"), F.coalesce("p", empty).alias("p")
    )
    signatures = items.groupBy("g", "p").agg(F.count("*").alias("n"))
    both = F.flatten(
        F.transform("g", lambda x: F.transform("p", lambda y: F.concat_ws("\u0000", x, y)))
    )
    crossed = signatures.withColumn("gp", F.sort_array(both))
    one = gold.sparkSession.range(1)
    counts = one.select(
        _pair_count(crossed, "gp").alias("tp"),
        _pair_count(signatures, "g").alias("gold_pairs"),
        _pair_count(signatures, "p").alias("pred_pairs"),
    ).select("tp", (F.col("pred_pairs") - F.col("tp")).alias("fp"), (F.col("gold_pairs") - F.col("tp")).alias("fn"))
    return counts.select(*precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")), "tp", "fp", "fn")


# --- stage scores -----------------------------------------------------------------------------------


def mentions_with_doi(mentions: DataFrame, works: DataFrame) -> DataFrame:
    """``(paper, marker, resolved_doi)``; unresolved mentions stay with a null DOI, and the
    last mention of a marker counts.

    ``mentions(paper, marker, cited_work_id, position)``.
    """
    from ..plans.skew import spread_nulls

    dois = works.select(F.col("work_id").alias("_w"), "doi")
    return (
        mentions.withColumn("_w", spread_nulls(F.col("cited_work_id"), F.col("position")))
        .join(dois, "_w", "left")
        .groupBy("paper", "marker")
        .agg(F.max_by("doi", "position").alias("resolved_doi"))
    )


def parsing_scores(
    gold_citations: DataFrame, predicted: DataFrame, known_papers: DataFrame, gold_sections: DataFrame, predicted_sections: DataFrame
) -> DataFrame:
    """Citation-marker resolution and section accuracy.

    ``gold_citations(paper, marker, resolved_doi)`` of papers that were ingested;
    ``gold_sections(gold_id, section)`` against ``predicted_sections(gold_id, section)`` of
    aligned claims.
    """
    wanted = gold_citations.join(known_papers.select("paper").distinct(), "paper", "left_semi")
    found = predicted.select("paper", "marker", F.col("resolved_doi").alias("_found"))
    cites = wanted.join(found, ["paper", "marker"], "left").agg(
        F.count_if(F.col("resolved_doi").eqNullSafe(F.col("_found"))).alias("c"), F.count("*").alias("n")
    )
    clean = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    sections = (
        gold_sections.filter(F.col("section").isNotNull())
        .join(predicted_sections.select("gold_id", F.col("section").alias("_s")), "gold_id")
        .agg(F.count_if(clean(F.col("_s")) == clean(F.col("section"))).alias("sc"), F.count("*").alias("sn"))
    )
    return cites.withColumns({c: sections.select(c).scalar() for c in ("sc", "sn")}).select(
        F.bround(ratio(F.col("c"), F.col("n")), 4).alias("citation_resolution_accuracy"),
        F.col("n").alias("citations_evaluated"),
        F.bround(ratio(F.col("sc"), F.col("sn")), 4).alias("section_recognition_accuracy"),
        F.col("sn").alias("sections_evaluated"),
    )


def extraction_scores(gold: DataFrame, predicted: DataFrame, alignment: DataFrame, exhaustive: bool = True) -> DataFrame:
    """Span precision, recall, F1 over reported results, and accuracy of their qualifiers.

    ``gold(gold_id, occurrence_type, effect_direction, negated, certainty)``,
    ``predicted(pred_id, ...)`` of the same shape, ``alignment(gold_id, pred_id)``. Without
    an exhaustive gold set only recall means something.
    """
    results = gold.filter(F.col("occurrence_type") == "reported_result")
    pred = predicted.filter(F.col("occurrence_type") == "reported_result")
    total_pred = pred.agg(F.count("*")).scalar()
    hits = results.join(alignment, "gold_id", "left").join(
        pred.select(
            "pred_id",
            F.lit(True).alias("_hit"),
            *[F.col(c).alias(f"p_{c}") for c in ("effect_direction", "negated", "certainty")],
        ),
        "pred_id",
        "left",
    )
    hit = F.coalesce("_hit", F.lit(False))

    def accuracy(name: str, predicted_value: Column) -> Column:
        judged = hit & F.col(name).isNotNull()
        right = judged & F.coalesce(predicted_value == F.col(name), F.lit(False))
        return F.bround(ratio(F.count_if(right), F.count_if(judged)), 4)

    sums = hits.agg(
        F.count_if(hit).alias("tp"),
        F.count_if(~hit).alias("fn"),
        accuracy("effect_direction", F.col("p_effect_direction")).alias("effect_direction_accuracy"),
        accuracy("negated", F.coalesce("p_negated", F.lit(False))).alias("negation_accuracy"),
        accuracy("certainty", F.col("p_certainty")).alias("certainty_accuracy"),
    ).withColumn("fp", (total_pred - F.col("tp")) if exhaustive else F.lit(0).cast("long"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    if exhaustive:
        spans = precision_recall_f1(tp, fp, fn)
    else:
        spans = [
            F.lit(0.0).alias("precision"),
            F.bround(ratio(tp, tp + fn), 4).alias("recall"),
            F.lit(0.0).alias("f1"),
        ]
    return sums.select(
        *spans, "tp", "fp", "fn", "effect_direction_accuracy", "negation_accuracy", "certainty_accuracy"
    )


def aligned_relations(gold_relations: DataFrame, alignment: DataFrame, assertions: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Each gold relation of an aligned claim with the first assertion of the predicted
    occurrence for the same cited DOI.

    ``gold_relations(gold_id, cited_doi, function, stance, scope, resolution,
    target_gold_id)``, ``alignment(gold_id, pred_id, occurrence_id)``,
    ``assertions(occurrence_id, cited_doi, assertion_id, ...)``. ``fields`` names what of an
    assertion is read later (``None``: all of it), for a first row is chosen with all it bears.
    Ids meet by their digests, so an id that nobody reads moves no further.
    """
    taken = [c for c in assertions.columns if c not in ("occurrence_id", "cited_doi") and (fields is None or c in fields)]
    first = (
        assertions.select(digest("occurrence_id").alias("_occurrence"), "cited_doi", F.col("assertion_id").alias("_order"), F.struct(*taken).alias("a"))
        .groupBy("_occurrence", "cited_doi")
        .agg(F.min_by("a", "_order").alias("a"))
    )
    own = [c for c in gold_relations.columns if c not in ("gold_id", "cited_doi")]
    aligned = alignment.select(digest("gold_id").alias("_gold"), *(F.col(c) for c in alignment.columns if c != "gold_id")).withColumn("_occurrence", digest("occurrence_id"))
    found = gold_relations.withColumn("_gold", digest("gold_id")).join(aligned, "_gold").join(first, ["_occurrence", "cited_doi"], "left")
    return found.select("occurrence_id", "cited_doi", "gold_id", *own, *(c for c in alignment.columns if c not in ("gold_id", "occurrence_id")), "a")


def relationship_pairs(aligned: DataFrame, dimension: str) -> DataFrame:
    """(gold, predicted) labels of one dimension where an assertion took a position."""
    predicted = F.col("a")[dimension]
    return aligned.filter(predicted.isNotNull()).select(F.col(dimension).alias("gold"), predicted.alias("predicted"))


def scope_accuracy(aligned: DataFrame) -> DataFrame:
    pairs = relationship_pairs(aligned, "scope")
    return pairs.agg(
        F.bround(ratio(F.count_if(F.col("gold") == F.col("predicted")), F.count("*")), 4).alias("citation_scope_accuracy"),
        F.count("*").alias("citation_scope_evaluated"),
    )


def target_ranks(aligned: DataFrame, alignment: DataFrame) -> DataFrame:
    """Rank of the gold target among the assertion's target and candidates, null when it is
    not there.

    Assertions carry ``target_interpretation_id`` and ``target_candidates``.
    """
    wanted = aligned.filter(
        (F.col("resolution") == "claim_resolved") & (F.col("target_gold_id") != "")
    )
    target = alignment.select(digest("gold_id").alias("_gold"), digest("pred_id").alias("_target"))
    listed = F.array_distinct(
        F.array_compact(
            F.concat(
                F.array(digest("a.target_interpretation_id")),
                F.coalesce(
                    F.transform(F.col("a.target_candidates"), lambda c: digest(c["interpretation_id"])),
                    F.array().cast("array<binary>"),
                ),
            )
        )
    )
    # only digests move on
    named = wanted.select("gold_id", "cited_doi", "target_gold_id", digest("target_gold_id").alias("_gold"), listed.alias("_listed"))
    position = F.array_position("_listed", F.col("_target"))
    return named.join(target, "_gold", "left").select(
        "gold_id", "cited_doi", "target_gold_id", F.when(position > 0, position).cast("int").alias("rank")
    )


def link_precision(gold_relations: DataFrame, alignment: DataFrame, assertions: DataFrame) -> DataFrame:
    """Of everything resolved at claim level, the share whose target is the adjudicated one."""
    expected = (
        gold_relations.filter((F.col("resolution") == "claim_resolved") & (F.col("target_gold_id") != ""))
        .groupBy("gold_id", "cited_doi")
        .agg(F.max("target_gold_id").alias("expected"))
    )
    citing = alignment.select("occurrence_id", "gold_id")
    target = alignment.select(F.col("pred_id").alias("target_interpretation_id"), F.col("gold_id").alias("got"))
    return (
        assertions.filter(F.col("resolution") == "claim_resolved")
        .join(citing, "occurrence_id", "left")
        .join(target, "target_interpretation_id", "left")
        .join(expected, ["gold_id", "cited_doi"], "left")
        .agg(
            F.bround(ratio(F.count_if(F.col("expected") == F.col("got")), F.count("*")), 4).alias("precision_at_threshold"),
            F.count("*").alias("claim_resolved_predicted"),
        )
    )


def stance_confidences(aligned: DataFrame) -> DataFrame:
    """``(item_id, confidence, correct)`` of the stance decisions that have a distribution."""
    dist = F.col("a.stance_distribution")
    return aligned.filter(F.size(dist) > 0).select(
        F.concat_ws("|", "gold_id", "cited_doi").alias("item_id"),
        F.array_max(F.map_values(dist)).alias("confidence"),
        F.coalesce(F.col("a.stance") == F.col("stance"), F.lit(False)).alias("correct"),
    )


def operations(runs: DataFrame) -> DataFrame:
    """Papers, throughput and latency from ``runs(paper, seconds)``."""
    return runs.agg(
        F.count("*").alias("papers"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"),
        F.coalesce(F.try_divide(F.count("*"), F.sum("seconds")), F.lit(0.0)).alias("throughput_papers_per_s"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_latency_s"),
        F.coalesce(F.max("seconds"), F.lit(0.0)).alias("max_latency_s"),
        F.lit(0.0).alias("cost_per_paper_usd"),
    )


def long_metrics(table: DataFrame, extractor: str, stage: str) -> DataFrame:
    """One row per metric of a one-row score table."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in table.columns]
    )
    return table.select(F.lit(extractor).alias("extractor"), F.lit(stage).alias("stage"), F.explode(cells).alias("m")).select(
        "extractor", "stage", "m.*"
    )


def report(parts: list[DataFrame]) -> DataFrame:
    """The metrics of several stages and extractors as one long table."""
    return reduce(DataFrame.unionByName, parts)
