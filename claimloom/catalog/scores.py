"""Evaluation queries, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicons import FUNCTIONS, STANCES
from ..functions.text import content_tokens
from ..functions.lexicons import EVALUATION_STOPWORDS
from ..operators import evaluation as V
from ..operators import similarity as S
from ..plans import bindings as B
from ..sources.sinks import comparison_table
from .ctes import with_ctes

_LABELS = ("good", "bad")


def _label_pairs(t):
    """Quality as gold, absence of toxicity as prediction; an odd label now and then."""
    return t.labels.selectExpr(
        "case when quality = 1 then 'good' else 'bad' end as gold",
        "case when toxic = 1 then case when quality = 1 then 'bad' else 'odd' end else 'good' end as predicted",
    )


def confusion_matrix(t):
    return V.confusion_matrix(_label_pairs(t), _LABELS)


def per_class_prf(t):
    return V.per_class_prf(_label_pairs(t), _LABELS)


def macro_f1(t):
    return V.macro_f1(V.per_class_prf(_label_pairs(t), _LABELS))


def _scored(t):
    """Lines as answers: discount-scaled confidence with many ties."""
    return B.keyed_lines(t).selectExpr("k as item_id", "l_discount * 10 as confidence", "l_returnflag <> 'R' as correct")


def calibration_bins(t):
    return V.calibration_bins(_scored(t).withColumn("confidence", F.expr("round(confidence, 3)"))).withColumns(
        {c: F.bround(c, 6) for c in ("mean_confidence", "accuracy")}
    )


def ece(t):
    scored = _scored(t).withColumn("confidence", F.expr("round(confidence, 3)"))
    return V.expected_calibration_error(scored).withColumn("ece", F.bround("ece", 6))


def risk_coverage(t):
    scored = _scored(t).withColumn("confidence", F.expr("round(confidence, 3)"))
    return V.risk_coverage(scored).withColumn("risk", F.bround("risk", 6))


def recall_at_k(t):
    ranks = t.lineitem.selectExpr("case when l_discount > 0 then l_linenumber end as rank")
    return V.recall_at(ranks).withColumns({c: F.bround(c, 6) for c in ("recall_at_1", "recall_at_3")})


def pair_prf(t):
    """Orders grouped by customer against priority and year."""
    gold = t.orders.selectExpr("concat('O', o_orderkey) as item", "concat('c', o_custkey) as group")
    predicted = t.orders.selectExpr("concat('O', o_orderkey) as item", "concat(o_orderpriority, year(o_orderdate)) as group")
    return V.pair_prf(gold, predicted)


def pair_prf_overlapping(t):
    """Parts grouped by brand and by type against their names."""
    parts = t.part.withColumn("item", F.concat(F.lit("P"), "p_partkey"))
    gold = parts.select("item", F.col("p_brand").alias("group")).unionByName(
        parts.select("item", F.col("p_type").alias("group"))
    )
    return V.pair_prf(gold, parts.select("item", F.col("p_name").alias("group")))


def gold_alignment(t):
    """Benchmark items aligned to whole document paragraphs."""
    words = lambda c: content_tokens(F.col(c), EVALUATION_STOPWORDS)
    gold = t.benchmark.select(
        F.concat(F.lit("B"), "item_id").alias("gold_id"), F.lit("corpus").alias("paper"), words("text").alias("tokens")
    )
    paragraphs = t.spread("documents", "doc_id").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "body")
    )
    predicted = paragraphs.select(
        F.concat(F.lit("D"), "doc_id", F.lit("."), "p").alias("pred_id"),
        F.lit("corpus").alias("paper"),
        words("body").alias("tokens"),
    ).filter(F.size("tokens") > 0)
    return S.align_greedy(gold, predicted)


# --- stage scores on lines: the gold set and a perturbed reading of it --------------------------------


def _gold_claims(t):
    return B.keyed_lines(t).selectExpr(
        "concat('Q', k) as gold_id",
        "case when l_linenumber % 3 = 0 then 'background_assertion' else 'reported_result' end as occurrence_type",
        "case when l_linenumber % 4 = 0 then null when l_returnflag = 'A' then 'increase' else 'decrease' end as effect_direction",
        "l_linestatus = 'F' as negated",
        "case when l_tax > 0.04 then 'definite' else 'possible' end as certainty",
        "case when l_linenumber = 7 then null else l_returnflag end as section",
    )


def _predicted_claims(t):
    return B.keyed_lines(t).selectExpr(
        "concat('I', k) as pred_id",
        "case when l_linenumber % 3 = 0 and l_tax < 0.05 then 'background_assertion' else 'reported_result' end as occurrence_type",
        "case when l_returnflag = 'N' then 'increase' when l_returnflag = 'A' then 'increase' else 'decrease' end as effect_direction",
        "case when l_discount < 0.02 then l_linestatus <> 'F' when l_discount < 0.03 then null else l_linestatus = 'F' end as negated",
        "case when l_tax > 0.05 then 'definite' else 'possible' end as certainty",
        "concat(' ', lower(case when l_quantity < 10 then 'x' else l_returnflag end)) as section",
    )


def _alignment(t):
    return B.keyed_lines(t).filter("l_tax > 0.01").selectExpr(
        "concat('Q', k) as gold_id", "concat('I', k) as pred_id", "concat('C', k) as occurrence_id"
    )


def parsing_scores(t):
    lines = B.keyed_lines(t)
    gold = lines.selectExpr(
        "concat('O', l_orderkey) as paper", "k as marker", "case when l_returnflag = 'N' then null else concat('10.5555/p', l_partkey) end as resolved_doi"
    )
    mentions = B.line_relations(t).selectExpr(
        "citing_work_id as paper", "substring(assertion_id, 2) as marker", "cited_work_id", "assertion_id as position"
    )
    predicted = V.mentions_with_doi(mentions, B.part_works(t))
    known = t.orders.filter("o_orderstatus <> 'P'").selectExpr("concat('O', o_orderkey) as paper")
    sections = _alignment(t).join(_predicted_claims(t), "pred_id").select("gold_id", "section")
    return V.parsing_scores(gold, predicted, known, _gold_claims(t).select("gold_id", "section"), sections)


def extraction_scores(t):
    return V.extraction_scores(_gold_claims(t), _predicted_claims(t), _alignment(t).drop("occurrence_id"))


def _gold_relations(t):
    """Each line's part has one target, so Spark drops the left join where nobody reads it, as in ``line_relations``."""
    lines = B.keyed_lines(t).filter("l_partkey is not null")
    target = lines.groupBy("l_partkey").agg(F.min("k").alias("target_k"))
    return lines.join(target, "l_partkey", "left").selectExpr(
        "concat('Q', k) as gold_id", "concat('10.5555/p', l_partkey) as cited_doi",
        "element_at(array('background', 'method', 'comparison', 'direct_evidence'), cast(l_linenumber % 4 as int) + 1) as function",
        "case when l_returnflag = 'A' then 'support' when l_tax > 0.03 then 'contradict' else 'unclear' end as stance",
        "case when l_quantity < 25 then 'whole_claim' else 'partial_claim' end as scope",
        "case when l_linestatus = 'F' then 'claim_resolved' else 'paper_resolved' end as resolution",
        "case when l_linestatus = 'F' then concat('Q', target_k) end as target_gold_id",
    )


def _assertions(t):
    none = F.array().cast("array<struct<interpretation_id:string,score:double>>")
    return B.line_relations(t).select(
        F.col("citing_occurrence_id").alias("occurrence_id"),
        F.when(F.col("cited_work_id").isNotNull(), F.concat(F.lit("10.5555/p"), F.substr("cited_work_id", F.lit(2)))).alias("cited_doi"),
        "assertion_id", "function", "stance", "scope", "resolution", "stance_distribution",
        F.when(F.col("stance") == "support", F.col("target_interpretation_id")).alias("target_interpretation_id"),
        F.when(
            F.col("stance") == "neutral",
            F.array(
                F.struct(F.lit("other").alias("interpretation_id"), F.lit(0.1).alias("score")),
                F.struct(F.col("target_interpretation_id").alias("interpretation_id"), F.lit(0.05).alias("score")),
            ),
        ).otherwise(none).alias("target_candidates"),
    )


def _aligned(t, *fields):
    return V.aligned_relations(_gold_relations(t), _alignment(t), _assertions(t), fields)


def stance_classification(t):
    return V.per_class_prf(V.relationship_pairs(_aligned(t, "stance"), "stance"), STANCES)


def function_confusion(t):
    return V.confusion_matrix(V.relationship_pairs(_aligned(t, "function"), "function"), FUNCTIONS)


def scope_accuracy(t):
    return V.scope_accuracy(_aligned(t, "scope"))


def target_retrieval(t):
    return V.recall_at(V.target_ranks(_aligned(t, "target_interpretation_id", "target_candidates"), _alignment(t))).withColumns(
        {c: F.bround(c, 6) for c in ("recall_at_1", "recall_at_3")}
    )


def link_precision(t):
    return V.link_precision(_gold_relations(t), _alignment(t), _assertions(t))


def stance_calibration(t):
    scored = V.stance_confidences(_aligned(t, "stance", "stance_distribution")).withColumn("confidence", F.round("confidence", 3))
    return V.calibration_bins(scored).withColumns({c: F.bround(c, 6) for c in ("mean_confidence", "accuracy")})


def operations(t):
    runs = t.events.selectExpr("event_id as paper", "value / 100 as seconds")
    return V.operations(runs).withColumns(
        {c: F.bround(c, 6) for c in ("total_seconds", "throughput_papers_per_s", "mean_latency_s")}
    )


def extractor_comparison(t):
    """Two readings of the lines side by side."""
    first = V.extraction_scores(_gold_claims(t), _predicted_claims(t), _alignment(t).drop("occurrence_id"))
    second = V.extraction_scores(
        _gold_claims(t), _predicted_claims(t).withColumn("certainty", F.lit("definite")), _alignment(t).drop("occurrence_id"), exhaustive=False
    )
    rows = V.report([V.long_metrics(first, "rules", "extraction"), V.long_metrics(second, "replay", "extraction")])
    return comparison_table(rows, ["rules", "replay"])


_PAIRS = """WITH pairs AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold,
      CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'bad' ELSE 'odd' END ELSE 'good' END AS predicted FROM labels),
   labs AS (SELECT unnest(['good', 'bad']) AS label),
   c AS (SELECT label, (SELECT count(*) FROM pairs WHERE gold = label AND predicted = label) AS tp,
      (SELECT count(*) FROM pairs WHERE gold <> label AND predicted = label) AS fp,
      (SELECT count(*) FROM pairs WHERE gold = label AND predicted <> label) AS fn FROM labs),
   pc AS (SELECT label, tp / (tp + fp) AS p, tp / (tp + fn) AS r, tp + fn AS support FROM c),
   prf AS (SELECT label, round_even(coalesce(p, 0), 4) AS precision, round_even(coalesce(r, 0), 4) AS recall,
      round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, support FROM pc)"""
_SCORED = "scored AS (SELECT k AS item_id, round(l_discount * 10, 3) AS confidence, l_returnflag <> 'R' AS correct FROM lines)"
_PRF_TAIL = """SELECT round_even(tp / (tp + fp), 4) AS precision, round_even(tp / (tp + fn), 4) AS recall,
     round_even(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1, tp, fp, fn FROM t"""
_GOLD = """, g AS (SELECT k, CASE WHEN l_linenumber % 3 = 0 THEN 'background_assertion' ELSE 'reported_result' END AS got,
      CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'increase' ELSE 'decrease' END AS gdir, l_linestatus = 'F' AS gneg,
      CASE WHEN l_tax > 0.04 THEN 'definite' ELSE 'possible' END AS gcert, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS gsec,
      CASE WHEN l_linenumber % 3 = 0 AND l_tax < 0.05 THEN 'background_assertion' ELSE 'reported_result' END AS pot,
      CASE WHEN l_returnflag IN ('N', 'A') THEN 'increase' ELSE 'decrease' END AS pdir,
      CASE WHEN l_discount < 0.02 THEN l_linestatus <> 'F' WHEN l_discount < 0.03 THEN NULL ELSE l_linestatus = 'F' END AS pneg,
      CASE WHEN l_tax > 0.05 THEN 'definite' ELSE 'possible' END AS pcert,
      lower(CASE WHEN l_quantity < 10 THEN 'x' ELSE l_returnflag END) AS psec, l_tax > 0.01 AS aligned FROM lines),
   h AS (SELECT *, aligned AND pot = 'reported_result' AS hit FROM g WHERE got = 'reported_result'),
   s AS (SELECT count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn,
      (SELECT count(*) FROM g WHERE pot = 'reported_result') AS np,
      count(*) FILTER (hit AND gdir = pdir) / count(*) FILTER (hit AND gdir IS NOT NULL) AS da,
      count(*) FILTER (hit AND gneg = coalesce(pneg, false)) / count(*) FILTER (hit) AS na,
      count(*) FILTER (hit AND gcert = pcert) / count(*) FILTER (hit) AS ca,
      count(*) FILTER (hit AND gcert = 'definite') / count(*) FILTER (hit) AS ca2 FROM h)"""
_ALIGNED = """, tk AS (SELECT l_partkey, min(k) AS target_k FROM lines GROUP BY 1),
   gr AS (SELECT k, '10.5555/p' || l_partkey AS doi, ['background', 'method', 'comparison', 'direct_evidence'][l_linenumber % 4 + 1] AS gfunction,
      CASE WHEN l_returnflag = 'A' THEN 'support' WHEN l_tax > 0.03 THEN 'contradict' ELSE 'unclear' END AS gstance,
      CASE WHEN l_quantity < 25 THEN 'whole_claim' ELSE 'partial_claim' END AS gscope, l_linestatus = 'F' AS gresolved, target_k, l_tax > 0.01 AS is_aligned
      FROM lines JOIN tk USING (l_partkey)),
   al AS (SELECT gr.*, r.assertion_id, r.function, r.stance, r.stance_confidence, r.target_interpretation_id, r.assertion_id IS NOT NULL AS found
      FROM gr LEFT JOIN relations r ON r.assertion_id = 'R' || k AND r.cited_work_id IS NOT NULL WHERE is_aligned)"""

ENTRIES = {
    "confusion_matrix": (
        confusion_matrix,
        _PAIRS
        + """ SELECT label AS gold, (SELECT count(*) FROM pairs WHERE gold = label AND predicted = 'good') AS good,
             (SELECT count(*) FROM pairs WHERE gold = label AND predicted = 'bad') AS bad FROM labs""",
    ),
    "per_class_prf": (per_class_prf, _PAIRS + " SELECT * FROM prf"),
    "macro_f1": (macro_f1, _PAIRS + " SELECT round_even(avg(f1) FILTER (support > 0), 4) AS macro_f1 FROM prf"),
    "calibration_bins": (
        calibration_bins,
        with_ctes(
            "lines",
            f""", {_SCORED} SELECT greatest(ceil(confidence * 5), 1)::INT AS bin, count(*) AS n, round_even(avg(confidence), 6) AS mean_confidence,
                 round_even(avg(correct::INT), 6) AS accuracy FROM scored GROUP BY 1""",
        ),
    ),
    "ece": (
        ece,
        with_ctes(
            "lines",
            f""", {_SCORED}, b AS (SELECT count(*) AS n, avg(confidence) AS c, avg(correct::INT) AS a FROM scored GROUP BY greatest(ceil(confidence * 5), 1))
               SELECT round_even(sum(n * abs(c - a)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b""",
        ),
    ),
    "risk_coverage": (
        risk_coverage,
        with_ctes(
            "lines",
            f""", {_SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, item_id) AS rn, count(*) OVER () AS n FROM scored)
               SELECT coverage::DOUBLE AS coverage, round_even(count(*) FILTER (NOT correct) / count(*), 6) AS risk
               FROM r, (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS coverage) WHERE rn <= greatest(round_even(coverage::DOUBLE * n, 0), 1) GROUP BY 1""",
        ),
    ),
    "recall_at_k": (
        recall_at_k,
        """SELECT round_even(count(*) FILTER (l_discount > 0 AND l_linenumber <= 1) / count(*), 6) AS recall_at_1,
             round_even(count(*) FILTER (l_discount > 0 AND l_linenumber <= 3) / count(*), 6) AS recall_at_3 FROM lineitem""",
    ),
    "pair_prf": (
        pair_prf,
        f"""WITH o AS (SELECT o_custkey AS g, o_orderpriority || year(o_orderdate) AS p FROM orders),
            n AS (SELECT (SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM o GROUP BY g)) AS gp,
              (SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM o GROUP BY p)) AS pp,
              (SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM o GROUP BY g, p)) AS tp),
            t AS (SELECT tp::BIGINT AS tp, (pp - tp)::BIGINT AS fp, (gp - tp)::BIGINT AS fn FROM n) {_PRF_TAIL}""",
    ),
    "pair_prf_overlapping": (
        pair_prf_overlapping,
        f"""WITH pp AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_name = b.p_name),
            gp AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_brand = b.p_brand
                   UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_type = b.p_type),
            t AS (SELECT (SELECT count(*) FROM gp SEMI JOIN pp USING (a, b)) AS tp, (SELECT count(*) FROM pp ANTI JOIN gp USING (a, b)) AS fp,
                    (SELECT count(*) FROM gp ANTI JOIN pp USING (a, b)) AS fn) {_PRF_TAIL}""",
    ),
    "gold_alignment": (gold_alignment, None),
    "parsing_scores": (
        parsing_scores,
        with_ctes(
            "lines relations",
            _GOLD
            + """, c AS (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE '10.5555/p' || l_partkey END AS want,
                   CASE WHEN cited_work_id IS NOT NULL THEN '10.5555/p' || substring(cited_work_id, 2) END AS got
                 FROM lines JOIN relations ON assertion_id = 'R' || k JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
               SELECT round_even(count(*) FILTER (want IS NOT DISTINCT FROM got) / count(*), 4) AS citation_resolution_accuracy, count(*) AS citations_evaluated,
                 (SELECT round_even(count(*) FILTER (lower(gsec) = psec) / count(*), 4) FROM g WHERE aligned AND gsec IS NOT NULL) AS section_recognition_accuracy,
                 (SELECT count(*) FROM g WHERE aligned AND gsec IS NOT NULL) AS sections_evaluated FROM c""",
        ),
    ),
    "extraction_scores": (
        extraction_scores,
        with_ctes(
            "lines",
            _GOLD
            + """ SELECT round_even(tp / np, 4) AS precision, round_even(tp / (tp + fn), 4) AS recall,
                 round_even(2 * (tp / np) * (tp / (tp + fn)) / (tp / np + tp / (tp + fn)), 4) AS f1, tp, np - tp AS fp, fn,
                 round_even(da, 4) AS effect_direction_accuracy, round_even(na, 4) AS negation_accuracy, round_even(ca, 4) AS certainty_accuracy FROM s""",
        ),
    ),
    "stance_classification": (
        stance_classification,
        with_ctes(
            "lines relations",
            _ALIGNED
            + """, pr AS (SELECT gstance AS gold, stance AS predicted FROM al WHERE stance IS NOT NULL),
               labs AS (SELECT unnest(['support', 'contradict', 'neutral', 'unclear']) AS label),
               c AS (SELECT label, (SELECT count(*) FROM pr WHERE gold = label AND predicted = label) AS tp,
                  (SELECT count(*) FROM pr WHERE gold <> label AND predicted = label) AS fp,
                  (SELECT count(*) FROM pr WHERE gold = label AND predicted <> label) AS fn FROM labs),
               pc AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, tp + fn AS support FROM c)
               SELECT label, round_even(p, 4) AS precision, round_even(r, 4) AS recall,
                 round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, support FROM pc""",
        ),
    ),
    "function_confusion": (
        function_confusion,
        with_ctes(
            "lines relations",
            _ALIGNED
            + " SELECT label AS gold, "
            + ", ".join(f"(SELECT count(*) FROM al WHERE gfunction = label AND function = '{f}') AS {f}" for f in FUNCTIONS)
            + " FROM (SELECT unnest(['background', 'method', 'direct_evidence', 'comparison', 'other']) AS label)",
        ),
    ),
    "scope_accuracy": (
        scope_accuracy,
        with_ctes(
            "lines relations",
            _ALIGNED
            + """ SELECT round_even(count(*) FILTER (gscope = 'whole_claim') / count(*), 4) AS citation_scope_accuracy,
                 count(*) AS citation_scope_evaluated FROM al WHERE found""",
        ),
    ),
    "target_retrieval": (
        target_retrieval,
        with_ctes(
            "lines relations",
            _ALIGNED
            + """, rk AS (SELECT CASE WHEN NOT found OR target_k NOT IN (SELECT k FROM gr WHERE is_aligned) THEN NULL WHEN stance = 'support' THEN 1 WHEN stance = 'neutral' THEN 2 END AS rank
                 FROM al WHERE gresolved)
               SELECT round_even(count(*) FILTER (rank <= 1) / count(*), 6) AS recall_at_1, round_even(count(*) FILTER (rank <= 3) / count(*), 6) AS recall_at_3 FROM rk""",
        ),
    ),
    "link_precision": (
        link_precision,
        with_ctes(
            "lines relations",
            _ALIGNED
            + """ SELECT round_even(count(*) FILTER (is_aligned AND r.cited_work_id IS NOT NULL AND stance = 'support' AND target_k IN (SELECT k FROM gr WHERE is_aligned))
                 / count(*), 4) AS precision_at_threshold, count(*) AS claim_resolved_predicted
               FROM relations r JOIN gr ON assertion_id = 'R' || k WHERE resolution = 'claim_resolved'""",
        ),
    ),
    "stance_calibration": (
        stance_calibration,
        with_ctes(
            "lines relations",
            _ALIGNED
            + """, sc AS (SELECT round(stance_confidence, 3) AS confidence, coalesce(stance = gstance, false) AS correct FROM al WHERE found)
               SELECT greatest(ceil(confidence * 5), 1)::INT AS bin, count(*) AS n, round_even(avg(confidence), 6) AS mean_confidence,
                 round_even(avg(correct::INT), 6) AS accuracy FROM sc GROUP BY 1""",
        ),
    ),
    "operations": (
        operations,
        """SELECT count(*) AS papers, round_even(sum(value / 100), 6) AS total_seconds, round_even(count(*) / sum(value / 100), 6) AS throughput_papers_per_s,
             round_even(avg(value / 100), 6) AS mean_latency_s, max(value / 100) AS max_latency_s, 0.0::DOUBLE AS cost_per_paper_usd FROM events""",
    ),
    "extractor_comparison": (
        extractor_comparison,
        with_ctes(
            "lines",
            _GOLD
            + """, m AS (SELECT unnest(['precision', 'recall', 'f1', 'tp', 'fp', 'fn', 'effect_direction_accuracy', 'negation_accuracy', 'certainty_accuracy']) AS metric,
                 unnest([round_even(tp / np, 4), round_even(tp / (tp + fn), 4), round_even(2 * (tp / np) * (tp / (tp + fn)) / (tp / np + tp / (tp + fn)), 4),
                   tp, np - tp, fn, round_even(da, 4), round_even(na, 4), round_even(ca, 4)])::DOUBLE AS rules,
                 unnest([0, round_even(tp / (tp + fn), 4), 0, tp, 0, fn, round_even(da, 4), round_even(na, 4), round_even(ca2, 4)])::DOUBLE AS replay FROM s)
               SELECT 'extraction' AS stage, * FROM m""",
        ),
    ),
}
