"""Takedowns, review and cohort selection, each with its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import review as R
from ..operators import selection as S
from ..operators import takedown as T
from ..operators.citations import citation_pairs
from ..plans import bindings as B
from ..plans.lineage import fresh_path
from .ctes import with_ctes

_DEPENDENTS = {
    "works": T.Dependent("work_id", "work_id", "work", ("title", "doi")),
    "versions": T.Dependent("version_id", "work_id", "work", ()),
    "passages": T.Dependent("passage_id", "paper_version_id", "versions", ("verbatim_text",)),
    "occurrences": T.Dependent("occurrence_id", "passage_id", "passages", ()),
    "claims": T.Dependent("interpretation_id", "claim_occurrence_id", "occurrences", ("normalized_text",)),
}
_TEXT = {"works": "title", "passages": "verbatim_text", "claims": "normalized_text"}


def _tombstones(t):
    """Pending orders of two priorities are removed, some are lifted a day later, some of those removed again."""
    pending = t.orders.filter("o_orderstatus = 'P' and o_orderpriority in ('1-URGENT', '5-LOW')")

    def rows(letter, action, reason, days, condition):
        return pending.filter(condition).selectExpr(
            f"concat('{letter}', o_orderkey) as tombstone_id", "concat('O', o_orderkey) as work_id", f"'{action}' as action", f"{reason} as reason",
            f"o_orderdate + interval {days} days as requested_at",
        )

    return rows("T", "remove", "o_orderpriority", 0, "true").unionByName(rows("L", "lift", "'appeal'", 1, "o_custkey % 3 = 0")).unionByName(
        rows("Z", "remove", "'again'", 2, "o_custkey % 9 = 0")
    )


def standing_takedowns(t):
    return T.standing_takedowns(_tombstones(t))


def takedown_store(t):
    """All stored texts after the removals before 1996, then all tombstones, then all of them once more."""
    folder = fresh_path(t.spark, "store")
    tables = {"works": B.order_works(t), "versions": B.line_versions(t), "passages": B.line_passages(t), "occurrences": B.line_occurrences(t), "claims": B.line_interpretations(t)}
    T.create_store(t.spark, folder, tables, _DEPENDENTS, 4)
    stones = _tombstones(t)
    T.apply_takedowns(t.spark, folder, stones.filter("action = 'remove' and requested_at < '1996-01-01'"), _DEPENDENTS, 4)
    for _ in range(2):
        version = T.apply_takedowns(t.spark, folder, stones, _DEPENDENTS, 4)
    T.vacuum(t.spark, folder)
    shown = (
        T.read_table(t.spark, folder, name).select(
            F.lit(name).alias("table_name"), F.col(_DEPENDENTS[name].key).alias("id"), F.col(text).alias("content"), "tombstone_id", "removed_reason", F.lit(version).alias("version")
        )
        for name, text in _TEXT.items()
    )
    return reduce(lambda a, b: a.unionByName(b), shown)


def _annotations(t):
    """Stances by three readers and functions by two; some lines have been read by one only."""
    lines = B.keyed_lines(t)
    rows = (
        ("stance", "ann1", "l_returnflag", "true"), ("stance", "ann2", "case when l_tax < 0.02 then 'N' else l_returnflag end", "l_linenumber <> 3"),
        ("stance", "ann3", "'A'", "l_linenumber = 3 and l_quantity > 25"), ("function", "ann1", "cast(l_linenumber % 4 as string)", "true"),
        ("function", "ann2", "cast(case when l_quantity > 40 then 0 else l_linenumber % 4 end as string)", "l_discount > 0"),
    )
    said = (f"case when {where} then named_struct('task', '{task}', 'item_id', k, 'annotator', '{who}', 'label', {label}) end" for task, who, label, where in rows)
    return lines.selectExpr(f"inline(array_compact(array({', '.join(said)})))")  # one scan for all readers


def annotator_agreement(t):
    out = R.cohen_kappa(R.label_pairs(_annotations(t)))
    return out.withColumns({c: F.round(c, 9) for c in ("observed", "expected", "kappa")})


def annotator_disagreements(t):
    return R.disagreements(R.label_pairs(_annotations(t))).withColumn("share", F.round("share", 9))


def agreement_interval(t):
    return R.kappa_interval(R.label_pairs(_annotations(t)), 100, seed=7).withColumns({c: F.round(c, 9) for c in ("kappa_low", "kappa_high")})


def _queued(t):
    """Relations with the price of their part as value; a part with support and contradiction is contested."""
    split = t.lineitem.filter("l_discount <> 0").groupBy("l_partkey").agg((F.max(F.col("l_returnflag") == "A") & F.max(F.col("l_returnflag") == "R")).alias("contested"))
    lines = B.keyed_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(split, "l_partkey", "left")
    return lines.selectExpr("concat('R', k) as assertion_id", "case when l_tax > 0.02 then l_tax * 10 end as confidence", "contested", "p_retailprice as value")


def review_queue(t):
    queue = R.review_queue(_queued(t), "contested")
    return queue.select("position", "assertion_id", "contested")


def review_queue_page(t):
    """Twenty items of the eleventh page of 500, by least confidence; the page is the feature."""
    return R.queue_page(R.review_queue(_queued(t), "confidence"), 10, 500).select("position", "assertion_id")


def filter_funnel(t):
    works = B.all_works(t).join(B.set_members(t).select("work_id").distinct().withColumn("held", F.lit(True)), "work_id", "left")
    steps = [
        ("screening", "has a year", F.col("year").isNotNull()), ("screening", "from 1994 on", F.col("year") >= 1994), ("eligibility", "not retracted", ~F.col("is_retracted")),
        ("eligibility", "in building or machinery", F.col("venue").rlike("BUILDING|MACHINERY")), ("included", "not in a saved set", F.col("held").isNull()),
    ]
    return S.filter_funnel(works, steps)


#: Values of each field that are linked; the cut is the feature.
_TOP = 30


def linked_fields(t):
    works, pairs = B.order_works(t), citation_pairs(*B.edge_sets(t))
    fields = [S.field_values(works, B.authorships(t), None, None, pairs, f) for f in ("authors", "sources", "references")]
    return S.linked_fields(*fields, top=_TOP)


def metadata_completeness(t):
    return S.completeness(B.all_works(t).unionByName(B.reference_links(t).selectExpr("citing_work_id as work_id", "cited_title as title", "cited_doi as doi", "cited_year as year"), True)).withColumn(
        "missing_share", F.round("missing_share", 9)
    )


_STONES = """, pending AS (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW')),
stones AS (
    SELECT 'T' || o_orderkey AS tombstone_id, 'O' || o_orderkey AS work_id, 'remove' AS action, o_orderpriority AS reason, o_orderdate AS requested_at FROM pending
    UNION ALL SELECT 'L' || o_orderkey, 'O' || o_orderkey, 'lift', 'appeal', o_orderdate + INTERVAL 1 DAY FROM pending WHERE o_custkey % 3 = 0
    UNION ALL SELECT 'Z' || o_orderkey, 'O' || o_orderkey, 'remove', 'again', o_orderdate + INTERVAL 2 DAY FROM pending WHERE o_custkey % 9 = 0),
standing AS (SELECT work_id, tombstone_id, reason AS removed_reason FROM (
    SELECT * FROM stones QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY requested_at DESC, tombstone_id DESC) = 1) WHERE action = 'remove')"""
_NOTES = """, notes AS (
    SELECT 'stance' AS task, k AS item_id, 'ann1' AS annotator, l_returnflag AS label FROM lines
    UNION ALL SELECT 'stance', k, 'ann2', CASE WHEN l_tax < 0.02 THEN 'N' ELSE l_returnflag END FROM lines WHERE l_linenumber <> 3
    UNION ALL SELECT 'stance', k, 'ann3', 'A' FROM lines WHERE l_linenumber = 3 AND l_quantity > 25
    UNION ALL SELECT 'function', k, 'ann1', (l_linenumber % 4)::VARCHAR FROM lines
    UNION ALL SELECT 'function', k, 'ann2', (CASE WHEN l_quantity > 40 THEN 0 ELSE l_linenumber % 4 END)::VARCHAR FROM lines WHERE l_discount > 0),
said AS (SELECT task, item_id, annotator, max(label) AS label, row_number() OVER (PARTITION BY task, item_id ORDER BY annotator) AS place FROM notes GROUP BY 1, 2, 3),
both_said AS (SELECT a.task, a.item_id, a.label AS l1, b.label AS l2 FROM said a JOIN said b ON a.task = b.task AND a.item_id = b.item_id AND a.place = 1 AND b.place = 2)"""
_QUEUE = """, queued AS (
    SELECT 'R' || k AS assertion_id, CASE WHEN l_tax > 0.02 THEN l_tax * 10 END AS confidence, coalesce(contested, false) AS contested, p_retailprice AS value
    FROM lines JOIN part ON l_partkey = p_partkey LEFT JOIN (
        SELECT l_partkey, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AS contested FROM lineitem WHERE l_discount <> 0 GROUP BY 1) USING (l_partkey))"""

ENTRIES = {
    "standing_takedowns": (standing_takedowns, _STONES.replace(",", "WITH", 1) + "SELECT * FROM standing"),
    "takedown_store": (
        takedown_store,
        with_ctes(
            "order_works passages interpretations",
            _STONES + """, marks AS (
    SELECT work_id, coalesce(e.tombstone_id, s.tombstone_id) AS tombstone_id, CASE WHEN e.tombstone_id IS NOT NULL THEN e.reason ELSE s.removed_reason END AS removed_reason
    FROM (SELECT * FROM stones WHERE action = 'remove' AND requested_at < '1996-01-01' QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY requested_at DESC, tombstone_id DESC) = 1) e
    FULL JOIN standing s USING (work_id)),
stored AS (
    SELECT 'works' AS table_name, work_id AS id, title AS content, work_id FROM order_works
    UNION ALL SELECT 'passages', passage_id, verbatim_text, 'O' || substr(paper_version_id, 2) FROM passages
    UNION ALL SELECT 'claims', interpretation_id, normalized_text, 'O' || split_part(substr(interpretation_id, 2), '-', 1) FROM interpretations)
SELECT table_name, id, CASE WHEN tombstone_id IS NULL THEN content END AS content, tombstone_id, removed_reason, 2::BIGINT AS version FROM stored LEFT JOIN marks USING (work_id)""",
        ),
    ),
    "annotator_agreement": (
        annotator_agreement,
        with_ctes(
            "lines",
            _NOTES + """, totals AS (SELECT task, count(*) AS items, avg((l1 = l2)::INT) AS observed FROM both_said GROUP BY 1),
by_chance AS (SELECT task, sum(a.n::DOUBLE * b.n) AS s FROM (SELECT task, l1 AS l, count(*) AS n FROM both_said GROUP BY ALL) a JOIN (SELECT task, l2 AS l, count(*) AS n FROM both_said GROUP BY ALL) b USING (task, l) GROUP BY 1)
SELECT task, items, round(observed, 9) AS observed, round(s / (items * items), 9) AS expected, round((observed - s / (items * items)) / (1 - s / (items * items)), 9) AS kappa
FROM totals JOIN by_chance USING (task)""",
        ),
    ),
    "annotator_disagreements": (
        annotator_disagreements,
        with_ctes(
            "lines",
            _NOTES + """SELECT task, least(l1, l2) AS label, greatest(l1, l2) AS other_label, count(*) AS items, round(count(*) / any_value(n), 9) AS share
            FROM both_said JOIN (SELECT task, count(*) AS n FROM both_said GROUP BY 1) USING (task) WHERE l1 <> l2 GROUP BY ALL""",
        ),
    ),
    "agreement_interval": (agreement_interval, None),
    "review_queue": (
        review_queue,
        with_ctes("lines", _QUEUE + "SELECT row_number() OVER (ORDER BY contested DESC, confidence NULLS FIRST, value DESC, assertion_id) AS position, assertion_id, contested FROM queued"),
    ),
    "review_queue_page": (
        review_queue_page,
        with_ctes(
            "lines",
            _QUEUE + "SELECT row_number() OVER (ORDER BY confidence NULLS FIRST, contested DESC, value DESC, assertion_id) AS position, assertion_id FROM queued QUALIFY position > 5000 AND position <= 5500",
        ),
    ),
    "filter_funnel": (
        filter_funnel,
        with_ctes(
            "all_works members",
            """, held AS (SELECT DISTINCT work_id, true AS held FROM members),
            tested AS (SELECT coalesce(year IS NOT NULL, false) AS c1, coalesce(year >= 1994, false) AS c2, coalesce(NOT is_retracted, false) AS c3,
                              coalesce(regexp_matches(venue, 'BUILDING|MACHINERY'), false) AS c4, held IS NULL AS c5 FROM all_works LEFT JOIN held USING (work_id)),
            n AS (SELECT count(*) AS n0, count(*) FILTER (c1) AS n1, count(*) FILTER (c1 AND c2) AS n2, count(*) FILTER (c1 AND c2 AND c3) AS n3,
                         count(*) FILTER (c1 AND c2 AND c3 AND c4) AS n4, count(*) FILTER (c1 AND c2 AND c3 AND c4 AND c5) AS n5 FROM tested)
            SELECT 0 AS step, 'identification' AS stage, 'all records' AS criterion, n0 AS entered, 0::BIGINT AS excluded, n0 AS passed FROM n
            UNION ALL SELECT 1, 'screening', 'has a year', n0, n0 - n1, n1 FROM n UNION ALL SELECT 2, 'screening', 'from 1994 on', n1, n1 - n2, n2 FROM n
            UNION ALL SELECT 3, 'eligibility', 'not retracted', n2, n2 - n3, n3 FROM n UNION ALL SELECT 4, 'eligibility', 'in building or machinery', n3, n3 - n4, n4 FROM n
            UNION ALL SELECT 5, 'included', 'not in a saved set', n4, n4 - n5, n5 FROM n""",
        ),
    ),
    "linked_fields": (
        linked_fields,
        with_ctes(
            "order_works authorships pairs",
            f""", f1 AS (SELECT DISTINCT work_id, trim(author) AS value FROM authorships WHERE trim(author) <> ''),
            f2 AS (SELECT DISTINCT work_id, trim(venue) AS value FROM order_works), f3 AS (SELECT DISTINCT citing_work_id AS work_id, cited_work_id AS value FROM pairs),
            t1 AS (SELECT value FROM f1 GROUP BY 1 ORDER BY count(*) DESC, value LIMIT {_TOP}), t2 AS (SELECT value FROM f2 GROUP BY 1 ORDER BY count(*) DESC, value LIMIT {_TOP}),
            t3 AS (SELECT value FROM f3 GROUP BY 1 ORDER BY count(*) DESC, value LIMIT {_TOP})
            SELECT 'left' AS side, a.value, b.value AS next_value, count(*) AS works FROM f1 a JOIN f2 b USING (work_id) WHERE a.value IN (FROM t1) AND b.value IN (FROM t2) GROUP BY ALL
            UNION ALL SELECT 'right', a.value, b.value, count(*) FROM f2 a JOIN f3 b USING (work_id) WHERE a.value IN (FROM t2) AND b.value IN (FROM t3) GROUP BY ALL""",
        ),
    ),
    "metadata_completeness": (
        metadata_completeness,
        with_ctes(
            "all_works links",
            """, recs AS (SELECT work_id, title, venue, year, doi, is_retracted FROM all_works
                          UNION ALL SELECT citing_work_id, cited_title, NULL, cited_year, cited_doi, NULL FROM links),
            counted AS (SELECT count(*) AS n, count(*) FILTER (work_id IS NULL OR trim(work_id) = '') AS c1, count(*) FILTER (title IS NULL OR trim(title) = '') AS c2,
                               count(*) FILTER (venue IS NULL OR trim(venue) = '') AS c3, count(*) FILTER (year IS NULL) AS c4, count(*) FILTER (doi IS NULL OR trim(doi) = '') AS c5,
                               count(*) FILTER (is_retracted IS NULL) AS c6 FROM recs),
            rows_ AS (SELECT unnest(['work_id', 'title', 'venue', 'year', 'doi', 'is_retracted']) AS field, n, unnest([c1, c2, c3, c4, c5, c6]) AS missing FROM counted)
            SELECT field, n AS records, missing, round(missing / n, 9) AS missing_share, CASE WHEN missing = 0 THEN 'complete' WHEN missing = n THEN 'completely missing' WHEN missing / n < 0.1 THEN 'excellent'
                   WHEN missing / n < 0.2 THEN 'good' WHEN missing / n < 0.5 THEN 'acceptable' ELSE 'poor' END AS rating FROM rows_""",
        ),
    ),
}
