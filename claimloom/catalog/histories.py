"""Cohort histories, each with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.citations import citation_pairs
from ..plans import bindings as B
from .ctes import with_ctes

#: Works of a year in the historiograph; the cut is the feature.
_PER_YEAR = 25


def _pairs(t):
    return citation_pairs(*B.edge_sets(t))


def local_citations(t):
    return H.local_citation_scores(B.order_works(t), _pairs(t)).select("work_id", "year", "local_citations")


def historiograph_nodes(t):
    return H.historiograph(B.order_works(t), _pairs(t), _PER_YEAR)[0]


def historiograph_edges(t):
    return H.historiograph(B.order_works(t), _pairs(t), _PER_YEAR)[1]


def reference_spectrum(t):
    return H.reference_spectrum(B.reference_links(t).select("cited_year"))


def _citations(t):
    years = lambda side: B.order_works(t).select(F.col("work_id").alias(f"{side}_work_id"), F.col("year").alias(f"{side}_year"))
    return _pairs(t).join(years("citing"), "citing_work_id").join(years("cited"), "cited_work_id")


def reference_classes(t):
    return H.reference_classes(_citations(t).select("cited_work_id", "cited_year", "citing_year"))


def _production(t):
    """Papers by venue; the months of the table stand in for years, of which it has few."""
    months = t.orders.select("o_orderkey", F.expr("year(o_orderdate) * 12 + month(o_orderdate)").alias("year"))
    venue = B.order_works(t).select(F.expr("cast(substr(work_id, 2) as bigint)").alias("o_orderkey"), F.col("venue").alias("field"))
    return venue.join(months, "o_orderkey").groupBy("field", "year").agg(F.count("*").alias("documents"))


def _rounded(frame, **digits):
    return frame.withColumns({c: F.round(c, n) for c, n in digits.items()})


def life_cycle(t):
    return _rounded(H.life_cycle(_production(t)), capacity=1, midpoint=1, duration=1, rmse=2, r2=3)


def life_cycle_forecast(t):
    rows = _production(t)
    return _rounded(H.life_cycle_curve(rows, H.life_cycle(rows), 12), fitted=1)


_LOCAL = """, lcs AS (
    SELECT w.*, coalesce(n, 0) AS local_citations FROM order_works w LEFT JOIN (
        SELECT cited_work_id AS work_id, count(*) AS n FROM pairs WHERE citing_work_id IN (SELECT work_id FROM order_works) GROUP BY 1) USING (work_id)),
nodes AS (SELECT work_id, title, year, local_citations, row_number() OVER (PARTITION BY year ORDER BY local_citations DESC, work_id) AS rank
          FROM lcs WHERE year IS NOT NULL AND local_citations > 0 QUALIFY rank <= 25)"""

ENTRIES = {
    "local_citations": (local_citations, with_ctes("pairs order_works", _LOCAL + "SELECT work_id, year, local_citations FROM lcs")),
    "historiograph_nodes": (historiograph_nodes, with_ctes("pairs order_works", _LOCAL + "SELECT * FROM nodes")),
    "historiograph_edges": (
        historiograph_edges,
        with_ctes(
            "pairs order_works",
            _LOCAL + """SELECT p.citing_work_id, p.cited_work_id, a.year AS citing_year, b.year AS cited_year
            FROM pairs p JOIN nodes a ON a.work_id = citing_work_id JOIN nodes b ON b.work_id = cited_work_id WHERE a.year >= b.year""",
        ),
    ),
    "reference_spectrum": (
        reference_spectrum,
        with_ctes(
            "links",
            """, counts AS (SELECT cited_year, count(*) AS n FROM links WHERE cited_year IS NOT NULL GROUP BY 1),
            dense AS (SELECT y AS year, coalesce(n, 0) AS refs FROM (SELECT unnest(generate_series(min(cited_year), max(cited_year))) AS y FROM counts) LEFT JOIN counts ON y = cited_year)
            SELECT year, refs AS "references", median(refs) OVER around AS median, refs - median(refs) OVER around AS deviation
            FROM dense WINDOW around AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
        ),
    ),
    "reference_classes": (
        reference_classes,
        with_ctes(
            "pairs order_works",
            r""", cites AS (SELECT cited_work_id, b.year AS cited_year, a.year AS citing_year
                FROM pairs JOIN order_works a ON a.work_id = citing_work_id JOIN order_works b ON b.work_id = cited_work_id WHERE a.year >= b.year),
            per AS (SELECT cited_work_id, cited_year, citing_year, count(*) AS n FROM cites GROUP BY ALL),
            refs AS (SELECT cited_work_id, cited_year, sum(n)::BIGINT AS citations FROM per GROUP BY ALL),
            years AS (SELECT unnest(generate_series((SELECT min(citing_year) FROM per), (SELECT max(citing_year) FROM per))) AS y),
            grid AS (SELECT r.cited_work_id, r.cited_year, r.citations, y, coalesce(n, 0) AS n
                     FROM refs r JOIN years ON y >= r.cited_year LEFT JOIN per p ON p.cited_work_id = r.cited_work_id AND p.citing_year = y),
            norms AS (SELECT cited_year, y, avg(n) AS mean, sqrt(greatest(avg(n * n) - avg(n) * avg(n), 0)) AS spread, sum(n) AS all_n FROM grid GROUP BY ALL),
            signs AS (SELECT cited_work_id, cited_year, citations,
                        string_agg(CASE WHEN all_n = 0 THEN '0' WHEN n > mean + spread THEN '+' WHEN n < mean - spread THEN '-' ELSE '0' END, '' ORDER BY y) AS sequence
                      FROM grid JOIN norms USING (cited_year, y) GROUP BY ALL)
            SELECT *, CASE WHEN regexp_matches(sequence, '^-{3}.*\+') THEN 'sleeping beauty'
                           WHEN regexp_matches(sequence, '^.{0,2}\+') AND NOT regexp_matches(sequence, '^.{3,}\+') THEN 'hot paper'
                           WHEN regexp_matches(sequence, '\+.*-') THEN 'life cycle'
                           WHEN NOT contains(sequence, '-') THEN 'constant performer' ELSE 'other' END AS class FROM signs""",
        ),
    ),
    "life_cycle": (life_cycle, None),
    "life_cycle_forecast": (life_cycle_forecast, None),
}
