"""Bibliometric queries, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bibliometrics as M
from ..operators.citations import citation_in_degree
from ..plans import bindings as B
from .ctes import with_ctes


def _degrees(t):
    return citation_in_degree(*B.edge_sets(t))


def author_h_index(t):
    metrics = M.author_metrics(B.order_works(t), B.authorships(t), _degrees(t))
    return M.ranked_authors(metrics).select("name", "document_count", "citation_count", "h_index")


def author_metrics(t):
    metrics = M.author_metrics(B.order_works(t), B.authorships(t), _degrees(t))
    return metrics.select("author_key", "name", "document_count", "citation_count", "h_index")


def lotka_points(t):
    return M.lotka_points(B.order_works(t), B.authorships(t))


def lotka_fit(t):
    fit = M.lotka_fit(M.lotka_points(B.order_works(t), B.authorships(t)))
    return fit.select("levels", F.bround("exponent", 4).alias("exponent"), F.bround("constant", 4).alias("constant"))


def source_metrics(t):
    return M.source_metrics(B.all_works(t), _degrees(t))


def bradford_zones(t):
    venues = B.order_works(t).groupBy(F.col("venue").alias("source")).agg(F.count("*").alias("document_count"))
    return M.bradford_summary(M.bradford_zones(venues))


def country_metrics(t):
    return M.country_metrics(M.work_countries(B.affiliations(t)))


def international_share(t):
    return M.international_share(M.work_countries(B.affiliations(t)))


def corpus_summary(t):
    out = M.corpus_summary(B.all_works(t), B.authorships(t), _degrees(t))
    return out.withColumns(
        {c: F.bround(c, 6) for c in ("co_authors_per_doc", "avg_citations_per_doc")}
    )


def annual_production(t):
    return M.annual_production(B.all_works(t))


def growth_rate(t):
    return M.growth_rate(B.all_works(t)).select(F.bround("annual_growth_rate", 6).alias("annual_growth_rate"))


def top_cited(t):
    return M.top_cited(B.all_works(t), _degrees(t), 50)


def top_authors(t):
    return M.top_authors(B.order_works(t), B.authorships(t), 50)


def top_sources(t):
    return M.top_sources(B.all_works(t), 50)


def cohort_year_filter(t):
    return M.cohort(B.all_works(t), None, 1996, 1999).groupBy("year").agg(F.count("*").alias("documents"))


def cohort_saved_set(t):
    members = M.saved_set_members(B.saved_sets(t), B.set_members(t), "collection", "S3", "U3")
    return M.cohort(B.all_works(t), members).select("work_id", "title")


def members_per_set(t):
    return M.members_per_set(B.saved_sets(t), B.set_members(t)).select("set_id", "name", "member_count")


def paper_listing(t):
    """One page of the paper listing, ordered by title then id."""
    return (
        B.all_works(t).orderBy(F.asc_nulls_last("title"), "work_id").offset(20).limit(50).select("work_id", "title", "year", "doi")
    )


_AUTHOR = """, aw AS (SELECT DISTINCT lower(trim(author)) AS author_key, trim(author) AS name, a.work_id
               FROM authorships a JOIN order_works USING (work_id)),
   ac AS (SELECT author_key, name, work_id, coalesce(citation_count, 0) AS c FROM aw LEFT JOIN degrees USING (work_id)),
   rk AS (SELECT *, row_number() OVER (PARTITION BY author_key ORDER BY c DESC) AS rn FROM ac),
   am AS (SELECT author_key, min(name) AS name, count(*) AS document_count, sum(c)::BIGINT AS citation_count,
                 count(*) FILTER (c >= rn) AS h_index FROM rk GROUP BY 1)"""
_LOTKA = """, d AS (SELECT lower(trim(author)) AS k, count(DISTINCT a.work_id) AS documents
               FROM authorships a JOIN order_works USING (work_id) GROUP BY 1),
   pts AS (SELECT documents, count(*) AS authors FROM d GROUP BY 1)"""
_BRADFORD = """, z AS (SELECT source, document_count,
      CASE WHEN mid <= tot / 3.0 THEN 1 WHEN mid <= 2 * tot / 3.0 THEN 2 ELSE 3 END AS zone
      FROM (SELECT source, document_count, sum(document_count) OVER () AS tot,
                   coalesce(sum(document_count) OVER (ORDER BY document_count DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     + document_count / 2.0 AS mid FROM v))"""
_COUNTRIES = """, parsed AS (
      SELECT DISTINCT work_id, CASE seg
               WHEN 'usa' THEN 'United States' WHEN 'uk' THEN 'United Kingdom' WHEN 'england' THEN 'United Kingdom'
               WHEN 'korea' THEN 'South Korea' WHEN 'prc' THEN 'China' WHEN 'russian federation' THEN 'Russia'
               WHEN 'south africa' THEN 'South Africa'
               ELSE upper(seg[1]) || seg[2:] END AS country
      FROM (SELECT work_id, rtrim(lower(trim(string_split(affiliation, ',')[-1])), '.') AS seg FROM affiliations)
      WHERE seg IN ('usa', 'germany', 'uk', 'france', 'korea', 'china', 'japan', 'england', 'canada', 'australia', 'italy',
                    'spain', 'brazil', 'india', 'prc', 'sweden', 'norway', 'denmark', 'south africa', 'russian federation',
                    'mexico', 'chile')),
   wc AS (SELECT work_id, count(*) AS n FROM parsed GROUP BY 1)"""

ENTRIES = {
    "author_h_index": (
        author_h_index,
        with_ctes(
            "order_works authorships degrees",
            _AUTHOR
            + """ SELECT name, document_count, citation_count, h_index FROM am
               """,
        ),
    ),
    "author_metrics": (author_metrics, with_ctes("order_works authorships degrees", _AUTHOR + " SELECT * FROM am")),
    "lotka_points": (lotka_points, with_ctes("order_works authorships", _LOTKA + " SELECT * FROM pts")),
    "lotka_fit": (
        lotka_fit,
        with_ctes(
            "order_works authorships",
            _LOTKA
            + """ SELECT count(*) AS levels, round_even(-regr_slope(log10(authors), log10(documents)), 4) AS exponent,
                   round_even(pow(10, regr_intercept(log10(authors), log10(documents))), 4) AS constant FROM pts""",
        ),
    ),
    "source_metrics": (
        source_metrics,
        with_ctes(
            "all_works degrees",
            """, sw AS (SELECT trim(venue) AS source, coalesce(citation_count, 0) AS c
                        FROM all_works LEFT JOIN degrees USING (work_id) WHERE trim(venue) <> ''),
               rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC) AS rn FROM sw),
               v AS (SELECT source, count(*) AS document_count, sum(c)::BIGINT AS citation_count,
                            count(*) FILTER (c >= rn) AS h_index FROM rk GROUP BY 1)"""
            + _BRADFORD
            + " SELECT source, document_count, citation_count, h_index, zone FROM v JOIN z USING (source, document_count)",
        ),
    ),
    "bradford_zones": (
        bradford_zones,
        with_ctes(
            "order_works",
            ", v AS (SELECT venue AS source, count(*) AS document_count FROM order_works GROUP BY 1)"
            + _BRADFORD
            + """ SELECT i AS zone, coalesce(source_count, 0) AS source_count, coalesce(article_count, 0) AS article_count
               FROM (SELECT unnest([1, 2, 3]) AS i) LEFT JOIN (
                 SELECT zone, count(*) AS source_count, sum(document_count)::BIGINT AS article_count FROM z GROUP BY 1) ON i = zone""",
        ),
    ),
    "country_metrics": (
        country_metrics,
        with_ctes(
            "affiliations",
            _COUNTRIES
            + """ SELECT country, count(*) AS document_count, count(*) FILTER (n = 1) AS single_country,
                   count(*) FILTER (n > 1) AS multi_country, count(*) FILTER (n > 1) / count(*) AS mcp_ratio
               FROM parsed JOIN wc USING (work_id) GROUP BY 1""",
        ),
    ),
    "international_share": (
        international_share,
        with_ctes(
            "affiliations",
            _COUNTRIES
            + """ SELECT count(*) AS documents_with_country, count(*) FILTER (n > 1) * 100.0::DOUBLE / count(*) AS international_pct FROM wc""",
        ),
    ),
    "corpus_summary": (
        corpus_summary,
        with_ctes(
            "all_works authorships degrees",
            """, slots AS (SELECT work_id, count(*) AS n FROM authorships WHERE trim(author) <> '' GROUP BY 1),
               b AS (SELECT w.*, n, citation_count FROM all_works w LEFT JOIN slots USING (work_id) LEFT JOIN degrees USING (work_id))
               SELECT count(*) AS document_count, sum(n)::BIGINT AS author_appearances,
                      count(*) FILTER (n = 1) AS single_authored_count, min(year) AS min_year, max(year) AS max_year,
                      count(*) FILTER (year IS NULL) AS documents_without_year,
                      sum(citation_count)::BIGINT AS total_citations,
                      count(DISTINCT nullif(trim(venue), '')) AS source_count,
                      (SELECT count(DISTINCT lower(trim(author))) FROM authorships) AS author_count,
                      round_even(sum(n) / count(*), 6) AS co_authors_per_doc,
                      round_even(sum(citation_count) / count(*), 6) AS avg_citations_per_doc
               FROM b""",
        ),
    ),
    "annual_production": (
        annual_production,
        with_ctes(
            "all_works",
            """, c AS (SELECT year, count(*) AS n FROM all_works WHERE year IS NOT NULL GROUP BY 1)
               SELECT y AS year, coalesce(n, 0) AS document_count
               FROM (SELECT unnest(generate_series((SELECT min(year) FROM c), (SELECT max(year) FROM c))) AS y) LEFT JOIN c ON y = year""",
        ),
    ),
    "growth_rate": (
        growth_rate,
        with_ctes(
            "all_works",
            """, c AS (SELECT year, count(*) AS n FROM all_works WHERE year IS NOT NULL GROUP BY 1)
               SELECT round_even((pow(arg_max(n, year) / arg_min(n, year), 1.0 / (max(year) - min(year))) - 1) * 100, 6)
                      AS annual_growth_rate FROM c""",
        ),
    ),
    "top_cited": (
        top_cited,
        with_ctes(
            "all_works degrees",
            """SELECT work_id, title, year, citation_count FROM all_works JOIN degrees USING (work_id)
               ORDER BY citation_count DESC, coalesce(title, ''), work_id LIMIT 50""",
        ),
    ),
    "top_authors": (
        top_authors,
        with_ctes(
            "order_works authorships",
            """SELECT min(trim(author)) AS name, count(DISTINCT a.work_id) AS document_count
               FROM authorships a JOIN order_works USING (work_id)
               GROUP BY lower(trim(author)) ORDER BY document_count DESC, lower(trim(author)) LIMIT 50""",
        ),
    ),
    "top_sources": (
        top_sources,
        with_ctes(
            "all_works",
            """SELECT trim(venue) AS source, count(*) AS document_count FROM all_works WHERE trim(venue) <> ''
               GROUP BY 1 ORDER BY document_count DESC, source LIMIT 50""",
        ),
    ),
    "cohort_year_filter": (
        cohort_year_filter,
        with_ctes("all_works", "SELECT year, count(*) AS documents FROM all_works WHERE year BETWEEN 1996 AND 1999 GROUP BY 1"),
    ),
    "cohort_saved_set": (
        cohort_saved_set,
        with_ctes(
            "all_works members sets",
            """SELECT work_id, title FROM all_works WHERE work_id IN (
                 SELECT work_id FROM members JOIN sets USING (set_id) WHERE set_id = 'S3' AND owner_id = 'U3')""",
        ),
    ),
    "members_per_set": (
        members_per_set,
        with_ctes(
            "members sets",
            "SELECT set_id, name, coalesce(n, 0) AS member_count FROM sets LEFT JOIN (SELECT set_id, count(*) AS n FROM members GROUP BY 1) USING (set_id)",
        ),
    ),
    "paper_listing": (
        paper_listing,
        with_ctes("all_works", "SELECT work_id, title, year, doi FROM all_works ORDER BY title NULLS LAST, work_id LIMIT 50 OFFSET 20"),
    ),
}
