"""Queries over citation pairs, tallies and paper reports, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations as C
from ..plans import bindings as B
from .ctes import with_ctes


def citation_pairs(t):
    return C.citation_pairs(*B.edge_sets(t)).select(
        "citing_work_id", "cited_work_id", F.array_join("sources", ",").alias("sources"), "is_influential"
    )


def mention_citation_pairs(t):
    mentions = B.line_relations(t).select(
        F.col("evidence_passage_id").alias("passage_id"), "cited_work_id"
    )
    pairs = C.mention_pairs(mentions, B.line_passages(t), B.line_versions(t))
    return C.usable_pairs(pairs).groupBy("citing_work_id", "cited_work_id").agg(F.count("*").alias("mentions"))


def citation_degrees(t):
    works = B.all_works(t).select("work_id")
    return C.citation_degrees(works, C.citation_pairs(*B.edge_sets(t)))


def citation_tallies(t):
    return C.tallies(B.line_statements(t))


def claim_citation_tallies(t):
    return C.tallies(C.relations_to_claims(B.line_relations(t)))


def collection_tallies(t):
    return C.member_tallies(C.tallies(B.line_statements(t)), B.set_members(t))


def member_stance_snapshot(t):
    counts = C.stance_counts(B.line_statements(t)).withColumnRenamed("subject_id", "work_id")
    retracted = B.part_works(t).select("work_id", F.col("is_retracted").alias("retracted"))
    return (
        B.set_members(t)
        .select("set_id", "work_id")
        .join(retracted, "work_id")
        .join(counts, "work_id", "left")
        .na.fill(0, ["support", "contradict"])
    )


def paper_report_facets(t):
    return C.report_facets(B.line_statements(t))


def paper_report_timeline(t):
    kept = B.line_statements(t).filter(C.statement_filter(min_year=1996, max_year=2000))
    return C.report_timeline(kept)


def paper_report_conflicts(t):
    kept = B.line_statements(t).filter(C.statement_filter(section="Results", min_year=1996))
    return C.report_conflicts(kept)


_TALLY_SELECT = """
    SELECT subject_id, 'stance' AS dimension, stance AS value, count(*) AS n FROM {s} WHERE stance IS NOT NULL GROUP BY 1, 3
    UNION ALL SELECT subject_id, 'function', function, count(*) FROM {s} WHERE function IS NOT NULL GROUP BY 1, 3
    UNION ALL SELECT subject_id, 'resolution', resolution, count(*) FROM {s} GROUP BY 1, 3
    UNION ALL SELECT subject_id, 'section', coalesce(section, 'unspecified'), count(*) FROM {s} GROUP BY 1, 3"""
_TOTALS = """
    UNION ALL SELECT subject_id, 'total', 'all', count(*) FROM {s} GROUP BY 1
    UNION ALL SELECT subject_id, 'abstained', 'all', count(*) FILTER (stance IS NULL AND function IS NULL) FROM {s} GROUP BY 1"""

ENTRIES = {
    "citation_pairs": (citation_pairs, with_ctes("pairs", "SELECT * FROM pairs")),
    "mention_citation_pairs": (
        mention_citation_pairs,
        with_ctes(
            "relations passages versions",
            """SELECT v.work_id AS citing_work_id, cited_work_id, count(*) AS mentions
               FROM relations r JOIN passages p ON r.evidence_passage_id = p.passage_id
               JOIN versions v ON p.paper_version_id = v.version_id
               WHERE cited_work_id IS NOT NULL AND v.work_id <> cited_work_id GROUP BY 1, 2""",
        ),
    ),
    "citation_degrees": (
        citation_degrees,
        with_ctes(
            "all_works pairs",
            """SELECT work_id,
                      coalesce(i.n, 0) AS cited_by_count, coalesce(o.n, 0) AS reference_count
               FROM all_works LEFT JOIN (SELECT cited_work_id AS w, count(*) n FROM pairs GROUP BY 1) i ON i.w = work_id
               LEFT JOIN (SELECT citing_work_id AS w, count(*) n FROM pairs GROUP BY 1) o ON o.w = work_id""",
        ),
    ),
    "citation_tallies": (
        citation_tallies,
        with_ctes("statements", (_TALLY_SELECT + _TOTALS).format(s="statements")),
    ),
    "claim_citation_tallies": (
        claim_citation_tallies,
        with_ctes(
            "relations",
            ", c AS (SELECT *, target_interpretation_id AS subject_id FROM relations WHERE target_interpretation_id IS NOT NULL)"
            + (_TALLY_SELECT + _TOTALS).format(s="c"),
        ),
    ),
    "collection_tallies": (
        collection_tallies,
        with_ctes(
            "statements members",
            ", tally AS (" + (_TALLY_SELECT + _TOTALS).format(s="statements") + ")"
            """ SELECT set_id, dimension, value, sum(n)::BIGINT AS n FROM members JOIN tally ON work_id = subject_id
               GROUP BY 1, 2, 3""",
        ),
    ),
    "member_stance_snapshot": (
        member_stance_snapshot,
        with_ctes(
            "statements members part_works",
            """SELECT set_id, m.work_id, is_retracted AS retracted, coalesce(s, 0) AS support, coalesce(c, 0) AS contradict
               FROM members m JOIN part_works USING (work_id)
               LEFT JOIN (SELECT subject_id, count(*) FILTER (stance = 'support') AS s,
                                 count(*) FILTER (stance = 'contradict') AS c FROM statements GROUP BY 1)
                 ON subject_id = m.work_id""",
        ),
    ),
    "paper_report_facets": (
        paper_report_facets,
        with_ctes(
            "statements",
            _TALLY_SELECT.format(s="statements")
            + " UNION ALL SELECT subject_id, 'year', year::VARCHAR, count(*) FROM statements WHERE year IS NOT NULL GROUP BY 1, 3",
        ),
    ),
    "paper_report_timeline": (
        paper_report_timeline,
        with_ctes(
            "statements",
            """SELECT subject_id, year, count(*) AS statement_count, count(DISTINCT citing_work_id) AS citing_work_count
               FROM statements WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2""",
        ),
    ),
    "paper_report_conflicts": (
        paper_report_conflicts,
        with_ctes(
            "statements",
            """, kept AS (SELECT * FROM statements WHERE section = 'Results' AND year >= 1996),
               per_work AS (SELECT subject_id, citing_work_id, bool_or(coalesce(stance, '') = 'support')
                                   AND bool_or(coalesce(stance, '') = 'contradict') AS both_sides FROM kept GROUP BY 1, 2),
               totals AS (SELECT subject_id, count(*) FILTER (stance = 'support') AS s,
                                 count(*) FILTER (stance = 'contradict') AS c, count(*) AS n FROM kept GROUP BY 1)
               SELECT subject_id, s AS supporting_statements, c AS contradicting_statements,
                      n - s - c AS neutral_or_unclear_statements,
                      (SELECT count(*) FROM per_work p WHERE p.subject_id = totals.subject_id AND both_sides)
                        AS conflicting_citing_work_count,
                      s > 0 AND c > 0 AS has_conflicting_stances
               FROM totals""",
        ),
    ),
}
