import duckdb
import pytest

import __spark_entry__ as entry
from claimloom.catalog import citations as QC
from claimloom.catalog import enrichment as QE
from claimloom.catalog import graphs as QG
from claimloom.catalog import texts as QT
from claimloom.operators import monitoring as M
from claimloom.plans.bindings import TABLES, Tables
from claimloom.plans.ranking import with_global_position
from tools.check_oracle import rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SMALL)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_nested_loops(t):
    for query in (QC.citation_tallies, QE.identifier_resolution, QE.backfill_papers, QG.one_hop_trace, QT.target_resolution, QG.entity_kg_edges):
        text = plan(query(t))
        assert "NestedLoop" not in text and "CartesianProduct" not in text, query.__name__


def test_no_python_in_column_work(t):
    for query in (QT.cue_classification, QT.stance_distribution, QT.target_resolution, QE.identifier_normalize, QC.paper_report_facets):
        assert "Python" not in plan(query(t)), query.__name__


def test_scans_read_only_what_they_need(t):
    text = plan(QC.citation_pairs(t)).split("== Physical Plan ==")[1]
    assert "l_extendedprice" not in text and "l_comment" not in text
    lookup = plan(QE.corpus_lookup(t))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in lookup


def test_saved_searches_join_nothing(spark, t):
    from claimloom.catalog.monitors import _event_claims, _event_searches

    text = plan(M.search_hits(_event_claims(t.events), _event_searches(t))).split("== Physical Plan ==")[1]
    assert "Join" not in text


def test_global_position_over_many_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"), F.lit(2).alias("w"))
    out = with_global_position(df, [F.desc("k"), F.col("id")], "position", "w", "before").orderBy("position").collect()
    want = sorted(((-(i % 3), i) for i in range(1000)))
    assert [r.id for r in out] == [i for _, i in want]
    assert [r.position for r in out] == list(range(1, 1001)) and all(r.before == 2 * (r.position - 1) for r in out)


def test_registry(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert len(entry.entry(spark).columns) == 4


@pytest.mark.parametrize(
    "name",
    "author_metrics source_metrics citation_tallies claim_facets neighborhood_k2 seed_discovery backfill_papers pasted_identifiers "
    "release_diff cue_classification best_claim_match pair_prf_overlapping collection_alerts document_parse completion_replay".split(),
)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cursor = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
