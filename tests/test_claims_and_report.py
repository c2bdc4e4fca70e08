import pytest
from pyspark.sql import functions as F

from claimloom.operators import citations as C
from claimloom.operators import claims as K

STATEMENT = (
    "subject_id string, assertion_id string, citing_work_id string, stance string, function string, resolution string, "
    "section string, year int"
)


@pytest.fixture(scope="module")
def statements(spark):
    return spark.createDataFrame(
        [
            ("w", "a1", "c1", "support", "direct_evidence", "claim_resolved", "Results", 2021),
            ("w", "a2", "c1", "contradict", "comparison", "paper_resolved", "Results", 2021),
            ("w", "a3", "c2", None, None, "paper_resolved", None, None),
            ("w", "a4", "c3", "neutral", None, "paper_resolved", "", 2020),
        ],
        STATEMENT,
    )


def test_tallies(statements):
    got = {(r.dimension, r.value): r.n for r in C.tallies(statements).collect()}
    assert got[("total", "all")] == 4 and got[("abstained", "all")] == 1
    assert got[("section", "unspecified")] == 2 and ("stance", None) not in got
    assert sum(n for (d, _), n in got.items() if d == "resolution") == 4


def test_report(statements, rows):
    report = C.paper_report(statements, section="Results")
    assert rows(report["timeline"]) == [("w", 2021, 2, 1)]
    conflict = report["conflicts"].first()
    assert conflict.has_conflicting_stances and conflict.conflicting_citing_work_count == 1
    only = C.paper_report(statements, stance="contradict")["conflicts"].first()
    assert not only.has_conflicting_stances
    assert C.paper_report(statements, section="results")["tallies"].count() == 0
    facets = {(r.dimension, r.value): r.n for r in report["facets"].collect()}
    assert facets[("year", "2021")] == 2 and ("year", None) not in facets


def test_incoming_relations_counts_a_work_once(spark, rows):
    relations = spark.createDataFrame(
        [("a", "w", "i1"), ("b", "w", None), ("c", None, "i1"), ("d", None, None), ("e", "v", "i1")],
        "assertion_id string, cited_work_id string, target_interpretation_id string",
    )
    claims = spark.createDataFrame([("i1", "w")], "interpretation_id string, work_id string")
    got = rows(C.incoming_relations(relations, claims), "subject_id", "assertion_id")
    assert got == [("v", "e"), ("w", "a"), ("w", "b"), ("w", "c"), ("w", "e")]


def test_pairs_keep_three_valued_influence(spark, rows):
    e = spark.createDataFrame(
        [("a", "b", "x", None), ("a", "b", "y", False), ("c", "b", "x", None), ("a", "a", "x", True), ("d", "b", "x", True), ("d", "b", "x", False)],
        "citing_work_id string, cited_work_id string, source string, is_influential boolean",
    )
    assert rows(C.citation_pairs(e)) == [("a", "b", ["x", "y"], False), ("c", "b", ["x"], None), ("d", "b", ["x"], True)]


def test_heads_and_cycles(spark, rows):
    df = spark.createDataFrame(
        [("i1", "o1", [], 1), ("i2", "o1", ["i1"], 2), ("j1", "o2", ["j2"], 1), ("j2", "o2", ["j1"], 2)],
        "interpretation_id string, claim_occurrence_id string, parent_interpretation_ids array<string>, created_at int",
    )
    assert rows(K.revision_heads(df), "interpretation_id") == [("i2",)]
    assert rows(K.head_per_occurrence(df)) == [("o1", "i2", False), ("o2", "j2", True)]


def test_stale_and_reviewed(spark, rows):
    relations = spark.createDataFrame(
        [("a", "i1", "proposed"), ("b", "i2", "proposed"), ("c", None, "proposed")],
        "assertion_id string, target_interpretation_id string, status string",
    )
    revisions = spark.createDataFrame([(["i1"], True), (["i2"], False)], "parent_interpretation_ids array<string>, is_material boolean")
    got = dict(rows(K.relation_status(relations, revisions), "assertion_id", "status"))
    assert got == {"a": "stale_pending_review", "b": "proposed", "c": "proposed"}
    reviews = spark.createDataFrame(
        [("RelationAssertion", "a", "reject", 1, "r1"), ("RelationAssertion", "a", "Accepted", 2, "r2"), ("Claim", "b", "reject", 1, "r3")],
        "subject_type string, subject_id string, label string, decided_at int, review_id string",
    )
    assert dict(rows(K.reviewed_status(relations, reviews), "assertion_id", "status")) == {"a": "accepted", "b": "proposed", "c": "proposed"}


def test_facets_ignore_categorical_filters(spark):
    claims = spark.createDataFrame(
        [("i1", "o1", "Drug reduces", "x", "Results", 2020, "T"), ("i2", "o2", "other", "drug text", None, 2021, "U"), ("i3", "o3", "none", "none", "Results", 2020, "V")],
        "interpretation_id string, occurrence_id string, normalized_text string, verbatim_text string, section string, year int, title string",
    )
    relations = spark.createDataFrame(
        [("o1", "support", "method", "claim_resolved"), ("o1", "support", None, "paper_resolved"), ("o2", None, None, "unresolved")],
        "citing_occurrence_id string, stance string, function string, resolution string",
    )
    found = K.search_candidates(claims, relations, q=" DRUG ")
    facets = {(r.dimension, r.value): r.n for r in K.claim_facets(found).collect()}
    assert facets == {
        ("section", "Results"): 1, ("section", "unspecified"): 1, ("stance", "support"): 1, ("function", "method"): 1,
        ("resolution", "claim_resolved"): 1, ("resolution", "paper_resolved"): 1, ("resolution", "unresolved"): 1,
    }
    assert K.facet_filter(found, section=" RESULTS ", stance="support").count() == 1
    page = K.search_page(found, 1, 1).first()
    assert page.interpretation_id == "i1"


def test_cluster_conflict_and_corroboration(spark, rows):
    memberships = spark.createDataFrame(
        [("x", "i1", "active"), ("x", "i2", "active"), ("x", "i3", "removed"), ("y", "i4", "active")],
        "cluster_id string, interpretation_id string, status string",
    )
    works = spark.createDataFrame([("i1", "w1"), ("i2", "w2"), ("i3", "w3"), ("i4", "w1")], "interpretation_id string, work_id string")
    assert rows(K.corroboration(memberships, works)) == [("i1", 1), ("i2", 1), ("i4", 0)]
    members = memberships.withColumn(
        "stance", F.element_at(F.array(F.lit("support"), F.lit("unclear"), F.lit("contradict"), F.lit("neutral")), F.substring("interpretation_id", 2, 1).cast("int"))
    )
    assert rows(K.cluster_conflicts(members)) == [("x", 3, True), ("y", 1, False)]


def test_relations_without_their_targets_need_no_exchange(spark, rows, capsys):
    from types import SimpleNamespace

    from claimloom.plans import bindings as B

    columns = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    )
    line = lambda order, part: (order, part, 1, 1, 2.0, 3.0, 0.1, 0.05, "A", "F", None)
    tables = SimpleNamespace(lineitem=spark.createDataFrame([line(2, 7), line(10, 7), line(3, None), line(4, 8), line(4, 8)], columns))
    relations = B.line_relations(tables)
    target = {"2": "I10", "10": "I10", "4": "I4"}  # the smallest as text
    got = relations.selectExpr("substring(citing_work_id, 2) as o", "substring_index(target_interpretation_id, '-', 1) as target")
    assert rows(got) == sorted(((o, target[o]) for o in ("2", "10", "4", "4")), key=repr)
    unread = relations.select("citing_occurrence_id", "stance")
    assert unread.count() == 4
    unread.explain()
    shown = capsys.readouterr().out
    assert "Exchange" not in shown and "Join" not in shown
