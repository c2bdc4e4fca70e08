"""What joins and aggregates move between tasks; the results are held by the other tests and the oracles."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimloom.operators import citations as C
from claimloom.operators import claims as K
from claimloom.operators import evaluation as V
from claimloom.operators import graph as G
from claimloom.operators import takedown as D
from claimloom.operators import tracing as T
from claimloom.plans.keys import digest, possibly_in
from claimloom.plans.skew import spread_nulls


@pytest.fixture
def moved(spark):
    """The lines of a plan from each exchange by a key down to what it reads, without broadcasts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def lines(df, key):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        return [" ".join(plan[i : i + 2]) for i, line in enumerate(plan) if f"Exchange hashpartitioning({key}#" in line]

    yield lines
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_stand_ins_are_short_and_many(spark):
    ids = spark.range(5000).select(F.concat(F.lit("R" * 50), F.col("id").cast("string")).alias("by"), F.lit(None).cast("string").alias("key"))
    found = [r[0] for r in ids.select(spread_nulls(F.col("key"), F.col("by"))).collect()]
    assert len(set(found)) > 4000 and all(k.startswith("\0") and len(k) <= 6 for k in found)
    known = ids.limit(1).select(spread_nulls(F.lit("w"), F.col("by")), spread_nulls(F.col("key"), F.col("key"))).first()
    assert known[0] == "w" and known[1].startswith("\0")


def test_unread_ids_of_relations_stay_behind(spark, moved):
    relations = table(
        spark, "assertion_id string, citing_work_id string, cited_work_id string, target_interpretation_id string, stance string",
        ("a", "x", "w", None, "support"), ("b", "x", "w", "i1", None), ("c", "y", None, "i1", "support"), ("d", "y", None, None, "support"),
    )
    got = C.incoming_relations(relations, table(spark, "interpretation_id string, work_id string", ("i1", "w"))).groupBy("subject_id").count()
    assert moved(got, "_target") and not any("assertion_id" in line for line in moved(got, "_target"))
    assert [tuple(r) for r in got.collect()] == [("w", 3)]


def test_statements_of_a_subject_meet_before_they_are_copied(spark):
    said = [("hot" if i % 4 else f"s{i}", ("support", "contradict", None)[i % 3], "method" if i % 5 else None, "claim_resolved", "" if i % 2 else "Results") for i in range(2000)]
    statements = table(spark, "subject_id string, stance string, function string, resolution string, section string", *said).repartition(7)
    out = C.tallies(statements)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("RebalancePartitions")
    want = Counter()
    for subject, *values in said:
        want[subject, "total", "all"] += 1
        want[subject, "abstained", "all"] += values[0] is None and values[1] is None
        for name, value in zip(("stance", "function", "resolution", "section"), values, strict=True):
            value = value or "unspecified" if name == "section" else value
            want[subject, name, value] += value is not None
    found = {(r.subject_id, r.dimension, r.value): r.n for r in out.collect()}
    assert found == {k: n for k, n in want.items() if k[2] is not None}


def test_passages_meet_their_work_once(spark, moved):
    versions = table(spark, "version_id string, work_id string", ("v", "w"), ("v", "u"))
    works = table(spark, "work_id string, title string, venue string, year int", ("w", "T", None, 2020), ("w", "T2", "V", None))
    passages = table(spark, "passage_id string, paper_version_id string, section string, verbatim_text string", ("p", "v", "Results", "text"), ("q", None, None, "lost"))
    occurrences = table(spark, "occurrence_id string, passage_id string, occurrence_type string", ("o", "p", "x"), ("o2", "q", "x"))
    claims = table(spark, "interpretation_id string, claim_occurrence_id string, normalized_text string", ("i", "o", "says"), ("j", "o2", "says"))
    flat = K.claims_flat(claims, occurrences, passages, versions, works)
    assert moved(flat, "work_id") and not any("verbatim_text" in line for line in moved(flat, "work_id"))
    assert sorted(tuple(r) for r in flat.select("interpretation_id", "work_id", "title", "verbatim_text").collect()) == [("i", "w", "T", "text"), ("i", "w", "T2", "text")]


def test_search_candidates_take_their_texts_last(spark, moved):
    from claimloom.catalog.monitors import _candidates
    from claimloom.plans.bindings import Tables

    found = _candidates(Tables(spark, "/root/testdata/sf0.001"))
    by_work = [line for key in ("citing_work_id", "evidence_passage_id") for line in moved(found, key)]
    assert by_work and not any("normalized_text" in line for line in by_work)


def test_two_states_from_one_reading(spark):
    statements = table(spark, "subject_id string, stance string, at int", ("w", "support", 1), ("w", "support", 3), ("w", "contradict", None), ("v", None, 1))
    found = C.stance_counts(statements, F.col("at") < 2)
    assert found.columns == ["subject_id", "support", "contradict", "support_then", "contradict_then"]
    assert sorted(tuple(r) for r in found.collect()) == [("v", 0, 0, 0, 0), ("w", 2, 1, 1, 0)]
    assert C.stance_counts(statements).columns == ["subject_id", "support", "contradict"]


def test_pairs_are_read_once_for_both_directions(spark):
    terms = table(spark, "interpretation_id string, curie string", ("i", "a"), ("i", "b"), ("j", "b"), ("j", None))
    kg = table(spark, "subject string, object string, predicate string, sources array<struct<resource_role string, resource_id string>>", ("b", "a", None, []), ("a", "b", "p:x_y", []), ("a", "c", "p:z", []))
    out = G.corroborating_edges(terms, kg)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r)[:5] for r in out.collect()) == [("i", "a", "p:x_y", "b", "x y"), ("i", "b", "biolink:related_to", "a", "related to")]


def test_edges_of_a_trace_are_made_once(spark, monkeypatch):
    made, real = [], T.stage
    monkeypatch.setattr(T, "stage", lambda df, label: (made.append(label), real(df, label))[1])
    edges = table(
        spark, "assertion_id string, source string, target string, work_id string, link_score double, stance_score double, accepted boolean, evidence string",
        ("r1", "a", "b", "w", 0.5, 0.5, True, "e"), ("r2", "b", "c", "w", 0.5, None, True, None), ("r3", "c", None, "w", None, None, None, None),
    )
    traced = T.trace_paths(edges, table(spark, "start string", ("a",)), 3)
    assert made == ["edges", "hop", "hop", "hop"]
    assert sorted((r.hop, r.node, r.ends) for r in traced.collect()) == [(1, "b", None), (2, "c", None), (3, "w", "paper")]


def test_assertions_bear_only_what_is_read(spark):
    gold = spark.createDataFrame(
        [("q1", "d1", "support", "i1"), ("q1", "d1", "support", "i1"), ("q2", "d2", "neutral", None), (None, "d1", "support", "i1"), ("q3", None, "support", "i3")],
        "gold_id string, cited_doi string, stance string, target_gold_id string",
    )
    alignment = spark.createDataFrame([("q1", "p1", "c1"), ("q1", "p9", "c1"), ("q2", "p2", None), (None, "p3", "c1"), ("q3", "p3", "c3")], "gold_id string, pred_id string, occurrence_id string")
    assertions = spark.createDataFrame(
        [("c1", "d1", "r2", "neutral", "t2"), ("c1", "d1", "r1", "support", "t1"), ("c1", "d1", None, "unclear", "t0"), (None, "d2", "r4", "neutral", "t4"), ("c3", None, "r5", "support", "t5")],
        "occurrence_id string, cited_doi string, assertion_id string, stance string, target_interpretation_id string",
    )
    first = assertions.groupBy("occurrence_id", "cited_doi").agg(F.min_by(F.struct("stance"), "assertion_id").alias("a"))
    want = gold.join(alignment, "gold_id").join(first, ["occurrence_id", "cited_doi"], "left")
    got = V.aligned_relations(gold, alignment, assertions, ("stance",))
    assert got.columns == want.columns
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect())) and got.count() == 6
    whole = V.aligned_relations(gold, alignment, assertions).select("a.*")
    assert whole.columns == ["assertion_id", "stance", "target_interpretation_id"]
    assert got.schema["a"].dataType.names == ["stance"]


def test_filter_of_keys_loses_none_and_lets_few_through(spark):
    rows = spark.range(4000).selectExpr("if(id % 100 = 99, null, concat('key-', id)) as k", "id")
    wanted = spark.range(0, 4000, 40).selectExpr("concat('key-', id) as w").unionByName(spark.sql("select cast(null as string) as w"))
    marked = possibly_in(rows, "k", wanted)
    assert marked.columns == ["k", "id", "_possible"] and marked.count() == 4000
    through = {r.k for r in marked.filter("_possible").collect()}
    assert {f"key-{i}" for i in range(0, 4000, 40)} <= through and None not in through and len(through) < 400
    assert not possibly_in(rows, "k", wanted.limit(0)).filter("_possible").count()


def test_digests_are_short_and_keep_nulls(spark):
    out = spark.sql("select explode(array('a', 'b', 'a', null)) as k").select("k", digest("k").alias("d")).collect()
    assert [r.d is None for r in out] == [False, False, False, True] and len({bytes(r.d) for r in out[:3]}) == 2 and len(out[0].d) == 12


def test_rows_without_takedown_stay_where_they_are(spark, moved):
    columns = "id string, text string, tombstone_id string, removed_reason string"
    table_ = spark.createDataFrame([(f"i{n}", "text", None, None) for n in range(500)] + [(None, "text", None, None), ("old", None, "t0", "why")], columns)
    keys = spark.createDataFrame([("i1", "t1", "gone"), ("old", "t2", "gone")], "_key string, tombstone_id string, removed_reason string")
    out = D.blank_content(table_, keys, D.Dependent("id", "id", "work", ("text",)))
    assert out.count() == 502 and out.filter("text is not null").count() == 500
    assert sorted(tuple(r) for r in out.filter("tombstone_id is not null").collect()) == [("i1", None, "t1", "gone"), ("old", None, "t0", "why")]
    assert moved(out, "id") and "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_scores_and_candidates_move_digests(spark):
    from claimloom.catalog import claims, monitors
    from claimloom.plans.bindings import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = claims.claim_scores(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") >= 6
    found = monitors._candidates(t)
    assert "evidence_passage_id" not in found.columns and "claim_occurrence_id" not in found.columns


def test_exports_are_read_by_every_core(spark):
    from claimloom.catalog.sources import _exports
    from claimloom.plans.bindings import Tables

    plan = _exports(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_a_hop_exchanges_only_edges_of_its_nodes(spark, monkeypatch):
    seen = []

    def watched(rows, key, wanted, *more):
        out = possibly_in(rows, key, wanted, *more)
        seen.append((rows.count(), out.filter("_possible").count()))
        return out

    monkeypatch.setattr(T, "possibly_in", watched)
    rows = [(f"r{i}", f"n{i}", f"n{i + 1}", "w", 1.0, 1.0, True, "e") for i in range(300)]
    edges = spark.createDataFrame(rows, "assertion_id string, source string, target string, work_id string, link_score double, stance_score double, accepted boolean, evidence string")
    got = T.trace_paths(edges, spark.createDataFrame([("n0",)], "start string"), 3)
    assert sorted((r.hop, r.node) for r in got.collect()) == [(1, "n1"), (2, "n2"), (3, "n3")]
    assert len(seen) == 3 and all(n == 300 and 1 <= few < 30 for n, few in seen)
