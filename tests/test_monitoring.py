import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import monitoring as M
from claimloom.plans.lineage import fresh_path
from claimloom.streaming import monitors as S

CLAIM = (
    "claim_id string, work_id string, title string, normalized_text string, verbatim_text string, section_facet string, "
    "functions array<string>, stances array<string>, resolutions array<string>, year int"
)
SEARCH = (
    "search_id string, owner_id string, name string, q string, section string, function string, stance string, "
    "resolution string, min_year int, max_year int"
)


def setup(spark):
    claims = spark.createDataFrame(
        [
            ("c1", "w1", "T1", "Drug helps", "x", "Results", ["method"], ["support"], ["claim_resolved"], 2020),
            ("c2", "w2", None, "other", "a DRUG case", "Methods", [], [], ["unresolved"], None),
            ("c3", "w3", "T3", "none", "none", "Results", [], ["support"], [], 2019),
        ],
        CLAIM,
    )
    searches = spark.createDataFrame(
        [("s1", "u", "drugs", " drug ", None, None, None, None, None, None), ("s2", "u", "all supported", "", None, None, "support", None, None, None),
         ("s3", "v", "recent", "drug", "RESULTS", None, None, None, 2020, None)],
        SEARCH,
    )
    return claims, searches


def test_saved_searches(spark, rows):
    claims, searches = setup(spark)
    hits = M.search_hits(claims, searches)
    assert rows(hits, "search_id", "claim_id") == [("s1", "c1"), ("s1", "c2"), ("s2", "c1"), ("s2", "c3"), ("s3", "c1")]
    seen = spark.createDataFrame([("s1", "c1"), ("s1", "gone"), ("s2", "c1")], "search_id string, claim_id string")
    alerts, baseline = M.saved_search_alerts(hits, seen, searches)
    assert rows(alerts, "source_id", "claim_id") == [("s1", "c2"), ("s2", "c3"), ("s3", "c1")]
    assert {r.summary for r in alerts.collect()} >= {'New match for "drugs": w2 — other'}
    again, _ = M.saved_search_alerts(hits, baseline, searches)
    assert again.count() == 0


def brute_hits(claims, searches):
    found = []
    for c in claims:
        for s in searches:
            term, section = (s.q or "").strip(" ").lower(), None if s.section is None else s.section.strip(" ").lower()
            texts = [x.lower() for x in (c.normalized_text, c.verbatim_text) if x is not None]
            held = [(s.function, c.functions), (s.stance, c.stances), (s.resolution, c.resolutions)]
            years = (s.min_year is None or (c.year is not None and c.year >= s.min_year)) and (s.max_year is None or (c.year is not None and c.year <= s.max_year))
            if (not term or any(term in x for x in texts)) and (section is None or (c.section_facet or "\0").lower() == section) and years and all(w is None or w in (v or []) for w, v in held):
                found.append((s.search_id, c.claim_id))
    return sorted(found, key=repr)


@pytest.mark.parametrize("per_index", [100_000, 20, 1])
def test_an_index_of_searches_finds_what_each_search_finds(spark, rows, per_index):
    from claimloom.operators.search_index import match_searches

    rng = random.Random(3)
    word = lambda: rng.choice(["drug", "Drug trial", "ÉTÉ", "a b", "", "rug", None])
    few = lambda values: [v for v in values if rng.random() < 0.5] if rng.random() < 0.9 else None
    claims = spark.createDataFrame(
        [(f"c{i}", "w", "T", word(), word(), rng.choice(["Results", "methods", None]), few(["method", "x", None]), few(["support", "support"]), few(["r"]), rng.choice([2000, 2010, None])) for i in range(80)], CLAIM
    ).repartition(4)
    searches = spark.createDataFrame(
        [(f"s{i}", "u", "n", rng.choice(["drug", " RUG ", "été", "", None, "b"]), rng.choice([None, None, " results", "METHODS "]), rng.choice([None, None, "method"]),
          rng.choice([None, None, "support"]), rng.choice([None, None, "r"]), rng.choice([None, None, 2005]), rng.choice([None, None, 2005])) for i in range(60)], SEARCH
    )
    shaped = searches.select("search_id", F.lower(F.trim("q")).alias("term"), F.lower(F.trim("section")).alias("section"), "function", "stance", "resolution", "min_year", "max_year")
    got = match_searches(claims, shaped, per_index)
    assert got.columns == [*claims.columns, "search_id"]
    assert rows(got, "search_id", "claim_id") == brute_hits(claims.collect(), searches.collect())
    assert match_searches(claims, shaped.limit(0), per_index).collect() == [] and match_searches(claims.limit(0), shaped, per_index).collect() == []


def test_delta_and_alerts(spark, rows):
    members = spark.createDataFrame([("k", "w1"), ("k", "w2"), ("k", "w3")], "set_id string, work_id string")
    works = spark.createDataFrame([("w1", "One", False), ("w2", None, True), ("w3", "Three", None)], "work_id string, title string, is_retracted boolean")
    counts = spark.createDataFrame([("w1", 5, 1), ("w3", 2, 2)], "subject_id string, support long, contradict long")
    now = M.stance_snapshot(members, works, counts)
    before = spark.createDataFrame([("k", "w1", 3, 4, False), ("k", "w2", 0, 0, False)], "set_id string, work_id string, support long, contradict long, retracted boolean")
    delta = M.citation_delta(now, before)
    assert rows(M.delta_members(delta), "work_id", "new_support", "new_contradict") == [("w1", 2, 0), ("w3", 2, 2)]
    assert rows(M.delta_totals(delta)) == [("k", 4, 2)]
    sets = spark.createDataFrame([("k", "u", "Kit")], "set_id string, owner_id string, name string")
    summaries = sorted(r.summary for r in M.collection_alerts(delta, sets).collect())
    assert summaries == [
        '"Kit": One gained 2 new supporting citation(s)', '"Kit": Three gained 2 new contradicting citation(s)',
        '"Kit": Three gained 2 new supporting citation(s)', '"Kit": w2 has been retracted',
    ]
    assert M.collection_alerts(M.citation_delta(now, now), sets).count() == 0


def test_map_monitor_first_run_is_silent(spark):
    candidates = spark.createDataFrame([("m", None, "CorpusId:1", "New", 2), ("n", "w", None, None, 1)], "set_id string, work_id string, external_id string, title string, connection_score long")
    seen = spark.createDataFrame([], "set_id string, candidate_id string")
    maps = spark.createDataFrame([("m", "u", "Map", None), ("n", "u", "Old", 1)], "set_id string, owner_id string, name string, last_checked_at int")
    alerts, baseline = M.discovery_alerts(candidates, seen, maps)
    assert [r.summary for r in alerts.collect()] == ['"Old": newly connected paper — w (connected to 1 seed(s))']
    later, _ = M.discovery_alerts(candidates, baseline, maps.withColumn("last_checked_at", F.lit(2)))
    assert later.count() == 0


def test_feed(spark, rows):
    alerts = spark.createDataFrame([("a", "u", 1), ("b", "u", 3), ("c", "u", 2), ("d", "v", 1)], "alert_id string, owner_id string, created_at int")
    marks = spark.createDataFrame([("b",), ("b",)], "alert_id string")
    assert rows(M.unread_feed(alerts, marks, 1), "owner_id", "alert_id") == [("u", "c"), ("v", "d")]
    assert rows(M.unread_counts(alerts, marks)) == [("u", 2), ("v", 1)]
    sized = alerts.withColumns({"work_id": F.col("alert_id"), "support": F.col("created_at"), "contradict": F.lit(0), "added_at": F.col("created_at")})
    assert [r.work_id for r in M.sort_members(sized, "support_desc").collect()] == ["b", "c", "a", "d"]
    assert [r.work_id for r in M.sort_members(sized, "added_asc").collect()] == ["a", "d", "c", "b"]


def test_stream_remembers_across_batches(spark, rows):
    claims, searches = setup(spark)
    claims = claims.withColumn("seen_at", F.to_timestamp(F.lit("2024-01-01")))
    folder = fresh_path(spark, "claims")
    for _ in range(3):
        claims.coalesce(1).write.mode("append").parquet(folder)
    stream = S.read_table_stream(spark, folder, claims, 1)
    got = rows(S.run_new_hits(spark, stream, searches), "search_id", "claim_id")
    assert got == rows(M.search_hits(claims, searches), "search_id", "claim_id")


def test_snapshot_monitor_goes_on_from_its_state(spark, rows):
    """Totals add up over batches and runs, a retraction alerts once, and a run without new files changes nothing."""
    schema, folder = "set_id string, work_id string, stance string, retracted boolean", fresh_path(spark, "statements")
    land = lambda *r: spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(folder)
    monitor = S.SnapshotMonitor(spark, fresh_path(spark, "monitor"))
    run = lambda: monitor.run(S.read_table_stream(spark, folder, spark.createDataFrame([], schema), 1))
    land(("k", "w", "support", None), ("k", "w", "contradict", False), ("k", "v", None, None), (None, "w", "support", True))
    land(("k", "w", "support", True), ("k", "w", "neutral", True))
    run()
    assert rows(monitor.alerts()) == [("k", "w", "new_contradict", 1), ("k", "w", "new_support", 1), ("k", "w", "new_support", 1), ("k", "w", "retraction", 1)]
    run()
    land(("k", "w", None, True), ("j", "w", "contradict", False))
    run()
    assert rows(monitor.latest()) == [("j", "w", 0, 1, False), ("k", "v", 0, 0, False), ("k", "w", 2, 1, True)]
    assert monitor.alerts().count() == 5 and monitor.alerts().filter("alert_type = 'retraction'").count() == 1


def test_a_batch_writes_only_the_members_it_touches(spark):
    """The second batch adds one row to the output, though a hundred members are known."""
    schema, folder = "set_id string, work_id string, stance string, retracted boolean", fresh_path(spark, "statements")
    monitor = S.SnapshotMonitor(spark, fresh_path(spark, "monitor"))
    for rows_ in ([("k", f"w{i}", "neutral", False) for i in range(100)], [("k", "w7", "neutral", False)]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(folder)
        monitor.run(S.read_table_stream(spark, folder, spark.createDataFrame([], schema), 1))
    assert spark.read.schema(S.SnapshotMonitor.OUT).parquet(f"{monitor.root}/changes").count() == 101
