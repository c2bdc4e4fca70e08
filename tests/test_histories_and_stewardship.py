"""Cohort histories, life cycles, takedowns, agreement, review queues and selection."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.operators import history as H
from claimloom.operators import review as R
from claimloom.operators import selection as S
from claimloom.operators import takedown as T
from claimloom.plans.lineage import fresh_path

# --- histories -----------------------------------------------------------------------------------


def works(spark, rows):
    return spark.createDataFrame(rows, "work_id string, title string, year int")


def cites(spark, rows):
    return spark.createDataFrame(rows, "citing_work_id string, cited_work_id string")


def test_historiograph(spark):
    cohort = works(spark, [("a", "A", 2000), ("b", "B", 2000), ("c", "C", 2001), ("d", "D", 2003), ("e", "E", None), ("f", "F", 2000)])
    pairs = cites(spark, [("c", "a"), ("d", "a"), ("d", "a"), ("d", "b"), ("c", "b"), ("d", "c"), ("x", "c"), ("x", "f"), ("c", "e"), ("a", "c")])
    scores = {r.work_id: r.local_citations for r in H.local_citation_scores(cohort, pairs).collect()}
    assert scores == {"a": 2, "b": 2, "c": 2, "d": 0, "e": 1, "f": 0}
    nodes, edges = H.historiograph(cohort, pairs, 1)
    assert sorted((r.work_id, r.year, r.rank) for r in nodes.collect()) == [("a", 2000, 1), ("c", 2001, 1)]
    assert [(r.citing_work_id, r.cited_work_id) for r in edges.collect()] == [("c", "a")]  # a -> c leads forward in time


def test_reference_spectrum(spark):
    years = [1990] * 4 + [1991] + [1993] * 10 + [1995] * 2 + [None] * 3
    rows = H.reference_spectrum(spark.createDataFrame([(y,) for y in years], "cited_year int")).collect()
    got = {r.year: (r.references, r.median, r.deviation) for r in rows}
    assert got == {1990: (4, 1.0, 3.0), 1991: (1, 2.5, -1.5), 1992: (0, 1.0, -1.0), 1993: (10, 1.0, 9.0), 1994: (0, 1.0, -1.0), 1995: (2, 2.0, 0.0)}
    assert H.reference_spectrum(spark.createDataFrame([(None,)], "cited_year int")).collect() == []


def test_a_sleeping_beauty_and_the_other_classes(spark):
    """One odd reference among eight usual ones in each year; signs by hand from mean and deviation."""
    odd = {2000: ("beauty", [0, 0, 0, 0, 0, 9]), 2001: ("cycle", [1, 1, 1, 9, 0]), 2002: ("hot", [9, 9, 1, 1]), 2003: ("steady", [1, 1, 1])}
    by_year = {y: {o[0]: o[1], **{f"usual{y}-{i}": [1] * (2006 - y) for i in range(8)}} for y, o in odd.items()}
    rows = [(w, y, y + i) for y, works_ in by_year.items() for w, counts in works_.items() for i, n in enumerate(counts) for _ in range(n)]
    rows += [("beauty", 2000, 1999), ("beauty", None, 2001), ("beauty", 2000, None)]  # before its year, or without one
    got = {r.cited_work_id: r for r in H.reference_classes(spark.createDataFrame(rows, "cited_work_id string, cited_year int, citing_year int")).collect()}
    want = {}
    for y, works_ in by_year.items():
        for i in range(2006 - y):
            column = [counts[i] for counts in works_.values()]
            mean, spread = np.mean(column), np.std(column)
            for w, counts in works_.items():
                want[w] = want.get(w, "") + ("+" if counts[i] > mean + spread else "-" if counts[i] < mean - spread else "0")
    assert {w: r.sequence for w, r in got.items()} == want
    classes = {w: got[w]["class"] for w in ("beauty", "hot", "cycle", "steady", "usual2000-1")}
    assert classes == {"beauty": "sleeping beauty", "hot": "hot paper", "cycle": "life cycle", "steady": "constant performer", "usual2000-1": "constant performer"}
    assert got["beauty"].citations == 9
    assert H.reference_classes(spark.createDataFrame(rows, "cited_work_id string, cited_year int, citing_year int"), min_citations=9).count() == 3


def production(spark, fields):
    rows = [(f, 1980 + i, int(n)) for f, series in fields.items() for i, n in enumerate(series)]
    return spark.createDataFrame(rows, "field string, year int, documents long")


def logistic(capacity, midpoint, scale, years):
    totals = [capacity / (1 + math.exp(-(1980 + i - midpoint) / scale)) for i in range(years)]
    return np.diff(np.round([0, *totals]))


def numpy_fit(totals):
    """Damped Gauss-Newton on one field, from the same start."""
    t, y = np.arange(1980.0, 1980 + len(totals)), np.asarray(totals, float)
    p = np.array([y.max() * 1.1, t[np.argmax(y >= 0.55 * y.max())], max((t[-1] - t[0]) / 6, 0.5)])
    curve = lambda p: p[0] / (1 + np.exp(np.clip(-(t - p[1]) / p[2], -500, 500)))
    damping = 1e-3
    for _ in range(500):
        x, s = (t - p[1]) / p[2], curve(p) / p[0]
        slope = p[0] * s * (1 - s) / p[2]
        jacobian = np.stack([s, -slope, -slope * x], 1)
        a = jacobian.T @ jacobian
        trial = p + np.linalg.solve(a + damping * np.diag(np.diag(a)), jacobian.T @ (y - curve(p)))
        trial = np.maximum(trial, [1e-6, -1e6, 0.02])
        if np.sum((y - curve(trial)) ** 2) < np.sum((y - curve(p)) ** 2):
            p, damping = trial, damping / 5
        else:
            damping *= 7
    return p, np.sqrt(np.mean((y - curve(p)) ** 2))


def test_life_cycles_against_numpy(spark):
    rng = np.random.default_rng(2)
    fields = {
        "whole": logistic(1000, 1995, 3.0, 40), "growing": logistic(5000, 2005, 4.0, 24), "young": logistic(4000, 2020, 5.0, 24), "noisy": rng.poisson(logistic(800, 2000, 6.0, 35) + 2),
        "short": [3, 4, 5], "gap": [5, 0, 0, 0, 20, 40, 20, 5, 1],
    }
    got = {r.field: r for r in H.life_cycle(production(spark, fields)).collect()}
    assert got["short"].capacity is None and got["short"].stage is None and got["short"].years == 3
    for name in ("whole", "growing", "noisy", "gap"):
        (capacity, midpoint, scale), rmse = numpy_fit(np.cumsum(fields[name]))
        r = got[name]
        assert (r.capacity, r.midpoint, r.duration) == pytest.approx((capacity, midpoint, scale * math.log(81)), rel=1e-4)
        assert r.rmse == pytest.approx(rmse, rel=1e-3) and 0.9 < r.r2 <= 1
    assert (got["whole"].capacity, got["whole"].midpoint) == pytest.approx((1000, 1995), rel=2e-3)
    assert (got["whole"].stage, got["growing"].stage) == ("saturation", "growth") and got["young"].r2 > 0.99
    curve = H.life_cycle_curve(production(spark, fields), H.life_cycle(production(spark, fields)), 5).filter("field = 'whole'").orderBy("year").collect()
    assert len(curve) == 45 and curve[-1].observed is None and curve[-1].fitted == pytest.approx(1000, rel=5e-3)
    assert curve[15].fitted == pytest.approx(curve[15].observed, abs=3)
    assert H.life_cycle(production(spark, {})).collect() == []


# --- takedowns -----------------------------------------------------------------------------------

DEPENDENTS = {
    "works": T.Dependent("work_id", "work_id", "work", ("title",)),
    "passages": T.Dependent("passage_id", "work_id", "works", ("body", "note")),
    "claims": T.Dependent("claim_id", "passage_id", "passages", ("text",)),
}
STONE = "tombstone_id string, work_id string, action string, reason string, requested_at timestamp"


def stones(spark, *rows):
    from datetime import datetime

    return spark.createDataFrame([(i, w, a, r, None if d is None else datetime(2024, 1, d)) for i, w, a, r, d in rows], STONE)


def corpus(spark):
    tables = {
        "works": spark.createDataFrame([(f"w{i}", f"title secret{i}") for i in range(12)], "work_id string, title string"),
        "passages": spark.createDataFrame([(f"p{i}", f"w{i % 12}", f"body secret{i % 12}", None if i % 2 else f"secret{i % 12}") for i in range(40)], "passage_id string, work_id string, body string, note string"),
        "claims": spark.createDataFrame([(f"c{i}", f"p{i % 40}", f"claim secret{i % 40 % 12}") for i in range(100)] + [("c-orphan", None, "orphan")], "claim_id string, passage_id string, text string"),
    }
    folder = fresh_path(spark, "store")
    T.create_store(spark, folder, tables, DEPENDENTS, 5)
    return folder, tables


def contents(spark, folder, version=None):
    return {name: sorted(map(tuple, T.read_table(spark, folder, name, version).collect()), key=repr) for name in DEPENDENTS}


def test_standing_takedowns_are_merged_in_order(spark):
    got = T.standing_takedowns(
        stones(
            spark, ("t3", "w1", "remove", "again", 9), ("t1", "w1", "remove", "first", 1), ("t2", "w1", "lift", "appeal", 5), ("t4", "w2", "lift", "x", 3), ("t0", "w2", "remove", "y", 2),
            ("t5", "w3", "remove", "a", 4), ("t6", "w3", "remove", "b", 4), ("t5", "w3", "remove", "a", 4), ("t7", None, "remove", "z", 1), ("t8", "w4", "remove", "z", None),
        )
    )
    assert sorted(map(tuple, got.collect())) == [("w1", "t3", "again"), ("w3", "t6", "b")]


def test_a_takedown_reaches_all_tables_and_a_replay_changes_nothing(spark):
    folder, tables = corpus(spark)
    before = contents(spark, folder)
    first = stones(spark, ("t1", "w3", "remove", "rights", 1), ("t2", "w7", "remove", "court", 2), ("t9", "nowhere", "remove", "x", 2))
    assert T.apply_takedowns(spark, folder, first, DEPENDENTS, 5) == 1
    after = contents(spark, folder)
    words = repr(after)
    assert "secret3'" not in words and "secret7'" not in words and "secret4'" in words
    assert {n: [r[0] for r in rows] for n, rows in after.items()} == {n: [r[0] for r in rows] for n, rows in before.items()}  # every record stays
    marked = {r[0]: r[-2:] for r in after["claims"] if r[-2]}
    assert marked == {f"c{i}": (("t1", "rights") if i % 40 % 12 == 3 else ("t2", "court")) for i in range(100) if i % 40 % 12 in (3, 7)}
    assert ("c-orphan", None, "orphan", None, None) in after["claims"]
    for replay in (first, first.unionByName(first), stones(spark)):
        assert T.apply_takedowns(spark, folder, replay, DEPENDENTS, 5) == 1
    assert contents(spark, folder) == after and contents(spark, folder, 0) == before
    more = first.unionByName(stones(spark, ("t3", "w3", "lift", "appeal", 5), ("t4", "w5", "remove", "rights", 6)))
    assert T.apply_takedowns(spark, folder, more, DEPENDENTS, 5) == 2
    last = contents(spark, folder)
    assert "secret3'" not in repr(last) and "secret5'" not in repr(last)  # what is gone does not come back
    assert [r for r in last["works"] if r[0] == "w3"] == [("w3", None, "t1", "rights")]


def test_a_run_that_fails_before_the_manifest_changes_nothing(spark, monkeypatch):
    folder, _ = corpus(spark)
    before, stone = contents(spark, folder), stones(spark, ("t1", "w3", "remove", "rights", 1))

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(T, "_publish", fail)
    with pytest.raises(RuntimeError):
        T.apply_takedowns(spark, folder, stone, DEPENDENTS, 5)
    monkeypatch.undo()
    assert contents(spark, folder) == before and T.current_version(spark, folder) == 0
    assert T.apply_takedowns(spark, folder, stone, DEPENDENTS, 5) == 1 and "secret3'" not in repr(contents(spark, folder))


def test_vacuum_leaves_no_word_on_disk(spark):
    folder, _ = corpus(spark)
    T.apply_takedowns(spark, folder, stones(spark, ("t1", "w3", "remove", "rights", 1)), DEPENDENTS, 5)
    after = contents(spark, folder)
    assert T.vacuum(spark, folder) and T.vacuum(spark, folder) is not None
    assert contents(spark, folder) == after
    for name in DEPENDENTS:
        rest = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
        assert "secret3'" not in repr(rest.collect())


def test_no_task_writes_a_bucket_alone(spark, tmp_path):
    rows = spark.range(60).selectExpr("concat('w', id) as work_id", "'t' as title").repartition(3)
    one = {"works": T.Dependent("work_id", "work_id", "work", ("title",))}
    T.create_store(spark, str(tmp_path / "store"), {"works": rows}, one, 2)
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "store" / "works" / "v0").glob("bucket=*")]
    assert files == [3, 3] and T.read_table(spark, str(tmp_path / "store"), "works").distinct().count() == 60


def test_an_empty_store(spark):
    folder = fresh_path(spark, "store")
    empty = {n: t.limit(0) for n, t in corpus(spark)[1].items()}
    T.create_store(spark, folder, empty, DEPENDENTS, 3)
    assert T.apply_takedowns(spark, folder, stones(spark, ("t1", "w3", "remove", "rights", 1)), DEPENDENTS, 3) == 0
    assert contents(spark, folder) == {"works": [], "passages": [], "claims": []}


# --- agreement ------------------------------------------------------------------------------------


def annotations(spark, rows):
    return spark.createDataFrame(rows, "task string, item_id string, annotator string, label string")


def brute_kappa(pairs):
    n = sum(pairs.values())
    observed = sum(w for (a, b), w in pairs.items() if a == b) / n
    one, two = Counter(), Counter()
    for (a, b), w in pairs.items():
        one[a] += w
        two[b] += w
    expected = sum(one[x] * two[x] for x in one) / n**2
    return None if expected >= 1 else (observed - expected) / (1 - expected)


def random_annotations(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        truth = rng.choice("xyz")
        rows += [("t", f"i{i}", "ann", truth), ("t", f"i{i}", "bob", truth if rng.random() < 0.7 else rng.choice("xyz"))]
    rows += [("t", "i0", "cat", "x"), ("t", "alone", "ann", "x"), ("t", "i1", "ann", None), ("t", "i2", None, "x"), ("u", "i", "a", "k"), ("u", "i", "b", "k")]
    return rows


def test_kappa_and_disagreements(spark):
    rows = random_annotations()
    pairs = R.label_pairs(annotations(spark, rows + rows[:4]))
    got = {(r.task, r.item_id): (r.first, r.second) for r in pairs.collect()}
    by_item = defaultdict(dict)
    for task, item, who, label in rows:
        if who and label:
            by_item[task, item][who] = label
    assert got == {k: tuple(v[w] for w in sorted(v)[:2]) for k, v in by_item.items() if len(v) > 1}
    kappas = {r.task: r for r in R.cohen_kappa(pairs).collect()}
    assert kappas["t"].kappa == pytest.approx(brute_kappa(Counter(v for (t, _), v in got.items() if t == "t"))) and kappas["u"].kappa is None and kappas["u"].observed == 1
    unequal = Counter(tuple(sorted(v)) for (t, _), v in got.items() if t == "t" and v[0] != v[1])
    assert {(r.label, r.other_label): r["items"] for r in R.disagreements(pairs).collect()} == unequal


def test_bootstrap_interval_against_brute_force(spark):
    pairs = R.label_pairs(annotations(spark, random_annotations()))
    items = [(r.task, r.item_id, r.first, r.second) for r in pairs.collect()]
    edges = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    kappas = []
    for replicate in range(1, 61):
        drawn = Counter()
        for task, item, a, b in items:
            if task == "t":
                drawn[a, b] += sum(zlib.crc32(f"3:{task}/{item}:{replicate}".encode()) / 2**32 >= e for e in edges)
        kappas.append(brute_kappa(drawn))
    kappas.sort()
    got = {r.task: r for r in R.kappa_interval(pairs, 60, seed=3, level=0.9).collect()}
    at = lambda share: kappas[math.floor(share * 59 + 0.5)]
    assert (got["t"].kappa_low, got["t"].kappa_high) == pytest.approx((at(0.05), at(0.95)))
    assert got["t"].kappa_low < R.cohen_kappa(pairs).filter("task = 't'").first().kappa < got["t"].kappa_high


def test_labels_of_an_item_meet_in_one_exchange(spark, capsys):
    R.label_pairs(annotations(spark, random_annotations())).explain()
    assert capsys.readouterr().out.count("Exchange ") == 1


def test_agreement_reads_the_pairs_once(spark, capsys):
    """Everything after the count of label pairs reads that count."""
    pairs = R.label_pairs(annotations(spark, random_annotations()))
    for out in (R.cohen_kappa(pairs), R.disagreements(pairs)):
        out.explain()
        assert "item_id" not in capsys.readouterr().out


def test_replicates_are_drawn_without_a_row_for_each(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "poisson_weight", lambda *_: seen.append("text for each item and replicate"))
    rows = [(task, f"i\u00e9{i}", "x" if i % 3 else "y", None if i == 5 else "xyz"[i % 2]) for task in "tu" for i in range(40)]
    pairs = spark.createDataFrame(rows, "task string, item_id string, first string, second string")
    assert R.kappa_interval(pairs, 1001, seed=2).count() == 2 and not seen
    monkeypatch.undo()
    schema = pa.schema([("task", pa.string()), ("first", pa.string()), ("second", pa.string()), ("replicate", pa.int32()), ("n", pa.int64())])
    batch = pa.RecordBatch.from_pydict({"task": [r[0] for r in rows], "first": [r[2] for r in rows], "second": [r[3] for r in rows], "crc": [zlib.crc32(f"2:{r[0]}/{r[1]}:".encode()) for r in rows]})
    monkeypatch.setattr(R, "_BLOCK", 3000)
    got = Counter()
    for part in R._drawn(iter([batch, batch.slice(0, 0)]), 1001, schema):
        for r in part.to_pylist():
            got[r["task"], r["first"], r["second"], r["replicate"]] += r["n"]
    copies = pairs.crossJoin(spark.range(1, 1002).withColumnRenamed("id", "replicate"))
    weighed = copies.withColumn("n", R.poisson_weight(F.concat_ws("/", "task", "item_id"), F.col("replicate"), 2)).groupBy("task", "first", "second", "replicate").agg(F.sum("n").alias("n"))
    assert got == {(r.task, r.first, r.second, r.replicate): r.n for r in weighed.filter("n > 0").collect()}


# --- queue ------------------------------------------------------------------------------------------


def test_queue_pages_and_resuming(spark):
    rng = random.Random(4)
    rows = [(f"a{i:03}", rng.choice([0.1, 0.1, 0.5, None]), rng.choice([True, False, None]), rng.choice([1.0, 2.0, None])) for i in range(300)]
    items = spark.createDataFrame(rows, "assertion_id string, confidence double, contested boolean, value double").repartition(6)
    sure = lambda c: (c is not None, c or 0)
    orders = {
        "confidence": lambda r: (sure(r[1]), not r[2], -(r[3] or 0), r[0]), "contested": lambda r: (not r[2], sure(r[1]), -(r[3] or 0), r[0]),
        "value": lambda r: (-(r[3] or 0), not r[2], sure(r[1]), r[0]),
    }
    for first, key in orders.items():
        queue = R.review_queue(items, first)
        want = [r[0] for r in sorted(rows, key=key)]
        ids = lambda df: [r.assertion_id for r in df.orderBy("position").collect()]
        assert ids(queue) == want
        assert ids(R.queue_page(queue, 3, 40)) == want[120:160] and ids(R.queue_page(queue, 7, 40)) == want[280:] and ids(R.queue_page(queue, 8, 40)) == []
        assert ids(R.queue_after(queue, want[99], 10)) == want[100:110] and ids(R.queue_after(queue, "gone", 10)) == []
    with pytest.raises(ValueError, match="luck"):
        R.review_queue(items, "luck")


# --- selection ----------------------------------------------------------------------------------------


def test_filter_funnel(spark):
    rows = [(i, None if i % 7 == 0 else i % 5) for i in range(100)]
    steps = [("screening", "even", F.col("id") % 2 == 0), ("screening", "known", F.col("v") >= 1), ("included", "small", F.col("id") < 60)]
    got = S.filter_funnel(spark.createDataFrame(rows, "id int, v int"), steps).orderBy("step").collect()
    left, want = rows, [(0, "identification", "all records", 100, 0, 100)]
    for i, (stage, name, _) in enumerate(steps):
        test = (lambda r: r[0] % 2 == 0, lambda r: r[1] is not None and r[1] >= 1, lambda r: r[0] < 60)[i]
        kept = [r for r in left if test(r)]
        want.append((i + 1, stage, name, len(left), len(left) - len(kept), len(kept)))
        left = kept
    assert [tuple(r) for r in got] == want
    none = S.filter_funnel(spark.createDataFrame([], "id int, v int"), steps).orderBy("step").collect()
    assert [tuple(r)[3:] for r in none] == [(0, 0, 0)] * 4


def test_linked_fields(spark):
    table = lambda rows: spark.createDataFrame(rows, "work_id string, value string")
    a = table([("1", "x"), ("2", "x"), ("2", "y"), ("3", "z")])
    b = table([("1", "s"), ("2", "s"), ("3", "t")])
    c = table([("1", "q"), ("2", "r"), ("2", "q")])
    got = sorted(map(tuple, S.linked_fields(a, b, c).collect()))
    assert got == [("left", "x", "s", 2), ("left", "y", "s", 1), ("left", "z", "t", 1), ("right", "s", "q", 2), ("right", "s", "r", 1)]
    assert sorted(map(tuple, S.linked_fields(a, b, c, 1).collect())) == [("left", "x", "s", 2), ("right", "s", "q", 2)]


def test_completeness(spark):
    rows = [("a", None, [], float("nan"), None), (" ", 1, ["x"], 1.0, None), ("b", 2, None, 2.0, None), ("c", 3, ["y"], 2.0, None)]
    got = {r.field: (r.missing, r.missing_share, r.rating) for r in S.completeness(spark.createDataFrame(rows, "s string, i int, l array<string>, d double, n string")).collect()}
    assert got == {"s": (1, 0.25, "acceptable"), "i": (1, 0.25, "acceptable"), "l": (2, 0.5, "poor"), "d": (1, 0.25, "acceptable"), "n": (4, 1.0, "completely missing")}
