import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimloom.functions.values import precision_recall_f1
from claimloom.operators import evaluation as V
from claimloom.sources.sinks import comparison_table


def test_prf(spark):
    row = spark.range(1).select(*precision_recall_f1(F.lit(2), F.lit(1), F.lit(1))).first()
    assert tuple(row) == (0.6667, 0.6667, 0.6667)
    assert tuple(spark.range(1).select(*precision_recall_f1(F.lit(0), F.lit(0), F.lit(0))).first()) == (0.0, 0.0, 0.0)


def test_recall(spark):
    ranks = spark.createDataFrame([(1,), (None,), (3,)], "rank int")
    row = V.recall_at(ranks).first()
    assert (round(row.recall_at_1, 4), round(row.recall_at_3, 4)) == (0.3333, 0.6667)
    assert V.recall_at(ranks.limit(0)).first().recall_at_1 == 0.0


def test_ece(spark):
    def ece(data):
        return V.expected_calibration_error(spark.createDataFrame(data, "confidence double, correct boolean")).first().ece

    assert ece([(0.6, True), (0.6, True)]) == pytest.approx(0.4)
    assert ece([(1.0, True), (1.0, True)]) == 0.0
    assert ece([(0.0, False)]) == 0.0 and ece([]) == 0.0


def test_risk_coverage(spark):
    random.seed(9)
    data = [(f"i{k:03d}", random.choice([0.5, 0.9, 1.0]), random.random() < 0.7) for k in range(37)]
    got = {r.coverage: r.risk for r in V.risk_coverage(spark.createDataFrame(data, "item_id string, confidence double, correct boolean")).collect()}
    ordered = sorted(data, key=lambda d: (-d[1], d[0]))
    for cov in (0.25, 0.5, 0.75, 1.0):
        k = max(1, round(cov * len(data)))
        assert got[cov] == pytest.approx(sum(not d[2] for d in ordered[:k]) / k)


def test_confusion_and_classes(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "odd")], "gold string, predicted string")
    matrix = {r.gold: (r.a, r.b) for r in V.confusion_matrix(pairs, ("a", "b", "c")).collect()}
    assert matrix == {"a": (1, 1), "b": (0, 1), "c": (0, 0)}
    per = {r.label: (r.precision, r.recall, r.support) for r in V.per_class_prf(pairs, ("a", "b", "c")).collect()}
    assert per == {"a": (1.0, 0.5, 2), "b": (0.5, 0.5, 2), "c": (0.0, 0.0, 0)}
    assert V.macro_f1(V.per_class_prf(pairs, ("a", "b", "c"))).first()[0] == pytest.approx((0.6667 + 0.5) / 2, abs=1e-4)


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_prf_equals_counting_pairs(spark, seed):
    random.seed(seed)
    items = [f"x{i}" for i in range(30)]
    gold = [(i, f"g{random.randint(0, 5)}") for i in items for _ in range(random.randint(0, 2))]
    pred = [(i, f"p{random.randint(0, 4)}") for i in items for _ in range(random.randint(0, 2))]

    def pairs(rows):
        groups = {}
        for i, g in rows:
            groups.setdefault(g, set()).add(i)
        return {p for m in groups.values() for p in combinations(sorted(m), 2)}

    g, p = pairs(gold), pairs(pred)
    schema = "item string, group string"
    row = V.pair_prf(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)).first()
    assert (row.tp, row.fp, row.fn) == (len(g & p), len(p - g), len(g - p))


def test_pair_prf_fixture(spark):
    schema = "item string, group string"
    gold = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2"), ("c", "2")], schema)
    row = V.pair_prf(gold, spark.createDataFrame([("a", "1"), ("b", "1")], schema)).first()
    assert (row.precision, row.recall) == (1.0, 0.5)


def test_target_ranks(spark, rows):
    aligned = spark.createDataFrame(
        [("g1", "d", "claim_resolved", "g2", ("i9", [("i2", 0.1), ("i9", 0.1)])), ("g3", "d", "claim_resolved", "g2", ("i2", [])),
         ("g4", "d", "claim_resolved", "gone", ("i2", [])), ("g5", "d", "paper_resolved", "g2", ("i2", [])), ("g6", "d", "claim_resolved", "g2", None)],
        "gold_id string, cited_doi string, resolution string, target_gold_id string, "
        "a struct<target_interpretation_id:string,target_candidates:array<struct<interpretation_id:string,score:double>>>",
    )
    alignment = spark.createDataFrame([("g2", "i2")], "gold_id string, pred_id string")
    assert rows(V.target_ranks(aligned, alignment), "gold_id", "rank") == [("g1", 2), ("g3", 1), ("g4", None), ("g6", None)]


def test_mentions_keep_unresolved_and_last(spark, rows):
    mentions = spark.createDataFrame(
        [("p", "1", "w1", "a"), ("p", "2", None, "b"), ("p", "3", "w1", "c"), ("p", "3", "w2", "d")],
        "paper string, marker string, cited_work_id string, position string",
    )
    works = spark.createDataFrame([("w1", "10.1/a"), ("w2", "10.1/b")], "work_id string, doi string")
    assert rows(V.mentions_with_doi(mentions, works)) == [("p", "1", "10.1/a"), ("p", "2", None), ("p", "3", "10.1/b")]


def test_report_table(spark):
    runs = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "paper string, seconds double")
    rows = V.report([V.long_metrics(V.operations(runs), e, "ops") for e in ("x", "y")])
    wide = {r.metric: (r.x, r.y) for r in comparison_table(rows, ["x", "y"]).collect()}
    assert wide["mean_latency_s"] == (3.0, 3.0) and wide["papers"] == (2.0, 2.0)
