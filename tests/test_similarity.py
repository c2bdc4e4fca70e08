import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import nearest as V
from claimloom.operators import similarity as S


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def claims_of(n, seed, vocabulary=18):
    random.seed(seed)
    words = [f"w{i:02d}" for i in range(vocabulary)]
    out = []
    for i in range(n):
        if out and random.random() < 0.3:
            tokens = list(random.choice(out)[1])
            if random.random() < 0.5 and tokens:
                tokens[0] = random.choice(words)
            tokens = sorted(set(tokens))
        else:
            tokens = sorted(random.sample(words, random.randint(0, 7)))
        out.append((f"c{i:03d}", tokens))
    return out


def brute_best(claims, threshold, allowed=lambda a, b: True):
    best = {}
    for i, a in claims:
        scored = [(-jaccard(a, b), j) for j, b in claims if j != i and allowed(i, j)]
        if scored and -min(scored)[0] >= threshold:
            best[i] = (min(scored)[1], round(-min(scored)[0], 9))
    return best


@pytest.fixture
def small_grid(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 5)
    monkeypatch.setattr(S, "CELL", 7)


@pytest.mark.parametrize("threshold", [0.34, 0.5])
def test_best_match_equals_brute_force(spark, small_grid, threshold):
    claims = claims_of(90, 11)
    df = spark.createDataFrame(claims, "claim_id string, tokens array<string>")
    got = {r.claim_id: (r.match_id, round(r.score, 9)) for r in S.best_matches(df, threshold).collect()}
    assert got == brute_best(claims, threshold)


def test_hot_scope_meets_in_one_cell(spark):
    """Claims of one frequent token, empty, null and repeated ones among them, are compared without a copy each 256 claims."""
    random.seed(2)
    claims = [(f"c{i:04d}", sorted({"hot", *(f"w{random.randrange(40):02d}" for _ in range(3))})) for i in range(700)] + [("e", []), ("n", None)]
    df = spark.createDataFrame(claims, "id string, tokens array<string>").withColumn("scope", F.lit("s"))
    asked, held = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "match_id")
    out = S.grid_matches(asked, held, 2, 0.0, skip_self=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "array_intersect" not in plan
    assert len(claims) <= min(S.CHUNK, S.CELL)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9) + 0.0, r.match_id))
    want = {i: sorted((round(-jaccard(a or [], b or []), 9) + 0.0, j) for j, b in claims)[:2] for i, a in claims}
    assert {i: sorted(v) for i, v in got.items()} == want


def test_hot_group_of_copies_is_one_class(spark, small_grid):
    claims = [(f"c{i:03d}", ["alpha", "beta", "gamma"]) for i in range(60)] + [("d1", ["alpha", "beta", "delta"]), ("d2", ["zeta"])]
    df = spark.createDataFrame(claims, "claim_id string, tokens array<string>")
    got = {r.claim_id: (r.match_id, r.score) for r in S.best_matches(df).collect()}
    assert got == {**brute_best(claims, 0.34), "c000": ("c001", 1.0)}


def test_gate_equals_brute_force(spark, small_grid):
    claims = claims_of(70, 23, 12)
    random.seed(3)
    paper = {i: random.choice(["p1", "p2", "p3", "p4", None]) for i, _ in claims}
    vectors = {"p1": [1.0, 0.0], "p2": [0.0, 1.0], "p3": [0.8, 0.6]}

    def allowed(a, b):
        x, y = paper[a], paper[b]
        if not x or not y or x == y or x not in vectors or y not in vectors:
            return True
        return sum(p * q for p, q in zip(vectors[x], vectors[y])) >= 0.5 * 1.0

    df = spark.createDataFrame([(i, paper[i], t) for i, t in claims], "claim_id string, corpus_id string, tokens array<string>")
    v = spark.createDataFrame(list(vectors.items()), "corpus_id string, vector array<float>")
    got = {r.claim_id: (r.match_id, round(r.score, 9)) for r in S.best_matches(df, vectors=v).collect()}
    assert got == brute_best(claims, 0.34, allowed)


def test_components_equal_union_find(spark):
    random.seed(5)
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(0, 30)] + [(f"m{random.randint(0, 40):02d}", f"m{random.randint(0, 40):02d}") for _ in range(25)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in S.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}


def test_clusters_cover_exactly_the_matched(spark, small_grid):
    claims = claims_of(60, 31)
    df = spark.createDataFrame(claims, "claim_id string, tokens array<string>")
    best = S.best_matches(df)
    cluster = {r.interpretation_id: r.cluster_id for r in S.claim_clusters(best).collect()}
    matched = {r.claim_id: r.match_id for r in best.collect()}
    assert set(cluster) == set(matched) | set(matched.values())
    assert all(cluster[a] == cluster[b] for a, b in matched.items())


def test_targets_equal_brute_force(spark, small_grid):
    claims = [(i, f"W{k % 3}", t) for k, (i, t) in enumerate(claims_of(60, 41))]
    relations = [(f"r{k:02d}", random.choice(["W0", "W1", "W2", "W9", None]), t) for k, (_, t) in enumerate(claims_of(40, 43))]
    r = spark.createDataFrame(relations, "assertion_id string, cited_work_id string, tokens array<string>")
    c = spark.createDataFrame(claims, "interpretation_id string, work_id string, tokens array<string>")
    got = {x.assertion_id: x for x in S.resolve_targets(r, c).collect()}
    for a, work, tokens in relations:
        scored = sorted((-jaccard(tokens, t), i) for i, w, t in claims if w == work)
        x = got[a]
        if work is None:
            assert (x.resolution, x.target_link_score, x.target_candidates) == ("unresolved", None, [])
        elif scored and -scored[0][0] >= 0.18:
            assert (x.resolution, x.target_interpretation_id, x.target_candidates) == ("claim_resolved", scored[0][1], [])
        else:
            assert x.resolution == "paper_resolved" and x.target_interpretation_id is None
            assert [k.interpretation_id for k in x.target_candidates] == [i for s, i in scored[:3] if -s >= 0.05]
            assert (x.target_link_score is None) == (not scored)


def test_alignment_equals_greedy(spark, small_grid):
    gold = [(f"g{k:02d}", f"P{k % 2}", t) for k, (_, t) in enumerate(claims_of(24, 51, 10))]
    pred = [(f"p{k:02d}", f"P{k % 2}", t) for k, (_, t) in enumerate(claims_of(60, 53, 10))]
    pairs = sorted((-jaccard(a, b), g, p) for g, gp, a in gold for p, pp, b in pred if gp == pp and jaccard(a, b) >= 0.3)
    want, used = {}, set()
    for _, g, p in pairs:
        if g not in want and p not in used:
            want[g] = p
            used.add(p)
    got = S.align_greedy(
        spark.createDataFrame(gold, "gold_id string, paper string, tokens array<string>"),
        spark.createDataFrame(pred, "pred_id string, paper string, tokens array<string>"),
    )
    assert {r.gold_id: r.pred_id for r in got.collect()} == want


def test_embedding_ranking(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [])], "match_id long, vector array<float>")
    queries = rows.filter("match_id = 1").select(F.col("match_id").alias("query_id"), "vector")
    got = [(r.rank, r.match_id, r.score) for r in V.embedding_top_k(queries, rows, 2).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0), (2, 3, 0.0)]


def brute_nearest(queries, rows, k):
    import numpy as np

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9) + 0.0

    return {q: [m for _, m in sorted((-cosine(v, w), m) for m, w in rows if m != q)[:k]] for q, v in queries}


@pytest.mark.parametrize("block,query_bytes", [(4096, 1 << 25), (7, 1 << 25), (16, 300)])
def test_nearest_against_all_pairs(spark, monkeypatch, block, query_bytes):
    """Equal vectors tie by id, odd vectors score 0, and blocks and passes change nothing."""
    monkeypatch.setattr(V, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(V, "QUERY_BYTES", query_bytes)
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(160)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, 2.0]), (204, [1.0, None, 2.0, 1.0]), (205, rows[3][1]), (206, rows[3][1])]
    frame = spark.createDataFrame(rows, "match_id long, vector array<float>").repartition(5)
    queries = [r for r in rows if r[0] % 10 == 0 or r[0] > 199]
    got = V.embedding_top_k(frame.filter("match_id % 10 = 0 or match_id > 199").withColumnRenamed("match_id", "query_id"), frame, 6).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.match_id)
    assert found == brute_nearest(queries, rows, 6)
    assert V.embedding_top_k(frame.limit(0).withColumnRenamed("match_id", "query_id"), frame, 3).collect() == []
    assert V.embedding_top_k(frame.withColumnRenamed("match_id", "query_id"), frame.limit(0), 3).collect() == []


def test_tokens_travel_as_numbers_in_order_of_frequency(spark):
    classes = spark.createDataFrame([("a", ["zz", "b", "c"]), ("b", ["b", "c"]), ("c", ["c", "yy"])], "class_id string, tokens array<string>")
    ordered = S._rarest_first(classes)
    # yy and zz are of one class each, then b, then c
    assert ordered.schema["tokens"].dataType.simpleString() == "array<int>"
    assert {r.class_id: r.tokens for r in ordered.collect()} == {"a": [0, 1, 2], "b": [1, 2], "c": [-1, 2]}
    assert {(r.class_id, r.scope, r.place) for r in S._prefixes(ordered, 0.4).collect()} == {("a", 1, 2), ("b", 1, 1), ("b", 2, 2), ("c", 2, 2)}
