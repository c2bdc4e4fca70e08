import random

from pyspark.sql import functions as F

from claimloom.operators import discovery as D
from claimloom.operators import graph as G
from claimloom.operators.citations import citation_pairs


def brute_neighborhood(center, edges, depth, cap):
    adjacency = {}
    for a, b in edges:
        adjacency.setdefault(a, set()).add(b)
        adjacency.setdefault(b, set()).add(a)
    hop, frontier, truncated = {center: 0}, [center], False
    for level in range(1, depth + 1):
        reached = sorted({n for f in frontier for n in adjacency.get(f, ())} - set(hop))
        room = cap - len(hop)
        truncated = len(reached) > room
        frontier = reached[:room]
        hop.update({n: level for n in frontier})
        if truncated:
            break
    return hop, truncated


def test_neighborhoods_match_brute_force(spark):
    random.seed(7)
    nodes = [f"n{i:03d}" for i in range(120)]
    edges = {(random.choice(nodes), random.choice(nodes)) for _ in range(170)} | {("n000", n) for n in nodes[1:60]}
    edges = {(a, b) for a, b in edges if a != b}
    pairs = spark.createDataFrame(list(edges), "citing_work_id string, cited_work_id string")
    centers = ["n000", "n005", "n077", "n100", "lonely"]
    df = spark.createDataFrame([(c,) for c in centers], "work_id string")
    for depth, cap in ((1, 250), (2, 25), (3, 40), (9, 12)):
        got = {}
        for r in G.neighborhoods(df, pairs, depth, cap).collect():
            got.setdefault(r.center, ({}, r.truncated))[0][r.work_id] = r.hop
        for c in centers:
            assert got[c] == brute_neighborhood(c, edges, depth, cap), (c, depth, cap)


def test_one_hop_stages_only_what_touches_the_centers(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(G, "stage", lambda df, label="stage": staged.append((label, df.count())) or df)
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("c", "d"), ("e", "f")], "citing_work_id string, cited_work_id string")
    got = G.neighborhoods(spark.createDataFrame([("a",), ("a",)], "work_id string"), pairs, 1, 5)
    assert {(r.work_id, r.hop) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert dict(staged)["adjacency"] == 2


def test_queries_that_read_pairs_often_make_them_once(spark, monkeypatch):
    from claimloom.catalog import graphs as C

    works = [("a", "v", True), ("b", "v", False), ("c", "w", False), ("O7", "w", True)]
    edges = [("O7", "b", "extracted", None), ("b", "c", "extracted", True), ("a", "c", "bibliographic", False), ("O7", "a", "extracted", None)]
    made = []

    def pairs(t):
        made.append(1)
        return citation_pairs(spark.createDataFrame(edges, "citing_work_id string, cited_work_id string, source string, is_influential boolean"))

    monkeypatch.setattr(C, "_pairs", pairs)
    monkeypatch.setattr(C.B, "order_works", lambda t: spark.createDataFrame(works, "work_id string, venue string, is_retracted boolean"))
    assert sorted((r.work_id, r.level) for r in C.snowball(None).collect()) == [("O7", 0), ("a", 1)]
    assert len(made) == 1
    # O7 is the first of its venue, so is a: both see a-O7, a-c, O7-b
    assert sorted(tuple(r) for r in C.neighborhood_edges(None).collect()) == [("O7", 2), ("a", 2)]
    assert len(made) == 2


def test_paper_graph(spark, rows):
    works = spark.createDataFrame([("a", "B"), ("b", "A"), ("c", None)], "work_id string, title string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b")], "citing_work_id string, cited_work_id string")
    nodes, truncated = G.first_papers(works, 2)
    assert rows(nodes, "work_id") == [("a",), ("b",)] and truncated.first()[0]
    assert rows(G.induced_edges(nodes, pairs)) == [("a", "b")] or rows(G.induced_edges(nodes, pairs), "citing_work_id", "cited_work_id") == [("a", "b")]
    counted = rows(G.paper_nodes(nodes, pairs), "work_id", "cited_by_count", "reference_count")
    assert counted == [("a", 0, 2), ("b", 2, 0)]


def test_claim_network_limit(spark, rows):
    relations = spark.createDataFrame(
        [("a1", "o1", "i2", "claim_resolved"), ("a2", "o2", "i3", "claim_resolved"), ("a3", "o1", "i3", "claim_resolved"),
         ("a4", "o3", "i4", "claim_resolved"), ("a5", "o1", "i2", "paper_resolved"), ("a6", "o1", "gone", "claim_resolved")],
        "assertion_id string, citing_occurrence_id string, target_interpretation_id string, resolution string",
    ).withColumns({c: F.lit("x") for c in ("function", "stance", "status")})
    interps = spark.createDataFrame(
        [(f"i{k}", f"o{k}", [], k) for k in range(1, 5)],
        "interpretation_id string, claim_occurrence_id string, parent_interpretation_ids array<string>, created_at int",
    )
    assert [r[0] for r in rows(G.claim_network(relations, interps), "assertion_id")] == ["a1", "a2", "a3", "a4"]
    assert [r[0] for r in rows(G.claim_network(relations, interps, 3), "assertion_id")] == ["a1", "a2"]
    assert G.claim_network(relations, interps, 99).count() == 4


LINKS = [("1", "2", 0), ("1", "3", 1), ("2", "4", 0), ("3", "5", 0), ("3", "1", 1), ("2", "3", 1)]


def test_snowball(spark, rows):
    links = spark.createDataFrame(LINKS, "citing_work_id string, cited_work_id string, position int")
    seeds = spark.createDataFrame([("1", 0)], "work_id string, position int")
    corpus, edges = G.snowball(seeds, links, 100)
    assert rows(corpus) == [("1", 0, 1), ("2", 1, 2), ("3", 1, 3), ("4", 2, 4), ("5", 2, 5)]
    assert rows(edges) == sorted((a, b) for a, b, _ in LINKS)
    corpus, edges = G.snowball(seeds, links, 4)
    assert rows(corpus, "work_id") == [("1",), ("2",), ("3",), ("4",)]
    assert rows(edges) == [("1", "2"), ("1", "3"), ("2", "4")]
    assert G.snowball(seeds, links, 1)[0].count() == 1
    assert rows(G.snowball(seeds, links, 100, refs_per_paper=1)[0], "work_id") == [("1",), ("2",), ("4",)]


def test_grounding_and_corroboration(spark, rows):
    terms = spark.createDataFrame(
        [("i1", "intervention", "Metformin"), ("i1", "outcome", "HbA1c"), ("i1", "population", "adults"), ("i2", "outcome", "HbA1c")],
        "interpretation_id string, role string, term string",
    )
    lexicon = spark.createDataFrame(
        [("metformin", "CHEBI:6801", "metformin", ["drug"]), ("HbA1c", "CHEBI:145907", "HbA1c", ["protein"])],
        "term string, curie string, label string, types array<string>",
    )
    grounded = G.ground_terms(terms, lexicon)
    assert grounded.filter("curie is null").count() == 1
    sources = [("primary_knowledge_source", "infores:ctd"), ("aggregator_knowledge_source", "infores:agg")]
    kg = spark.createDataFrame(
        [("CHEBI:145907", "biolink:treats_it", "CHEBI:6801", sources), ("CHEBI:145907", "biolink:treats_it", "CHEBI:6801", []),
         ("CHEBI:6801", "", "CHEBI:145907", []), ("CHEBI:6801", "biolink:x", "other", [])],
        "subject string, predicate string, object string, sources array<struct<resource_role:string,resource_id:string>>",
    )
    got = rows(G.corroborating_edges(grounded, kg), "interpretation_id", "subject", "predicate", "label")
    assert got == [("i1", "CHEBI:145907", "biolink:treats_it", "treats it"), ("i1", "CHEBI:6801", "biolink:related_to", "related to")]
    assert G.entity_pairs(grounded).count() == 1
    assert G.claim_entity_edges(grounded).count() == 3


def test_seed_discovery(spark, rows):
    works = spark.createDataFrame(
        [("A", None, "10.1/a", None, "Seed a", 2020), ("B", None, "10.1/b", None, "Seed b", 2020), ("L", "101", None, None, "Local copy", 2019)],
        "work_id string, s2_corpus_id string, doi string, pmid string, title string, year int",
    )
    seeds = spark.createDataFrame([("s", "A"), ("s", "B")], "set_id string, work_id string")
    links = spark.createDataFrame(
        [("A", 0, "100", None, None, "Hundred", 2020, True), ("A", 1, "101", None, None, "Link title", 2019, False),
         ("A", 2, None, "10.1/b", None, "Seed b", 2020, False), ("A", 3, None, None, None, "No id", 2020, False),
         ("B", 0, "100", None, None, None, None, False), ("B", 1, "102", None, None, "Later", 2021, False)],
        "citing_work_id string, position int, cited_corpus_id string, cited_doi string, cited_pmid string, cited_title string, cited_year int, is_influential boolean",
    )
    best = D.top_candidates(D.discover(seeds, works, links)).orderBy("rank").collect()
    assert [r.external_id for r in best] == ["CorpusId:100", "CorpusId:102", "CorpusId:101"]
    assert (best[0].connection_score, best[0].is_influential, best[0].in_corpus) == (2, True, False)
    assert (best[2].work_id, best[2].title) == ("L", "Local copy")
    assert [r.external_id for r in D.discover(seeds, works, links, min_year=2021).collect()] == ["CorpusId:102"]
    assert rows(D.supporting_seeds(seeds, works, links), "key", "seed_work_id")[0:2] == [("cited_corpus_id:100", "A"), ("cited_corpus_id:100", "B")]


def test_pairs_do_not_depend_on_partitioning(spark, rows):
    e = spark.createDataFrame(
        [(f"a{i % 7}", f"b{i % 5}", "xy"[i % 2], i % 3 == 0) for i in range(80)],
        "citing_work_id string, cited_work_id string, source string, is_influential boolean",
    )
    assert rows(citation_pairs(e.repartition(1))) == rows(citation_pairs(e.repartition(7)))
