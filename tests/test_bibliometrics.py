import pytest
from pyspark.sql import functions as F

from claimloom.operators import bibliometrics as M
from claimloom.operators import citations as C


@pytest.fixture(scope="module")
def four(spark):
    works = spark.createDataFrame(
        [
            ("w1", "Alpha", "Journal A", 2019, ["Ada Lovelace"]),
            ("w2", "Beta", "Journal A", 2020, ["Ada Lovelace", "Alan Turing"]),
            ("w3", "Gamma", "Journal B", 2021, ["Alan Turing", "Grace Hopper", " ada lovelace "]),
            ("w4", "Delta", "Journal B", 2022, ["Grace Hopper", " "]),
        ],
        "work_id string, title string, venue string, year int, authors array<string>",
    )
    edges = spark.createDataFrame(
        [("w2", "w1"), ("w3", "w1"), ("w4", "w1"), ("w3", "w2"), ("w2", "w2"), ("w2", "w1")],
        "citing_work_id string, cited_work_id string",
    )
    return works, M.long_form(works, "authors", "author"), C.citation_in_degree(edges)


def test_summary(four):
    works, authors, degrees = four
    row = M.corpus_summary(works, authors, degrees).first()
    assert (row.document_count, row.source_count, row.author_count, row.author_appearances) == (4, 2, 3, 7)
    assert (row.single_authored_count, row.total_citations, row.avg_citations_per_doc) == (2, 4, 1.0)
    assert (row.min_year, row.max_year, row.co_authors_per_doc) == (2019, 2022, 1.75)


def test_production_and_growth(spark, four, rows):
    works, _, _ = four
    assert rows(M.annual_production(works)) == [(y, 1) for y in range(2019, 2023)]
    assert M.growth_rate(works).first()[0] == 0.0
    grown = spark.createDataFrame([(2018,)] + [(2020,)] * 4, "year int")
    assert M.growth_rate(grown).first()[0] == pytest.approx(100.0)
    assert rows(M.annual_production(grown)) == [(2018, 1), (2019, 0), (2020, 4)]
    assert M.growth_rate(grown.filter("year = 2018")).first()[0] is None
    assert M.annual_production(grown.filter("year is null")).count() == 0


def test_cohorts(spark, four):
    works, authors, degrees = four
    two = spark.createDataFrame([("w1",), ("w2",)], "work_id string")
    assert M.corpus_summary(M.cohort(works, two), authors, degrees).first().total_citations == 4
    assert M.cohort(works, None, 2020, 2021).count() == 2
    assert M.cohort(works, two.limit(0)).count() == 0
    unknown = works.withColumn("year", F.lit(None).cast("int"))
    assert M.cohort(unknown, None, 1900).count() == 0
    assert M.corpus_summary(M.cohort(works, two.limit(0)), authors, degrees).first().avg_citations_per_doc == 0.0


def test_authors(four, rows):
    works, authors, degrees = four
    metrics = {r.author_key: r for r in M.author_metrics(works, authors, degrees).collect()}
    ada = metrics["ada lovelace"]
    assert (ada.document_count, ada.citation_count, ada.h_index) == (3, 4, 1)
    assert rows(M.lotka_points(works, authors)) == [(2, 2), (3, 1)]
    assert M.lotka_fit(M.lotka_points(works, authors)).first().exponent == pytest.approx(1.7095, abs=1e-4)


def test_h_index_matches_definition(spark):
    import random

    random.seed(4)
    groups = {f"g{i}": [random.choice([0, 0, 1, 2, 3, 5, 8, 40]) for _ in range(random.randint(1, 30))] for i in range(25)}
    groups["fixture"] = [3, 2, 1]
    rows = [(g, f"{g}-{i}", c) for g, cs in groups.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "g string, work_id string, citation_count int")
    got = {r.g: r.h_index for r in M.impact(df.select("g", "work_id"), "g", df.select("work_id", "citation_count")).collect()}
    for g, cs in groups.items():
        ordered = sorted(cs, reverse=True)
        assert got[g] == max([i for i, c in enumerate(ordered, 1) if c >= i], default=0), g
    assert got["fixture"] == 2


def test_bradford(spark, rows):
    venues = spark.createDataFrame([("S1", 3), ("S2", 2), ("S3", 2), ("S4", 1), ("S5", 1)], "source string, document_count long")
    zoned = M.bradford_zones(venues)
    summary = rows(M.bradford_summary(zoned))
    assert summary[0] == (1, 1, 3)
    assert sum(r[1] for r in summary) == 5 and sum(r[2] for r in summary) == 9
    assert rows(M.bradford_summary(zoned.filter("zone = 1"))) == [(1, 1, 3), (2, 0, 0), (3, 0, 0)]


def test_countries(spark, rows):
    aff = spark.createDataFrame(
        [
            ("c1", "Dept, Univ X, United States"), ("c2", "Univ X, USA"), ("c2", "Univ Y, United Kingdom"),
            ("c3", "Univ Z, Germany"), ("c3", "Elsewhere"),
        ],
        "work_id string, affiliation string",
    )
    countries = M.work_countries(aff)
    got = {r[0]: r[1:4] for r in rows(M.country_metrics(countries))}
    assert got == {"United States": (2, 1, 1), "United Kingdom": (1, 0, 1), "Germany": (1, 1, 0)}
    assert M.international_share(countries).first().international_pct == pytest.approx(33.3333, abs=1e-3)
    empty = M.international_share(countries.limit(0)).first()
    assert (empty.documents_with_country, empty.international_pct) == (0, None)


def test_members_and_owner(spark):
    sets = spark.createDataFrame([("map", "m", "u"), ("map", "e", "u")], "kind string, set_id string, owner_id string")
    members = spark.createDataFrame([("map", "m", "w1"), ("map", "m", "w2")], "kind string, set_id string, work_id string")
    assert M.saved_set_members(sets, members, "map", "m", "u").count() == 2
    assert M.saved_set_members(sets, members, "map", "m", "other").count() == 0
    assert {r.set_id: r.member_count for r in M.members_per_set(sets, members).collect()} == {"m": 2, "e": 0}
