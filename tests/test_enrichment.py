import pytest
from pyspark.sql import functions as F

from claimloom.operators import resolution as R
from claimloom.sources import sinks, tables

WORK = "work_id string, s2_corpus_id string, doi string, pmid string, title string, authors array<string>, venue string, year int, tldr string, abstract string"


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(
        [
            ("a", "111", None, None, "Kept title", [], None, None, None, None),
            ("b", None, "10.1000/ABC", None, None, ["Known"], None, 0, None, ""),
            ("c", None, None, "777", "", None, "Venue", 2001, "short", "long"),
            ("d", None, None, None, "Unmatched", [], None, None, None, None),
        ],
        WORK,
    )


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(
        [
            ("1", 111, ("10.9/x", None), "Other", [("1", "New"), ("2", None)], "", 2010),
            ("2", 222, ("10.1000/abc", None), "Filled", [("1", "Zed")], "J", 2011),
            ("3", 333, (None, "777"), "Third", [], "K", 2012),
            ("4", 444, (None, None), "Nobody", [], "K", 2012),
        ],
        "record_id string, corpusid long, externalids struct<DOI:string,PubMed:string>, title string, "
        "authors array<struct<authorId:string,name:string>>, venue string, year int",
    )


def test_backfill_fills_only_gaps(works, records):
    out = {r.work_id: r for r in R.backfill_papers(works, records).collect()}
    assert (out["a"].title, out["a"].authors, out["a"].venue, out["a"].year) == ("Kept title", ["New"], None, 2010)
    assert (out["b"].s2_corpus_id, out["b"].doi, out["b"].authors, out["b"].year) == ("222", "10.1000/ABC", ["Known"], 2011)
    assert (out["c"].s2_corpus_id, out["c"].title, out["c"].venue, out["c"].year) == ("333", "Third", "Venue", 2001)
    assert out["d"].filled == [] and out["a"].filled == ["s2_corpus_id", "doi", "authors", "year"][1:]


def test_backfill_is_idempotent(works, records):
    once = R.backfill_papers(works, records).drop("filled")
    again = R.backfill_papers(once, records)
    assert again.filter(F.size("filled") > 0).count() == 0


def test_text_passes_and_order(spark, works, records):
    abstracts = spark.createDataFrame([("1", 222, "B abstract"), ("2", 333, "C abstract"), ("3", 999, "x")], "record_id string, corpusid long, abstract string")
    tldrs = spark.createDataFrame([("1", 111, "A short"), ("2", 333, "C short")], "record_id string, corpusid long, text string")
    done, reports = R.backfill(works, {"abstracts": abstracts, "tldrs": tldrs, "papers": records})
    out = {r.work_id: r for r in done.collect()}
    assert (out["b"].abstract, out["c"].abstract, out["a"].tldr, out["c"].tldr) == ("B abstract", "long", "A short", "short")
    assert {r.field: r.works_filled for r in reports["abstracts"].collect()} == {"abstract": 1}
    with pytest.raises(ValueError):
        R.backfill(works, {"nonsense": records})


def test_citation_backfill(spark, rows):
    held = spark.createDataFrame([("w1", "1"), ("w2", "2"), ("w3", "3")], "work_id string, s2_corpus_id string")
    bulk = spark.createDataFrame(
        [(1, 2), (1, 999), (999, 2), (1, 1), (1, 2), (1, 3)], "citingcorpusid long, citedcorpusid long"
    ).withColumns({"isinfluential": F.lit(True), "intents": F.array(), "contexts": F.array()})
    offered = R.edges_between_known(held, bulk)
    none = spark.createDataFrame([], "citing_work_id string, cited_work_id string, source string")
    first = R.new_edges(none, offered, "bulk")
    assert rows(first, "citing_work_id", "cited_work_id") == [("w1", "w2"), ("w1", "w3")]
    assert R.new_edges(first.select("citing_work_id", "cited_work_id", "source"), offered, "bulk").count() == 0


def test_resolution_priority(spark, rows):
    w = spark.createDataFrame([("x", "1", None, None), ("y", None, "10.1/A", None), ("z", None, None, "5"), ("a", None, "10.1/a", None)],
                              "work_id string, s2_corpus_id string, doi string, pmid string")
    r = spark.createDataFrame([("r1", "1", "10.1/a", "5"), ("r2", None, "10.1/a", None), ("r3", "9", None, "5"), ("r4", "", None, None)],
                              "rid string, c string, d string, p string")
    keys = {"corpus": F.col("c"), "doi": F.col("d"), "pmid": F.col("p")}
    assert dict(rows(R.resolve(r, "rid", keys, w), "rid", "work_id")) == {"r1": "x", "r2": "a", "r3": "z"}
    assert dict(rows(R.resolve(r, "rid", keys, w, ("pmid", "doi")), "rid", "work_id")) == {"r1": "z", "r2": "a", "r3": "z"}


def test_intake(spark, rows):
    ids = spark.createDataFrame([("s", "doi", "10.1/a", 0), ("s", "doi", "10.1/new", 1), ("s", "ambiguous", "2021", 2), ("t", "doi", "10.1/new", 0)],
                                "set_id string, kind string, value string, position int")
    w = spark.createDataFrame([("x", "10.1/A", None)], "work_id string, doi string, pmid string")
    members = spark.createDataFrame([("s", "x")], "set_id string, work_id string")
    out = R.intake_members(ids, w, members)
    assert out["stubs"].count() == 1 and rows(out["skipped"]) == [("s", "2021")]
    assert sorted(r.set_id for r in out["added"].collect()) == ["s", "t"]
    remaining, removed = R.remove_members(members, spark.createDataFrame([("s", "x"), ("s", "ghost")], "set_id string, work_id string"))
    assert remaining.count() == 0 and removed.count() == 1


def test_members_are_made_once_for_both_parts(spark, rows):
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    given = spark.createDataFrame([("s", "x", 1), ("s", "x", 1), ("s", "y", 2), (None, "x", 3), ("s", None, 4)], "set_id string, work_id string, n int")
    removals = spark.createDataFrame([("s", "x"), ("s", "x"), (None, "x"), ("s", None), ("t", "y")], "set_id string, work_id string")
    remaining, removed = R.remove_members(given.mapInArrow(told, given.schema), removals)
    assert rows(remaining, "n") == [(2,), (3,), (4,)] and rows(removed) == [("s", "x", 1)] * 2
    assert made.value == 5 and remaining.columns == given.columns


def test_release_diff(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "corpusid long, title string")
    updates = spark.createDataFrame([(2, "b1", 1), (2, "b2", 2), (4, "d", 1), (3, "c1", 1)], "corpusid long, title string, seq int")
    deletes = spark.createDataFrame([(3,)], "corpusid long")
    assert rows(tables.apply_release_diff(base, updates, deletes, "corpusid", "seq")) == [(1, "a"), (2, "b2"), (4, "d")]


def test_release_check_and_lookup(spark):
    one = spark.createDataFrame([("r1",), ("r1",)], "release_id string")
    assert tables.check_one_release(one) == "r1"
    with pytest.raises(ValueError):
        tables.check_one_release(spark.createDataFrame([("r1",), ("r2",)], "release_id string"))
    assert tables.point_lookup(spark.range(10), "id", [3, 99]).count() == 1


def test_documents_and_gold(spark, tmp_path):
    gold = tmp_path / "gold.json"
    gold.write_text(
        '{"papers": [{"doi": "10.1/a", "order": 1, "citations": [{"marker": "1", "resolved_doi": null}], "claims": '
        '[{"gold_id": "g1", "text": "t", "relations": [{"cited_doi": "10.1/b", "function": "method"}]}]}],\n'
        ' "equivalences": [["g1", "g2"]], "exhaustive_claims": true}'
    )
    parts = tables.gold_tables(tables.read_json_document(spark, str(gold), tables.GOLD_SCHEMA))
    assert parts["relations"].first().function == "method" and parts["equivalences"].count() == 2
    seeds = tmp_path / "seeds.json"
    seeds.write_text('{"seeds": [{"id": "DOI:10.1/a"}, {"id": "PMID:2"}]}')
    assert [r.id for r in tables.seed_rows(tables.read_json_document(spark, str(seeds), tables.SEED_SCHEMA)).orderBy("position").collect()] == ["DOI:10.1/a", "PMID:2"]


def test_exports(spark, tmp_path):
    members = spark.createDataFrame([("=1+1", 'say "x"', "10.1/a", "5"), ("plain", None, "10.1/a", None)], "title string, note string, doi string, pmid string")
    sinks.write_member_csv(members, ["title", "note"], str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert '"\'=1+1","say ""x"""' in text and '"plain",""' in text
    sinks.write_identifier_text(members, str(tmp_path / "ids"))
    lines = sorted(x for p in (tmp_path / "ids").glob("part-*") for x in p.read_text().split())
    assert lines == ["10.1/a", "5"]
    for _ in range(2):
        sinks.append_run(members, str(tmp_path / "runs"), "r1")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    metrics = spark.createDataFrame([("rules", "ops", "papers", 2.0)], "extractor string, stage string, metric string, value double")
    sinks.write_report(metrics, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().metric == "papers"
