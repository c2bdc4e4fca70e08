import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom.operators import extraction as E
from claimloom.sources import fulltext as X
from claimloom.sources import references as R

PAPER_A = """<article><front><journal-meta><journal-title>J Trials</journal-title></journal-meta><article-meta>
<article-id pub-id-type="doi">10.1/a</article-id><title-group><article-title>Paper <i>A</i></article-title></title-group>
<contrib-group><contrib><name><surname>Lovelace</surname><given-names>Ada</given-names></name></contrib></contrib-group>
<pub-date><year>2021</year></pub-date></article-meta></front><body>
<sec><title>Results</title><p>The drug significantly reduced HbA1c, consistent with <xref ref-type="bibr" rid="r1">[1]</xref>. However, others differ <xref ref-type="bibr" rid="r3">[3]</xref>.</p>
<sec><p>Nested text.</p></sec></sec><sec><title>Methods</title><p>Assays followed <b>Smith</b> <xref ref-type="bibr" rid="r2">[2]</xref>.</p><p>  </p></sec></body>
<back><ref-list><ref id="r1"><label>1</label><article-title>Paper B</article-title><pub-id pub-id-type="doi">10.1/b</pub-id><year>2019</year></ref>
<ref id="r2"><pub-id pub-id-type="pmid">42</pub-id></ref><ref id="r3"><article-title>No ids</article-title></ref></ref-list></back></article>"""


@pytest.fixture(scope="module")
def parsed(spark):
    docs = [("A", PAPER_A), ("bad", "<article><front>"), ("bomb", '<!DOCTYPE x [<!ENTITY a "b">]><article/>'), ("other", "<html><p>x</p></html>")]
    return X.parse_papers(spark.createDataFrame(docs, "doc_id string, xml string")).cache()


def test_full_text(parsed):
    status = {r.doc_id: r.parse_status for r in parsed.collect()}
    assert status == {"A": "parsed", "bad": "failed", "bomb": "failed", "other": "failed"}
    head = X.paper_rows(parsed).first()
    assert (head.title, head.venue, head.year, head.doi, head.authors) == ("Paper A", "J Trials", 2021, "10.1/a", ["Ada Lovelace"])
    refs = {r.rid: (r.doi, r.pmid, r.year) for r in X.reference_rows(parsed).collect()}
    assert refs == {"r1": ("10.1/b", None, 2019), "r2": (None, "42", None), "r3": (None, None, None)}
    rows = X.passage_rows(parsed).orderBy("char_start").collect()
    assert [(r.section, r.paragraph, r.sentence) for r in rows] == [("Results", 1, 1), ("Results", 1, 2), ("Results", 2, 1), ("Methods", 3, 1)]
    document = "\n".join(["The drug significantly reduced HbA1c, consistent with [1]. However, others differ [3].", "Nested text.", "Assays followed Smith [2]."])
    assert all(document[r.char_start: r.char_end] == r.text for r in rows)
    assert [[(c.marker, c.rid) for c in r.citations] for r in rows] == [[("[1]", "r1")], [("[3]", "r3")], [], [("[2]", "r2")]]
    assert all(r.text[c.offset:].startswith(c.marker) for r in rows for c in r.citations)


def test_ingest(spark, parsed):
    known = spark.createDataFrame([("B", "10.1/b", None)], "work_id string, doi string, pmid string")
    out = E.ingest_papers(X.evidence(parsed), known)
    states = sorted(r.availability_state for r in out["works"].collect())
    assert states == ["full_text", "metadata_stub"]
    mentions = {r.marker_span: (r.cited_work_id is not None, r.confidence) for r in out["mentions"].collect()}
    assert mentions == {"[1]": (True, 0.95), "[2]": (True, 0.95), "[3]": (False, 0.0)}
    again = E.ingest_papers(X.evidence(parsed), known)
    assert sorted(r.passage_id for r in again["passages"].collect()) == sorted(r.passage_id for r in out["passages"].collect())


def test_rules(parsed):
    passages = X.passage_rows(parsed).withColumn("passage_id", F.concat_ws(".", "paragraph", "sentence"))
    claims = {r.passage_id: r for r in E.extract_by_rules(passages).collect()}
    assert set(claims) == {"1.1", "1.2", "3.1"}
    assert (claims["1.1"].occurrence_type, claims["1.1"].qualifiers.effect_direction, claims["1.1"].qualifiers.certainty) == ("reported_result", "decrease", "definite")
    assert claims["3.1"].occurrence_type == "method_description"
    relations = {r.passage_id: (r.function, r.stance, r.rid) for r in E.relations_by_rules(passages).collect()}
    assert relations == {"1.1": ("direct_evidence", "support", "r1"), "1.2": ("comparison", "contradict", "r3"), "3.1": ("method", "neutral", "r2")}


def test_custom_extractor(parsed):
    def shout(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "claim": b["text"].str.upper()})

    got = E.extract_with(X.passage_rows(parsed).select("doc_id", "text"), shout, "doc_id string, claim string")
    assert "NESTED TEXT." in {r.claim for r in got.collect()}


def good(**claim):
    base = {"verbatim_text": "drug reduced", "normalized_text": " Drug reduces ", "occurrence_type": "reported_result"}
    return {"claims": [{**base, **claim}]}


RELATION = {"citation_marker": "( 1 )", "function": "background", "stance": "support"}
CASES = {
    "valid": (good(relations=[RELATION]), 1, 1),
    "empty": ({}, 0, 0),
    "no_claims": ({"claims": []}, 0, 0),
    "extra_top": ({"claims": [], "note": 1}, 0, 0),
    "extra_claim": (good(surprise=1), 0, 0),
    "bad_enum": (good(occurrence_type="rumour"), 0, 0),
    "missing": ({"claims": [{"verbatim_text": "drug reduced", "occurrence_type": "other"}]}, 0, 0),
    "bad_qualifier": (good(qualifiers={"certainty": "sure"}), 0, 0),
    "extra_qualifier": (good(qualifiers={"mood": "x"}), 0, 0),
    "qualifier": (good(qualifiers={"certainty": "possible", "negated": True, "outcome": "HbA1c"}), 1, 0),
    "bad_relation": (good(relations=[{**RELATION, "stance": "maybe"}]), 0, 0),
    "unknown_marker": (good(relations=[{**RELATION, "citation_marker": "[7]"}]), 1, 0),
    "not_in_text": (good(verbatim_text="drug increased"), 0, 0),
    "one_of_two": ({"claims": good()["claims"] + good(verbatim_text="never")["claims"]}, 1, 0),
    "one_bad_spoils": ({"claims": good()["claims"] + good(occurrence_type="x")["claims"]}, 0, 0),
    "number_as_text": (good(normalized_text=7), 0, 0),
    "object_as_text": (good(normalized_text={"a": "b"}), 0, 0),
    "list_as_population": (good(qualifiers={"population": ["rats"]}), 0, 0),
    "null_population": (good(qualifiers={"population": None}), 1, 0),
    "number_as_marker": (good(relations=[{**RELATION, "citation_marker": 1}]), 0, 0),
    "object_as_relations": (good(relations={"a": RELATION}), 0, 0),
    "list_as_distribution": (good(relations=[{**RELATION, "stance_distribution": [0.7]}]), 0, 0),
    "claims_object": ({"claims": {"a": 1}}, 0, 0),
    "distribution": (good(relations=[{**RELATION, "stance_distribution": {"support": 0.7, "neutral": 0.3}}]), 1, 1),
}


def test_strict_completions(spark):
    rows = [(k, json.dumps(v[0]), "The drug reduced HbA1c [1].", [("[1]", "r1")]) for k, v in CASES.items()]
    rows.append(("broken", "{\"claims\": [", "The drug reduced", []))
    whole = json.dumps(good())
    for name, text in (("prose_after", whole + " Done."), ("prose_before", "Here: " + whole), ("two_values", whole + ", " + whole), ("list", "[" + whole + "]")):
        rows.append((name, text, "The drug reduced HbA1c [1].", []))
    df = spark.createDataFrame(rows, "request_id string, completion string, text string, citations array<struct<marker:string,rid:string>>")
    claims = E.parse_completions(df).cache()
    counts = {r.request_id: r["count"] for r in claims.groupBy("request_id").count().collect()}
    assert counts == {k: v[1] for k, v in CASES.items() if v[1]}
    first = claims.filter("request_id = 'valid'").first()
    assert (first.span_start, first.span_end, first.normalized_text) == (4, 16, "Drug reduces")
    relations = {r.request_id: (r.rid, r.stance_score, r.scope) for r in E.match_markers(claims).collect()}
    assert set(relations) == {k for k, v in CASES.items() if v[2]}
    assert relations["valid"] == ("r1", 0.9, "whole_claim") and relations["distribution"][1] == 0.7
    qualified = claims.filter("request_id = 'qualifier'").first().qualifiers
    assert (qualified.certainty, qualified.negated, qualified.effect_direction, qualified.outcome) == ("possible", True, "unclear", "HbA1c")


def test_response_shapes_and_replay(spark, tmp_path):
    lines = [
        {"request_id": "a", "completion": "old"}, {"request_id": "a", "completion": "new"},
        {"custom_id": "b", "choices": [{"message": {"content": "direct"}}]},
        {"custom_id": "c", "response": {"choices": [{"message": {"content": "nested"}}]}},
        {"custom_id": "d", "response": {"choices": []}}, {"completion": "no id"},
    ]
    path = tmp_path / "responses.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines))
    raw = spark.read.schema(E.RESPONSE_SCHEMA).json(str(path)).withColumn("position", F.monotonically_increasing_id())
    got = {r.request_id: r.completion for r in E.completion_rows(raw).collect()}
    assert got == {"a": "new", "b": "direct", "c": "nested"}
    requests = spark.createDataFrame([("a",), ("z",)], "request_id string")
    assert [r.request_id for r in E.replay(requests, E.completion_rows(raw)).collect()] == ["a"]


def test_prompts(spark):
    df = spark.createDataFrame(
        [("d", 0, None, "Nothing here", []), ("d", 1, "Results", "Risk was lower", [("[2]", "r"), ("[1]", "r"), ("[2]", "r")])],
        "doc_id string, passage_index int, section string, text string, citations array<struct<marker:string,rid:string>>",
    )
    got = E.build_requests(df, "m").collect()
    assert len(got) == 1 and got[0].request_id.startswith("p1_") and len(got[0].request_id) == 19
    assert got[0].user == "Section: Results\nCitation markers present: [1], [2]\n\n<passage>\nRisk was lower\n</passage>"
    assert E.prompt_manifest(E.build_requests(df, "m")).first().prompt_count == 1


RIS = "TY  - JOUR\nTI  - A\nDO  - https://doi.org/10.1000/RIS.\nAN  - 555\nDB  - PubMed\nER  - \n\nTY  - JOUR\nTI  - none\nAN  - 99\nER  - \n"
BIB = '@comment{10.9/x}\n@article{k1, title={A {nested} one}, doi = {10.2000/BIB}, url={https://pubmed.ncbi.nlm.nih.gov/321/}}\n@book{k2, title="none"}\n'


def test_reference_exports(spark):
    files = spark.createDataFrame([("a.ris", RIS), ("b.bib", BIB), ("c", "stray 10.3000/x in\nTY  - JOUR\nno end"), ("d.csv", "10.1/x"), ("e.txt", "doi:10.5000/A. 1999, PMID:77\n10.5000/a none 77 123456789 1999")], "file string, text string")
    rows = {(r.file, r.position): (r.doi, r.pmid) for r in R.parse_exports(files).collect()}
    assert rows[("a.ris", 0)] == ("10.1000/ris", "555") and rows[("a.ris", 1)] == (None, None)
    assert rows[("b.bib", 0)] == ("10.2000/bib", "321") and rows[("b.bib", 1)] == (None, None)
    assert {k: v for k, v in rows.items() if k[0] == "e.txt"} == {("e.txt", 0): ("10.5000/a", None), ("e.txt", 1): (None, None), ("e.txt", 2): (None, "77"), ("e.txt", 6): (None, None)}
    counts = {r.file: (r.entry_count, r.matched_count) for r in R.export_counts(R.parse_exports(files)).collect()}
    assert counts["e.txt"] == (4, 2) and "d.csv" not in counts  # too short for a DOI, and no number
    assert counts["a.ris"] == (2, 1) and counts["b.bib"] == (2, 1)
    formats = {r.file: r.f for r in files.select("file", R.detect_format(F.lit(None), F.col("text")).alias("f")).collect()}
    assert formats["a.ris"] == "ris" and formats["b.bib"] == "bibtex" and formats["d.csv"] == "csv"


def test_export_counts_without_copies_of_every_entry(spark, capsys):
    entries = [("a", "d1", "p1"), ("a", "d1", None), ("a", None, "p1"), ("a", None, None), ("a", None, None), ("a", "d2", "d1"), (None, "d1", None), ("", None, "7"), ("b", None, None)]
    got = R.export_counts(spark.createDataFrame(entries, "file string, doi string, pmid string"))
    assert {tuple(r) for r in got.collect()} == {("a", 6, 4, 2, 2), (None, 1, 1, 1, 0), ("", 1, 1, 0, 1), ("b", 1, 0, 0, 0)}
    got.explain()
    assert "Expand" not in capsys.readouterr().out


def test_full_text_reader_details():
    from claimloom.sources.fulltext import flatten_document

    deep = "<article><body>" + "<sec>" * 5000 + "<p>Deep.</p>" + "</sec>" * 5000 + "</body></article>"
    assert flatten_document(deep)["paragraphs"] == [{"section": None, "text": "Deep.", "start": 0, "marks": []}]
    late = "<article><body><sec><p>First.</p><sec><title> </title><p>In <b>it<xref ref-type='bibr' rid='a'>1<sup>x</sup></xref></b>.</p></sec><title>Late</title></sec></body></article>"
    assert flatten_document(late)["paragraphs"] == [
        {"section": "Late", "text": "First.", "start": 0, "marks": []},
        {"section": "Late", "text": "In it1.", "start": 7, "marks": [{"marker": "1", "rid": "a", "at": 5}]},
    ]
    twice = (
        "<article><front><article-meta><article-title>T</article-title><article-title>U</article-title></article-meta></front><back><ref id='r'><label>1</label>"
        "<label>2</label><pub-id pub-id-type='doi'>a</pub-id><pub-id pub-id-type='doi'>b</pub-id><year>1999</year><year>2001</year><year>x</year></ref></back></article>"
    )
    found = flatten_document(twice)
    assert found["title"] == "T" and found["refs"] == [{"rid": "r", "label": "2", "title": None, "doi": "b", "pmid": None, "year": 2001}]
    assert flatten_document("<!DOCTYPE a [<!ENTITY x 'y'>]><article><body><p>&x;</p></body></article>") is None
    assert flatten_document("<html><p>no paper</p></html>") is None and flatten_document("<a>") is None and flatten_document(None) is None


def test_repeated_ids_do_not_multiply(spark):
    xml = "<article><body><p>One.</p></body></article>"
    docs = spark.createDataFrame([("a", xml), ("a", xml), ("b", "<broken")], "doc_id string, xml string")
    assert sorted(r.parse_status for r in X.parse_papers(docs).collect()) == ["failed", "parsed", "parsed"]


def test_bibtex_scan():
    from claimloom.sources.references import split_bibtex

    text = "@comment{@article{in, a={1}}} stray } @book{x, t={a {b} c}} { @misc{y} } @open{z, {q"
    assert split_bibtex(text) == ["in, a={1}}", "x, t={a {b} c}}", "y}", "z, {q"]
    assert split_bibtex(None) == []
