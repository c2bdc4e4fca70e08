"""Inputs that the oracles do not show: control characters and several records of one identifier."""

from pyspark.sql import functions as F

from claimloom.functions.text import sentences_with_offsets
from claimloom.operators.bibliometrics import ranked_authors
from claimloom.operators.resolution import check_integrity


def test_sentences_keep_control_characters(spark):
    text = "One\u0001two. Three!  (Four) five."
    row = spark.createDataFrame([(text,)], "t string").select(sentences_with_offsets(F.col("t")).alias("s")).first()
    assert [(s.offset, s.text) for s in row.s] == [(0, "One\u0001two."), (9, "Three!"), (17, "(Four) five.")]
    assert all(text[s.offset :].startswith(s.text) for s in row.s)


def test_one_retraction_among_records_is_enough(spark):
    works = spark.createDataFrame([("w", "10.5555/a", None, None), ("v", "10.5555/b", None, None)], "work_id string, doi string, is_retracted boolean, integrity_notice string")
    messages = spark.createDataFrame(
        [("10.5555/A", [("correction", "Correction")], []), ("10.5555/a", [("retraction", "Retraction")], []), ("10.5555/a", None, []), ("10.5555/b", [("correction", "Fixed")], [])],
        "doi string, update_to array<struct<type:string,label:string>>, title array<string>",
    )
    got = {r.work_id: (r.is_retracted, r.integrity_notice) for r in check_integrity(works, messages).collect()}
    assert got == {"w": (True, "Retraction"), "v": (False, "Fixed")}


def test_nothing_is_cut_unasked(spark):
    metrics = spark.range(80).selectExpr("cast(id as string) as author_key", "id as document_count", "id as h_index", "id as citation_count")
    assert ranked_authors(metrics).count() == 80 and ranked_authors(metrics, 60).count() == 60
