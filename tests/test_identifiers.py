from pyspark.sql import functions as F

from claimloom.functions import identifiers as I
from claimloom.functions import text as X
from claimloom.functions import values as V
from claimloom.operators.resolution import pasted_identifiers


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first()["x"]


def test_doi_forms(spark):
    cases = {
        "10.1002/(SICI)1097-4636(199905)45:2<133::AID-JBM9>3.0.CO;2-#": "10.1002/(sici)1097-4636(199905)45:2<133::aid-jbm9>3.0.co;2-#",
        "https://doi.org/10.3000/from-url": "10.3000/from-url",
        "HTTP://DX.DOI.ORG/10.1000/Abc.": "10.1000/abc",
        " doi:10.1234/x;, ": "10.1234/x",
        "10.12/short": None,
        "10.1234/": None,
        "2021": None,
    }
    for raw, want in cases.items():
        assert one(spark, raw, I.normalize_doi) == want, raw


def test_pmid_and_paper_ids(spark):
    for raw, want in {"pmid:87654321": "87654321", "PMID 12": "12", "2021": None, "1499": "1499", "123456789": None}.items():
        assert one(spark, raw, I.pmid_from_token) == want, raw
    for raw, want in {"corpusid:5": "CorpusId:5", "doi:10.1/x:y": "DOI:10.1/x:y", "foo:1": None, "doi:": None, "": None, "abc": "abc"}.items():
        assert one(spark, raw, I.normalize_paper_id) == want, raw
    for raw, want in {"PMC12": "12", "pmc7": "7", "9": "9", "PMCx": None}.items():
        assert one(spark, raw, I.normalize_pmcid) == want, raw


def test_pasted_text(spark, rows):
    text = "10.1002/(SICI)1097-4636(199905)45:2<133::AID-JBM9>3.0.CO;2-#, https://doi.org/10.3000/from-url\n2021 pmid:87654321 title"
    got = rows(pasted_identifiers(spark.createDataFrame([("s", text)], "set_id string, csv_text string")), "kind", "value")
    assert [k for k, _ in got] == ["ambiguous", "doi", "doi", "pmid"]
    assert ("ambiguous", "2021") in got and ("pmid", "87654321") in got


def test_best_id_priority(spark):
    df = spark.createDataFrame([("7", "10.1/x", None)], "c string, d string, p string")
    corpus = df.select(I.best_external_id(("corpus", "doi", "pmid"), F.col("c"), F.col("d"), F.col("p"))).first()[0]
    doi = df.select(I.best_external_id(("doi", "pmid", "corpus"), F.col("c"), F.col("d"), F.col("p"))).first()[0]
    assert (corpus, doi) == ("CorpusId:7", "DOI:10.1/x")


def test_safe_names_and_markers(spark):
    assert one(spark, " a/b c.", I.safe_document_id) == "a_b_c"
    assert one(spark, "///", I.safe_document_id) == "doc"
    assert one(spark, " [12 , 3] ", X.normalize_marker) == "12,3"


def test_sentences_and_offsets(spark):
    text = "First claim (a). Second one [1]!  Third? no break. (Fourth) ends."
    got = spark.createDataFrame([(text,)], "t string").select(X.sentences_with_offsets(F.col("t")).alias("s")).first()["s"]
    assert [s["text"] for s in got] == ["First claim (a).", "Second one [1]!", "Third? no break.", "(Fourth) ends."]
    assert all(text[s["offset"]: s["offset"] + len(s["text"])] == s["text"] for s in got)


def test_claim_text(spark):
    assert one(spark, "Drug  lowered\tpressure [12]", X.normalize_claim) == "Drug lowered pressure"
    assert one(spark, "[3]", X.normalize_claim) == "[3]"
    tokens = one(spark, "The study showed HbA1c fell by 12% in 340 adults, adults", X.content_tokens)
    assert sorted(tokens) == ["340", "adults", "fell", "hba1c"]


def test_cue_quirks(spark):
    lexicon = X.DEFAULT_LEXICON
    assert one(spark, "p<0.05", lambda c: X.matches(c, lexicon.result))
    assert not one(spark, "p < 0.05", lambda c: X.matches(c, lexicon.result))
    assert not one(spark, "was upregulated", lambda c: X.matches(c, lexicon.increase))
    assert one(spark, "HOWEVER it fell", lambda c: X.matches(c, lexicon.contrast))


def test_stance_table(spark):
    want = {  # (support, contrast, method) -> stance, score
        (0, 0, 0): ("neutral", 0.545), (1, 0, 0): ("support", 0.652), (0, 1, 0): ("contradict", 0.609),
        (1, 1, 0): ("unclear", 0.429), (0, 0, 1): ("neutral", 0.737), (1, 0, 1): ("unclear", 0.484),
    }
    df = spark.createDataFrame([tuple(map(bool, k)) for k in want], "s boolean, c boolean, m boolean")
    dist = X.stance_distribution(F.col("s"), F.col("c"), F.col("m"))
    for r in df.select("s", "c", "m", X.stance_of(dist).alias("stance"), X.stance_score(dist).alias("score")).collect():
        assert (r.stance, r.score) == want[(int(r.s), int(r.c), int(r.m))]


def test_countries(spark):
    cases = {
        "Dept, Univ X, United States": "United States", "Univ X, USA": "United States", "Univ Y, United Kingdom": "United Kingdom",
        "Univ Z, Germany.": "Germany", "Lab, U.S.A.": None, "Seoul, Korea, Building 3": "South Korea", "China Hospital": None, "": None,
    }
    for raw, want in cases.items():
        assert one(spark, raw, V.parse_country) == want, raw


def test_cosine_guards(spark):
    schema = "a array<float>, b array<float>"
    data = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])]
    got = [r[0] for r in spark.createDataFrame(data, schema).select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_integrity_messages(spark):
    schema = "update_to array<struct<type:string,label:string>>, title array<string>"
    data = [
        ([("retraction", "Retraction")], None), ([("expression_of_concern", "Expression of concern")], None),
        (None, ["RETRACTED: a paper"]), ([], ["clean"]), ([("unheard", "x"), ("Correction", None)], ["fine"]),
    ]
    got = [tuple(r[0]) for r in spark.createDataFrame(data, schema).select(V.integrity_flags(F.col("update_to"), F.col("title"))).collect()]
    assert got == [(True, "Retraction"), (False, "Expression of concern"), (True, "Retracted"), (False, None), (False, "Correction")]


def test_knowledge_sources(spark):
    schema = "s array<struct<resource_role:string,resource_id:string>>"
    data = [([("primary_knowledge_source", "infores:ctd"), ("aggregator_knowledge_source", "infores:agg")],), (None,)]
    got = [tuple(r[0]) for r in spark.createDataFrame(data, schema).select(V.knowledge_sources(F.col("s"))).collect()]
    assert got == [("infores:ctd", ["infores:agg"]), (None, [])]
    assert one(spark, "biolink:affects_level_of", V.predicate_label) == "affects level of"
