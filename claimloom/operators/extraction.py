"""Passages to claims and relations: by rules, by a supplied function, or from stored
model completions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.identifiers import derived_id, strip
from ..functions.lexicons import (
    CERTAINTIES,
    EFFECT_DIRECTIONS,
    FUNCTIONS,
    MENTION_CONFIDENCE,
    OCCURRENCE_TYPES,
    SCOPES,
    STANCES,
    CueLexicon,
)
from .resolution import INGEST_PRIORITY, resolve

# --- ingest ------------------------------------------------------------------------------------


def ingest_papers(parsed: dict[str, DataFrame], works: DataFrame) -> dict[str, DataFrame]:
    """Evidence tables of a batch of parsed papers.

    ``parsed`` holds ``papers(doc_id, title, doi, pmid, year, venue, artifact_hash)``,
    ``references(doc_id, rid, title, doi, pmid, year)`` and ``passages(doc_id, paragraph,
    sentence, section, text, char_start, char_end, citations)``. Papers and references
    resolve by doi, then pmid; an unknown paper becomes a work, an unknown reference a stub,
    and a reference without identifiers stays unresolved.
    """
    papers = parsed["papers"]
    known = resolve(
        papers.select("doc_id", "doi", "pmid"), "doc_id", {"doi": F.col("doi"), "pmid": F.col("pmid")},
        works, INGEST_PRIORITY, fold_doi=False,
    ).select("doc_id", F.col("work_id").alias("_known"))
    natural = F.coalesce("doi", F.concat(F.lit("pmid:"), "pmid"), F.concat(F.lit("doc:"), "doc_id"))
    placed = papers.join(known, "doc_id", "left").withColumn(
        "work_id", F.coalesce("_known", derived_id("work", natural))
    )
    fresh = (
        placed.filter(F.col("_known").isNull())
        .groupBy("work_id")
        .agg(*[F.min_by(c, "doc_id").alias(c) for c in ("title", "doi", "pmid", "year", "venue")])
    )
    versions = placed.select(
        derived_id("ver", F.col("work_id"), F.col("artifact_hash")).alias("version_id"), "work_id", "doc_id", "artifact_hash"
    )
    references = parsed["references"].filter(F.col("doi").isNotNull() | F.col("pmid").isNotNull())
    index = works.select("work_id", "doi", "pmid").unionByName(fresh.select("work_id", "doi", "pmid"))
    distinct = references.select(
        F.concat_ws("|", F.coalesce("doi", F.lit("")), F.coalesce("pmid", F.lit(""))).alias("ref_key"),
        "doi", "pmid", "title", "year",
    ).groupBy("ref_key").agg(*[F.min(c).alias(c) for c in ("doi", "pmid", "title", "year")])
    found = resolve(
        distinct.select("ref_key", "doi", "pmid"), "ref_key", {"doi": F.col("doi"), "pmid": F.col("pmid")},
        index, INGEST_PRIORITY, fold_doi=False,
    ).select("ref_key", "work_id")
    stubs = distinct.join(found, "ref_key", "left_anti").withColumn(
        "work_id", derived_id("work", F.coalesce("doi", F.concat(F.lit("pmid:"), "pmid")))
    )
    targets = found.unionByName(stubs.select("ref_key", "work_id"))
    cited = (
        references.withColumn("ref_key", F.concat_ws("|", F.coalesce("doi", F.lit("")), F.coalesce("pmid", F.lit(""))))
        .join(targets, "ref_key")
        .select("doc_id", "rid", F.col("work_id").alias("cited_work_id"))
    )
    passages = parsed["passages"].join(versions.select("doc_id", "version_id"), "doc_id").withColumn(
        "passage_id", derived_id("psg", F.col("version_id"), F.col("paragraph").cast("string"), F.col("sentence").cast("string"))
    )
    mentions = (
        passages.select("doc_id", "passage_id", F.posexplode("citations").alias("ordinal", "c"))
        .select("doc_id", "passage_id", "ordinal", F.col("c.marker").alias("marker_span"), F.col("c.rid").alias("rid"))
        .join(cited, ["doc_id", "rid"], "left")
        .select(
            derived_id("men", F.col("passage_id"), F.col("ordinal").cast("string")).alias("mention_id"),
            "passage_id",
            "ordinal",
            "marker_span",
            "cited_work_id",
            F.when(F.col("cited_work_id").isNotNull(), MENTION_CONFIDENCE).otherwise(0.0).alias("confidence"),
        )
    )
    stub_rows = stubs.select("work_id", "title", "doi", "pmid", "year", F.lit(None).cast("string").alias("venue"))
    return {
        "works": fresh.withColumn("availability_state", F.lit("full_text")).unionByName(
            stub_rows.groupBy("work_id")
            .agg(*[F.min(c).alias(c) for c in ("title", "doi", "pmid", "year", "venue")])
            .withColumn("availability_state", F.lit("metadata_stub"))
        ),
        "versions": versions,
        "passages": passages.withColumnRenamed("version_id", "paper_version_id"),
        "mentions": mentions,
    }


# --- rule-based extraction ---------------------------------------------------------------------------


def extract_by_rules(passages: DataFrame, lexicon: CueLexicon = X.DEFAULT_LEXICON) -> DataFrame:
    """Claims of result sentences and of sentences with a citation.

    ``passages(passage_id, section, text, citations)``; the claim spans the whole passage.
    """
    body, section = F.col("text"), F.col("section")
    kept = passages.filter(X.is_result(body, lexicon) | (F.size("citations") > 0))
    return kept.select(
        "passage_id",
        F.concat(F.lit("occ:"), "passage_id").alias("occurrence_id"),
        F.concat(F.lit("int:"), "passage_id").alias("interpretation_id"),
        X.occurrence_type(body, section, lexicon).alias("occurrence_type"),
        F.lit(0).alias("span_start"),
        F.length(body).alias("span_end"),
        X.normalize_claim(body).alias("normalized_text"),
        X.qualifiers(body, lexicon).alias("qualifiers"),
    )


def relations_by_rules(passages: DataFrame, lexicon: CueLexicon = X.DEFAULT_LEXICON) -> DataFrame:
    """One relation per citation of a passage, with function, stance and its distribution."""
    body, section = F.col("text"), F.col("section")
    cited = passages.filter(F.size("citations") > 0).withColumns(
        {
            "function": X.citation_function(body, section, lexicon),
            "_support": X.matches(body, lexicon.support),
            "_contrast": X.matches(body, lexicon.contrast),
        }
    )
    read = cited.withColumn(
        "stance_distribution",
        X.stance_distribution(F.col("_support"), F.col("_contrast"), F.col("function") == "method"),
    )
    rows = read.select("*", F.posexplode("citations").alias("ordinal", "citation"))
    return rows.select(
        "passage_id",
        "ordinal",
        F.col("citation.marker").alias("marker"),
        F.col("citation.rid").alias("rid"),
        "function",
        X.stance_of(F.col("stance_distribution")).alias("stance"),
        F.lit("whole_claim").alias("scope"),
        "stance_distribution",
        X.stance_score(F.col("stance_distribution")).alias("stance_score"),
    )


def extract_with(passages: DataFrame, extractor: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Claims from a caller's function over batches of passages (pandas frames)."""
    return passages.mapInPandas(extractor, schema)


# --- model prompts and completions ------------------------------------------------------------------------


def build_requests(passages: DataFrame, model: str, template: str = "extract-v1") -> DataFrame:
    """One prompt per claim-worthy passage, with a content-addressed request id.

    ``passages(doc_id, passage_index, section, text, citations)``.
    """
    worthy = passages.filter((F.size("citations") > 0) | X.is_claimworthy(F.col("text")))
    markers = F.transform("citations", lambda c: c["marker"])
    return worthy.select(
        "doc_id",
        "passage_index",
        X.request_id(F.lit(model), F.lit(template), F.col("passage_index"), F.col("text")).alias("request_id"),
        F.lit(model).alias("model"),
        X.user_prompt(F.col("section"), markers, F.col("text")).alias("user"),
        F.lit(0.0).alias("temperature"),
        F.lit(1536).alias("max_tokens"),
        "text",
        "citations",
    )


def completion_rows(raw: DataFrame) -> DataFrame:
    """``(request_id, completion)`` from stored response lines; the last line of an id wins.

    ``raw(position, request_id, custom_id, completion, choices, response)``: the completion
    is given directly, or as the first choice of the row or of its ``response``.
    """
    first = lambda c: F.get(F.col(c), 0)["message"]["content"]
    completion = F.coalesce(
        "completion", F.when(F.col("response").isNull(), first("choices")), first("response.choices")
    )
    rid = F.coalesce(F.nullif(F.col("request_id"), F.lit("")), F.nullif(F.col("custom_id"), F.lit("")))
    return (
        raw.select(rid.alias("request_id"), completion.alias("completion"), "position")
        .filter(F.col("request_id").isNotNull() & F.col("completion").isNotNull())
        .groupBy("request_id")
        .agg(F.max_by("completion", "position").alias("completion"))
    )


RESPONSE_SCHEMA = (
    "request_id string, custom_id string, completion string, "
    "choices array<struct<message:struct<content:string>>>, "
    "response struct<choices:array<struct<message:struct<content:string>>>>"
)
_CLAIM_SCHEMA = (
    "struct<verbatim_text:string,normalized_text:string,occurrence_type:string,"
    "qualifiers:struct<population:string,intervention:string,comparator:string,outcome:string,"
    "effect_direction:string,certainty:string,negated:boolean>,"
    "relations:array<struct<citation_marker:string,`function`:string,stance:string,scope:string,"
    "stance_distribution:map<string,double>>>>"
)
_CLAIM_KEYS = ("verbatim_text", "normalized_text", "occurrence_type", "qualifiers", "relations")
_QUALIFIER_KEYS = (
    "population", "intervention", "comparator", "outcome", "effect_direction", "certainty", "negated",
)
_RELATION_KEYS = ("citation_marker", "function", "stance", "scope", "stance_distribution")


def _only_keys(given: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.map_keys(given), F.array(*[F.lit(k) for k in allowed]))) == 0


def _alone(text: Column) -> Column:
    """The text as one JSON value, null if anything else precedes or follows it.

    Set in a list before its own checksum, a text that ends early, or holds more than one value,
    leaves the list another shape.
    """
    check = F.sha2(text, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "'), check, F.lit('"]')))
    closed = (F.try_variant_get(pair, "$[1]", "string") == check) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(closed, F.try_variant_get(pair, "$[0]", "variant"))


def _kind(value: Column, path: str, *kinds: str, absent: bool = True) -> Column:
    """Whether what stands at ``path`` is of one of the kinds; ``absent`` if nothing does."""
    found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.coalesce(F.regexp_extract(found, "^[A-Z]+", 0).isin(*kinds), F.lit(absent))


def _claim_kinds(claim: Column) -> Column:
    """JSON kinds of a claim's fields, which a declared string would turn into text unseen."""
    optional_text = [_kind(claim, f"$.qualifiers.{k}", "STRING", "VOID") for k in _QUALIFIER_KEYS[:4]]
    fixed_text = [_kind(claim, f"$.qualifiers.{k}", "STRING") for k in _QUALIFIER_KEYS[4:6]]
    relations = F.coalesce(F.try_variant_get(claim, "$.relations", "array<variant>"), F.array().cast("array<variant>"))

    def relation(r: Column) -> Column:
        texts = [_kind(r, f"$.{k}", "STRING", absent=False) for k in _RELATION_KEYS[:3]]
        return reduce(and_, [*texts, _kind(r, "$.scope", "STRING"), _kind(r, "$.stance_distribution", "OBJECT", "VOID")])

    return reduce(
        and_,
        [
            *(_kind(claim, f"$.{k}", "STRING", absent=False) for k in _CLAIM_KEYS[:3]),
            _kind(claim, "$.qualifiers", "OBJECT"), *optional_text, *fixed_text, _kind(claim, "$.qualifiers.negated", "BOOLEAN"),
            _kind(claim, "$.relations", "ARRAY"), F.forall(relations, relation),
        ],
    )


def parse_completions(replayed: DataFrame) -> DataFrame:
    """Claims of completions that match the closed output shape; any deviation (bad JSON, text
    around it, unknown key, missing field, wrong kind, bad enum value) rejects the whole completion.

    ``replayed(request_id, completion, text, citations, ...)``. Of an accepted completion,
    a claim is kept when its words occur in the passage.
    """
    # maps of raw values expose the key sets that a declared struct would hide
    raw_map = "map<string,string>"
    shaped = (
        replayed.withColumn("_top", F.from_json("completion", raw_map))
        .withColumn("_raw", F.from_json(F.col("_top")["claims"], f"array<{raw_map}>"))
        .withColumn("_claims", F.from_json(F.col("_top")["claims"], f"array<{_CLAIM_SCHEMA}>"))
        .withColumn("_value", _alone(F.col("completion")))
        .withColumn("_kinds", F.try_variant_get("_value", "$.claims", "array<variant>"))
    )

    def object_of(value: Column) -> Column:
        return F.from_json(value, raw_map)

    def array_of(value: Column) -> Column:
        return F.from_json(value, f"array<{raw_map}>")

    def good_qualifiers(value: Column) -> Column:
        q = object_of(value)
        return value.isNull() | (
            q.isNotNull()
            & _only_keys(q, _QUALIFIER_KEYS)
            & F.coalesce(q["effect_direction"].isin(*EFFECT_DIRECTIONS), ~F.map_contains_key(q, "effect_direction"))
            & F.coalesce(q["certainty"].isin(*CERTAINTIES), ~F.map_contains_key(q, "certainty"))
            & F.coalesce(q["negated"].isin("true", "false"), ~F.map_contains_key(q, "negated"))
        )

    def good_relation(r: Column) -> Column:
        dist = F.from_json(r["stance_distribution"], "map<string,double>")
        return (
            _only_keys(r, _RELATION_KEYS)
            & r["citation_marker"].isNotNull()
            & F.coalesce(r["function"].isin(*FUNCTIONS), F.lit(False))
            & F.coalesce(r["stance"].isin(*STANCES), F.lit(False))
            & F.coalesce(r["scope"].isin(*SCOPES), ~F.map_contains_key(r, "scope"))
            & (r["stance_distribution"].isNull() | (dist.isNotNull() & ~F.exists(F.map_values(dist), lambda v: v.isNull())))
        )

    def good_claim(m: Column) -> Column:
        relations = array_of(m["relations"])
        return (
            _only_keys(m, _CLAIM_KEYS)
            & m["verbatim_text"].isNotNull()
            & m["normalized_text"].isNotNull()
            & F.coalesce(m["occurrence_type"].isin(*OCCURRENCE_TYPES), F.lit(False))
            & (~F.map_contains_key(m, "qualifiers") | (m["qualifiers"].isNotNull() & good_qualifiers(m["qualifiers"])))
            & (
                ~F.map_contains_key(m, "relations")
                | (relations.isNotNull() & F.forall(relations, good_relation))
            )
        )

    top_ok = F.col("_top").isNotNull() & _only_keys(F.col("_top"), ("claims",))
    claims_ok = F.col("_raw").isNotNull() & F.forall("_raw", good_claim)
    claims_ok &= _kind(F.col("_value"), "$.claims", "ARRAY") & F.forall("_kinds", _claim_kinds)
    accepted = shaped.filter(F.coalesce(top_ok & claims_ok, F.lit(False)))
    rows = accepted.select(*replayed.columns, F.posexplode("_claims").alias("claim_ordinal", "claim"))
    verbatim = strip(F.col("claim.verbatim_text"))
    normalized = strip(F.col("claim.normalized_text"))
    start = F.instr(F.col("text"), F.col("verbatim"))
    return (
        rows.withColumn("verbatim", verbatim)
        .withColumn("span_start", start - 1)
        .filter(F.col("span_start") >= 0)
        .select(
            *[c for c in replayed.columns if c != "completion"],
            "claim_ordinal",
            F.col("span_start"),
            (F.col("span_start") + F.length("verbatim")).alias("span_end"),
            F.when(normalized != "", normalized).otherwise(F.col("verbatim")).alias("normalized_text"),
            F.col("claim.occurrence_type").alias("occurrence_type"),
            F.struct(
                *[F.col(f"claim.qualifiers.{k}").alias(k) for k in _QUALIFIER_KEYS[:4]],
                F.coalesce("claim.qualifiers.effect_direction", F.lit("unclear")).alias("effect_direction"),
                F.coalesce("claim.qualifiers.certainty", F.lit("probable")).alias("certainty"),
                F.coalesce("claim.qualifiers.negated", F.lit(False)).alias("negated"),
            ).alias("qualifiers"),
            F.coalesce("claim.relations", F.array()).alias("relations"),
        )
    )


def match_markers(claims: DataFrame) -> DataFrame:
    """Relations whose marker names a citation of the passage (the first such citation);
    the others are dropped."""
    rows = claims.select("*", F.posexplode("relations").alias("relation_ordinal", "r"))
    wanted = X.normalize_marker(F.col("r.citation_marker"))
    named = F.filter("citations", lambda c: X.normalize_marker(c["marker"]) == F.col("_wanted"))
    dist = F.col("r.stance_distribution")
    fallback = F.when(F.col("r.stance") == "unclear", 0.5).otherwise(0.9)
    score = F.when(F.size(dist) > 0, F.array_max(F.map_values(dist))).otherwise(fallback)
    return (
        rows.withColumn("_wanted", wanted)
        .filter(F.col("_wanted") != "")
        .withColumn("citation", F.get(named, 0))
        .filter(F.col("citation").isNotNull())
        .select(
            "request_id",
            "claim_ordinal",
            "relation_ordinal",
            F.col("citation.marker").alias("marker"),
            F.col("citation.rid").alias("rid"),
            F.col("r.function").alias("function"),
            F.col("r.stance").alias("stance"),
            F.coalesce("r.scope", F.lit("whole_claim")).alias("scope"),
            F.bround(score, 3).alias("stance_score"),
        )
    )


def replay(requests: DataFrame, completions: DataFrame) -> DataFrame:
    """Prompts with their stored completion; a prompt without one abstains."""
    return requests.join(completions, "request_id").filter(F.col("completion") != "")


def prompt_manifest(requests: DataFrame) -> DataFrame:
    """Prompts per document, and in long form their ids in passage order."""
    return requests.groupBy("doc_id").agg(F.count("*").alias("prompt_count"), F.count_distinct("request_id").alias("distinct_ids"))
