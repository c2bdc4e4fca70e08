"""Identifier resolution, additive enrichment, bulk backfill and member intake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import (
    derived_id,
    identifier_kind,
    identifier_tokens,
    normalize_doi,
    pmid_from_token,
)
from ..functions.values import integrity_flags, is_blank, names_of
from ..plans.lineage import stage
from ..plans.skew import spread_nulls

#: Work column behind each kind of identifier.
WORK_KEYS = {"corpus": "s2_corpus_id", "doi": "doi", "pmid": "pmid"}
BACKFILL_PRIORITY = ("corpus", "doi", "pmid")
INGEST_PRIORITY = ("doi", "pmid")
METADATA_PRIORITY = ("doi", "pmid", "corpus")


def _keyed(kind: str, value: Column, fold_doi: bool) -> Column:
    text = value.cast("string")
    return F.concat(F.lit(kind + ":"), F.lower(text) if kind == "doi" and fold_doi else text)


def identifier_map(works: DataFrame, priority: tuple[str, ...], fold_doi: bool = True) -> DataFrame:
    """``(key, work_id)`` over all identifiers of all works; the smallest id wins a tie."""
    keys = F.array(
        *[
            F.when(F.col(WORK_KEYS[k]) != "", _keyed(k, F.col(WORK_KEYS[k]), fold_doi))
            for k in priority
        ]
    )
    return (
        works.select("work_id", F.explode(F.array_compact(keys)).alias("key"))
        .groupBy("key")
        .agg(F.min("work_id").alias("work_id"))
    )


def resolve(
    records: DataFrame,
    record_id: str,
    keys: dict[str, Column],
    works: DataFrame,
    priority: tuple[str, ...] = BACKFILL_PRIORITY,
    fold_doi: bool = True,
) -> DataFrame:
    """Matched records with the ``work_id`` found under the first identifier that matches.

    The identifiers are unpivoted, so it takes one equi join however many kinds there are.
    With few works the map is broadcast and only matches are ever shuffled.
    """
    candidates = F.array(
        *[
            F.when(
                keys[k].isNotNull() & (keys[k].cast("string") != ""),
                F.struct(F.lit(i).alias("rank"), _keyed(k, keys[k], fold_doi).alias("key")),
            )
            for i, k in enumerate(priority)
            if k in keys
        ]
    )
    exploded = records.withColumn("_c", F.explode(F.array_compact(candidates))).select(
        *records.columns, F.col("_c.rank").alias("_rank"), F.col("_c.key").alias("_key")
    )
    known = identifier_map(works, priority, fold_doi).withColumnRenamed("key", "_key")
    found = exploded.join(known, "_key").drop("_key")
    return (
        found.groupBy(record_id)
        .agg(F.min_by(F.struct(*[c for c in found.columns if c not in (record_id, "_rank")]), "_rank").alias("_m"))
        .select(record_id, "_m.*")
    )


# --- additive fills -----------------------------------------------------------------------------


def fill_nulls(works: DataFrame, values: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Set each field only where the work has none and ``values`` has one.

    ``fields`` maps a column to its kind (``scalar``, ``array`` or ``number``). Adds a
    ``filled`` array naming what changed.
    """
    offered = values.select("work_id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = works.join(offered, "work_id", "left")
    takes = {
        c: is_blank(F.col(c), kind) & ~is_blank(F.col(f"_new_{c}"), kind) for c, kind in fields.items()
    }
    filled = F.array_compact(F.array(*[F.when(takes[c], F.lit(c)) for c in fields]))
    return joined.withColumn("filled", filled).withColumns(
        {c: F.when(takes[c], F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields}
    ).drop(*[f"_new_{c}" for c in fields])


def first_values(matched: DataFrame, position: str, fields: dict[str, str]) -> DataFrame:
    """First usable value per work and field in record order."""
    picks = [
        F.min(F.when(~is_blank(F.col(c), kind), F.struct(position, c)))[c].alias(c)
        for c, kind in fields.items()
    ]
    return matched.groupBy("work_id").agg(*picks)


BIBLIOGRAPHIC_FIELDS = {
    "s2_corpus_id": "scalar",
    "doi": "scalar",
    "pmid": "scalar",
    "title": "scalar",
    "authors": "array",
    "venue": "scalar",
    "year": "number",
}


def backfill_papers(works: DataFrame, records: DataFrame) -> DataFrame:
    """Fill bibliographic gaps from bulk paper records.

    ``records``: record_id (order of the scan), corpusid, externalids(DOI, PubMed), title,
    authors(array of name structs), venue, year. Writing or not is the caller's choice, so a
    dry run is simply not writing; ``filled`` tells what would change.
    """
    ext = F.col("externalids")
    keys = {"corpus": F.col("corpusid"), "doi": ext["DOI"], "pmid": ext["PubMed"]}
    shaped = records.select(
        "record_id",
        F.col("corpusid").cast("string").alias("s2_corpus_id"),
        ext["DOI"].alias("doi"),
        ext["PubMed"].cast("string").alias("pmid"),
        "title",
        names_of(F.col("authors")).alias("authors"),
        "venue",
        "year",
    )
    keys = {"corpus": F.col("s2_corpus_id"), "doi": F.col("doi"), "pmid": F.col("pmid")}
    matched = resolve(shaped, "record_id", keys, works)
    return fill_nulls(works, first_values(matched, "record_id", BIBLIOGRAPHIC_FIELDS), BIBLIOGRAPHIC_FIELDS)


def backfill_text(works: DataFrame, records: DataFrame, record_field: str, work_field: str) -> DataFrame:
    """Fill one text column (tldr or abstract) by corpus id."""
    shaped = records.select(
        "record_id", F.col("corpusid").cast("string").alias("corpus"), F.col(record_field).alias(work_field)
    )
    matched = resolve(shaped, "record_id", {"corpus": F.col("corpus")}, works, ("corpus",))
    fields = {work_field: "scalar"}
    return fill_nulls(works, first_values(matched, "record_id", fields), fields)


def edges_between_known(works: DataFrame, citations: DataFrame) -> DataFrame:
    """Bulk citation records whose two ends are known works, without self-citations."""
    ids = works.filter(F.col("s2_corpus_id") != "").groupBy(F.col("s2_corpus_id").alias("c")).agg(F.min("work_id").alias("w"))
    citing = ids.select(F.col("c").alias("_citing"), F.col("w").alias("citing_work_id"))
    cited = ids.select(F.col("c").alias("_cited"), F.col("w").alias("cited_work_id"))
    return (
        citations.withColumn("_citing", F.col("citingcorpusid").cast("string"))
        .withColumn("_cited", F.col("citedcorpusid").cast("string"))
        .join(citing, "_citing")
        .join(cited, "_cited")
        .filter("citing_work_id <> cited_work_id")
        .select("citing_work_id", "cited_work_id", "isinfluential", "intents", "contexts")
    )


def new_edges(existing: DataFrame, offered: DataFrame, source: str) -> DataFrame:
    """Offered edges not yet present under ``source``, one row per pair."""
    known = existing.filter(F.col("source") == source).select("citing_work_id", "cited_work_id")
    return (
        offered.join(known, ["citing_work_id", "cited_work_id"], "left_anti")
        .dropDuplicates(["citing_work_id", "cited_work_id"])
        .withColumn("source", F.lit(source))
    )


def fill_report(before_after: DataFrame) -> DataFrame:
    """How many works got each field."""
    return before_after.select(F.explode("filled").alias("field")).groupBy("field").agg(
        F.count("*").alias("works_filled")
    )


#: Passes in the order they must run; later ones match on what earlier ones filled.
BACKFILL_PASSES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "papers": backfill_papers,
    "tldrs": lambda works, records: backfill_text(works, records, "text", "tldr"),
    "abstracts": lambda works, records: backfill_text(works, records, "abstract", "abstract"),
}


def backfill(works: DataFrame, datasets: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Run the wanted passes in order; returns the works and one report per pass."""
    unknown = set(datasets) - set(BACKFILL_PASSES) - {"citations"}
    if unknown:
        raise ValueError(f"unknown datasets: {sorted(unknown)}")
    reports: dict[str, DataFrame] = {}
    for name, run in BACKFILL_PASSES.items():
        if name in datasets:
            result = run(works, datasets[name])
            reports[name] = fill_report(result)
            works = result.drop("filled")
    if "citations" in datasets:
        reports["citations"] = edges_between_known(works, datasets["citations"])
    return works, reports


def enrich_from_snapshot(works: DataFrame, papers: DataFrame) -> DataFrame:
    """Per-paper metadata fill from a snapshot; works with an abstract are complete.

    ``papers``: record_id, corpus_id, doi, pmid, title, authors, venue, year, tldr, abstract.
    """
    fields = {**BIBLIOGRAPHIC_FIELDS, "tldr": "scalar", "abstract": "scalar"}
    todo = works.filter(is_blank(F.col("abstract")))
    shaped = papers.withColumnRenamed("corpus_id", "s2_corpus_id").select("record_id", *fields)
    keys = {"corpus": F.col("s2_corpus_id"), "doi": F.col("doi"), "pmid": F.col("pmid")}
    matched = resolve(shaped, "record_id", keys, todo, METADATA_PRIORITY)
    return fill_nulls(works, first_values(matched, "record_id", fields), fields)


def check_integrity(works: DataFrame, messages: DataFrame, only_unchecked: bool = False) -> DataFrame:
    """Retraction flags for works with a DOI from editorial records keyed by DOI.

    A work without a record keeps its flags and is marked checked. ``changed`` compares
    null-safely.
    """
    todo = works.filter(F.col("doi") != "")
    if only_unchecked:
        todo = todo.filter(F.col("is_retracted").isNull())
    flags = messages.select(
        normalize_doi(F.col("doi")).alias("_doi"),
        integrity_flags(F.col("update_to"), F.col("title")).alias("f"),
    ).filter(F.col("_doi").isNotNull())
    # one record of a retraction is enough; a retraction's notice goes before others, then by text
    notice = F.min(F.when(F.col("f.notice").isNotNull(), F.struct((~F.col("f.is_retracted")).alias("later"), F.col("f.notice").alias("notice"))))
    flags = flags.groupBy("_doi").agg(
        F.struct(F.bool_or("f.is_retracted").alias("is_retracted"), notice["notice"].alias("notice")).alias("f")
    )
    joined = todo.withColumn("_doi", F.lower("doi")).join(flags, "_doi", "left")
    seen = F.col("f").isNotNull()
    return joined.select(
        "work_id",
        "doi",
        F.lit(True).alias("checked"),
        F.when(seen, F.col("f.is_retracted")).otherwise(F.col("is_retracted")).alias("is_retracted"),
        F.when(seen, F.col("f.notice")).otherwise(F.col("integrity_notice")).alias("integrity_notice"),
        (
            seen
            & ~(
                F.col("is_retracted").eqNullSafe(F.col("f.is_retracted"))
                & F.col("integrity_notice").eqNullSafe(F.col("f.notice"))
            )
        ).alias("changed"),
        F.when(~seen, "no record").alias("skipped_reason"),
    )


def attach_reference_metadata(
    mentions: DataFrame, cited_works: DataFrame, links: DataFrame, provider: str = "s2"
) -> DataFrame:
    """Intents, contexts and influence of the matching reference on each mention.

    ``mentions``: mention_id, citing_work_id, cited_work_id. ``links``: citing_work_id,
    position, cited_doi/pmid/corpus_id, intents, contexts, is_influential. Matching happens
    once per (citing, cited) pair; a repeated identifier keeps its last link.
    """

    def keys(doi: str, pmid: str, corpus: str) -> Column:
        named = [("doi", doi), ("pmid", pmid), ("corpus", corpus)]
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(c) != "",
                        F.struct(F.lit(i).alias("rank"), F.concat(F.lit(k + ":"), F.col(c)).alias("key")),
                    )
                    for i, (k, c) in enumerate(named)
                ]
            )
        )

    payload = F.struct("intents", "contexts", "is_influential")
    by_key = (
        links.withColumn("c", F.explode(keys("cited_doi", "cited_pmid", "cited_corpus_id")))
        .groupBy("citing_work_id", F.col("c.key").alias("key"))
        .agg(F.max_by(payload, "position").alias("link"))
    )
    pairs = (
        mentions.filter(F.col("cited_work_id").isNotNull())
        .select("citing_work_id", "cited_work_id")
        .distinct()
        .join(cited_works.select(F.col("work_id").alias("cited_work_id"), "doi", "pmid", "s2_corpus_id"), "cited_work_id")
        .withColumn("c", F.explode(keys("doi", "pmid", "s2_corpus_id")))
        .select("citing_work_id", "cited_work_id", F.col("c.rank").alias("rank"), F.col("c.key").alias("key"))
    )
    best = (
        pairs.join(by_key, ["citing_work_id", "key"])
        .groupBy("citing_work_id", "cited_work_id")
        .agg(F.min_by("link", "rank").alias("link"))
    )
    return mentions.join(best, ["citing_work_id", "cited_work_id"]).select(
        "mention_id",
        F.lit(provider).alias("provider"),
        F.col("link.intents").alias("s2_intents"),
        F.col("link.contexts").alias("contexts"),
        F.coalesce("link.is_influential", F.lit(False)).alias("is_influential"),
    )


# --- member intake ------------------------------------------------------------------------------------


def pasted_identifiers(requests: DataFrame, text: str = "csv_text") -> DataFrame:
    """One row per distinct identifier of a pasted text, with its kind and value.

    Kinds are ``doi``, ``pmid`` and ``ambiguous``; other words are dropped, as are repeats
    (the first position is kept).
    """
    tokens = requests.select("set_id", F.posexplode(identifier_tokens(F.col(text))).alias("position", "token"))
    token = F.col("token")
    kind = identifier_kind(token)
    value = F.when(kind == "doi", normalize_doi(token)).when(kind == "pmid", pmid_from_token(token)).otherwise(token)
    return (
        tokens.select("set_id", "position", kind.alias("kind"), value.alias("value"))
        .filter(F.col("kind").isNotNull())
        .groupBy("set_id", "kind", "value")
        .agg(F.min("position").alias("position"))
    )


def intake_members(identifiers: DataFrame, works: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Resolve identifiers to works, create stubs for unknown ones, add absent members.

    Returns ``stubs``, ``added`` (absent memberships) and ``skipped`` (ambiguous tokens).
    """
    usable = identifiers.filter(F.col("kind").isin("doi", "pmid"))
    distinct = usable.select("kind", "value").distinct().withColumn(
        "record_id", F.concat_ws(":", "kind", "value")
    )
    keys = {
        "doi": F.when(F.col("kind") == "doi", F.col("value")),
        "pmid": F.when(F.col("kind") == "pmid", F.col("value")),
    }
    known = resolve(distinct, "record_id", keys, works, INGEST_PRIORITY).select("record_id", "work_id")
    stubs = distinct.join(known, "record_id", "left_anti").select(
        "record_id",
        derived_id("work", F.col("kind"), F.col("value")).alias("work_id"),
        F.when(F.col("kind") == "doi", F.col("value")).alias("doi"),
        F.when(F.col("kind") == "pmid", F.col("value")).alias("pmid"),
        F.lit("metadata_stub").alias("availability_state"),
    )
    target = known.unionByName(stubs.select("record_id", "work_id"))
    added = (
        usable.withColumn("record_id", F.concat_ws(":", "kind", "value"))
        .join(target, "record_id")
        .select("set_id", "work_id")
        .distinct()
        .join(members.select("set_id", "work_id"), ["set_id", "work_id"], "left_anti")
    )
    return {
        "stubs": stubs.drop("record_id"),
        "added": added,
        "skipped": identifiers.filter(F.col("kind") == "ambiguous").select("set_id", "value"),
    }


def remove_members(members: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining, removed) members; unknown ids are ignored. Members are made and matched once."""
    on = ["set_id", "work_id"]
    wanted = removals.select(*on).distinct().withColumn("_gone", F.lit(True))
    matched = stage(members.join(wanted, on, "left").select(*members.columns, F.col("_gone").isNotNull().alias("_gone")), "members")
    return matched.filter("not _gone").drop("_gone"), matched.filter("_gone").drop("_gone")


def stub_works(links: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve reference links to works, creating one metadata stub per unknown link key.

    Returns (links with ``cited_work_id``, stubs). Links without an identifier are dropped.
    """
    from ..functions.identifiers import link_key

    keyed = links.withColumn(
        "link_key", link_key(F.col("cited_corpus_id"), F.col("cited_doi"), F.col("cited_pmid"))
    ).filter(F.col("link_key").isNotNull())
    order = F.struct("citing_work_id", "position")
    unique = keyed.groupBy("link_key").agg(
        *[
            F.min_by(c, order).alias(c)
            for c in ("cited_corpus_id", "cited_doi", "cited_pmid")
        ],
        *[
            F.min(F.when(F.col(c).isNotNull(), F.struct("citing_work_id", "position", c)))[c].alias(c)
            for c in ("cited_title", "cited_year")
        ],
    )
    keys = {"corpus": F.col("cited_corpus_id"), "doi": F.col("cited_doi"), "pmid": F.col("cited_pmid")}
    known = resolve(unique, "link_key", keys, works, fold_doi=False).select("link_key", "work_id")
    stubs = unique.join(known, "link_key", "left_anti").select(
        "link_key",
        derived_id("work", F.col("link_key")).alias("work_id"),
        F.col("cited_title").alias("title"),
        F.col("cited_year").alias("year"),
        F.col("cited_corpus_id").alias("s2_corpus_id"),
        F.col("cited_doi").alias("doi"),
        F.col("cited_pmid").alias("pmid"),
        F.lit("metadata_stub").alias("availability_state"),
    )
    target = known.unionByName(stubs.select("link_key", "work_id")).withColumnRenamed("work_id", "cited_work_id")
    return keyed.join(target, "link_key").drop("link_key"), stubs.drop("link_key")
