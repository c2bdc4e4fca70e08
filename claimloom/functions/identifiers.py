"""Paper identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import DOI_PREFIXES, PAPER_ID_PREFIXES


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_doi(token: Column) -> Column:
    """Lower-case DOI of a raw token, or null when it is not DOI-shaped."""
    wrapper = "(?i)^(?:" + "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES) + ")"
    bare = F.regexp_replace(F.regexp_replace(strip(token), wrapper, ""), r"[.,;:]+$", "")
    return F.when(bare.rlike(r"(?U)^10\.\d{4,9}/\S+$"), F.lower(bare))


def pmid_from_token(token: Column) -> Column:
    """PubMed id of a raw token; bare numbers that look like a year are refused."""
    prefixed = F.regexp_extract(token, r"(?iU)^pmid:?\s*(\d{1,8})$", 1)
    year_like = token.rlike(r"^\d{4}$") & token.cast("int").between(1500, 2099)
    return F.when(prefixed != "", prefixed).when(token.rlike(r"^\d{1,8}$") & ~year_like, token)


def identifier_tokens(text: Column) -> Column:
    """Pasted text split on white space and commas, empty tokens dropped."""
    return F.filter(F.split(text, r"(?U)[\s,]+"), lambda t: t != "")


def identifier_kind(token: Column) -> Column:
    """``doi``, ``pmid``, ``ambiguous`` (a number that is refused as an id) or null."""
    return (
        F.when(normalize_doi(token).isNotNull(), "doi")
        .when(pmid_from_token(token).isNotNull(), "pmid")
        .when(token.rlike(r"(?U)^\d+$"), "ambiguous")
    )


def doi_in_text(text: Column) -> Column:
    """First DOI inside free text, lower-cased, trailing punctuation dropped."""
    found = F.regexp_extract(text, r"(?iU)10\.\d{4,9}/[^\s\"'{}<>,;]+", 0)
    return F.when(found != "", F.lower(F.regexp_replace(found, r"[.,;:]+$", "")))


def pmid_in_url(text: Column) -> Column:
    """PubMed id embedded in a URL."""
    found = F.regexp_extract(text, r"(?i)(?:pubmed\.ncbi\.nlm\.nih\.gov/|/pubmed/)(\d{1,8})", 1)
    return F.when(found != "", found)


def normalize_paper_id(raw: Column) -> Column:
    """Prefix casing made canonical; null for an empty id, an unknown prefix or no value."""
    value = strip(raw)
    prefix = F.upper(F.substring_index(value, ":", 1))
    rest = F.regexp_replace(value, r"^[^:]*:", "")
    canonical = F.when(prefix == "CORPUSID", "CorpusId").otherwise(prefix)
    prefixed = F.when(
        prefix.isin(*PAPER_ID_PREFIXES) & (rest != ""), F.concat(canonical, F.lit(":"), rest)
    )
    return F.when(value == "", None).when(value.contains(":"), prefixed).otherwise(value)


def normalize_pmcid(raw: Column) -> Column:
    """Bare number of ``PMC123`` / ``pmc123`` / ``123``, else null."""
    number = F.regexp_extract(F.upper(strip(raw)), r"^(?:PMC)?(\d+)$", 1)
    return F.when(number != "", number)


_LABELS = {"corpus": "CorpusId", "doi": "DOI", "pmid": "PMID"}


def best_external_id(
    priority: tuple[str, ...] = ("corpus", "doi", "pmid"),
    corpus: Column | None = None,
    doi: Column | None = None,
    pmid: Column | None = None,
) -> Column:
    """First non-empty identifier in ``priority`` order, with its prefix.

    The order differs between uses: corpus-first for discovery and snowballing,
    doi-first for per-paper metadata.
    """
    given = {"corpus": corpus, "doi": doi, "pmid": pmid}
    parts = [
        F.when(given[k] != "", F.concat(F.lit(f"{_LABELS[k]}:"), given[k]))
        for k in priority
        if given[k] is not None
    ]
    return F.coalesce(*parts)


def link_key(corpus: Column, doi: Column, pmid: Column) -> Column:
    """Dedup key of a reference link; null when it carries no identifier."""
    return F.coalesce(
        F.when(corpus != "", F.concat(F.lit("cited_corpus_id:"), corpus)),
        F.when(doi != "", F.concat(F.lit("cited_doi:"), doi)),
        F.when(pmid != "", F.concat(F.lit("cited_pmid:"), pmid)),
    )


def author_key(name: Column) -> Column:
    """Case-insensitive key of an author name (``lower``; ß is kept as is)."""
    return F.lower(strip(name))


def author_node_id(name: Column) -> Column:
    return F.concat(F.lit("author_"), F.substring(F.sha1(author_key(name)), 1, 16))


def derived_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id of a derived row: reruns and retried tasks produce the same one."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def safe_document_id(raw: Column) -> Column:
    """An id usable as a file name; ``doc`` when nothing usable is left."""
    cleaned = F.regexp_replace(strip(raw), r"[^A-Za-z0-9._-]+", "_")
    bare = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.when(bare != "", bare).otherwise("doc")
