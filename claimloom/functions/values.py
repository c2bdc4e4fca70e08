"""Scores, vectors, countries, editorial updates and knowledge sources as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import strip
from .lexicons import (
    CERTAINTY_SCORES,
    COUNTRIES,
    COUNTRY_ALIASES,
    ENTITY_ROLES,
    NOTICE_TYPES,
    RETRACTION_TYPES,
)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 when the denominator is 0 or nothing was counted."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def harmonic_mean(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def precision_recall_f1(tp: Column, fp: Column, fn: Column, digits: int = 4) -> list[Column]:
    """Zero-safe precision, recall and F1 columns."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [
        F.bround(p, digits).alias("precision"),
        F.bround(r, digits).alias("recall"),
        F.bround(harmonic_mean(p, r), digits).alias("f1"),
    ]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 for empty, unequal or zero vectors."""

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)

    def times(x: Column, y: Column) -> Column:
        return x.cast("double") * y.cast("double")

    dot = total(F.zip_with(a, b, times))
    norm_a = F.sqrt(total(F.transform(a, lambda x: times(x, x))))
    norm_b = F.sqrt(total(F.transform(b, lambda x: times(x, x))))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm_a != 0) & (norm_b != 0)
    return F.when(usable, dot / (norm_a * norm_b)).otherwise(F.lit(0.0))


def country_table(
    aliases: dict[str, str] = COUNTRY_ALIASES, lexicon: tuple[str, ...] = COUNTRIES
) -> dict[str, str]:
    """Segment text to country name; an alias wins over the lexicon."""
    names = {c: " ".join(w.capitalize() for w in c.split()) for c in lexicon}
    return {**names, **aliases}


def parse_country(affiliation: Column, table: dict[str, str] | None = None) -> Column:
    """Country of an affiliation: comma segments tried from last to first."""
    pairs = []
    for key, name in (table or country_table()).items():
        pairs += [F.lit(key), F.lit(name)]
    lookup = F.create_map(*pairs)
    segments = F.transform(
        F.reverse(F.split(affiliation, ",")),
        lambda s: lookup[F.regexp_replace(F.lower(strip(s)), r"\.+$", "")],
    )
    found = F.filter(segments, lambda c: c.isNotNull())
    return F.when(F.size(found) > 0, found[0])


def certainty_score(certainty: Column) -> Column:
    pairs = []
    for key, score in CERTAINTY_SCORES.items():
        pairs += [F.lit(key), F.lit(score)]
    return F.create_map(*pairs)[certainty]


def integrity_flags(update_to: Column, titles: Column) -> Column:
    """``(is_retracted, notice)`` from editorial updates and, failing those, the title.

    ``update_to`` is an array of ``(type, label)``; ``titles`` an array of strings.
    """
    kind = lambda u: F.lower(strip(F.coalesce(u["type"], F.lit(""))))
    known = F.filter(update_to, lambda u: kind(u).isin(*RETRACTION_TYPES, *NOTICE_TYPES))
    retracted = F.coalesce(
        F.exists(update_to, lambda u: kind(u).isin(*RETRACTION_TYPES)), F.lit(False)
    )
    labels = F.transform(
        known, lambda u: F.coalesce(F.when(u["label"] != "", u["label"]), u["type"])
    )
    named = F.filter(labels, lambda v: v.isNotNull() & (v != ""))
    label = F.when(F.size(named) > 0, named[0])
    by_title = ~retracted & F.coalesce(
        F.exists(titles, lambda t: F.lower(strip(t)).startswith("retracted")), F.lit(False)
    )
    return F.struct(
        (retracted | by_title).alias("is_retracted"),
        F.coalesce(label, F.when(by_title, "Retracted")).alias("notice"),
    )


def knowledge_sources(sources: Column) -> Column:
    """Split edge sources into the primary one and the aggregators."""
    primary = F.filter(sources, lambda s: s["resource_role"] == "primary_knowledge_source")
    aggregators = F.filter(
        sources,
        lambda s: (s["resource_role"] == "aggregator_knowledge_source") & (s["resource_id"] != ""),
    )
    return F.struct(
        F.when(F.size(primary) > 0, F.element_at(primary, -1)["resource_id"]).alias(
            "primary_knowledge_source"
        ),
        F.transform(F.coalesce(aggregators, F.array()), lambda s: s["resource_id"]).alias(
            "aggregator_knowledge_source"
        ),
    )


def predicate_label(predicate: Column) -> Column:
    """Readable edge label: the part after the prefix, underscores as blanks."""
    return F.when(
        predicate != "", F.replace(F.regexp_replace(predicate, r"^[^:]*:", ""), F.lit("_"), F.lit(" "))
    )


def entity_terms(qualifiers: Column) -> Column:
    """Array of ``(role, term)`` for the entity qualifiers that are not blank."""
    terms = F.array(
        *[
            F.struct(F.lit(role).alias("role"), strip(qualifiers[role]).alias("term"))
            for role in ENTITY_ROLES
        ]
    )
    return F.filter(terms, lambda t: t["term"] != "")


def is_blank(value: Column, kind: str = "scalar") -> Column:
    """Missing in the sense of additive fills: null, '', an empty array or 0."""
    if kind == "array":
        return value.isNull() | (F.size(value) == 0)
    if kind == "number":
        return value.isNull() | (value == 0)
    return value.isNull() | (value == "")


def names_of(authors: Column) -> Column:
    """Non-empty names of an array of author records."""
    return F.filter(F.transform(authors, lambda a: a["name"]), lambda n: n != "")
