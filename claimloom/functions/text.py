"""Sentences, tokens and the rule-based reading of a sentence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import strip
from .lexicons import (
    CLAIMWORTHY,
    CONTENT_STOPWORDS,
    SENTENCE_BOUNDARY,
    STANCE_ABSTAIN_THRESHOLD,
    STANCE_BASE,
    STANCE_CUE,
    TRAILING_MARKER,
    CueLexicon,
)

DEFAULT_LEXICON = CueLexicon()


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive, Unicode-aware search."""
    return text.rlike("(?iU)" + pattern)


def content_tokens(text: Column, stopwords: list[str] = CONTENT_STOPWORDS) -> Column:
    """Distinct lower-case ASCII tokens longer than two characters, stop words removed."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    long_enough = F.filter(tokens, lambda t: F.length(t) > 2)
    return F.array_except(long_enough, F.array(*[F.lit(w) for w in stopwords]))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two token sets, 0.0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / union)


def sentences_with_offsets(text: Column) -> Column:
    """Array of ``(offset, text)`` sentences of a stripped paragraph.

    Each piece keeps the white space in front of it, so piece lengths add up to the
    paragraph and give exact offsets.
    """
    pieces = F.split(text, "(?U)" + SENTENCE_BOUNDARY)
    starts = F.aggregate(
        pieces,
        F.array(F.lit(0)),
        lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))),
    )
    spans = F.zip_with(
        pieces,
        F.slice(starts, 1, F.size(pieces)),
        lambda p, s: F.struct(
            (s + F.length(p) - F.length(F.regexp_replace(p, r"(?U)^\s+", ""))).alias("offset"),
            strip(p).alias("text"),
        ),
    )
    return F.filter(spans, lambda s: s["text"] != "")


def normalize_claim(text: Column) -> Column:
    """Drop a trailing citation marker and collapse white space."""
    short = F.regexp_replace(strip(F.regexp_replace(text, "(?U)" + TRAILING_MARKER, "")), r"(?U)\s+", " ")
    return F.when(short != "", short).otherwise(strip(text))


def is_result(text: Column, lexicon: CueLexicon = DEFAULT_LEXICON) -> Column:
    return matches(text, lexicon.result)


def is_claimworthy(text: Column, pattern: str = CLAIMWORTHY) -> Column:
    return matches(text, pattern)


def occurrence_type(text: Column, section: Column, lexicon: CueLexicon = DEFAULT_LEXICON) -> Column:
    method = F.lower(F.coalesce(section, F.lit(""))).contains("method") | matches(text, lexicon.method)
    return (
        F.when(matches(text, lexicon.hypothesis), "hypothesis")
        .when(method, "method_description")
        .when(is_result(text, lexicon), "reported_result")
        .otherwise("background_assertion")
    )


def qualifiers(text: Column, lexicon: CueLexicon = DEFAULT_LEXICON) -> Column:
    """Negation, effect direction and certainty; the entity roles are abstained on."""
    negated = matches(text, lexicon.negation)
    up, down = matches(text, lexicon.increase), matches(text, lexicon.decrease)
    direction = (
        F.when(negated, "no_effect")
        .when(up & down, "mixed")
        .when(up, "increase")
        .when(down, "decrease")
        .otherwise("unclear")
    )
    certainty = (
        F.when(matches(text, lexicon.strong) | matches(text, lexicon.significant), "definite")
        .when(matches(text, lexicon.hedge), "possible")
        .otherwise("probable")
    )
    absent = F.lit(None).cast("string")
    return F.struct(
        direction.alias("effect_direction"),
        certainty.alias("certainty"),
        negated.alias("negated"),
        absent.alias("population"),
        absent.alias("intervention"),
        absent.alias("comparator"),
        absent.alias("outcome"),
    )


def citation_function(text: Column, section: Column, lexicon: CueLexicon = DEFAULT_LEXICON) -> Column:
    method = F.lower(F.coalesce(section, F.lit(""))).contains("method") | matches(text, lexicon.method)
    return (
        F.when(method, "method")
        .when(matches(text, lexicon.contrast) | matches(text, lexicon.comparison), "comparison")
        .when(matches(text, lexicon.support) | matches(text, lexicon.result), "direct_evidence")
        .otherwise("background")
    )


def stance_distribution(support_cue: Column, contrast_cue: Column, method_function: Column) -> Column:
    """Normalised weights of the three stances, three decimals."""
    cue = {"support": support_cue, "contradict": contrast_cue, "neutral": method_function}
    raw = {
        label: F.lit(STANCE_BASE[label]) + F.when(cue[label], STANCE_CUE[label]).otherwise(0.0)
        for label in STANCE_BASE
    }
    total = raw["support"] + raw["contradict"] + raw["neutral"]
    pairs = []
    for label, value in raw.items():
        pairs += [F.lit(label), F.bround(value / total, 3)]
    return F.create_map(*pairs)


def stance_of(distribution: Column) -> Column:
    """Strongest stance, ``unclear`` below the abstention threshold; the first wins ties."""
    s, c, n = (distribution[k] for k in ("support", "contradict", "neutral"))
    top = F.greatest(s, c, n)
    return (
        F.when(top < STANCE_ABSTAIN_THRESHOLD, "unclear")
        .when(s == top, "support")
        .when(c == top, "contradict")
        .otherwise("neutral")
    )


def stance_score(distribution: Column) -> Column:
    return F.array_max(F.map_values(distribution))


def normalize_marker(marker: Column) -> Column:
    """Citation marker without brackets or white space, lower-cased."""
    bare = F.regexp_replace(strip(F.coalesce(marker, F.lit(""))), r"^[\[\]()]+|[\[\]()]+$", "")
    return F.lower(F.regexp_replace(bare, r"(?U)\s+", ""))


def user_prompt(section: Column, markers: Column, text: Column) -> Column:
    """Prompt text of one passage; ``markers`` is an array of marker texts."""
    listed = F.array_join(F.sort_array(F.array_distinct(F.filter(markers, lambda m: m != ""))), ", ")
    return F.concat(
        F.lit("Section: "),
        F.when(section != "", section).otherwise("(unlabeled)"),
        F.lit("\nCitation markers present: "),
        F.when(listed != "", listed).otherwise("(none)"),
        F.lit("\n\n<passage>\n"),
        text,
        F.lit("\n</passage>"),
    )


def request_id(model: Column, template: Column, passage_index: Column, text: Column) -> Column:
    """Content-addressed id of a prompt."""
    digest = F.sha2(F.concat_ws("\u0000", template, model, text), 256)
    return F.concat(F.lit("p"), passage_index.cast("string"), F.lit("_"), F.substring(digest, 1, 16))
