"""Word lists, cue patterns, lookup tables and thresholds.

Results depend on these exact values; callers may pass their own instead.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: stop words ---------------------------------------------------------
EVALUATION_STOPWORDS = (
    "the a an of in on and or to for with was "
    "were is are be been that this these those we "
    "our by as at from not no than which it its"
).split()
CONTENT_STOPWORDS = EVALUATION_STOPWORDS + (
    "significantly significant study results showed found"
).split()

# --- fixed values: cue patterns (case-insensitive, Unicode word boundaries) ------------


@dataclass(frozen=True)
class CueLexicon:
    """Patterns that drive the rule-based reading of a sentence."""

    result: str = (
        r"\b(significant(?:ly)?|increased?|decreased?|reduced?|elevated|higher|lower|"
        r"greater|fewer|associated with|correlat(?:ed|ion)|improved|risk|odds ratio|"
        r"hazard ratio|p\s*[<=]|more likely|less likely)\b"
    )
    increase: str = (
        r"\b(increased?|elevated|higher|greater|more likely|improved|rose|upregulat)\b"
    )
    decrease: str = (
        r"\b(decreased?|reduced?|lower|fewer|less likely|declin|downregulat|suppress)\b"
    )
    negation: str = (
        r"\b(no significant|not significant|did not|no difference|no effect|failed to|"
        r"unable to|no association)\b"
    )
    hypothesis: str = r"\b(we hypothesi[sz]e|we propose|it is possible that|we predict)\b"
    hedge: str = r"\b(may|might|could|suggests?|possibly|potentially|appears? to)\b"
    strong: str = r"\b(demonstrate[sd]?|show(?:ed|s)?|establish(?:ed)?|confirm(?:ed|s)?)\b"
    significant: str = r"\bsignificant"
    method: str = (
        r"\b(as described|using the|following the|protocol|method of|according to|"
        r"we used|were performed as)\b"
    )
    contrast: str = (
        r"\b(in contrast|however|unlike|contrary to|differs? from|whereas|"
        r"did not replicate|inconsistent with)\b"
    )
    support: str = (
        r"\b(consistent with|in agreement|agreement with|confirm(?:s|ed)?|corroborat|"
        r"support(?:s|ed|ing)?|in line with|as reported|as (?:previously )?shown|"
        r"replicat|similar to those|extends? (?:the )?finding)\b"
    )
    comparison: str = (
        r"\b(compared (?:to|with)|relative to|versus|vs\.?|than (?:in|those))\b"
    )


#: Sentences worth a model prompt.
CLAIMWORTHY = (
    r"\b(significant|increased?|decreased?|reduced?|elevated|higher|lower|greater|"
    r"associated|correlat|improved|risk|ratio|p\s*[<=]|effect|compared|versus|vs)\b"
)
TRAILING_MARKER = r"\s*[\[(]?\b\d{1,3}\b[\])]?(?:\s*[-,]\s*\d{1,3})?\s*$"
SENTENCE_BOUNDARY = r"(?<=[.!?])(?=\s+[A-Z(\[])"

# --- fixed values: thresholds ----------------------------------------------------------
CLAIM_RESOLVE_THRESHOLD = 0.18
CANDIDATE_FLOOR = 0.05
MAX_CANDIDATES = 3
CLUSTER_THRESHOLD = 0.34
ALIGN_THRESHOLD = 0.3
STANCE_ABSTAIN_THRESHOLD = 0.5
EMBEDDING_GATE_THRESHOLD = 0.5
MENTION_CONFIDENCE = 0.95
COVERAGES = (0.25, 0.5, 0.75, 1.0)
CERTAINTY_SCORES = {"definite": 0.9, "probable": 0.7, "possible": 0.5, "speculative": 0.3}
#: Base weights of the stance distribution and what each cue adds.
STANCE_BASE = {"support": 0.15, "contradict": 0.1, "neutral": 0.3}
STANCE_CUE = {"support": 0.6, "contradict": 0.6, "neutral": 0.4}

# --- fixed values: enumerations --------------------------------------------------------
OCCURRENCE_TYPES = (
    "reported_result", "background_assertion", "method_description", "hypothesis", "other",
)
EFFECT_DIRECTIONS = ("increase", "decrease", "no_effect", "mixed", "unclear")
CERTAINTIES = ("definite", "probable", "possible", "speculative")
FUNCTIONS = ("background", "method", "direct_evidence", "comparison", "other")
STANCES = ("support", "contradict", "neutral", "unclear")
SCOPES = ("whole_claim", "partial_claim", "paper_level_only")
RESOLUTIONS = ("claim_resolved", "paper_resolved", "unresolved")
ENTITY_ROLES = ("intervention", "comparator", "outcome", "population")

# --- fixed values: identifiers ---------------------------------------------------------
DOI_PREFIXES = (
    "doi:",
    "https://doi.org/",
    "http://doi.org/",
    "https://dx.doi.org/",
    "http://dx.doi.org/",
)
#: Prefixes a paper id may carry; all are upper-cased except CorpusId.
PAPER_ID_PREFIXES = (
    "DOI", "PMID", "PMCID", "CORPUSID", "ARXIV", "MAG", "ACL", "URL",
)

# --- fixed values: editorial updates ---------------------------------------------------
RETRACTION_TYPES = ("retraction", "removal", "withdrawal")
NOTICE_TYPES = (
    "expression_of_concern", "concern", "correction", "corrigendum", "erratum",
    "addendum", "clarification", "partial_retraction", "new_edition", "new_version",
)

# --- fixed values: countries -----------------------------------------------------------
COUNTRY_ALIASES = {
    "usa": "United States",
    "u.s.a.": "United States",
    "u.s.": "United States",
    "united states of america": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "england": "United Kingdom",
    "scotland": "United Kingdom",
    "wales": "United Kingdom",
    "northern ireland": "United Kingdom",
    "south korea": "South Korea",
    "republic of korea": "South Korea",
    "korea": "South Korea",
    "prc": "China",
    "p.r. china": "China",
    "p.r.china": "China",
    "russia": "Russia",
    "russian federation": "Russia",
}
COUNTRIES = (
    "united states", "united kingdom", "china", "germany", "france", "japan", "canada",
    "australia", "italy", "spain", "netherlands", "switzerland", "sweden", "india",
    "brazil", "south korea", "russia", "belgium", "denmark", "norway", "finland",
    "austria", "poland", "portugal", "greece", "ireland", "israel", "turkey", "mexico",
    "argentina", "chile", "south africa", "egypt", "saudi arabia", "iran", "singapore",
    "new zealand", "taiwan", "hong kong", "czech republic", "hungary", "romania",
    "thailand", "malaysia", "indonesia", "pakistan", "colombia",
)

# --- fixed values: BibTeX blocks that are no entries -------------------------------------
BIBTEX_NOT_ENTRIES = ("comment", "string", "preamble")
