"""Evidence tables derived from the given test tables, so every operator runs at any scale.

Orders and parts play works, line items play citing claims, customers play saved sets,
documents play full text, events play revisions and claim streams. All rules are
aggregations, equi joins or per-row expressions; none needs an ordered window.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_tokens, sentences_with_offsets

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

LINE_KEY = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_quantity) as bigint), "
    "cast(round(l_extendedprice * 100) as bigint), cast(round(l_discount * 100) as bigint), "
    "cast(round(l_tax * 100) as bigint), l_returnflag, l_linestatus, date_format(l_shipdate, 'yyyyMMdd'))"
)
#: Country texts the supplier nations stand for; blanks and unknown ones included.
NATION_COUNTRIES = (
    "USA|Germany|UK|France|Korea|China|Atlantis|Japan|england|Canada.|Australia|Italy|Spain||Brazil|"
    "India|PRC|Sweden|Norway|Denmark|South Africa|Russian Federation|Mexico|Chile|U.S.A."
).split("|")


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str, key: str) -> DataFrame:
        """A text table split over all cores even when its file is one row group.

        Text costs far more to read than to move; a table with enough partitions of its own
        is left as it is.
        """
        table = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


# --- works, authors, affiliations, edges ------------------------------------------------


def order_works(t: Tables) -> DataFrame:
    buyers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey", "concat(n_name, '/', c_mktsegment) as venue"
    )
    return t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "concat('O', o_orderkey) as work_id",
        "concat('Order ', o_orderkey) as title",
        "venue",
        "cast(year(o_orderdate) as int) as year",
        "concat('10.5555/o', o_orderkey) as doi",
        "o_orderstatus = 'P' as is_retracted",
    )


def part_works(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "concat('P', p_partkey) as work_id",
        "p_name as title",
        "cast(null as string) as venue",
        "cast(null as int) as year",
        "concat('10.5555/p', p_partkey) as doi",
        "p_size = 13 as is_retracted",
    )


def all_works(t: Tables) -> DataFrame:
    return order_works(t).unionByName(part_works(t))


def authorships(t: Tables) -> DataFrame:
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "concat('O', l_orderkey) as work_id", "s_name as author"
    )


def affiliations(t: Tables) -> DataFrame:
    names = "array(" + ", ".join(f"'{c}'" for c in NATION_COUNTRIES) + ")"
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "concat('O', l_orderkey) as work_id",
        f"concat('Dept ', s_suppkey, ', Univ ', s_nationkey, ', ', {names}[s_nationkey % 25]) as affiliation",
    )


def extracted_edges(t: Tables) -> DataFrame:
    """Order to the earliest order that holds the same part."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_partkey", "o_orderdate"
    )
    first = lines.groupBy("l_partkey").agg(
        F.min(F.struct("o_orderdate", "l_orderkey"))["l_orderkey"].alias("first_order")
    )
    return (
        t.lineitem.select("l_orderkey", "l_partkey")
        .join(first, "l_partkey")
        .filter("l_orderkey <> first_order")
        .selectExpr(
            "concat('O', l_orderkey) as citing_work_id",
            "concat('O', first_order) as cited_work_id",
            "'extracted' as source",
            "cast(null as boolean) as is_influential",
        )
        .distinct()
    )


def bibliographic_edges(t: Tables) -> DataFrame:
    """Order to the first order of its customer in the same and the two previous years."""
    orders = t.orders.selectExpr(
        "o_orderkey", "o_custkey", "year(o_orderdate) as y", "o_orderdate",
        "case when o_orderpriority = '1-URGENT' then true "
        "when o_orderpriority = '5-LOW' then null else false end as is_influential",
    )
    anchors = orders.groupBy("o_custkey", "y").agg(
        F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("anchor")
    )
    return (
        orders.withColumn("y", F.explode(F.array(F.col("y"), F.col("y") - 1, F.col("y") - 2)))
        .join(anchors, ["o_custkey", "y"])
        .filter("o_orderkey <> anchor")
        .selectExpr(
            "concat('O', o_orderkey) as citing_work_id",
            "concat('O', anchor) as cited_work_id",
            "'bibliographic' as source",
            "is_influential",
        )
    )


def edge_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    return extracted_edges(t), bibliographic_edges(t)


def reference_links(t: Tables) -> DataFrame:
    """Reference list of every order, with position, identifiers, title and year."""
    cited = t.orders.selectExpr(
        "concat('O', o_orderkey) as cited_work_id",
        "case when o_orderkey % 3 <> 0 then cast(o_orderkey as string) end as cited_corpus_id",
        "case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then concat('10.5555/o', o_orderkey) end as cited_doi",
        "case when o_orderkey % 3 = 0 and o_orderkey % 5 = 0 then cast(o_orderkey as string) end as cited_pmid",
        "concat('Order ', o_orderkey) as cited_title",
        "case when o_orderkey % 4 <> 0 then cast(year(o_orderdate) as int) end as cited_year",
    )
    return bibliographic_edges(t).join(cited, "cited_work_id").select(
        "citing_work_id", "cited_corpus_id", "cited_doi", "cited_pmid", "cited_title", "cited_year",
        F.coalesce("is_influential", F.lit(False)).alias("is_influential"),
    )


# --- claims and relations on line items -----------------------------------------------------


def keyed_lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("k", F.expr(LINE_KEY))


def line_versions(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "concat('V', o_orderkey) as version_id", "concat('O', o_orderkey) as work_id", "'preprint' as manifestation"
    )


def line_passages(t: Tables) -> DataFrame:
    return keyed_lines(t).selectExpr(
        "concat('G', k) as passage_id",
        "concat('V', l_orderkey) as paper_version_id",
        "element_at(array('Introduction', 'Methods', 'Results', 'Discussion', cast(null as string)), "
        "cast(l_linenumber % 5 as int) + 1) as section",
        "concat('ordered ', cast(l_quantity as int), ' of part ', l_partkey) as verbatim_text",
        "0 as char_start",
        "length(concat('ordered ', cast(l_quantity as int), ' of part ', l_partkey)) as char_end",
    )


def line_occurrences(t: Tables) -> DataFrame:
    return keyed_lines(t).selectExpr(
        "concat('C', k) as occurrence_id", "concat('G', k) as passage_id",
        "case when l_linenumber % 2 = 0 then 'reported_result' else 'background_assertion' end as occurrence_type",
    )


def line_interpretations(t: Tables) -> DataFrame:
    return keyed_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "concat('I', k) as interpretation_id",
        "concat('C', k) as claim_occurrence_id",
        "concat(p_name, ' ', p_type) as normalized_text",
        "element_at(array('definite', 'probable', 'possible', 'speculative', 'other'), "
        "cast(l_linenumber % 5 as int) + 1) as certainty",
        "cast(array() as array<string>) as parent_interpretation_ids",
        "l_shipdate as created_at",
    )


def line_claim_works(t: Tables) -> DataFrame:
    return keyed_lines(t).selectExpr("concat('I', k) as interpretation_id", "concat('O', l_orderkey) as work_id")


def line_relations(t: Tables) -> DataFrame:
    """One relation per line: stance from the return flag, resolution from the line status.

    Resolved ones target the smallest claim of the part; every second of those carries the
    target claim only, so works are reached on both paths. Each part has one target, so Spark
    drops the left join, and its exchange, where nobody reads the target.
    """
    lines = keyed_lines(t).filter("l_partkey is not null")
    target = lines.groupBy("l_partkey").agg(F.min("k").alias("target_k"))
    return lines.join(target, "l_partkey", "left").selectExpr(
        "concat('R', k) as assertion_id",
        "concat('C', k) as citing_occurrence_id",
        "concat('G', k) as evidence_passage_id",
        "concat('O', l_orderkey) as citing_work_id",
        "case when l_linestatus = 'F' and l_linenumber % 2 = 0 then null else concat('P', l_partkey) end as cited_work_id",
        "case when l_linestatus = 'F' then concat('I', target_k) end as target_interpretation_id",
        "case when l_discount = 0 then null else element_at(array('background', 'method', 'direct_evidence', "
        "'comparison'), cast(l_linenumber % 4 as int) + 1) end as function",
        "case when l_discount = 0 then null when l_returnflag = 'A' then 'support' "
        "when l_returnflag = 'R' then 'contradict' else 'neutral' end as stance",
        "'whole_claim' as scope",
        "case when l_linestatus = 'F' then 'claim_resolved' else 'paper_resolved' end as resolution",
        "case when l_tax > 0.02 then l_tax * 10 end as target_link_score",
        "map('support', l_discount * 10, 'contradict', l_tax * 10, 'neutral', 0.25D) as stance_distribution",
        "'proposed' as status",
        "element_at(array('Introduction', 'Methods', 'Results', 'Discussion', cast(null as string)), "
        "cast(l_linenumber % 5 as int) + 1) as section",
        "l_shipdate as stated_at",
    )


def line_statements(t: Tables) -> DataFrame:
    """Incoming statements per cited work, with the citing year."""
    from ..operators.citations import incoming_relations

    years = t.orders.selectExpr("concat('O', o_orderkey) as citing_work_id", "cast(year(o_orderdate) as int) as year")
    return incoming_relations(line_relations(t), line_claim_works(t)).join(years, "citing_work_id", "left")


# --- saved sets ---------------------------------------------------------------------------------


def saved_sets(t: Tables) -> DataFrame:
    return t.nation.selectExpr(
        "'collection' as kind", "concat('S', n_nationkey) as set_id", "concat('U', n_regionkey) as owner_id",
        "n_name as name", "n_nationkey % 5 <> 0 as is_watched",
    )


def set_members(t: Tables) -> DataFrame:
    """Per nation, the parts its suppliers delivered."""
    return (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .selectExpr("concat('S', s_nationkey) as set_id", "concat('P', l_partkey) as work_id")
        .distinct()  # without the kind, so that joins on both ids find the rows where they are
        .select(F.lit("collection").alias("kind"), "set_id", "work_id")
    )


# --- revisions on events ------------------------------------------------------------------------


def event_interpretations(t: Tables) -> DataFrame:
    """Events as interpretations of one occurrence per user and day; errors revise the first."""
    first = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.min(F.struct("ts", "event_id"))["event_id"].alias("first_id")
    )
    return (
        t.events.withColumn("d", F.to_date("ts"))
        .join(first, ["user_id", "d"])
        .selectExpr(
            "concat('E', event_id) as interpretation_id",
            "concat('U', user_id, '@', date_format(d, 'yyyyMMdd')) as claim_occurrence_id",
            "concat(event_type, ' ', get_json_object(props, '$.k')) as normalized_text",
            "case when event_type = 'error' and event_id <> first_id then array(concat('E', first_id)) "
            "else cast(array() as array<string>) end as parent_interpretation_ids",
            "ts as created_at",
            "event_type",
            "value",
        )
    )


# --- text ------------------------------------------------------------------------------------------


def document_sentences(t: Tables) -> DataFrame:
    """Sentences of every document, paragraph by paragraph, whole text."""
    paragraphs = t.spread("documents", "doc_id").select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("paragraph", "body")
    )
    body = F.regexp_replace("body", r"(?U)^\s+|\s+$", "")
    return (
        paragraphs.select(
            "doc_id", "lang", "source", "paragraph", F.posexplode(sentences_with_offsets(body)).alias("sentence", "s")
        )
        .select(
            F.concat(
                F.lit("I"), F.col("doc_id"), F.lit("."), F.col("paragraph"), F.lit("."), F.col("sentence")
            ).alias("interpretation_id"),
            F.concat(F.lit("D"), F.col("doc_id")).alias("work_id"),
            F.col("lang").alias("section"),
            F.col("source").alias("venue"),
            "paragraph",
            "sentence",
            F.col("s.offset").alias("offset"),
            F.col("s.text").alias("text"),
        )
    )


def sentence_tokens(t: Tables) -> DataFrame:
    return document_sentences(t).select(
        "interpretation_id", "work_id", "section", "venue", content_tokens(F.col("text")).alias("tokens")
    )
