"""Snapshot and bulk scans: shards, releases, diffs, reference lists, evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Record shapes of the bulk datasets.
BULK_SCHEMAS = {
    "papers": (
        "corpusid long, externalids struct<DOI:string,PubMed:string>, title string, "
        "authors array<struct<authorId:string,name:string>>, venue string, year int"
    ),
    "citations": (
        "citationid long, citingcorpusid long, citedcorpusid long, isinfluential boolean, "
        "contexts array<string>, intents array<array<string>>"
    ),
    "tldrs": "corpusid long, text string",
    "abstracts": "corpusid long, abstract string",
    "embeddings": "corpusid long, vector array<float>",
}
REFERENCE_SCHEMA = (
    "paper_id string, references array<struct<citedPaper:struct<externalIds:struct<CorpusId:long,DOI:string,"
    "PubMed:string>,title:string,year:int>,contexts:array<string>,intents:array<string>,isInfluential:boolean>>"
)
INTEGRITY_SCHEMA = "doi string, update_to array<struct<type:string,label:string>>, title array<string>"
SEED_SCHEMA = "seeds array<struct<id:string,note:string>>"
GOLD_SCHEMA = (
    "papers array<struct<doi:string,`order`:int,citations:array<struct<marker:string,resolved_doi:string>>,"
    "claims:array<struct<gold_id:string,text:string,occurrence_type:string,section:string,effect_direction:string,"
    "negated:boolean,certainty:string,relations:array<struct<cited_doi:string,`function`:string,stance:string,"
    "scope:string,resolution:string,target_gold_id:string>>>>>>, equivalences array<array<string>>, "
    "exhaustive_claims boolean"
)


def shard_paths(spark: SparkSession, manifest: DataFrame, root: str, dataset: str) -> list[str]:
    """Paths of the manifest's shards that exist; the manifest is one row per shard."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(root).select("path")
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("basename"))
    wanted = manifest.filter(F.col("dataset") == dataset).select("basename").distinct()
    # a release has some thousand shards
    return [f"{root}/{r.basename}" for r in wanted.join(there, "basename", "left_semi").orderBy("basename").collect()]


def read_shards(spark: SparkSession, paths: list[str], dataset: str) -> DataFrame:
    """Gzipped JSON-lines shards with a declared schema and their scan order.

    A gzip shard is one task; ``land_shards`` writes them once as Parquet for joins.
    """
    schema = T.StructType.fromDDL(BULK_SCHEMAS[dataset])
    if not paths:
        return spark.createDataFrame([], schema).withColumn("record_id", F.lit(""))
    rows = spark.read.schema(schema).json(paths)
    position = F.format_string("%020d", F.monotonically_increasing_id())
    return rows.withColumn("record_id", F.concat(F.col("_metadata.file_name"), F.lit("#"), position))


def land_shards(records: DataFrame, path: str, key: str, release_id: str) -> None:
    """Write one release as Parquet, range partitioned and sorted by key so that point and
    range lookups skip row groups. A rerun replaces the release's own folder."""
    (
        records.repartitionByRange(F.col(key))
        .sortWithinPartitions(key)
        .write.mode("overwrite")
        .parquet(f"{path}/release_id={release_id}")
    )


def check_one_release(manifest: DataFrame) -> str:
    """The release all shards belong to; mixing releases is refused."""
    releases = [r[0] for r in manifest.select("release_id").distinct().limit(2).collect()]
    if len(releases) != 1:
        raise ValueError(f"expected one release, found {len(releases)}")
    return releases[0]


def point_lookup(records: DataFrame, key: str, values: list[int]) -> DataFrame:
    """Records of a few keys; the predicate reaches the Parquet scan."""
    return records.filter(F.col(key).isin(values))


def keyed_lookup(records: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Records of many keys, given as a one-column table."""
    return records.join(wanted.select(key).distinct(), key, "left_semi")


def apply_release_diff(base: DataFrame, updates: DataFrame, deletes: DataFrame, key: str, order: str) -> DataFrame:
    """Next release: deleted and updated keys leave the base, the last update of a key
    enters. A key that is both updated and deleted is deleted."""
    gone = deletes.select(key).distinct()
    latest = updates.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in base.columns if c != key]), order).alias("_r")
    ).select(key, "_r.*")
    changed = updates.select(key).union(deletes.select(key)).distinct()
    kept = base.join(changed, key, "left_anti")
    return kept.unionByName(latest.join(gone, key, "left_anti").select(base.columns))


def reference_links(snapshot: DataFrame, max_records: int | None = None) -> DataFrame:
    """One row per listed reference with its position; the cap is by list position."""
    listed = F.col("references") if max_records is None else F.slice("references", 1, max_records)
    rows = snapshot.select("paper_id", F.posexplode(listed).alias("position", "r"))
    cited, ids = F.col("r.citedPaper"), F.col("r.citedPaper.externalIds")
    return rows.select(
        "paper_id",
        "position",
        ids["CorpusId"].cast("string").alias("cited_corpus_id"),
        ids["DOI"].alias("cited_doi"),
        ids["PubMed"].alias("cited_pmid"),
        cited["title"].alias("cited_title"),
        cited["year"].alias("cited_year"),
        F.coalesce("r.contexts", F.array().cast("array<string>")).alias("contexts"),
        F.coalesce("r.intents", F.array().cast("array<string>")).alias("intents"),
        F.coalesce("r.isInfluential", F.lit(False)).alias("is_influential"),
    )


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A nested JSON document (gold corpus, seed list) with a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def seed_rows(document: DataFrame) -> DataFrame:
    return document.select(F.posexplode("seeds").alias("position", "s")).select("position", "s.*")


def gold_tables(document: DataFrame) -> dict[str, DataFrame]:
    """Papers, citations, claims, relations and equivalences of a gold corpus."""
    papers = document.select(F.explode("papers").alias("p")).select("p.*")
    claims = papers.select("doi", F.explode("claims").alias("c")).select("doi", "c.*")
    return {
        "papers": papers.select("doi", "order"),
        "citations": papers.select("doi", F.explode("citations").alias("c")).select("doi", "c.*"),
        "claims": claims.drop("relations"),
        "relations": claims.select("doi", "gold_id", F.explode("relations").alias("r")).select("doi", "gold_id", "r.*"),
        "equivalences": document.select(F.posexplode("equivalences").alias("group_id", "m")).select(
            "group_id", F.explode("m").alias("gold_id")
        ),
        "settings": document.select("exhaustive_claims"),
    }
