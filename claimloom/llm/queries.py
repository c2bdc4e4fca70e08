"""One query per operator, over its whole table; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversation_repair, exact_dedup, jaccard_join, language_id, mixing, ngram_lm, quality, sharding, suffix_dedup, token_files, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_shard(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.histogram_shards(_table(spark, folder, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_ngram_score(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, folder, "documents"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, folder, "documents"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"), digest_all=True)


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_archive(_table(spark, folder, "pages"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(_table(spark, folder, "documents"), tokenizer, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = _table(spark, folder, "labels").filter("quality = 1 and toxic = 0")
    return quality.rate_quality(_table(spark, folder, "documents"), trusted)


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_archive(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine_collocations(_table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    return conversation_repair.repair_conversations(conversation_repair.damaged(rows), rows)


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"), columns=("n_bytes", "n_removed", "n_spans", "kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_shard, op3_ngram_score, op4_language_id, op5_jaccard_join, op6_exact_dedup, op7_warc, op8_bpe, op9_quality_rules,
        op10_token_files, op11_collocations, op12_conversation_repair, op13_suffix_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": """
        WITH hashed AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        ), copies AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256)
        SELECT h.doc_id, c.keep_id, c.group_size, h.doc_id = c.keep_id AS kept, h.text_sha256
        FROM hashed h JOIN copies c USING (text_sha256)""",
    "op11_collocations": r"""
        WITH texts AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), pieces AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS words
            FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)
        ), totals AS (
            SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
        ), sizes AS (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS size
        ), phrases AS (
            SELECT lang, size, phrase, count(*) AS f
            FROM (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: list_slice(words, i, i + size - 1))) AS phrase
                  FROM pieces JOIN sizes ON len(words) >= size)
            GROUP BY ALL HAVING count(*) >= 100
        ), cuts AS (
            SELECT p.lang, p.phrase, p.f AS a, k.size AS k, l.f AS l, r.f AS r, t.n,
                   ((1000::HUGEINT * p.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM phrases p JOIN sizes k ON k.size < p.size
            JOIN phrases l ON l.lang = p.lang AND l.phrase = list_slice(p.phrase, 1, k.size)
            JOIN phrases r ON r.lang = p.lang AND r.phrase = list_slice(p.phrase, k.size + 1, p.size)
            JOIN totals t ON t.lang = p.lang
        ), longer AS (
            SELECT lang, list_slice(phrase, 1, size - 1) AS phrase, f FROM phrases WHERE size > 2
            UNION ALL SELECT lang, list_slice(phrase, 2, size), f FROM phrases WHERE size > 2
        ), best AS (
            SELECT lang, phrase, any_value(a) AS a, any_value(n) AS n, min(struct_pack(score := score, k := k, l := l, r := r)) AS cut
            FROM cuts GROUP BY lang, phrase
        ), ranked AS (
            SELECT b.lang, array_to_string(b.phrase, ' ') AS phrase, a, cut.l AS l, cut.r AS r, n, cut.score AS score,
                   row_number() OVER (PARTITION BY b.lang ORDER BY cut.score DESC, a DESC, array_to_string(b.phrase, ' ')) AS rank
            FROM best b
            WHERE NOT EXISTS (SELECT 1 FROM longer g WHERE g.lang = b.lang AND g.phrase = b.phrase AND g.f >= b.a)
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
