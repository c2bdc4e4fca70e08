"""Mixing, sharding, exact copies and quality rules against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import exact_dedup, mixing, quality, sharding

from .conftest import WORDS, docs_frame, sentence


def lower_az(text):
    return (text or "").encode().lower().decode()


# --- mixing -------------------------------------------------------------------------------------


def water_level(sizes, weights, share, most):
    target = {s: 0.0 for s in sizes}
    open_, rest = set(sizes), share * sum(sizes.values())
    while open_:
        price = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * price >= most * sizes[s]}
        if not full:
            return target | {s: weights[s] * price for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets(odd_docs, odd_rows):
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == len(odd_rows)
    sizes = defaultdict(int)
    for _, text, _, source in odd_rows:
        sizes[source] += len(WORDS.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    taken, targets = defaultdict(int), {}
    by_size = Counter((r.source_size, round(r.target, 6)) for r in got)
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
        targets[r.source_size, round(r.target, 6)] = r.target
    assert set(by_size) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for key, words in taken.items():
        # one very long text holds nearly all of source d: its words cannot be split
        assert abs(words - targets[key]) <= 1 or key[0] > 50_000, key


def test_mix_is_the_same_again(odd_docs):
    again = [sorted(map(tuple, mixing.mix_sources(odd_docs.repartition(n)).collect()), key=repr) for n in (2, 7)]
    assert again[0] == again[1]


def test_mix_buckets_of_equal_sizes(spark):
    docs = docs_frame(spark, [(i, "a b c", "en", "s" if i % 3 else "t") for i in range(3000)])
    got = mixing.mix_sources(docs, per_bucket=50)
    for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 3
    assert got.count() == 3000


def test_mix_of_nothing(no_docs, spark):
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.mix_sources(docs_frame(spark, [(1, None, None, None), (2, "", None, "a")])).select("taken").distinct().collect()[0][0] == 0


@pytest.mark.parametrize("seed", range(6))
def test_fit_counts(seed):
    rng = random.Random(seed)
    sizes = np.array(sorted(rng.sample(range(1, 90_000), 30)))
    counts = np.array([rng.randrange(1, 50) for _ in sizes])
    budget = rng.randrange(int((sizes * counts).sum()))
    taken = mixing.fit_counts(sizes, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    assert abs(int((taken * sizes).sum()) - budget) <= sizes.min()


def test_fit_counts_exact_when_possible():
    assert (mixing.fit_counts(np.array([3, 5]), np.array([1, 1]), 8) == [1, 1]).all()
    assert mixing.fit_counts(np.array([3, 7]), np.array([4, 2]), 13) @ [3, 7] == 13
    assert mixing.fit_counts(np.array([0, 4]), np.array([9, 1]), 0).sum() == 0


def test_mixed_documents_repeat_rows(odd_docs):
    got = mixing.mixed_documents(odd_docs)
    assert got.columns == odd_docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(odd_docs).filter("doc_id > 99").collect()}
    rows = Counter(r.doc_id for r in got.filter("doc_id > 99").select("doc_id").collect())
    assert rows == Counter({k: v for k, v in copies.items() if v})


# --- sharding -----------------------------------------------------------------------------------


def test_shards(odd_docs, odd_rows):
    got = sharding.histogram_shards(odd_docs, shards=4).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(1)
    texts = [sentence(rng, 50) for _ in range(800)]
    docs = docs_frame(spark, [(i, texts[i % 800] if i < 1000 else "hot text " * 20, "en", "s") for i in range(1600)])
    got = sharding.histogram_shards(docs, shards=8, tolerance=0.01).withColumn("size", F.col("size")).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    ideal = sum(sizes.values()) / 8
    assert all(abs(s - ideal) <= 0.03 * ideal for s in sizes.values()) and len(sizes) == 8
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    hot = zlib.crc32(("hot text " * 20).encode())
    assert len(where[hot]) > 1 and sum(len(s) > 1 for k, s in where.items() if k != hot) == 0


def test_shards_of_nothing(no_docs):
    assert sharding.histogram_shards(no_docs).count() == 0


def test_written_shards(odd_docs, spark, tmp_path):
    sharding.write_shards(odd_docs, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").exceptAll(odd_docs.select("doc_id", "text")).count() == 0


# --- exact copies -------------------------------------------------------------------------------


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_duplicates(odd_docs, odd_rows, digest_all):
    groups = defaultdict(list)
    for d, t, _, _ in odd_rows:
        groups[lower_az(t)].append(d)
    got = exact_dedup.exact_duplicates(odd_docs, digest_all=digest_all).collect()
    assert len(got) == len(odd_rows)
    best = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    if digest_all:
        assert all((r.keep_id, r.group_size) == best[r.text_sha256] for r in got)
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert kept == Counter(dict.fromkeys(best, 1))
    else:
        assert sum(r.kept for r in got) == len(groups)
        assert all((r.keep_id, r.group_size) == best[r.text_sha256] for r in got if r.text_sha256)
        assert all(r.group_size == 1 for r in got if r.text_sha256 is None)


def test_drop_duplicates(odd_docs, odd_rows, no_docs):
    got = exact_dedup.drop_duplicates(odd_docs)
    assert got.columns == odd_docs.columns
    assert Counter(lower_az(r.text) for r in got.collect()) == Counter({lower_az(t): 1 for _, t, _, _ in odd_rows})
    assert exact_dedup.drop_duplicates(no_docs).count() == 0 and exact_dedup.exact_duplicates(no_docs).count() == 0


def test_native_plans(odd_docs):
    for df in (exact_dedup.exact_duplicates(odd_docs), sharding.histogram_shards(odd_docs, 3), quality.with_base_counts(odd_docs.select("text"))):
        assert "Python" not in df._jdf.queryExecution().toString()


# --- quality ------------------------------------------------------------------------------------


def base_counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_quality_counts(odd_docs, odd_rows, spark):
    trusted = spark.createDataFrame([(100 + i,) for i in range(30)] + [(None,)], "doc_id long")
    got = quality.rate_quality(odd_docs, trusted, buckets=256).collect()
    want = Counter((d, *base_counts(t)) for d, t, _, _ in odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_separates_and_is_deterministic(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 80), "en", "s") for i in range(200)] + [(200 + i, " ".join(f"z{rng.randrange(400)}##" for _ in range(80)), "en", "s") for i in range(60)]
    docs, trusted = docs_frame(spark, rows), spark.createDataFrame([(i,) for i in range(120)], "doc_id long")
    first = {r.doc_id: (r.kept, r.score) for r in quality.rate_quality(docs, trusted).collect()}
    again = {r.doc_id: (r.kept, r.score) for r in quality.rate_quality(docs.repartition(7), trusted).collect()}
    assert first == again
    assert all(first[i][0] for i in range(200)) and not any(first[i][0] for i in range(200, 260))


def test_quality_of_nothing(no_docs, odd_docs, spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.rate_quality(no_docs, none, buckets=16).count() == 0
    got = quality.rate_quality(odd_docs, none, buckets=16).collect()
    assert all(r.kept != r.base_failed for r in got)
