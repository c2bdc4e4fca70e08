"""The n-gram Jaccard join against all pairs, and the pipeline stage by stage."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from claimloom.llm import jaccard_join, queries

from .conftest import WORDS, docs_frame, sentence

SMALL = "/root/testdata/sf0.001"


def grams(text):
    words = WORDS.findall((text or "").encode().lower().decode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(rows):
    """Smallest id reachable by links, from all pairs of rows."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min((x for x in (best.get(find(i)), d) if x is not None), default=None)
    return Counter((d, len(sets[i]), best[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def check(spark, rows, parts=5):
    docs = docs_frame(spark, [(d, t, "en", "s") for d, t in rows]).repartition(parts)
    got = jaccard_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows)


def test_odd_documents(odd_docs, odd_rows, no_docs):
    got = jaccard_join.near_duplicates(odd_docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components([(d, t) for d, t, _, _ in odd_rows])
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def hard_rows(seed):
    """Near copies at all distances, chains, a shared passage that fills much of many texts, short texts, copies."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        words = sentence(rng, rng.randrange(20, 300), 3000).split()
        rows += [varied(rng, words, rng.randrange(0, 9)) for _ in range(rng.randrange(1, 9))]
    passage = sentence(rng, 60, 3000).split()
    for _ in range(60):  # around the threshold: 60 shared words and up to 25 others
        own = sentence(rng, rng.randrange(0, 25), 3000).split()
        at = rng.randrange(len(own) + 1)
        rows.append(" ".join(own[:at] + passage + own[at:]))
    words = sentence(rng, 100, 3000).split()
    for _ in range(25):  # a chain: each close to the one before
        words = words[3:] + sentence(rng, 3, 3000).split()
        rows.append(" ".join(words))
    rows += [" ".join(words[:n]) for n in (1, 2, 3, 4, 5, 6)] * 3 + ["", None]
    rng.shuffle(rows)
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", range(2))
def test_hard_documents(spark, seed):
    check(spark, hard_rows(seed))


@pytest.mark.parametrize("few", [True, False])
def test_large_columns_and_cells(spark, monkeypatch, few):
    """Tiny limits send nearly all columns to the grid, in many cells; without minima nothing is settled first."""
    monkeypatch.setattr(jaccard_join, "DENSE", 2)
    monkeypatch.setattr(jaccard_join, "CELL", 4)
    monkeypatch.setattr(jaccard_join, "LOCAL_REPEATS", 2)
    if few:
        monkeypatch.setattr(jaccard_join, "_SEEDS", jaccard_join._SEEDS[:1])
    check(spark, hard_rows(7))


def test_limits_at_the_threshold():
    a, b = np.arange(1, 60)[:, None], np.arange(1, 60)[None, :]
    need = jaccard_join.least_overlap(a, b)
    assert (100 * need >= 75 * (a + b - need)).all() and (100 * (need - 1) < 75 * (a + b - need + 1)).all()


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(4)
    for n, changed in ((300, 20), (900, 60), (5000, 700), (5000, 900), (700, 0)):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[changed:], rng.integers(0, 2**63, changed // 3, dtype=np.uint64))))
        apart = len(np.setxor1d(a, b))
        short = np.bitwise_count(np.frombuffer(jaccard_join.sketch(a), np.uint64) ^ np.frombuffer(jaccard_join.sketch(b), np.uint64)).sum()
        assert short <= apart and (apart - short) % 2 == 0
        x, y = jaccard_join.long_sketch(a), jaccard_join.long_sketch(b)
        assert (x is None) == (2 * len(a) <= jaccard_join.SKETCH)
        if x and y:
            assert jaccard_join.bits_apart(x, y) == jaccard_join.bits_apart(y, x) <= apart
    whole, half = np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(1900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert len(jaccard_join.long_sketch(whole)) > len(jaccard_join.long_sketch(half))
    assert jaccard_join.bits_apart(jaccard_join.long_sketch(whole), jaccard_join.long_sketch(half)) <= 2100


def test_one_document_of_each_group_stays(spark):
    rows = [(d, t) for d, t in hard_rows(3) if d is not None]
    docs = docs_frame(spark, [(d, t, "en", "s") for d, t in rows])
    got = jaccard_join.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for (d, _, c), n in components(rows).items() for _ in range(n) if d == c)


def linked(x, y):
    both = len(x & y)
    return both and 100 * both >= 75 * (len(x) + len(y) - both)


@pytest.mark.parametrize("ids", ["a third null", "repeated", "all null", "as they are"])
def test_no_other_text_goes_with_a_shared_id(spark, ids):
    """Of every component exactly one row stays, with its smallest id, and rows without words all stay."""
    kinds = {"a third null": lambda i, d: i if i % 3 else None, "repeated": lambda i, d: i * 7 % 90, "all null": lambda i, d: None, "as they are": lambda i, d: d}
    rows = [(kinds[ids](i, d), t) for i, (d, t) in enumerate(hard_rows(3))]
    sets = [grams(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]) and part[i] != part[j]:
                part = [part[j] if x == part[i] else x for x in part]
    smallest = {}
    for (d, _), s, p in zip(rows, sets, part, strict=True):
        if s:
            smallest[p] = min((x for x in (smallest.get(p), d) if x is not None), default=None)
    docs = docs_frame(spark, [(d, t, "en", "s") for d, t in rows]).repartition(4)
    got = jaccard_join.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert Counter(k for k in kept if not grams(k[1])) == Counter(r for r, s in zip(rows, sets, strict=True) if not s)
    of = {row: p for row, p, s in zip(rows, part, sets, strict=True) if s}
    assert Counter((of[k], k[0]) for k in kept if grams(k[1])) == Counter(smallest.items())


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mix_sources", "bpe"]
    kept = []
    now = docs
    for name, apply in corpus_pipeline.STAGES:
        now = apply(spark, now, SMALL).cache()
        kept.append((name, now))
        if name != "bpe":
            assert now.columns == docs.columns and now.exceptAll(now.intersect(docs)).count() == now.count() - now.distinct().count()
    sizes = {n: d.count() for n, d in kept}
    assert sizes["language_id"] >= 0.98 * docs.count()
    lowered = Counter(r.text.encode().lower() for r in kept[0][1].collect())
    assert sizes["exact_dedup"] == len(lowered)
    left = [(r.doc_id, r.text) for r in kept[1][1].collect()]
    assert {r.doc_id for r in kept[2][1].collect()} == {c for _, _, c in components(left)}
    words = lambda df: df.select(F.sum(F.regexp_count("text", F.lit(r"[^ \t-\r]+")))).first()[0]
    assert abs(words(kept[3][1]) - 1.5 * words(kept[2][1])) <= 0.02 * words(kept[2][1])
    assert sizes["bpe"] == sizes["mix_sources"] and kept[4][1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.run(spark, SMALL).exceptAll(kept[4][1]).count() == 0


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_of_odd_documents(spark, odd_docs, no_docs, empty):
    docs = no_docs if empty else odd_docs
    for name, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, SMALL)
        if name != "bpe":
            assert docs.columns == no_docs.columns
    assert (docs.count() == 0) == empty


def test_registered():
    found = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert "pipeline" in found and set(queries.ORACLES) <= set(found)
