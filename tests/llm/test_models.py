"""Language-model scores and language identification."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import language_id, ngram_lm

from .conftest import WORDS, docs_frame, sentence


def lm_tokens(text):
    return [w.encode() for w in WORDS.findall((text or "").encode().lower().decode())] + [b""]


def is_held(doc_id, modulus, rest):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == rest


def plain_score(words, levels, unigram, heads, n_states):
    """The same model by definition: counts of n-grams in dictionaries, longest context first."""

    def chance(context, word):
        if not context:
            return unigram(word)
        shorter = chance(context[1:], word)
        table = levels[len(context)].get(context)
        if table is None:
            return shorter
        seen, kept = table
        below = max(seen, sum(kept.values())) + len(kept)
        return kept.get(word, 0) / below + (1 - sum(kept.values()) / below) * shorter

    order, total = max(levels, default=0), 0.0
    history = (b"",)
    for w in words:
        total += math.log10(chance(history[-order:] if order else (), w))
        history += (w,)
    return total


def whole_scores(rows, order):
    """Scores by definition under every n-gram seen twice, whatever the number of words."""
    train = [lm_tokens(t) for d, t in rows if not is_held(d, 7, 2)]
    counts = Counter(w for words in train for w in words)
    total, kinds = sum(counts.values()), len(counts)
    unigram = lambda w: (counts[w] + 1) / (total + kinds + 1)
    levels, kept = {}, {(w,): n for w, n in counts.items()}
    for n in range(2, order + 1):
        grams = Counter(tuple(p[i : i + n]) for p in ([b"", *words] for words in train) for i in range(len(p) - n + 1))
        levels[n - 1] = {}
        for g, c in grams.items():
            if c >= 2:
                levels[n - 1].setdefault(g[:-1], (kept[g[:-1]], {}))[1][g[-1]] = c
        kept = grams
    out = []
    for d, t in rows:
        words = lm_tokens(t)
        out.append((d, len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10(unigram(w)) for w in words), plain_score(words, levels, unigram, None, None)))
    return out


def assert_scores(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[-1], 6))
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    want = sorted(want, key=order)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in found], [r[4:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_are_those_of_the_definition(odd_docs, odd_rows, order):
    got = ngram_lm.score_documents(odd_docs, order=order).collect()
    assert_scores(got, whole_scores([(d, t) for d, t, _, _ in odd_rows], order))
    assert all(r.held_out == is_held(r.doc_id, 7, 2) for r in got)


@pytest.mark.parametrize(("block", "share"), [(400, 1 << 21), (5_000_000, 64), (300, 16)])
def test_blocks_ranges_and_split_contexts_change_nothing(odd_docs, odd_rows, monkeypatch, block, share):
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(ngram_lm, "RANGE_TOKENS", share)
    assert_scores(ngram_lm.score_documents(odd_docs).collect(), whole_scores([(d, t) for d, t, _, _ in odd_rows], 3))


def test_one_context_before_a_third_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "RANGE_TOKENS", 256)
    rng = random.Random(3)
    rows = [(i, " ".join(f"the w{rng.randrange(300)} x{rng.randrange(4)}" for _ in range(20))) for i in range(120)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    assert_scores(ngram_lm.score_documents(docs_frame(spark, [(d, t, "en", "s") for d, t in rows]).repartition(5)).collect(), whole_scores(rows, 3))


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for numbers in ([], [0], [5, 0, 255, 256], rng.integers(0, 2**63, 1000, np.uint64) * np.uint64(2)):
        numbers = np.array(numbers, np.uint64)
        assert np.array_equal(ngram_lm.unpack(ngram_lm.pack(numbers)), numbers)
        assert np.array_equal(ngram_lm.unpack_sorted(ngram_lm.pack_sorted(np.sort(numbers))), np.sort(numbers))


def test_more_words_and_bigrams_than_any_cut(spark):
    words = [f"v{i}" for i in range(22_000)]
    rng, rows = random.Random(1), []
    for i in range(24):  # 264,000 bigrams, each in two texts
        if i % 2 == 0:
            rng.shuffle(words)
        rows.append((i + 100 * (i % 2), " ".join(words)))
    got = ngram_lm.score_documents(docs_frame(spark, [(d, t, "en", "s") for d, t in rows]).repartition(4), order=2).collect()
    assert_scores(got, whole_scores(rows, 2))


def test_states_sum_to_one():
    none = np.zeros(0, np.int64)
    words = ngram_lm.Level(np.arange(4), none, none, np.arange(4), none, none)
    pairs = ngram_lm.Level(np.arange(3), np.array([1, 1, 2]), np.array([1, 2, 0]), np.array([1, 2, 0]), none, none)
    triples = ngram_lm.Level(np.arange(2), np.array([0, 1]), np.array([1, 2]), np.array([2, 0]), none, none)
    seen = [np.array([5, 6, 3, 2]), np.array([3, 2, 4]), np.array([2, 2])]
    built = ngram_lm.build_automaton([words, pairs, triples], seen, [np.array([0, 5, 4, 0]), np.array([2, 2, 0])], [np.array([0, 2, 1, 0]), np.array([1, 1, 0])], 16, 4)
    for state in range(len(built.fail_state)):
        score, _ = built.step(np.full(4, state), np.arange(4))
        unseen, s = 0.0, state
        while s:
            unseen, s = unseen + built.fail_score[s], built.fail_state[s]
        assert math.isclose((10**score).sum() + 10**unseen / 21, 1.0)


def test_model_beats_base_on_repeated_language(spark):
    rng = random.Random(5)
    chain = {f"w{i}": [f"w{rng.randrange(50)}" for _ in range(3)] for i in range(50)}

    def text():
        words = ["w0"]
        for _ in range(60):
            words.append(rng.choice(chain[words[-1]]))
        return " ".join(words)

    docs = docs_frame(spark, [(i, text(), "en", "s") for i in range(200)])
    held = [r for r in ngram_lm.score_documents(docs).collect() if r.held_out]
    assert held and all(r.score > r.base_score for r in held)


def test_scores_of_nothing(no_docs, spark):
    assert ngram_lm.score_documents(no_docs).count() == 0
    held = next(i for i in range(100) if is_held(i, 7, 2))
    got = ngram_lm.score_documents(docs_frame(spark, [(held, "a b", None, None)])).collect()[0]
    assert (got.n_known, got.train_tokens, got.base_score, got.score) == (0, 0, 0.0, 0.0)


# --- languages ----------------------------------------------------------------------------------

SYLLABLES = {"en": "the ing and tion ent wh sh".split(), "fr": "eau qui é ment oi elle ç".split(), "de": "sch ung ein keit ü ver ß".split()}


def in_language(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(9)
    rows = [(i, in_language(rng, lang := ("en", "fr", "de")[i % 3], rng.randrange(1, 120)), lang if i % 5 else None, "s") for i in range(400)]
    truth = {i: ("en", "fr", "de")[i % 3] for i in range(400)}
    odd = [(1000, None, "en", None), (1001, "", "fr", None), (1002, "123 $$ 456", "de", None), (None, "the and", None, None), (1003, "the ing " * 200_000, None, None)]
    return docs_frame(spark, rows + odd + [rows[0], rows[0]]), truth


def test_languages_held_out(languages):
    docs, truth = languages
    got = language_id.identify_languages(docs).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == is_held(r.doc_id, 5, 0) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and not by_id[i].accepted for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)


def test_languages_are_the_same_again(languages):
    docs, _ = languages
    one = sorted(map(tuple, language_id.identify_languages(docs).collect()), key=repr)
    two = sorted(map(tuple, language_id.identify_languages(docs.repartition(7)).collect()), key=repr)
    assert [r[:3] for r in one] == [r[:3] for r in two]
    assert np.allclose([r[3] for r in one], [r[3] for r in two], atol=1e-9)


def test_kept_languages(languages, no_docs):
    docs, _ = languages
    got = language_id.keep_identified(docs)
    assert got.columns == docs.columns and got.filter("doc_id in (1000, 1001, 1002)").count() == 0
    assert got.count() >= 0.97 * (docs.count() - 3)
    assert language_id.identify_languages(no_docs).count() == 0


def test_no_labels(spark):
    got = language_id.identify_languages(docs_frame(spark, [(1, "the", None, None), (2, "und", None, None)])).collect()
    assert {r.lang_pred for r in got} == {"und"}


def test_features_of_long_texts_are_counted_whole():
    text = "the quick brown fox " * 60_000
    assert language_id.features(text).sum() == sum(len(text.encode()) + 2 - k for k in range(language_id.LONGEST))
