"""Collocations, conversation repair and passage removal against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import collocations, conversation_repair, queries, suffix_dedup
from claimloom.llm.suffix_sort import byte_rows, common_prefixes, deep_shallow_order

from .conftest import docs_frame, sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def all_phrases(rows, longest=5):
    counts, totals = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return counts, totals


def brute_collocations(rows, least, longest=5, top=2000):
    counts, totals = all_phrases(rows, longest)
    frequent = {p: n for p, n in counts.items() if n >= least}
    as_frequent = set()
    for (lang, words), n in frequent.items():
        for size in range(2, len(words)):
            as_frequent.update((lang, words[i : i + size]) for i in range(len(words) - size + 1) if frequent[lang, words[i : i + size]] <= n)
    found = {}
    for (lang, words), a in frequent.items():
        if len(words) > 1 and (lang, words) not in as_frequent:
            cuts = [(1000 * a * totals[lang] // (frequent[lang, words[:k]] * frequent[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            row = (" ".join(words), a, frequent[lang, words[:k]], frequent[lang, words[k:]], totals[lang], score)
            found.setdefault(lang, []).append(row)
    out = []
    for lang, phrases in found.items():
        phrases.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(phrases[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(2, 2000), (3, 7), (100, 2000)])
def test_collocations(odd_rows, odd_docs, least, top):
    got = collocations.mine_collocations(odd_docs, least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == brute_collocations(odd_rows, least, top=top)
    assert found or least == 100


def test_collocations_across_ranges_blocks_and_shares(spark, monkeypatch):
    """Streams cut inside a hot first word, blocks cut inside texts, and ranking in shares change nothing."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 50)
    monkeypatch.setattr(collocations, "HELD_KEYS", 20)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 20)
    monkeypatch.setattr(collocations, "RANKED", 5)
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["the", "the", "of", "a\tb", "x,", "Y.", "z\x01", "q"]) for _ in range(80))
    rows = [(i, text(), ["en", "de", None][i % 3], "s") for i in range(60)] + [(99, "the " * 500, "en", "s"), (100, "no,break;" * 30, "en", "s")]
    got = sorted(tuple(r) for r in collocations.mine_collocations(docs_frame(spark, rows).repartition(3), 3, top=40).collect())
    assert got == brute_collocations(rows, 3, top=40)


def test_collocations_of_nothing(spark, no_docs):
    assert collocations.mine_collocations(no_docs).collect() == []
    assert collocations.mine_collocations(docs_frame(spark, [(1, None, None, None), (2, "", "en", "a"), (3, ".,;", "en", "a")]), 1).collect() == []


NEXT, KEPT = (2, 2, 3, 2), {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}


def brute_repair(symbols):
    """Cheapest edits by comparing whole audits, row by row from the end."""
    after = None
    for i in range(len(symbols), -1, -1):
        here = []
        for q in range(4):
            found = [(10**9, "")]
            if i == len(symbols):
                found += [(0, "")] if q in (0, 3) else []
            else:
                kind, fault = divmod(symbols[i], 4)
                found.append((3 + after[q][0], "D" + after[q][1]))
                if fault in (0, 3):
                    more = fault == 3
                    if (q, kind) in KEPT:
                        found.append((more + after[KEPT[q, kind]][0], "K" + after[KEPT[q, kind]][1]))
                    found.append((2 + more + after[NEXT[q]][0], "R" + after[NEXT[q]][1]))
            here.append(min(found))
        for _ in range(3):
            here = [min(here[q], (2 + here[NEXT[q]][0], "I" + here[NEXT[q]][1])) for q in range(4)]
        after = here
    return after[0]


@given(st.lists(st.tuples(st.integers(0, 15), st.integers(1, 7)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_cheapest_repair(runs):
    assert conversation_repair.cheapest_repair(runs) == brute_repair([s for s, n in runs for _ in range(n)])


def test_a_long_run_is_passed_by_powers():
    cost, audit = conversation_repair.cheapest_repair([(4, 100_000)])  # one user after the other
    assert cost == 2 * 100_000 // 2 and len(audit) == 100_000 and audit.count("R") == 50_000


def brute_report(rows):
    """The whole contract of the query, in memory."""
    space, convs = " \t\n\x0b\x0c\r", {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns, seen, symbols = {t for t, _, _ in kept if t is not None}, set(), []
        for _, role, text in kept:
            last = text.strip(space)[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 0 if last in ".!?" else 3
            seen.add((role, text))
            symbols.append(4 * ("sua".index(role[0]) if role[:1] in tuple("sua") else 3) + fault)
        legal = {(0, 1), (1, 2), (2, 1)}
        illegal = sum((a // 4, b // 4) not in legal for a, b in zip(symbols, symbols[1:]))
        cost, audit = brute_repair(symbols)
        state, at, lines = 0, 0, []
        for edit in audit:
            role, text = ("", "") if edit == "I" else kept[at][1:]
            at += edit != "I"
            if edit != "D":
                state = KEPT[state, "sua".index(role[0])] if edit == "K" else NEXT[state]
                lines.append(f"{role if edit == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults = [sum(s % 4 == f for s in symbols) for f in (1, 2, 3)]
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(0, 9)):
            text = rng.choice([sentence(rng, 5) + rng.choice(".!?"), sentence(rng, 3), "same.", "same.", " \t", "", None, "É.", "tail! \n"])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), rng.choice(["system", "user", "assistant", "user", "tool", "", None, "unknown"]), text))
    rows += rows[:5] + [(500, t, ["user", "assistant"][t % 2], "same." if t % 3 else f"t{t}.") for t in range(900)]  # a conversation over many ranges
    return rows + [(501, 3, "user", "x" * 200_000 + "?"), (502, 1, "user", "a."), (502, 1, "user", "a."), (502, 1, "assistant", "b.")]


def conversations(spark, rows):
    extra = "audit digest part kind n row".split()
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{e} string" for e in extra))


@pytest.mark.parametrize("hot", [10_000, 2])
def test_conversations(spark, monkeypatch, hot):
    monkeypatch.setattr(conversation_repair, "HOT_TURNS", hot)
    rows = conversation_rows(hot)
    table = conversations(spark, rows).repartition(4)
    got = conversation_repair.repair_conversations(conversation_repair.damaged(table), table)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_report(rows)


def test_repaired_rows_hash_to_the_report(spark):
    table = conversation_repair.damaged(conversations(spark, conversation_rows(3)))
    lines: dict = {}
    for r in sorted(conversation_repair.repaired_rows(table).collect(), key=lambda r: r.position):
        assert r.position == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in conversation_repair.repair_conversations(table).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest()


def test_no_conversations(spark):
    assert conversation_repair.repair_conversations(conversations(spark, []), conversations(spark, [])).collect() == []


def test_registered_repair(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_conversation_repair(spark, folder).collect()), key=repr) == brute_report(rows)


@given(st.lists(st.binary(max_size=40) | st.text("ab\0", max_size=60).map(str.encode), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_deep_shallow_order(strings):
    rows, lengths = byte_rows(strings)
    for shallow in (0, 8, 64):
        order = deep_shallow_order(strings, rows, shallow)
        assert [strings[i] for i in order] == sorted(strings)
        shared = common_prefixes(rows, lengths, order)
        for n, a, b in zip(shared[1:], order, order[1:], strict=False):
            longest = next((i for i, (x, y) in enumerate(zip(strings[a], strings[b], strict=False)) if x != y), min(lengths[a], lengths[b]))
            assert n == longest


def brute_removal(rows, span):
    """Rows as (doc_id, text); of equal ids the order is not tested here."""
    met, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            if (part := raw[i : i + span]) in met:
                cover[i : i + span] = b"\1" * span
            else:
                met.add(part)
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(cover))]
        out.append((doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs, kept))
    return sorted(out, key=repr)


def removed(docs, span=100, **kw):
    found = suffix_dedup.remove_repeats(docs, span, **kw).collect()
    return sorted(((*r[:5], [tuple(s) for s in r.spans], bytes(r.kept)) for r in found), key=repr)


def passage_rows(seed=1):
    rng = random.Random(seed)
    shared = [sentence(rng, n) for n in (16, 60, 400)]
    rows = []
    for i in range(80):
        parts = [sentence(rng, rng.randrange(1, 60)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(200 + i, rows[4][1].replace("w1", f"v{i}", 1 + i % 3)) for i in range(20)]
    rows += [(300, "z" * 5000), (301, "ab" * 700 + "z" * 150), (302, "é" * 120), (303, "\0" * 130 + "ab\0" * 60), (None, rows[5][1] + "!"), (304, None), (305, ""), (306, shared[2][:99])]
    return rows + [(307, sentence(rng, 30_000, 900) + shared[2])]


@pytest.mark.parametrize("crowd,block", [(1000, 1 << 20), (3, 1 << 20), (1000, 700), (2, 150)])
def test_passages(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BLOCK_TEXTS", 7 if block < 1000 else 1000)
    rows = passage_rows() if block >= 700 else passage_rows()[:130]
    docs = docs_frame(spark, [(d, t, "en", "s") for d, t in rows]).repartition(4)
    assert removed(docs, crowd=crowd) == brute_removal(rows, 100)


def test_passages_with_little_held_at_once(spark, monkeypatch):
    for name, value in (("HELD_RUNS", 50), ("HELD_BYTES", 2000), ("HELD_ROWS", 40)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = passage_rows(2)
    assert removed(docs_frame(spark, [(d, t, "en", "s") for d, t in rows]).repartition(3)) == brute_removal(rows, 100)


def test_odd_passages(spark, odd_rows, odd_docs, no_docs):
    """Repeated rows stay once; rows of one id stand by the hash of their text; every distinct string stays somewhere."""
    found = removed(odd_docs)
    assert len(found) == len(odd_rows) and removed(no_docs) == []
    strings = {(t or "").encode()[i : i + 100] for _, t, _, _ in odd_rows for i in range(len((t or "").encode()) - 99)}
    first = {r[0]: r for r in found if r[0] is not None and r[0] != 4}
    want = {r[0]: r for r in brute_removal([(d, t) for d, t, _, _ in odd_rows if d not in (None, 4)], 100)}
    assert {k: v for k, v in first.items() if k < 4} == {k: v for k, v in want.items() if k < 4}
    assert {k: v for k, v in first.items() if k > 4} == {k: v for k, v in want.items() if k > 4}
    assert [r[2] == r[1] for r in found if r[0] == 4] == [True, True]  # met in row 1 already
    assert len(strings) <= sum(r[1] for r in found)
    twins = docs_frame(spark, [(1, "y" * 50 + "z" * 70, "en", "a")] * 3 + [(None, "short", None, None)] * 2 + [(2, "q" * 99, "en", "b")] * 2)
    assert [(r[0], r[1], r[2], r[3]) for r in removed(twins)] == [(1, 120, 0, 0), (1, 120, 120, 1), (1, 120, 120, 1), (2, 99, 0, 0), (2, 99, 0, 0), (None, 5, 0, 0), (None, 5, 0, 0)]


def test_registered_passages(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_suffix_dedup(spark, folder).collect()), key=repr)
    assert got == [r[:5] for r in brute_removal(rows, 100)]
