"""WARC archives, byte-pair encoding and token files: exact round trips and the tokenizers library."""

from __future__ import annotations

import base64
import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm import bpe, token_files, warc

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def pages_frame(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", "x") for p, u, h in rows], "page_id long, url string, html string, payload string, sha string")


PAGES = [
    (3, "http://a/\r\nX-Evil: 1", "<html>one</html>"), (1, "http://b/", "<html>one</html>"), (2, None, "<p>ü\r\n\r\nWARC/1.0\r\n</p>"), (7, "http://c/", ""),
    (4, "http://d/", None), (None, "http://e/", "<html>one</html>"), (9, "http://f/", "y" * 3_000_000), (10, "http://f/", "y" * 3_000_000), (11, None, "z"),
]


@pytest.mark.parametrize("least", [0, 10])
def test_archive_round_trip(spark, least):
    got = {r.page_id: r for r in warc.page_archive(pages_frame(spark, PAGES).repartition(3), least_bytes=least).collect()}
    assert len(got) == len(PAGES)
    for page, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == payload and p is not None]
        again = len(payload) >= least and page != min(same)
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", min(same)) if again else ("response", None))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archive_contents_and_pushdown(spark, compression):
    folder = warc.write_pages(pages_frame(spark, PAGES), compression=compression, file_bytes="1000")
    records = warc.read_archive(spark, folder)
    payloads = {r.record_id: bytes(r.payload) for r in records.filter("record_type = 'response'").collect()}
    assert payloads["urn:page:2"] == PAGES[2][2].encode() and payloads["urn:page:9"] == b"y" * 3_000_000
    assert payloads["urn:page:1"] == b"<html>one</html>" and "urn:page:3" not in payloads
    picked = warc.read_archive(spark, folder, record_types=("response",), uri_prefix="http://b")
    assert picked.filter("record_type = 'revisit'").count() == 0
    assert [r.record_id for r in picked.collect()] == ["urn:page:1"]
    pushed = warc.read_archive(spark, folder, pushdown=True).filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http://b"))
    plan = pushed.select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert [r.record_id for r in pushed.collect()] == ["urn:page:1"]
    assert "BatchScan warc" in plan and "Filter" not in plan.replace("RuntimeFilters", "")
    assert records.filter("record_type = 'revisit'").count() == 4 and records.count() == len(PAGES)
    assert {r.target_uri for r in records.collect()} >= {"http://a/ X-Evil: 1", None}


def test_unwanted_payloads_are_never_read(tmp_path):
    import io

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    data = b"".join(warc.record_bytes(f"urn:page:{i}", "response", None, None, b"p" * 10_000) for i in range(20))
    stream = Counting(data)
    wanted = lambda h: h["warc-record-id"] == "<urn:page:7>"
    found = list(warc.read_records(stream, wanted, True, True))
    assert [f[0] for f in found] == ["urn:page:7"] and stream.taken == 10_000
    broken = data.replace(b"p" * 10_000, b"q" * 10_000, 1)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(broken), lambda h: True, False, True))


def test_lost_attempts_leave_no_record(spark):
    folder = warc.write_pages(pages_frame(spark, PAGES))
    store, path = warc.filesystem(folder)
    with store.open_output_stream(f"{path}/stray.warc", compression=None) as f:
        f.write(warc.record_bytes("urn:page:99", "response", None, None, b"stray"))
    assert warc.read_archive(spark, folder, payload=False).count() == len(PAGES)


def test_empty_archive(spark):
    assert warc.page_archive(pages_frame(spark, [])).count() == 0


# --- byte-pair encoding ---------------------------------------------------------------------------

TEXTS = [
    "", " ", "\n\t", "Hello, World's best THEY'LL it's'", "naïve Ünïcode ſtraße ΑΣ ΣΑΣ Σ İstanbul é é ﬁ", "12 345½ ² Ⅷ ٣٤", "a  b   c \n d\t\te \n\n f  ",
    " lead and trail ", "<|endoftext|> x<|startoftext|><|endoftext|>", "<|endo <ftext|>", "日本語テキスト と 한국어 　 x", "emoji 👩‍👩‍👧 🇩🇪!", "x" * 20_000, "a\x1cb\x1d c",
    "tab\x0bvert\x0cff\x85nel\xa0nbsp ls", "'s't're've'm'll'd'S", "___ __a__ 1_000", "​zero‍width", "#*$%&|<>" * 9, "\x00null\x7f", "Å̧ mark first ́x",
]


def test_word_bpe_equals_the_library(odd_docs, odd_rows):
    library = Tokenizer.from_file(WORD_FILE)
    own = bpe.WordBpe(WORD_FILE)
    for text in TEXTS + [t for _, t, _, _ in odd_rows if t]:
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert ids.tolist() == want, text[:80]
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    got = bpe.encode_documents(odd_docs, WORD_FILE, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    by_text = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}
    assert len(got) == len(odd_rows)
    for d, t, _, _ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) in by_text


@pytest.mark.parametrize("seed", range(20))
def test_merge_order(seed):
    """The linked list and heap against repeated scans for the lowest rank."""
    rng = random.Random(seed)
    own = bpe.WordBpe.__new__(bpe.WordBpe)
    pairs = [(rng.randrange(8), rng.randrange(8)) for _ in range(12)]
    own.merges = {}
    for rank, pair in enumerate(dict.fromkeys(pairs)):
        own.merges[pair] = rank, 8 + rank
    for rank in range(6):
        pair = (rng.randrange(20), rng.randrange(20))
        own.merges.setdefault(pair, (100 + rank, 40 + rank))
    ids = [rng.randrange(8) for _ in range(40)]
    want = list(ids)
    while True:
        ranked = [(own.merges[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in own.merges]
        if not ranked:
            break
        _, i = heapq.nsmallest(1, ranked)[0]
        want[i : i + 2] = [own.merges[want[i], want[i + 1]][1]]
    assert own.merge(list(ids)) == want


def test_full_caches_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    own, library = bpe.WordBpe(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    text = "one two three four five one two three"
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_nothing(no_docs):
    assert bpe.encode_documents(no_docs, WORD_FILE).count() == 0


# --- token files ----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("kind", ["small", "wide", "outliers", "same", "extremes"])
def test_block_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "small": lambda: rng.integers(0, 9, n), "wide": lambda: rng.integers(0, 50_000, n), "same": lambda: np.full(n, 77),
        "outliers": lambda: np.where(rng.random(n) < 0.03, rng.integers(0, 2**32 - 1, n), rng.integers(500, 600, n)),
        "extremes": lambda: rng.choice(np.array([0, 2**32 - 1]), n),
    }[kind]().astype(np.uint32)
    data = token_files.pack_file(ids, [5, None], [n, 0])
    file = token_files.TokenFile(data)
    assert (file.ids() == ids).all() and file.doc_ids() == [5, None] and file.doc_length.tolist() == [n, 0]
    for a, b in ((0, n // 2), (n // 3, n), (n // 2, n // 2 + min(1, n - n // 2))):
        assert (file.ids(a, b) == ids[a:b]).all()
    if kind == "outliers" and n == 5000:
        assert 0 < len(file.place) < 0.06 * 5 * token_files.BLOCK and file.width.max() <= 10 and len(data) < 2 * n


def test_no_other_file_is_read():
    with pytest.raises(ValueError, match="token file"):
        token_files.TokenFile(b"something else, long enough to hold a header")


def test_byte_encoder_equals_the_library(odd_rows):
    library, own = Tokenizer.from_file(BYTE_FILE), token_files.ByteEncoder(BYTE_FILE)
    for text in TEXTS + [t for _, t, _, _ in odd_rows if t]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_token_archive(odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(BYTE_FILE)
    got = sorted(token_files.token_archive(odd_docs, BYTE_FILE, ("ids", "ids_crc32")).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(got) == len(odd_rows)
    want = {(d, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t, _, _ in odd_rows}
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and (r.doc_id, tuple(r.ids)) in want
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert token_files.token_archive(no_docs, BYTE_FILE).count() == 0


def test_files_stay_small(odd_docs, spark):
    from claimloom.plans.lineage import fresh_path

    folder = fresh_path(spark, "small-files")
    files = token_files.write_token_files(odd_docs, BYTE_FILE, folder, file_ids=500)
    assert files.count() > 10 and files.agg(F.sum("n_docs")).first()[0] == odd_docs.count()
    rows = sorted(token_files.read_token_files(files, folder, ()).collect(), key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
