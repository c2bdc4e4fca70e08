"""Byte-pair encoding and decoding for a word-end vocabulary, from merge ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import give_back

#: Entries a worker keeps of words already encoded, in each of two generations.
CACHED = 90_000
#: Longer runs without white space are not worth keeping.
CACHED_CHARS = 64
_SPACES = "\t-\r \x85\xa0  -     　"
_SPACE_RUN = re.compile(f"[{_SPACES}]+")
_ONLY_PYTHON_SPACES = re.compile("[\x1c-\x1f]")  # str.split() would cut there
# fixed value: the pattern that cuts words in the tokenizer file
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file (JSON with vocab, ranked merges and a word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *added.values()]) + 1)
        for token, number in (self.vocab | added).items():
            self.tokens[number] = token
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[left], self.vocab[right]] = rank, self.vocab[left + right]
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.symbols = byte_symbols()
        self._parts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the lowest-ranked merge until none is left.

        The symbols form a doubly linked list; a heap holds (rank, place) of neighbouring pairs. An
        entry is stale, and skipped, when its place is gone or no longer starts the pair it was made for.
        """
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(*merges[pair], i, pair) for i in range(n - 1) if (pair := (ids[i], ids[i + 1])) in merges]
        heap = [(rank, i, new, pair) for rank, new, i, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != pair[0] or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            after[j] = -1
            if after[i] >= 0:
                before[after[i]] = i
                if (right := (new, ids[after[i]])) in merges:
                    rank, made = merges[right]
                    heapq.heappush(heap, (rank, i, made, right))
            if before[i] >= 0 and (left := (ids[before[i]], new)) in merges:
                rank, made = merges[left]
                heapq.heappush(heap, (rank, before[i], made, left))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece; one that stands alone between white space is looked up alike."""
        found = self._parts.get(piece) or self._older.get(piece)
        if found is None:
            symbols = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.end
            found = np.array(self.merge([self.vocab[s] for s in symbols if s in self.vocab]), "<u4").tobytes()
        return self._kept(piece, found)

    def _kept(self, part: str, ids: bytes) -> bytes:
        """Two generations: when the newer is full it becomes the older, and what is met again moves on."""
        if len(part) <= CACHED_CHARS:
            if len(self._parts) >= CACHED:
                self._parts, self._older = {}, self._parts
            self._parts[part] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Little-endian ids of a run without white space."""
        found = self._older.get(chunk)
        if found is not None:
            return self._kept(chunk, found)
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        lowered = "".join(c.lower() for c in plain) if "Σ" in plain else plain.lower()  # no special form for a final sigma
        return self._kept(chunk, b"".join([self._piece(p) for p in _PIECE.findall(lowered)]))

    def _plain(self, text: str) -> bytes:
        chunks = [c for c in _SPACE_RUN.split(text) if c] if _ONLY_PYTHON_SPACES.search(text) else text.split()
        parts = list(map(self._parts.get, chunks))
        if None in parts:
            make = self._chunk
            parts = [make(c) if part is None else part for c, part in zip(chunks, parts, strict=True)]
        return b"".join(parts)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the strings of added tokens stand for themselves."""
        if self.cut is None or "<" not in text:
            packed = self._plain(text)
        else:
            packed = b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.cut.split(text) if p)
        return np.frombuffer(packed, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Vocabulary strings, in order, parted by spaces, as a tokenizer without decoder gives them."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The encoder of a file, made once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


_OUTPUTS = {
    "n_tokens": (pa.int64(), "long", lambda ids, text: len(ids)),
    "ids": (pa.list_(pa.int32()), "array<int>", lambda ids, text: ids.astype(np.int32)),
    "decoded": (pa.string(), "string", lambda ids, text: text()),
    "ids_sha256": (pa.string(), "string", lambda ids, text: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded_sha256": (pa.string(), "string", lambda ids, text: hashlib.sha256(text().encode("utf-8", "surrogatepass")).hexdigest()),
}


def encode_documents(docs: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """Encode, and where asked decode, every whole text; one row per row of ``docs``, in place.

    ``outputs`` chooses among n_tokens, ids, decoded, ids_sha256 and decoded_sha256 (digests of the
    ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8). ``tokenizer`` is
    the path of a tokenizer file that every executor has. Nothing is shuffled. Nulls: a null text
    is empty and has no ids; ids and repeated rows pass through. An empty table gives no rows. Other
    columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what a stage before has left
        bpe = loaded(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                columns: list[list] = [[] for _ in outputs]
                for value in part.column("text"):
                    ids, cache = bpe.encode(value.as_py() or ""), []

                    def text(ids=ids, cache=cache) -> str:
                        if not cache:
                            cache.append(bpe.decode(ids))
                        return cache[0]

                    for column, name in zip(columns, outputs, strict=True):
                        column.append(_OUTPUTS[name][2](ids, text))
                arrays = [part.column("doc_id"), *(pa.array(c, _OUTPUTS[n][0]) for c, n in zip(columns, outputs, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *outputs])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{n} {_OUTPUTS[n][1]}" for n in outputs)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
