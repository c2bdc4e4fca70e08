"""Token ids in binary files: patched frame-of-reference blocks with an index of their starts."""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path, stage
from ..plans.ranking import with_global_position
from .bpe import byte_symbols
from .warc import filesystem

BLOCK = 1024
#: Share of a block's values that its packed width must hold; the others are exceptions.
PERCENTILE = 0.95
#: A writer closes a file at the first document that takes it to this many ids.
FILE_IDS = 4 << 20
MAGIC = b"PFORIDS1"
#: Entries a worker keeps of parts of texts already encoded, in each of two generations.
CACHED, CACHED_CHARS = 500_000, 64

# --- blocks -----------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values, each below 2 ** width, as rows of ``width`` 64-bit words."""
    columns = np.ascontiguousarray(values.T)  # one place of all rows lies together
    words = np.zeros((width, len(values)), np.uint64)
    for j in range(64 if width else 0):
        at, shift = divmod(j * width, 64)
        words[at] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= columns[j] >> np.uint64(64 - shift)
    return words.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    values = np.zeros((64, len(words)), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        at, shift = divmod(j * width, 64)
        np.right_shift(columns[at], np.uint64(shift), out=values[j])
        if shift + width > 64:
            values[j] |= columns[at + 1] << np.uint64(64 - shift)
        values[j] &= mask
    return values.T


_HEADER = ("n_ids", "n_blocks", "n_words", "n_exceptions", "n_docs")
_SECTIONS = (  # name, type, counted by
    ("minimum", "<u4", "n_blocks"), ("width", "u1", "n_blocks"), ("start", "<u8", "n_blocks"), ("first_exception", "<u8", "n_blocks"),
    ("words", "<u8", "n_words"), ("place", "<u2", "n_exceptions"), ("high", "<u4", "n_exceptions"),
    ("doc_id", "<i8", "n_docs"), ("doc_null", "u1", "n_docs"), ("doc_length", "<u8", "n_docs"),
)


def pack_file(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A file of ids and the documents they belong to, in order.

    In each block of 1024 ids the smallest is subtracted; the rest is packed at the width that
    holds the 95th percentile. Of larger values the low bits are packed too, and their place and
    high bits go to the exception list. The index has the first word and exception of each block.
    """
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = padded[len(ids) - 1]
    blocks = padded.reshape(n_blocks, BLOCK)
    minimum = blocks.min(axis=1) if n_blocks else np.zeros(0, np.uint64)
    blocks = blocks - minimum[:, None]
    rank = int(PERCENTILE * (BLOCK - 1))
    held = np.partition(blocks, rank, axis=1)[:, rank] if n_blocks else minimum
    width = np.frexp(held.astype(np.float64))[1].astype(np.int64)  # bits of the value
    start = np.concatenate(([0], np.cumsum(width * (BLOCK // 64))))
    words = np.zeros(int(start[-1]), np.uint64)
    for w in np.unique(width):
        pick = np.flatnonzero(width == w)
        packed = _pack((blocks[pick] & np.uint64((1 << int(w)) - 1)).reshape(-1, 64), int(w))
        words[(start[pick][:, None] + np.arange(w * BLOCK // 64)).ravel()] = packed.ravel()
    high = blocks >> width[:, None].astype(np.uint64)
    block, place = np.nonzero(high)
    data = {
        "minimum": minimum, "width": width, "start": start[:-1], "first_exception": np.searchsorted(block, np.arange(n_blocks)),
        "words": words, "place": place, "high": high[block, place],
        "doc_id": np.array([0 if d is None else d for d in doc_ids], np.int64), "doc_null": np.array([d is None for d in doc_ids], np.uint8), "doc_length": np.array(lengths, np.uint64),
    }
    counts = np.array([len(ids), n_blocks, len(words), len(place), len(doc_ids)], "<u8")
    return b"".join([MAGIC, counts.tobytes(), *(np.asarray(data[name]).astype(kind).tobytes() for name, kind, _ in _SECTIONS)])


class TokenFile:
    """A packed file; any span of ids is read from the blocks it touches."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC) + 8 * len(_HEADER)
        self.counts = dict(zip(_HEADER, np.frombuffer(data, "<u8", len(_HEADER), len(MAGIC)).tolist(), strict=True))
        for name, kind, counted in _SECTIONS:
            values = np.frombuffer(data, kind, self.counts[counted], at)
            setattr(self, name, values)
            at += values.nbytes

    def doc_ids(self) -> list[int | None]:
        return [None if null else d for d, null in zip(self.doc_id.tolist(), self.doc_null.tolist(), strict=True)]

    def ids(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.counts["n_ids"] if stop is None else stop
        low, high = first // BLOCK, -(-stop // BLOCK)
        out = np.zeros((max(high - low, 0), BLOCK), np.uint64)
        width, start = self.width[low:high].astype(np.int64), self.start[low:high].astype(np.int64)
        for w in np.unique(width):
            pick = np.flatnonzero(width == w)
            words = self.words[(start[pick][:, None] + np.arange(w * BLOCK // 64)).ravel()]
            out[pick] = _unpack(words.reshape(-1, w) if w else np.zeros((len(pick) * BLOCK // 64, 0), np.uint64), int(w)).reshape(-1, BLOCK)
        bounds = np.append(self.first_exception, self.counts["n_exceptions"]).astype(np.int64)
        a, b = (bounds[low], bounds[high]) if high > low else (0, 0)
        block = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1])) if high > low else np.zeros(0, np.int64)
        out[block, self.place[a:b]] |= self.high[a:b].astype(np.uint64) << width[block].astype(np.uint64)
        out += self.minimum[low:high].astype(np.uint64)[:, None]
        return out.ravel()[first - low * BLOCK : stop - low * BLOCK].astype(np.uint32)


# --- encoding ---------------------------------------------------------------------------------

#: Characters that Python's classes and the tokenizer's count differently; parts with them go to the tokenizer as they are.
_CONTROL = re.compile("[\x1c-\x1f]")
_ODD = re.compile("[" + "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")) + "]")
# fixed value: the pre-tokenizer's pattern, in classes of Python's re
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER_SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace() and chr(c) not in " \n"]
_ENDINGS = frozenset(".,;:!?")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class ByteEncoder:
    """The tokenizers library's byte-level model, asked once for each distinct word.

    A single space between other characters always starts a new piece, so a text may be cut there
    and the ids of each part kept for the next time it occurs. The parts are kept in two
    generations: when the newer is full it becomes the older, and what is met again moves on, so
    frequent parts are never lost.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.symbols = dict(enumerate(byte_symbols()))
        self.space = self.symbols[0x20]
        self._parts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._marks = {m: self._piece(m) for m in _ENDINGS}

    def _piece(self, piece: str) -> bytes:
        return self._ids(piece.encode().decode("latin-1").translate(self.symbols))

    def _ids(self, symbols: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _part(self, part: str) -> bytes:
        """A part that follows a space: mostly letters, which are one piece, and a mark, which is another."""
        found = self._parts.get(part) or self._older.get(part)
        if found is None:
            if part.isalpha():
                found = self._ids(self.space + part) if part.isascii() else self._piece(" " + part)
            elif part[-1:] in _ENDINGS and part[:-1].isalpha():
                found = self._part(part[:-1]) + self._marks[part[-1]]
            else:
                found = self._fresh(" " + part)
        if len(part) <= CACHED_CHARS:
            if len(self._parts) >= CACHED:
                self._parts, self._older = {}, self._parts
            self._parts[part] = found
        return found

    def _fresh(self, part: str) -> bytes:
        if _CONTROL.search(part) or not part.isascii() and _ODD.search(part):
            return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self._piece(p) for p in _PIECE.findall(part)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        if any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        uneven = "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or any(c in text for c in _OTHER_SPACES)
        parts = _SINGLE_SPACE.split(text) if uneven else text.split(" ")
        packed = list(map(self._parts.get, parts))
        packed[0] = self._fresh(parts[0])
        if None in packed:
            part = self._part
            packed = [part(p) if found is None else found for p, found in zip(parts, packed, strict=True)]
        return b"".join(packed)


_LOADED: dict[str, ByteEncoder] = {}


def loaded(path: str) -> ByteEncoder:
    """The encoder of a file, made once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteEncoder(path)
    return _LOADED[path]


# --- files ------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write ids in ascending doc_id order.

    Returns the written table of files: part, number (their order), file, n_docs, n_ids and
    ``start``, the ids in all files before. Texts move once, by range of doc_id (null first; rows
    of one id by a hash of their text). A task writes files under names of its own, and only names
    that a finished task returned enter the table, so lost attempts leave no trace in it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store_at = loaded(tokenizer), filesystem(folder)
        store, at = store_at
        end = np.array([end_id], "<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        packed: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.pfor"
            with store.open_output_stream(f"{at}/{name}", compression=None) as f:
                f.write(pack_file(np.frombuffer(b"".join(packed), "<u4"), doc_ids, lengths))
            columns = ((part, pa.int32()), (number, pa.int32()), (name, pa.string()), (len(doc_ids), pa.int64()), (total, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], ["part", "number", "file", "n_docs", "n_ids"])

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                packed.append(encoder.encode(value.as_py()) + end)
                doc_ids.append(doc_id.as_py())
                lengths.append(len(packed[-1]) // 4)
                total += lengths[-1]
                if total >= file_ids:
                    yield flush()
                    packed, doc_ids, lengths, total, number = [], [], [], 0, number + 1
        if doc_ids:
            yield flush()

    store, at = filesystem(folder)
    store.create_dir(at, recursive=True)
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = stage(sorted_rows.mapInArrow(write, "part int, number int, file string, n_docs long, n_ids long"), "token-files")
    placed = with_global_position(files, [F.col("part"), F.col("number")], "position", "n_ids", "start")
    return placed.select("part", "number", "file", "n_docs", "n_ids", "start")


def read_token_files(files: DataFrame, folder: str, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, start, n_tokens and of each document ``ids`` or their ``ids_crc32``, from the files.

    One file is one unit of work.
    """
    kinds = {"ids": (pa.list_(pa.int64()), "array<long>"), "ids_crc32": (pa.int64(), "long")}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}") as f:
                    file = TokenFile(f.read())
                lengths = file.doc_length.astype(np.int64)
                stops = np.cumsum(lengths)
                ids = file.ids()
                spans = [ids[b - n : b] for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                made = {
                    "ids": lambda: [s.astype(np.int64) for s in spans],  # noqa: B023
                    "ids_crc32": lambda: [zlib.crc32(s.astype("<u4").tobytes()) for s in spans],  # noqa: B023
                }
                arrays = [pa.array(file.doc_ids(), pa.int64()), pa.array(start + stops - lengths), pa.array(lengths)]
                arrays += [pa.array(made[o](), kinds[o][0]) for o in outputs]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", *outputs])

    tasks = max(1, min(files.count(), 10_000))
    schema = ", ".join(["doc_id long, start long, n_tokens long", *(f"{o} {kinds[o][1]}" for o in outputs)])
    return files.select("file", "start").repartition(tasks).mapInArrow(read, schema)


def token_archive(docs: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("ids_crc32",)) -> DataFrame:
    """Write the ids of ``docs`` as files in the shared folder and read them back, one row per document.

    Nulls: a null text has only the end id; null ids come first and stay null. Rows repeated are
    written one by one. An empty table gives no files and no rows. Other columns are ignored.
    """
    folder = fresh_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, folder), folder, outputs)
