"""Language-model scores from a weighted backoff automaton over smoothed n-grams.

The model is every n-gram seen ``least`` times, and grows with the corpus; no task holds it. Texts
are packed into blocks once. Level by level each block sends its distinct n-grams, packed, to the
range of their context, where counts meet and go back in the order they came. From those a block
builds the part of the automaton that its own texts can reach, and walks them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stage
from .common import give_back

#: Tokens of a block, tokens whose n-grams one range counts, words whose keys a task remembers; scores depend on none.
BLOCK_TOKENS, RANGE_TOKENS, HELD_WORDS = 2_000_000, 1 << 21, 400_000
#: Bits of the filter that tells most n-grams seen too rarely, and pieces it is merged in; it saves work, scores do not depend on it.
FILTER_BITS, SLICE_BITS = 28, 6
END = b""  # no word is empty, so the end of a text can take the empty one
HASH_BITS = 40  # an n-gram goes by its context and so many bits of the rest; a context has few n-grams in one range, see hot_of

#: What a range says to no block in particular goes under these block numbers.
FILTER, HOT, TOTALS = -1, -2, -3
ANSWER = "block long, place int, a binary, b binary, c binary"


def held_out(doc_id: object, modulus: int = 7, rest: int = 2) -> bool:
    """Whether a document is kept from training; a null id counts as the empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == rest


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, then the end."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space
    found.append(END)
    return found


# --- packed numbers ------------------------------------------------------------------------------


def pack(numbers: np.ndarray, width: int | None = None) -> bytes:
    """Numbers of 0 or more as planes of bytes, compressed; as many planes as the largest needs."""
    numbers = np.ascontiguousarray(numbers, dtype="<u8")
    width = width or max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(numbers), width) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    size, width = struct.unpack_from("<QB", packed)
    planes = np.zeros((size, 8), np.uint8)
    if size:
        flat = pa.decompress(packed[9:], decompressed_size=size * width, codec="zstd", asbytes=True)
        planes[:, :width] = np.frombuffer(flat, np.uint8).reshape(width, size).T
    return planes.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


def joined(context: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """64-bit key of an n-gram from the key of its context and the hash of what follows."""
    x = context ^ (rest * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


# --- blocks of texts -----------------------------------------------------------------------------


class _WordKeys(dict):
    """64-bit keys of words, kept for the next time; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def pack_texts(docs: DataFrame) -> DataFrame:
    """Blocks of whole texts: their ids, lengths, distinct words as keys, and which word stands where. Written once.

    Each text begins with the end of another, the context of its first word.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number = _WordKeys(), TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[np.ndarray] = []
        size, id_type = 0, pa.null()

        def block() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate(held), return_inverse=True)
            columns = [
                pa.array([number], pa.int64()), pa.array([size - len(held)], pa.int64()), pa.array([ids], pa.list_(id_type)),
                *(pa.array([x], pa.binary()) for x in (pack(np.array([len(x) for x in held])), pack_sorted(words), pack(at))),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "n", "ids", "lengths", "words", "at"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = tokens(text.as_py())
                if held and size + len(words) > BLOCK_TOKENS:
                    yield block()
                    number, ids, held, size = number + 1, [], [], 0
                ids.append(doc_id)
                held.append(np.fromiter(map(keys.__getitem__, [END, *words]), np.uint64, len(words) + 1))
                size += len(words) + 1
        if held:
            yield block()
        held = []
        keys.clear()
        give_back()

    schema = f"block long, n long, ids array<{kind}>, lengths binary, words binary, at binary"
    return stage(docs.select("doc_id", "text").mapInArrow(blocks, schema), "blocks")


class Level:
    """Distinct n-grams of a block: keys, which of the level below is the context and which the rest, training count."""

    def __init__(self, keys: np.ndarray, context: np.ndarray, rest: np.ndarray, last: np.ndarray, counts: np.ndarray, at: np.ndarray):
        self.keys, self.context, self.rest, self.last, self.counts, self.at = keys, context, rest, last, counts, at


class Block:
    """A block of texts, read back: its n-grams level by level, and the parcels they travel in."""

    def __init__(self, row: dict, bits: int):
        self.bits, self.ids = bits, row["ids"]
        self.held = np.array([held_out(x) for x in self.ids], bool)
        lengths = unpack(row["lengths"]).astype(np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.training = ~np.repeat(self.held, lengths)
        words, at = unpack_sorted(row["words"]), unpack(row["at"]).astype(np.int32)
        counts = np.bincount(at[self.from_place(1) & self.training], minlength=len(words))
        nothing = np.zeros(0, np.int32)
        self.levels = [Level(words, nothing, nothing, np.arange(len(words), dtype=np.int32), counts, at)]

    def from_place(self, least: int) -> np.ndarray:
        """Whether a token stands at the place ``least`` of its text or later; the end before it has place 0."""
        inside = np.ones(len(self.training), bool)
        for i in range(least):
            inside[self.starts[self.lengths > i] + i] = False
        return inside

    def extend(self, bits: list[bytes]) -> Level:
        """The n-grams one longer, of those whose context and rest pass the filter."""
        top, depth = self.levels[-1], len(self.levels)
        maybe = passes(bits, top.keys)
        good = top.at >= 0
        good[good] = maybe[top.at[good]]
        ends = np.flatnonzero(self.from_place(depth)[1:] & good[1:] & good[:-1]) + 1
        del good
        found, inverse = np.unique((top.at[ends - 1].astype(np.int64) << 32) | top.at[ends], return_inverse=True)
        context, rest = (found >> 32).astype(np.int32), (found & 0xFFFFFFFF).astype(np.int32)
        place = np.full(len(top.at), -1, np.int32)
        place[ends] = inverse
        counts = np.bincount(inverse[self.training[ends]], minlength=len(found)).astype(np.int32)
        top.maybe = maybe
        self.levels.append(Level(joined(top.keys[context], rest_hash(top.keys[rest])), context, rest, top.last[rest], counts, place))
        return self.levels[-1]

    def parcels(self, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Entries (context, range) of the last level and its n-grams in the order they are sent.

        A context goes to one range; one of the hot ones to several, its n-grams dealt by hash, and
        is named in each of them so that each says what it counted.
        """
        below, top = self.levels[-2:]
        contexts = np.flatnonzero(below.maybe)
        keys = below.keys[contexts]
        shares = np.ones(len(keys), np.int64)
        if len(hot[0]):
            near = np.minimum(np.searchsorted(hot[0], keys), len(hot[0]) - 1)
            shares = np.where(hot[0][near] == keys, hot[1][near], 1)
        first = np.cumsum(shares) - shares
        owner = np.repeat(np.arange(len(keys)), shares)
        salt = np.arange(len(owner)) - first[owner]
        ranges = (_range_of(keys, self.bits)[owner] + salt) & ((1 << self.bits) - 1)
        order = np.lexsort((keys[owner], ranges))
        where = np.empty_like(order)
        where[order] = np.arange(len(order))
        rank = np.zeros(len(below.keys), np.int64)
        rank[contexts] = np.arange(len(contexts))
        mine = rank[top.context]
        rest = rest_hash(below.keys[top.rest])
        entry = where[first[mine] + (rest % shares[mine].astype(np.uint64)).astype(np.int64)]
        grams = np.lexsort((rest, entry))
        return contexts[owner[order]], ranges[order], grams, entry[grams], rest[grams]


def rest_hash(keys: np.ndarray) -> np.ndarray:
    """What tells an n-gram from others of its context: ``HASH_BITS`` bits of the key of the rest."""
    return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# --- counting ------------------------------------------------------------------------------------


def passes(pieces: list[bytes], keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the table the filter was made of."""
    size = 1 << (FILTER_BITS - SLICE_BITS - 3)
    bits = np.concatenate([np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), np.uint8) if x else np.zeros(size, np.uint8) for x in pieces])
    at = keys >> np.uint64(64 - FILTER_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _answer(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "place", "a", "b", "c"])


def _said_to_all(keys: np.ndarray, n: np.ndarray, share: int) -> list[tuple]:
    """Pieces of the filter of the kept keys, and those counted so often that they must be split as contexts."""
    at = np.unique(keys >> np.uint64(64 - FILTER_BITS))
    piece = (at >> np.uint64(FILTER_BITS - SLICE_BITS)).astype(np.int64)
    rows = [(FILTER, int(p), pack_sorted(at[piece == p]), b"", b"") for p in np.unique(piece)]
    hot = np.flatnonzero(n > share)
    if len(hot):
        rows.append((HOT, 0, pack(keys[hot]), pack(-(-n[hot] // share)), b""))
    return rows


def count_level(sent: DataFrame, depth: int, least: int, share: int) -> DataFrame:
    """What each range of contexts counted: its answer to each block, in the block's own order. Written once."""

    def words(table: pa.Table) -> pa.Table:
        blocks, place = table.column("block").to_pylist(), table.column("place")[0].as_py()
        keys = [unpack_sorted(x) for x in table.column("a").to_pylist()]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate([unpack(x) for x in table.column("b").to_pylist()]), len(found)).astype(np.int64)
        kept = n >= max(least, 1)
        rows = _said_to_all(found[kept], n[kept], share)
        rows.append((TOTALS, place, pack(np.array([n.sum(), (n > 0).sum()])), b"", b""))
        ends = np.cumsum([len(x) for x in keys])[:-1]
        rows += [(block, place, pack(n[x]), b"", b"") for block, x in zip(blocks, np.split(at, ends), strict=True)]
        return _answer(rows)

    def grams(table: pa.Table) -> pa.Table:
        blocks, place = table.column("block").to_pylist(), table.column("place")[0].as_py()
        entries = [unpack_sorted(x) for x in table.column("a").to_pylist()]
        follow = np.concatenate([unpack(x) for x in table.column("b").to_pylist()]).astype(np.int64)
        rest = [unpack(x) for x in table.column("c").to_pylist()]
        own = np.concatenate([unpack(x) for x in table.column("d").to_pylist()])
        contexts, which = np.unique(np.concatenate(entries), return_inverse=True)
        context = np.repeat(which, follow)
        keys, first, at = np.unique(joined(contexts[context], np.concatenate(rest)), return_index=True, return_inverse=True)
        n = np.bincount(at, own, len(keys)).astype(np.int64)
        kept = n >= max(least, 1)
        mass = np.bincount(context[first[kept]], n[kept], len(contexts)).astype(np.int64)
        kinds = np.bincount(context[first[kept]], minlength=len(contexts))
        rows = _said_to_all(keys[kept], n[kept], share)
        n[~kept] = 0
        e = np.cumsum([len(x) for x in entries])[:-1]
        g = np.cumsum([len(x) for x in rest])[:-1]
        for block, x, y in zip(blocks, np.split(at, g), np.split(which, e), strict=True):
            rows.append((block, place, pack(n[x]), pack(mass[y]), pack(kinds[y])))
        return _answer(rows)

    return stage(sent.groupBy("place").applyInArrow(words if depth == 1 else grams, ANSWER), "answers")


def filter_of(answers: DataFrame) -> list[bytes]:
    """The merged filter, in packed pieces: a bit for the first ``FILTER_BITS`` bits of every kept key; its size is bounded."""
    width = 1 << (FILTER_BITS - SLICE_BITS)

    def merge(table: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        for x in table.column("a"):
            bits[unpack_sorted(x.as_py()) & np.uint64(width - 1)] = True
        packed = pa.compress(np.packbits(bits, bitorder="little").tobytes(), codec="zstd", asbytes=True)
        return pa.table([table.column("place")[:1], pa.array([packed], pa.binary())], ["place", "bits"])

    bits = [b""] * (1 << SLICE_BITS)
    pieces = answers.filter(F.col("block") == FILTER).select("place", "a")
    for row in pieces.groupBy("place").applyInArrow(merge, "place int, bits binary").collect():
        bits[row.place] = bytes(row.bits)
    return bits


def hot_of(answers: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts to split and into how many shares, by key.

    A context counts for a fixed part of a range at least, so they are few; and a share holds so
    few n-grams that two of one hash are not to be expected in it.
    """
    rows = answers.filter(F.col("block") == HOT).select("a", "b").collect()
    keys = np.concatenate([unpack(r.a) for r in rows]) if rows else np.zeros(0, np.uint64)
    shares = np.concatenate([unpack(r.b) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    order = np.argsort(keys)
    return keys[order], np.minimum(shares[order], ranges)


def send_level(blocks: DataFrame, depth: int, bits: int, model: Callable[[], tuple[list, list]]) -> DataFrame:
    """A row a block and range: contexts, how many n-grams each has, hashes of their rest, training counts."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, hot = model()
        for row in _rows(batches):
            block = Block(row, bits)
            for level in range(1, depth):
                block.extend(filters[level - 1])
            if depth == 1:
                entries = block.levels[0].keys
                ranges, counts = _range_of(entries, bits), block.levels[0].counts
            else:
                contexts, ranges, grams, entry, rest = block.parcels(hot[depth - 2])
                entries, counts = block.levels[-2].keys[contexts], block.levels[-1].counts[grams]
                follow = np.bincount(entry, minlength=len(entries))
                ends = np.concatenate(([0], np.cumsum(follow)))
            del block
            give_back()
            for p in np.unique(ranges):
                low, high = np.searchsorted(ranges, p), np.searchsorted(ranges, p, "right")
                if depth == 1:
                    parcel = pack_sorted(entries[low:high]), pack(counts[low:high]), b"", b""
                else:
                    a, z = ends[low], ends[high]
                    parcel = pack_sorted(entries[low:high]), pack(follow[low:high]), pack(rest[a:z], HASH_BITS // 8), pack(counts[a:z])
                columns = [pa.array([row["block"]], pa.int64()), pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in parcel)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "place", "a", "b", "c", "d"])
        give_back()

    return blocks.select("block", "ids", "lengths", "words", "at").mapInArrow(send, "block long, place int, a binary, b binary, c binary, d binary")


# --- the automaton -------------------------------------------------------------------------------


class Automaton:
    """States with weighted arcs; a failure arc leads to the state of the next shorter context.

    State 0 is the empty context and has an arc for every word. The other arcs are sorted codes
    ``state * words + word`` with a log10 probability and the state they lead to. Where a state has
    no arc for a word, its failure weight is added and the search goes on in its failure state.
    """

    def __init__(self, word_score: np.ndarray, word_state: np.ndarray):
        self.word_score, self.word_state, self.n_words = word_score, word_state, len(word_score)
        self.arcs, self.arc_score, self.arc_state = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.fail_score, self.fail_state = np.zeros(1), np.zeros(1, np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of a word in each state, and the states it leads to."""
        score, after = np.zeros(len(word)), np.zeros(len(word), np.int64)
        left = np.arange(len(word))
        while len(left):
            s, w = state[left], word[left]
            root = s == 0
            score[left[root]] += self.word_score[w[root]]
            after[left[root]] = self.word_state[w[root]]
            left, s, w = left[~root], s[~root], w[~root]
            if not len(left):
                break
            code = s * self.n_words + w  # int64 times int32 stays int64
            arc = np.minimum(np.searchsorted(self.arcs, code), max(len(self.arcs) - 1, 0))
            hit = self.arcs[arc] == code if len(self.arcs) else np.zeros(len(code), bool)
            score[left[hit]] += self.arc_score[arc[hit]]
            after[left[hit]] = self.arc_state[arc[hit]]
            left, s = left[~hit], s[~hit]
            score[left] += self.fail_score[s]
            state[left] = self.fail_state[s]
        return score, after

    def walk(self, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 probability of each text, read from left to right; the texts go in step, each with its own state."""
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        total, state = np.zeros(len(order)), self.word_state[at[begin]]
        running = len(order)
        for i in range(1, int(size[0]) if len(size) else 0):
            while running and size[running - 1] <= i:
                running -= 1
            score, state = self.step(state[:running].copy(), at[begin[:running] + i])
            total[:running] += score
        out = np.empty(len(order))
        out[order] = total
        return out


def build_automaton(levels: list[Level], seen: list[np.ndarray], mass: list[np.ndarray], kinds: list[np.ndarray], total: int, vocabulary: int) -> Automaton:
    """Interpolated Witten-Bell weights over the n-grams of some texts, under counts of the whole corpus.

    A context seen c times, whose t kept continuations were seen m times in all, gives a kept word w the
    probability n(w) / (max(c, m) + t) + left * p(w in the failure state), where left is what the
    kept counts leave; every other word has left * p(w in the failure state). Each state sums to one.
    A context without kept continuations is no state of its own, for it would only fail, at no cost.
    """
    chance = (seen[0] + 1) / (total + vocabulary + 1)
    order, n_words = len(levels), len(chance)
    bases = np.cumsum([1, *(len(x.keys) for x in levels[:-1])])
    shorter = np.zeros(n_words, np.int64)  # where each n-gram of a level fails to
    fails, codes, scores, targets = [], [], [], []
    word_state = np.zeros(n_words, np.int64)
    for depth, level in enumerate(levels):
        if depth:
            kept = np.flatnonzero(seen[depth] > 0)
            a, b = level.context[kept], level.rest[kept]
            p = np.zeros(len(level.keys))
            p[kept] = seen[depth][kept] / below[a] + left[a] * chance[b]
            chance, shorter = p, state[level.rest]
        if depth + 1 < order:
            below = np.maximum(seen[depth], mass[depth]) + kinds[depth]
            left = np.where(kinds[depth] > 0, 1 - mass[depth] / np.maximum(below, 1), 1.0)
            fails.append((np.log10(left), shorter))
            entered = np.where(kinds[depth] > 0, bases[depth] + np.arange(len(level.keys)), shorter)
        else:
            entered = shorter
        if depth:
            codes.append((bases[depth - 1] + a.astype(np.int64)) * n_words + level.last[kept])
            scores.append(np.log10(p[kept]))
            targets.append(entered[kept])
        else:
            word_state = entered
        state = entered
    built = Automaton(np.log10((seen[0] + 1) / (total + vocabulary + 1)), word_state)
    if codes:
        arcs = np.concatenate(codes)
        place = np.argsort(arcs, kind="stable")
        built.arcs, built.arc_score, built.arc_state = arcs[place], np.concatenate(scores)[place], np.concatenate(targets)[place]
        built.fail_score = np.concatenate([[0.0], *(x for x, _ in fails)])
        built.fail_state = np.concatenate([[0], *(x for _, x in fails)])
    return built


def score_block(block: Block, answers: dict[int, list[dict]], model: tuple[list, list], total: int, vocabulary: int) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each text of a block."""
    filters, hot = model
    depths = len(filters) + 1

    def told(depth: int, column: str) -> np.ndarray:
        parts = [unpack(r[column]) for r in sorted(answers.get(depth, ()), key=lambda r: r["place"])]
        return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)

    seen, mass, kinds = [told(1, "a")], [], []
    for depth in range(2, depths + 1):
        level = block.extend(filters[depth - 2])
        contexts, _, grams, _, _ = block.parcels(hot[depth - 2])
        n = np.zeros(len(level.keys), np.int64)
        n[grams] = told(depth, "a")
        size = len(block.levels[-2].keys)
        mass.append(np.bincount(contexts, told(depth, "b"), size).astype(np.int64))
        kinds.append(np.bincount(contexts, told(depth, "c"), size).astype(np.int64))
        seen.append(n)
    built = build_automaton(block.levels, seen, mass, kinds, total, vocabulary)
    at = block.levels[0].at
    of_word = np.where(block.from_place(1), built.word_score[at], 0.0)
    base = np.add.reduceat(of_word, block.starts)
    known = np.add.reduceat(block.from_place(1) & (seen[0][at] > 0), block.starts, dtype=np.int64)
    block.levels.clear()
    return block.lengths - 1, known, base, built.walk(at, block.starts, block.lengths)


def score_documents(docs: DataFrame, order: int = 3, least: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Words are counted over all training documents, then n-grams level by level up to ``order``
    words, over all of them too. Every n-gram seen ``least`` times or more is in the model, which
    grows with the data. Words go by 64-bit hashes there, longer n-grams by that of their context
    and 48 bits of the rest.

    ``base_score`` is the add-one unigram score, ``score`` that of the interpolated n-grams, both
    log10 of the whole text and its end. Nulls: a null text is empty (only the end is scored), a
    null id counts as the empty text. Rows repeated are scored one by one. An empty table gives no
    rows; without training documents every token has probability one. Other columns are ignored.
    """
    spark = docs.sparkSession
    blocks = pack_texts(docs)
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(FILTER_BITS - 6, max(0, int(size // RANGE_TOKENS).bit_length()))
    share = max(RANGE_TOKENS // 4, 1)
    shared, answers = None, []
    filters: list[list[bytes]] = []
    hot: list[tuple[np.ndarray, np.ndarray]] = []
    total = vocabulary = 0
    for depth in range(1, order + 1):
        shared = spark.sparkContext.broadcast((list(filters), list(hot)))  # filters of fixed size, few hot contexts
        answered = count_level(send_level(blocks, depth, bits, lambda shared=shared: shared.value), depth, least, share)
        answers.append(answered.filter(F.col("block") >= 0).withColumn("depth", F.lit(depth)))
        if depth == 1:
            sums = [unpack(r.a) for r in answered.filter(F.col("block") == TOTALS).select("a").toLocalIterator()]
            total, vocabulary = (int(sum(int(x[i]) for x in sums)) for i in (0, 1))
        if depth < order:
            filters.append(filter_of(answered))
            hot.append(hot_of(answered, 1 << bits))
    told = answers[0]
    for more in answers[1:]:
        told = told.unionByName(more)
    where = blocks.select("block", F.lit(0).alias("place"), F.encode("_metadata.file_path", "utf-8").alias("a"), *(F.lit(b"").alias(c) for c in "bc"), F.lit(0).alias("depth"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(said: pa.Table) -> pa.Table:
        by_depth: dict[int, list[dict]] = {}
        for r in said.to_pylist():
            by_depth.setdefault(r["depth"], []).append(r)
        texts = read_block(by_depth[0][0]["a"].decode(), by_depth[0][0]["block"])
        id_type = texts.schema.field("ids").type.value_type
        block = Block(texts.to_pylist()[0], bits)
        n, known, base, own = score_block(block, by_depth, shared.value, total, vocabulary)
        columns = [pa.array(block.ids, id_type), pa.array(block.held), pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(base), pa.array(own)]
        del block, by_depth
        give_back()
        return pa.table(columns, [f.split(" ")[0] for f in schema.split(", ")])

    return told.unionByName(where).groupBy("block").applyInArrow(score, schema)


def read_block(path: str, block: int) -> pa.Table:
    """A written block, read where its answers have met instead of being sent there."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        return pq.ParquetFile(file).read().filter(pc.field("block") == block)
