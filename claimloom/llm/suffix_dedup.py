"""Removal of passages that occur earlier in the corpus, by sorting the suffixes at sampled places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stage
from .rolling import RangeHash, key_filter
from .suffix_sort import byte_rows, common_prefixes, deep_shallow_order

#: Texts and bytes worked on at once, and runs, bytes of runs or rows a task holds before it hands them on.
BLOCK_TEXTS, BLOCK_BYTES, HELD_RUNS, HELD_BYTES, HELD_ROWS = 1000, 1 << 20, 1_000_000, 1 << 25, 20_000
#: An anchor around which more different runs than this are met is split into its single windows.
CROWD = 1000
_PLACE = np.uint64(2**24 - 1)


class _Block:
    """Runs of neighbouring windows of ``span`` bytes that share an anchor.

    The anchor of a window is the place of the smallest hash of ``seed`` bytes in it, the leftmost
    of equal ones. Equal windows have the same anchor, wherever they lie.
    """

    def __init__(self, data: np.ndarray, begin: int, offsets: np.ndarray, span: int, seed: int):
        self.data, self.hashes = data, RangeHash(data)
        seeds = self.hashes.windows(seed)
        least = (seeds & ~_PLACE) | np.arange(len(seeds), dtype=np.uint64)
        width, wanted = 1, span - seed + 1
        while width < wanted:
            step = min(width, wanted - width)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            width += step
        anchors = (least & _PLACE).astype(np.int64)
        first, last = np.searchsorted(offsets, [begin, begin + len(data)])
        ends = offsets[first : last + 1] - begin  # no window passes the end of a text
        crossing = np.zeros(len(anchors) + 1, np.int64)
        np.add.at(crossing, np.clip(ends - span + 1, 0, len(anchors)), 1)
        np.add.at(crossing, np.clip(ends, 0, len(anchors)), -1)
        inside = np.cumsum(crossing[:-1]) == 0
        joined = inside[1:] & inside[:-1] & (anchors[1:] == anchors[:-1])
        self.low = np.flatnonzero(inside & ~np.concatenate(([False], joined))[: len(inside)])
        self.high = np.flatnonzero(inside & ~np.concatenate((joined, [False]))[: len(inside)]) + span
        self.anchors = anchors[self.low]
        self.keys = seeds[self.anchors]
        self.texts = np.searchsorted(offsets, begin + self.low, side="right") - 1
        self.starts = begin + self.low - offsets[self.texts]  # in their text


def _blocks(batches: Iterable[pa.RecordBatch], span: int, seed: int) -> Iterator[tuple[pa.RecordBatch, _Block]]:
    """Blocks overlap by a window less one byte, so every window lies in exactly one of them."""
    for batch in (whole.slice(i, BLOCK_TEXTS) for whole in batches for i in range(0, whole.num_rows, BLOCK_TEXTS)):
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        for begin in range(0, len(data), BLOCK_BYTES):
            yield batch, _Block(data[begin : begin + BLOCK_BYTES + span - 1], begin, offsets - offsets[0], span, seed)


def _anchors(texts: DataFrame, span: int, seed: int) -> DataFrame:
    """(key, n): anchors that occur twice, with the number of different runs around them as tasks see them. Written once."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            keys, runs = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((runs, keys))
            keys, runs = keys[order], runs[order]
            new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
            firsts = np.flatnonzero(new_key)
            different = np.add.reduceat(new_key | np.concatenate(([True], runs[1:] != runs[:-1])), firsts, dtype=np.int64)
            met = np.diff(np.append(firsts, len(keys)))
            return pa.RecordBatch.from_arrays([pa.array(keys[firsts].view(np.int64)), pa.array(np.maximum(different, np.minimum(met, 2)))], ["key", "n"])

        for _, block in _blocks(batches, span, seed):
            held.append((block.keys, block.hashes.of(block.low, block.high)))
            if (n := n + len(block.keys)) > HELD_RUNS:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    met = texts.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return stage(met.filter("n > 1"), "anchors")


_RUNS = "key long, run binary, anchor int, id long, mark long, low long, high long"
_RUN_TYPES = (pa.int64(), pa.binary(), pa.int32(), *[pa.int64()] * 4)
_SPANS = "id long, mark long, low long, high long"


def _batch(rows: list[tuple], types: tuple, names: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [n.split()[0] for n in names.split(", ")])


class _Earliest:
    """Runs with the first place each was met at; what comes later is a span to be removed at once."""

    def __init__(self) -> None:
        self.runs: dict[tuple, tuple] = {}
        self.spans: list[tuple] = []
        self.size = 0

    def add(self, key: int, run: bytes, anchor: int, place: tuple) -> None:
        known = self.runs.get((key, run))
        if known is None:
            self.runs[key, run] = (place, anchor)
            self.size += len(run)
        elif known[0] == place:  # a repeated row: an empty span has it looked at
            self.span(place, place[2])
        elif known[0] < place:
            self.span(place, place[2] + len(run))
        else:
            self.runs[key, run] = (place, anchor)
            self.span(known[0], known[0][2] + len(run))

    def span(self, place: tuple, high: int) -> None:
        if self.spans and self.spans[-1][:2] == place[:2] and self.spans[-1][2] <= place[2] <= self.spans[-1][3]:
            place, high = self.spans[-1][:3], max(high, self.spans.pop()[3])
        self.spans.append((*place, high))


def _runs(texts: DataFrame, anchors: DataFrame, span: int, seed: int, crowd: int) -> DataFrame:
    """One row for each task and different run around a repeated anchor; rows without a run are spans to be removed."""
    context = texts.sparkSession.sparkContext
    repeated = context.broadcast(key_filter(anchors))  # at most 32 MB each
    crowded = context.broadcast(key_filter(anchors.filter(F.col("n") > crowd)))

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Earliest()

        def rows() -> Iterator[pa.RecordBatch]:
            found = [(key, run, anchor, *place, place[2] + len(run)) for (key, run), (place, anchor) in held.runs.items()]
            found += [(s[1], None, None, *s) for s in held.spans]
            for i in range(0, len(found), 50_000):
                yield _batch(found[i : i + 50_000], _RUN_TYPES, _RUNS)

        for batch, block in _blocks(batches, span, seed):
            ids, marks = batch.column("id").to_pylist(), batch.column("mark").to_pylist()
            raw, is_crowded = block.data.tobytes(), crowded.value.may_have(block.keys)
            for i in np.flatnonzero(repeated.value.may_have(block.keys)).tolist():
                low, high, text = int(block.low[i]), int(block.high[i]), block.texts[i]
                start = int(block.starts[i])
                if is_crowded[i]:  # by its single windows, which are spread by their own hashes
                    windows = np.arange(low, high - span + 1)
                    for at, key in zip(windows.tolist(), block.hashes.of(windows, windows + span).view(np.int64).tolist(), strict=True):
                        held.add(key, raw[at : at + span], 0, (ids[text], marks[text], start + at - low))
                else:
                    held.add(int(block.keys[i].view(np.int64)), raw[low:high], int(block.anchors[i]) - low, (ids[text], marks[text], start))
            if held.size > HELD_BYTES or len(held.spans) > HELD_RUNS:
                yield from rows()
                held = _Earliest()
        yield from rows()

    return texts.mapInArrow(collect, _RUNS)


def _repeats(rows: list[tuple], span: int) -> list[tuple]:
    """Spans that occur earlier, from all runs around some anchors.

    The suffixes that start at the anchors, and what stands before the anchors read backwards, are
    sorted. Windows with d bytes before the anchor are equal where neighbours in both orders share
    d bytes before and span - d bytes behind it; the earliest of equal ones stays.
    """
    held = _Earliest()
    for key, run, anchor, *place, _ in rows:
        held.add(key, run, anchor, tuple(place))
    around: dict[int, int] = {}
    for key, _ in held.runs:
        around[key] = around.get(key, 0) + 1
    several = [(place[0], place[1], place[2] + anchor, anchor, run) for (key, run), (place, anchor) in held.runs.items() if around[key] > 1]
    several.sort(key=lambda r: r[:3])
    if several:
        behind = [run[anchor:] for *_, anchor, run in several]
        before = [run[:anchor][::-1] for *_, anchor, run in several]
        repeated = np.zeros((len(several), max(map(len, before)) + 2), bool)  # by place of the window in its run
        anchors, n = np.array([r[3] for r in several]), np.arange(len(several))
        orders = []
        for side in (behind, before):
            matrix, lengths = byte_rows(side)
            order = deep_shallow_order(side, matrix)
            orders.append((order, common_prefixes(matrix, lengths, order), lengths))
        for d in range(int(anchors.max()) + 1):
            code = np.zeros(len(several), np.int64)
            for (order, shared, _), depth in zip(orders, (span - d, d), strict=True):
                classes = np.empty(len(several), np.int64)
                classes[order] = np.cumsum(shared < depth)
                code = code * (len(several) + 1) + classes
            have = n[(orders[0][2] >= span - d) & (anchors >= d)]
            _, first = np.unique(code[have], return_index=True)
            later = np.delete(have, first)
            repeated[later, anchors[later] - d] = True
        edge = np.diff(np.pad(repeated, ((0, 0), (1, 0))).astype(np.int8), axis=1)
        for i, low, high in zip(*np.nonzero(edge == 1), np.nonzero(edge == -1)[1], strict=True):
            id_, mark, at, anchor, _ = several[i]
            held.spans.append((id_, mark, at - anchor + int(low), at - anchor + int(high) - 1 + span))
    return held.spans


def repeated_spans(docs: DataFrame, span: int = 100, seed: int = 32, crowd: int = CROWD) -> DataFrame:
    """(id, mark, low, high): byte spans of rows that are covered by strings of ``span`` bytes met earlier.

    ``id`` and ``mark`` name a row as in ``_keyed``; spans of a row may overlap. An empty span marks
    a row that occurs more than once. Written once.
    """
    texts = _keyed(docs)
    anchors = _anchors(texts, span, seed)

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        spans: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] is None:
                    spans.append(row[3:])
                    continue
                if len(held) >= HELD_ROWS and held[-1][0] != row[0]:  # all runs of an anchor together
                    spans += _repeats(held, span)
                    held = []
                held.append(row)
            if len(spans) > HELD_ROWS:
                yield _batch(spans, _RUN_TYPES[3:], _SPANS)
                spans = []
        spans += _repeats(held, span)
        yield _batch(spans, _RUN_TYPES[3:], _SPANS)

    dealt = _runs(texts, anchors, span, seed, crowd).repartition("key").sortWithinPartitions("key")
    return stage(dealt.mapInArrow(sort, _SPANS), "spans")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what orders and names a row: id (null last) and a 64-bit hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    last = F.lit(2**63 - 1)
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), last).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("mark"))


_OUT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "spans": "array<struct<low:long,high:long>>", "kept": "binary"}
_OUT_TYPES = dict(zip(_OUT, (*[pa.int64()] * 3, pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary()), strict=True))


def remove_repeats(docs: DataFrame, span: int = 100, columns: tuple[str, ...] = tuple(_OUT), crowd: int = CROWD) -> DataFrame:
    """doc_id and, of a row's text without the bytes that strings of ``span`` bytes met earlier cover, ``columns``.

    n_bytes (before), n_removed, n_spans and spans (the maximal removed runs of bytes), kept_sha256
    and kept (the bytes left, joined; a cut may fall inside a character). Every string is judged on
    the input, not on what is left. Earlier is a smaller doc_id, or an earlier start in the same
    text; matches never cross texts. Of rows with the same doc_id the one with the smaller hash of
    its text is the earlier; a null doc_id comes last. A row repeated with the same id and text
    stays once, the others lose all if they have ``span`` bytes. A null text is empty. An empty
    table gives no rows. Other columns are ignored.

    Suffixes are sorted only at anchors, which every string of ``span`` bytes has at the same place:
    anchors that occur once are told by a count of their hashes, and of equal runs of bytes around
    an anchor a task hands on the earliest. The filters sent to all tasks have at most 32 MB. Runs
    around an anchor with more than about ``crowd`` different ones are split into their windows, so
    no task sorts a crowd.
    """
    texts, spans = _keyed(docs), repeated_spans(docs, span, crowd=crowd)
    touched = spans.select(F.xxhash64("id", "mark").alias("key"))
    marked = docs.sparkSession.sparkContext.broadcast(key_filter(touched))  # at most 32 MB
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def outcome(text: bytes, cuts: list[tuple[int, int]]) -> tuple:
        merged: list[list[int]] = []
        for low, high in sorted(cuts):
            if low == high:
                continue
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        ends = [0, *(x for m in merged for x in m), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
        found = (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"low": a, "high": b} for a, b in merged], kept)
        return tuple(x for x, name in zip(found, _OUT, strict=True) if name in columns)

    names = [c for c in _OUT if c in columns]

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that nothing is cut from need not move: their outcome is final unless a span says otherwise."""
        for batch in (b.slice(i, BLOCK_TEXTS) for b in batches for i in range(0, b.num_rows, BLOCK_TEXTS)):
            may = marked.value.may_have(batch.column("key").to_numpy().view(np.uint64))
            texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            done = [(None,) * len(names) if m else outcome(t, []) for m, t in zip(may.tolist(), texts, strict=True)]
            moved = pa.array([t if m else None for m, t in zip(may.tolist(), texts, strict=True)], pa.binary())
            none = pa.nulls(len(may), pa.int64())
            own = [pa.array([r[i] for r in done], _OUT_TYPES[c]) for i, c in enumerate(names)]
            keys = [batch.column(c) for c in ("doc_id", "id", "mark")]
            yield pa.RecordBatch.from_arrays([*keys, moved, none, none, *own], ["doc_id", "id", "mark", "moved", "low", "high", *names])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cuts, seen = None, [], False
        for batch in batches:
            rows, ids = [], []
            lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            done = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            for i, key in enumerate(zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), strict=True)):
                if key != place:
                    place, cuts, seen = key, [], False
                if lows[i] is not None:
                    cuts.append((lows[i], highs[i]))
                    continue
                text = batch.column("moved")[i].as_py()
                if text is None:
                    rows.append(done[i])
                else:
                    rows.append(outcome(text, [(0, len(text))] if seen and len(text) >= span else cuts))
                ids.append(i)
                seen = True
            if rows:
                own = [pa.array(list(c), _OUT_TYPES[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), *own], ["doc_id", *names])

    fields = [f"{c} {_OUT[c]}" for c in names]
    prepared = texts.withColumn("key", F.xxhash64("id", "mark")).mapInArrow(
        whole, ", ".join([f"doc_id {id_type}, id long, mark long, moved binary, low long, high long", *fields])
    )
    together = prepared.unionByName(spans, allowMissingColumns=True).repartition("id", "mark").sortWithinPartitions("id", "mark", F.col("low").asc_nulls_last())
    return together.mapInArrow(cut, ", ".join([f"doc_id {id_type}", *fields])).select("doc_id", *columns)
