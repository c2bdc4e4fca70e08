"""Near duplicates by n-gram Jaccard: a blocked sparse product of the document by n-gram incidence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.similarity import connected_components
from ..plans.lineage import stage
from .common import apart_from, checked_broadcast, give_back, lowest_count

WORDS = 5
#: Two documents link when their Jaccard similarity is NUM / DEN or more.
NUM, DEN = 75, 100
#: Independent minima per document, for the first links within groups of near copies.
MINIMA = 4
#: Largest column of the incidence that is multiplied where it lies; larger ones are cut into cells.
DENSE = 64
#: Rows of one side of a cell.
CELL = 1000
#: An n-gram in this many documents of one task is reported; the most frequent ones sort last.
LOCAL_REPEATS = 4
COMMON = 500_000
#: Incidence entries per block of the product, and n-grams a counting task holds.
BLOCK_ENTRIES, HELD = 250_000, 1_000_000
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)[:MINIMA]
#: Bits of a set's parity sketch; nodes of a second round of first links, and its random stars.
SKETCH, CROWD, STARS = 1024, 16, 3


# --- n-gram sets --------------------------------------------------------------------------------


class _WordHashes(dict):
    """64-bit hashes of words, kept for the next time; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a whole text, A-Z lower-cased.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(ids))
    if not size:
        return ids
    mixed = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k]
    return np.unique(_mixed(mixed))


def node_of(grams: np.ndarray) -> int:
    """Identity of a set: a signed 64-bit digest of its members."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(grams: np.ndarray) -> bytes:
    """Parity of the members that fall on each of ``SKETCH`` bits.

    Members of both sets cancel, so two sketches differ in at most as many bits as there are
    members of one set only. That bounds the overlap from above.
    """
    return np.packbits(np.bincount((grams & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def long_sketch(grams: np.ndarray) -> bytes | None:
    """Of a large set, whose short sketch is full, a longer one: at least two bits a member, by powers of two."""
    if 2 * len(grams) <= SKETCH:
        return None
    bits = 1 << (2 * len(grams) - 1).bit_length()
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two long sketches differ, the longer folded onto the shorter: parities of its parts add up."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def may_overlap(differ: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b whose sketches differ in so many bits can still link."""
    return (a + b - differ) // 2 >= least_overlap(a, b)


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest intersection of sets of these sizes that links them."""
    return -(-(NUM * (a + b)) // (NUM + DEN))


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


# --- passes over the texts ------------------------------------------------------------------------


def _summaries(docs: DataFrame) -> DataFrame:
    """One row per document (set, size, minima), and rows (gram, seen) of n-grams repeated in a task. Written once."""
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, node long, n long, minima array<long>, sketch binary, long_sketch binary, key long, n_seen long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        names = ["doc_id", "node", "n", "minima", "sketch", "long_sketch", "key", "n_seen"]

        def repeats(id_type: pa.DataType) -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL_REPEATS
            k = int(often.sum())
            columns = [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(_signed(grams[often])), pa.array(counts[often].astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            nodes, sizes, minima, sketches, longer = [], [], [], [], []
            for text in batch.column("text"):
                grams = shingles(text.as_py())
                sizes.append(len(grams))
                nodes.append(node_of(grams) if len(grams) else None)
                minima.append(_signed(_mixed(grams ^ _SEEDS[:, None]).min(axis=1)) if len(grams) else None)
                sketches.append(sketch(grams) if len(grams) else None)
                longer.append(long_sketch(grams))
                if len(grams) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    held.append(grams)
                    size += len(grams)
            n = batch.num_rows
            columns = [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(minima, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(longer, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)
            if size > HELD:
                yield repeats(id_type)
                held, size = [], 0
                seen.clear()
        if held:
            yield repeats(id_type)
        _HASHES.clear()  # a worker lives on for other tasks
        give_back()

    return stage(docs.select("doc_id", "text").mapInArrow(run, schema), "summaries")


def _entries(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, node, n, place, wide): the incidence entries that a link cannot avoid.

    All sets are ordered alike: n-grams that are not common by hash, then common ones by count and
    hash. A linked pair shares a member among the first n - ceil(3n/4) + 1 of each. A task gives
    each set once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON n-grams

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        maybe = np.zeros(1 << 22, bool)  # most n-grams are not common, and are told so by their first bits
        maybe[keys >> np.uint64(42)] = True
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                parts: list[list] = [[], [], [], []]  # entries, common flags; node and size of each set
                for text in batch.slice(start, 512).column("text"):
                    grams = shingles(text.as_py())
                    n = len(grams)
                    if not n or (node := node_of(grams)) in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(node)
                    kept = n - -(-NUM * n // DEN) + 1
                    wide = maybe[grams >> np.uint64(42)]
                    if wide.any():
                        hits = np.flatnonzero(wide)
                        at = np.minimum(np.searchsorted(keys, grams[hits]), len(keys) - 1)
                        real = keys[at] == grams[hits]
                        wide[hits[~real]] = False
                        last, at = hits[real], at[real]
                        order = np.concatenate((np.flatnonzero(~wide), last[np.lexsort((grams[last], counts[at]))]))[:kept]
                        grams, wide = grams[order], wide[order]
                    for part, value in zip(parts, (grams[:kept], wide[:kept], node, n), strict=True):
                        part.append(value)
                if parts[0]:
                    key, wide = np.concatenate(parts[0]), np.concatenate(parts[1])
                    lengths = np.array([len(k) for k in parts[0]])
                    node, size = np.repeat(np.array(parts[2], np.int64), lengths), np.repeat(np.array(parts[3], np.int64), lengths)
                    place = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(key)), pa.array(node), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(wide)],
                        ["key", "node", "n", "place", "wide"],
                    )
        _HASHES.clear()
        give_back()

    return docs.select("text").mapInArrow(run, "key long, node long, n int, place int, wide boolean")


def _sets(rows: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(carry..., node, grams): the sets of rows with a text, with long columns carried along."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [shingles(t.as_py()) for t in part.column("text")]
                columns = [part.column(c) for c in carry] + [pa.array([node_of(g) for g in found], pa.int64()), pa.array([g.tobytes() for g in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*carry, "node", "grams"])
        _HASHES.clear()
        give_back()

    schema = ", ".join([*(f"{c} long" for c in carry), "node long", "grams binary"])
    return rows.select(*carry, "text").mapInArrow(run, schema)


# --- products -------------------------------------------------------------------------------------


def _may_link(n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether entries of one column may belong to a link: sizes near enough, enough left from this place on."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    return (DEN * small >= NUM * large) & (np.minimum(n[a] - place[a], n[b] - place[b]) >= least_overlap(n[a], n[b]))


def _small_products(
    starts: np.ndarray, stops: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, group: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within small columns, across components, all columns of one length at a time."""
    length = stops - starts
    for size in np.unique(length).tolist():
        i, j = np.triu_indices(size, 1)
        of_size = starts[length == size]
        step = max(1, 500_000 // max(len(i), 1))  # bounded temporaries
        for first in range(0, len(of_size), step):
            at = of_size[first : first + step, None]
            a, b = (at + i).ravel(), (at + j).ravel()
            ok = (group[a] != group[b]) & _may_link(n, place, a, b)
            yield node[a[ok]], node[b[ok]]


def _cell_products(
    starts: np.ndarray, stops: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, side: np.ndarray, group: np.ndarray, signs: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within cells: ``side`` is 0 where both sides are the same rows, else 1 and 2.

    Pairs inside a known component are settled. Sketches, as rows of signs, multiply to the
    number of bits that agree less those that differ.
    """
    for first, stop in zip(starts.tolist(), stops.tolist(), strict=True):
        rows = np.arange(first, stop)
        if side[first:stop].any():
            left, right = rows[side[first:stop] == 1], rows[side[first:stop] == 2]
        else:
            left = right = rows
        if not len(left) or not len(right):
            continue
        other = signs[right].astype(np.float32).T
        for i in range(0, len(left), 256):  # bounded temporaries
            mine = left[i : i + 256]
            a, b = mine[:, None], right[None, :]
            ok = _may_link(n, place, a, b) & (group[a] != group[b])
            ok &= node[a] < node[b] if left is right else node[a] != node[b]
            differ = (SKETCH - signs[mine].astype(np.float32) @ other).astype(np.int64) // 2
            x, y = np.nonzero(ok & may_overlap(differ, n[a], n[b]))
            yield node[mine[x]], node[right[y]]


def _counted(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Accumulated counts of each pair, smaller node first."""
    if not pairs:
        none = np.zeros(0, np.int64)
        return none, none, none
    a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(new)
    return low[at], high[at], np.diff(np.append(at, len(low)))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of runs of equal sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(new))


def _columns(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray]:
    held = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches]
    return [np.concatenate(c) for c in zip(*held, strict=True)] if held else []


_MET = "key long, node long, n int, place int, large boolean, home long"


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one block of columns the entries of those with several rows; ``home`` is a column's smallest node."""
    columns = _columns(batches, ("key", "node", "n", "place", "wide"))
    if not columns:
        return
    order = np.argsort(columns[0])
    starts, stops = _runs(columns[0][order])
    met = np.repeat((stops - starts > 1) | columns[4][order][starts], stops - starts)
    order = order[met]  # an n-gram of one set links nothing
    order = order[np.lexsort((columns[1][order], columns[0][order]))]
    key, node, n, place, wide = (c[order] for c in columns)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # a set may come from several tasks
    key, node, n, place, wide = (c[new] for c in (key, node, n, place, wide))
    starts, stops = _runs(key)
    length = stops - starts
    large = wide[starts] | (length > DENSE)
    kept = np.repeat(large | (length > 1), length)
    spread = [np.repeat(large, length)[kept], np.repeat(node[starts] if len(starts) else starts, length)[kept]]
    arrays = [key[kept], node[kept], n[kept].astype(np.int32), place[kept].astype(np.int32), *spread]
    yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), ["key", "node", "n", "place", "large", "home"])
    give_back()


def _multiplied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the small columns that one task holds, counted over all of them."""
    columns = _columns(batches, ("key", "node", "n", "place", "component"))
    if not columns:
        return
    order = np.lexsort((columns[1], columns[0]))
    key, node, n, place, component = (c[order] for c in columns)
    starts, stops = _runs(key)
    a, b, shared = _counted(list(_small_products(starts, stops, node, n.astype(np.int64), place.astype(np.int64), component)))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared.astype(np.int64))], ["a", "b", "shared"])


def _products(entries: DataFrame, components: DataFrame, blocks: int) -> DataFrame:
    """(a, b, shared): pairs within small columns, across components.

    Columns that lie within one component are settled and dropped. The others go by their smallest
    node, so columns with the same rows meet in one task and a pair of them is made and counted once.
    """
    known = components.select("node", "component")
    rows = stage(entries.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "small-columns")
    open_ = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return rows.join(open_, "key").repartition(blocks, "home").select("key", "node", "n", "place", "component").mapInArrow(_multiplied, "a long, b long, shared long")


def _cell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of large columns: pairs of rows in different components."""
    columns = _columns(batches, ("key", "row", "col", "side", "node", "n", "place", "component", "sketch"))
    if not columns:
        return
    order = np.lexsort((columns[2], columns[1], columns[0]))
    key, row, col, side, node, n, place, component, sketches = (c[order] for c in columns)
    bits = np.unpackbits(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(key), -1), axis=1)
    signs = bits.view(np.int8) * np.int8(2) - np.int8(1)
    starts, stops = _runs(key, row, col)
    a, b, shared = _counted(list(_cell_products(starts, stops, node, n.astype(np.int64), place.astype(np.int64), side, component, signs)))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared.astype(np.int64))], ["a", "b", "shared"])


def _grid(entries: DataFrame, components: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs within large columns of the incidence, across components.

    In each column the rows of its largest component are *settled* among themselves. The others
    are cut into parts of at most ``CELL`` rows; every part meets every part of others, and of the
    settled rows. Near copies linked before make one component, so a column of many near copies
    and a few strangers costs one pass over its rows.
    """
    known = components.select("node", "component")
    rows = entries.dropDuplicates(["key", "node"]).join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stage(rows, "wide-columns")
    per = rows.groupBy("key", "component").agg(F.count("*").alias("rows"))
    columns = stage(
        per.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("rows").alias("rows"), F.max(F.struct("rows", "component")).alias("major"))
        .filter("kinds > 1")
        .select(
            "key", F.col("major.component").alias("major"),
            F.ceil((F.col("rows") - F.col("major.rows")) / CELL).cast("int").alias("parts"),
            F.ceil(F.col("major.rows") / CELL).cast("int").alias("major_parts"),
        ),
        "wide-keys",
    )
    joined = stage(rows.join(columns, "key"), "wide-cells").join(classes.select("node", "sketch"), "node")
    settled = F.col("component") == F.col("major")
    own = F.pmod(F.xxhash64("node"), F.when(settled, F.col("major_parts")).otherwise(F.col("parts"))).cast("int")
    at = joined.withColumn("own", own)
    # a settled part j meets parts 0 ... parts - 1 in cells (i, parts + j)
    of_settled = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.struct(i.alias("row"), (F.col("parts") + F.col("own")).alias("col"), F.lit(2).alias("side")),
    )
    of_others = F.concat(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda i: F.struct(
                F.least(i, F.col("own")).alias("row"), F.greatest(i, F.col("own")).alias("col"),
                F.when(i == F.col("own"), 0).when(i > F.col("own"), 1).otherwise(2).alias("side"),
            ),
        ),
        F.transform(
            F.sequence(F.lit(0), F.col("major_parts") - 1),
            lambda j: F.struct(F.col("own").alias("row"), (F.col("parts") + j).alias("col"), F.lit(1).alias("side")),
        ),
    )
    cells = at.withColumn("cell", F.explode(F.when(settled, of_settled).otherwise(of_others)))
    cells = cells.select("key", "cell.row", "cell.col", "cell.side", "node", "n", "place", "component", "sketch")
    return cells.repartition("key", "row", "col").mapInArrow(_cell, "a long, b long, shared long")


# --- verification ---------------------------------------------------------------------------------


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for left, right in zip(batch.column("grams"), batch.column("other"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
            both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            linked.append(DEN * both >= NUM * (len(x) + len(y) - both))
        mask = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _compare_sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("a_sketch", "b_sketch"))
        a, b = (batch.column(c).to_numpy() for c in ("a_n", "b_n"))
        ok = may_overlap(np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64), a, b) & (DEN * np.minimum(a, b) >= NUM * np.maximum(a, b))
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _compare_long_sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_sketch", "b_sketch"))
        ok = [x is None or y is None or bool(may_overlap(bits_apart(x, y), m, n)) for m, n, x, y in zip(*columns, strict=True)]
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches leave open; no link is among the others. Written once."""
    mine = classes.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    other = classes.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    joined = stage(pairs.select("a", "b"), "pairs").join(mine, "a").join(other, "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    near = stage(joined.mapInArrow(_compare_sketches, "a long, b long"), "near")
    mine = classes.filter("long_sketch is not null").select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("long_sketch").alias("a_sketch"))
    other = classes.filter("long_sketch is not null").select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("long_sketch").alias("b_sketch"))
    longer = near.join(mine, "a", "left").join(other, "b", "left").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    return stage(longer.mapInArrow(_compare_long_sketches, "a long, b long"), "plausible")


def _across(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    mine = components.select(F.col("node").alias("a"), F.col("component").alias("a_part"))
    other = components.select(F.col("node").alias("b"), F.col("component").alias("b_part"))
    return pairs.join(mine, "a", "left").join(other, "b", "left").filter(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link, by their whole sets. Written once.

    Texts are read again for the sets in question only; the sets of ``a`` move once, to those of ``b``.
    """
    first = classes.select(F.col("node").alias("a"), F.col("first_id").alias("_id"))
    second = classes.select(F.col("node").alias("b"), F.col("first_id").alias("_id"))
    left = stage(pairs.select("a", "b").join(first, "a"), "left")
    right = stage(pairs.select("b").distinct().join(second, "b").select("b", "_id"), "right")
    texts = docs.select("doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    ours = _sets(texts.join(checked_broadcast(left), same), ("a", "b")).filter("node = a").select("a", "b", "grams")
    theirs = _sets(texts.join(checked_broadcast(right), same), ("b",)).filter("node = b").select("b", F.col("grams").alias("other"))
    return stage(ours.join(theirs, "b").select("a", "b", "grams", "other").mapInArrow(_compare, "a long, b long").distinct(), "links")


def _components(edges: DataFrame) -> DataFrame:
    return connected_components(edges) if not edges.isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _labelled_rows(docs: DataFrame) -> DataFrame:
    """Rows of ``near_duplicates`` with their set's node and the node of the component's smallest doc_id."""
    found = _summaries(docs)
    rows = found.filter("n is not null").select("doc_id", "node", "n", "minima", "sketch", "long_sketch")
    classes = stage(
        rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("sketch").alias("sketch"), F.first("long_sketch").alias("long_sketch")), "sets"
    )
    repeated = found.filter("key is not null").groupBy("key").agg(F.sum("n_seen").alias("n"))
    repeated = stage(repeated, "repeated")
    cut = lowest_count(repeated, COMMON)
    top = (repeated.limit(0) if cut is None else repeated.filter(F.col("n") >= cut)).select("key", "n").toArrow()
    keys, counts = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    common = keys[order], counts[order]

    minima = classes.select("node", F.posexplode("minima").alias("which", "least"))
    group = ["which", "least"]
    leaders = stage(minima.groupBy(*group).agg(F.min("node").alias("b"), F.count("*").alias("nodes")).filter("nodes > 1"), "leaders")
    star = minima.join(leaders, group).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = _linked(docs, classes, _plausible(star, classes))
    settled = _components(links)

    crowds = leaders.filter(F.col("nodes") > CROWD).select(*group, "nodes")
    members = stage(minima.join(crowds, group).join(settled.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node")), "crowds")
    open_ = members.groupBy(*group).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select(*group)
    near = stage(members.join(stage(open_, "open"), group).select("node", *group, "nodes", F.explode(F.array(*[F.lit(i) for i in range(STARS)])).alias("star")), "near")
    bucket = F.pmod(F.xxhash64("node", "star"), F.ceil(F.col("nodes") / CROWD)).alias("bucket")
    near = near.select("node", *group, "star", bucket)
    centres = stage(near.groupBy(*group, "star", "bucket").agg(F.min("node").alias("b")), "centres")
    random = near.join(centres, [*group, "star", "bucket"]).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = links.unionByName(_linked(docs, classes, _plausible(_across(random, settled), classes)))
    settled = _components(links)

    entries = classes.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    blocks = max(-(-entries // BLOCK_ENTRIES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    apart = F.when(F.col("wide"), F.xxhash64("node")).otherwise(0)  # entries of common n-grams go anywhere
    met = stage(_entries(docs, common).repartition(blocks, "key", apart).mapInArrow(_met, _MET), "met")
    small = _products(met.filter("not large"), settled, blocks)
    wide = _grid(met.filter("large").select("key", "node", "n", "place"), settled, classes)
    counted = small.unionByName(wide).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    candidates = _plausible(_across(counted, settled), classes)
    links = links.unionByName(_linked(docs, classes, candidates))

    parts = _components(links)
    labelled = classes.join(parts, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    lowest = F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("lowest")  # a null id after all others
    smallest = stage(labelled.groupBy("component").agg(lowest).select("component", F.col("lowest.first_id").alias("component_id"), F.col("lowest.node").alias("keep_node")), "smallest")
    labels = stage(labelled.join(smallest, "component").select("node", "component_id", "keep_node"), "labels")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "node", "keep_node"]
    empty = rows.filter("node is null").withColumn("component_id", F.col("doc_id")).withColumn("keep_node", F.col("node")).select(*columns)
    return rows.filter("node is not null").join(labels, "node").select(*columns).unionByName(empty)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``.

    Documents with the same set are one node of the incidence. The steps:

    1. One pass gives every document its set's identity, size and ``MINIMA`` independent minima, and
       finds n-grams repeated inside a task.
    2. Nodes that share a minimum are compared with the smallest node that has it, then, where a
       crowd shares one and is not yet one component, with the smallest of some random sixteen.
       What links makes the first components: a few comparisons per member settle large groups.
    3. Another pass gives the leading entries of every node, common n-grams last, in blocks of
       columns, which keep the columns of several rows. Those across components meet again by
       their smallest node; there they are multiplied and shared entries counted per pair; pairs
       whose sizes, or what is left of either set, cannot reach the threshold are discarded, and
       so are those whose parity sketches differ in too many bits. Large columns are multiplied in
       cells, across components only.
    4. Pairs still in different components are compared by their whole sets, and components are
       closed over all links.

    No link between different texts is lost: components need only links across components. Sets
    hold 64-bit hashes. Nulls: a null text, or one without words, links with nothing and is its own
    component; a null id counts as larger than any other. Rows repeated share one set. An empty
    table gives no rows. Other columns are ignored.
    """
    return _labelled_rows(docs).select("doc_id", "n_shingles", "component_id")


def _with_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the node of their text; null without words."""
    for batch in batches:
        sets = (shingles(text.as_py()) for text in batch.column("text"))
        yield batch.append_column("_node", pa.array([node_of(grams) if len(grams) else None for grams in sets], pa.int64()))
    _HASHES.clear()  # a worker lives on for other tasks


@apart_from("doc_id", "text")
def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id, and all its columns.

    Ids need not be unique: rows are told apart by id and set of n-grams, and rows alike in both by
    nothing, so any one of them stays. A null id counts as larger than any other. Rows without
    words all stay.

    Ids of which every row goes are dropped by id; texts are read again only under ids that are
    null or of which some rows go and some stay.
    """
    stays = F.col("node").isNull() | (F.col("node") == F.col("keep_node")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    pairs = stage(_labelled_rows(docs).select("doc_id", "node", stays.alias("stays")).groupBy("doc_id", "node", "stays").agg(F.count("*").alias("n")), "near-copies")
    twin = F.col("stays") & F.col("node").isNotNull() & (F.col("n") > 1)
    ids = stage(pairs.groupBy("doc_id").agg(F.bool_or("stays").alias("some"), F.bool_and(F.col("stays") & ~twin).alias("whole")).filter("not whole"), "ids")
    gone = stage(ids.filter("doc_id is not null and not some").select(F.col("doc_id").alias("_gone_id")), "gone")
    mixed = stage(ids.filter("doc_id is null or some").select("doc_id"), "mixed")
    rows = docs.join(checked_broadcast(gone), docs["doc_id"] == F.col("_gone_id"), "left_anti")
    if mixed.isEmpty():
        return rows
    named = checked_broadcast(mixed.filter("doc_id is not null").select(F.col("doc_id").alias("_mixed_id")))
    unnamed = not mixed.filter("doc_id is null").isEmpty()
    null = F.col("doc_id").isNull() & F.lit(unnamed)  # apart, for no join of so many rows of one id
    sure = rows.filter(~null).join(named, F.col("doc_id") == F.col("_mixed_id"), "left_anti")
    open_ = rows.filter(~null).join(named, F.col("doc_id") == F.col("_mixed_id"), "left_semi").unionByName(rows.filter(null))
    read = open_.mapInArrow(_with_nodes, StructType([*docs.schema.fields, StructField("_node", LongType())]))
    asked = pairs.join(checked_broadcast(mixed.withColumnRenamed("doc_id", "_mixed_id")), F.col("doc_id").eqNullSafe(F.col("_mixed_id")), "left_semi")
    lost = stage(asked.filter("not stays").select(F.col("doc_id").alias("_id"), F.col("node").alias("_of")), "lost")
    twins = stage(asked.filter(twin).select(F.col("doc_id").alias("_id"), F.col("node").alias("_of")), "twins")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_of"))
    left = read.join(checked_broadcast(lost), same, "left_anti")
    single = left.join(checked_broadcast(twins), same, "left_anti")
    merged = left.join(checked_broadcast(twins), same, "left_semi").dropDuplicates(["doc_id", "_node"])
    return sure.unionByName(single.unionByName(merged).drop("_node"))
