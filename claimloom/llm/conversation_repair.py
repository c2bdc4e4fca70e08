"""Cheapest repair of the structure of conversations, by dynamic programming over runs of equal rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stage
from .common import checked_broadcast

#: A row's symbol is ``4 * class + fault``, its class by the first letter of its role.
CLASSES, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
OTHER = 3
#: States of the wanted form ``(s?(ua)+)?``: nothing yet, behind s, behind u, behind a; the last and the first may end it.
START, S, U, A = range(4)
STATES = range(4)
#: The next state by a kept row's class, and by an inserted or re-roled one.
_KEPT = {(START, 0): S, (START, 1): U, (S, 1): U, (A, 1): U, (U, 2): A}
_ALTERNATE = (U, U, A, U)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_ROLES = {U: "user", A: "assistant"}
#: A run whose rows' text occurs in more turns than this has its turns told apart by a broadcast, not a shuffle.
HOT_TURNS = 10_000

Vector = tuple[int, ...]


def _edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of what can be done to a row itself."""
    kind, fault = divmod(symbol, 4)
    yield "D", DELETE, state
    if FAULTS[fault] in ("", "truncated"):
        more = TRUNCATED if FAULTS[fault] else 0
        if (state, kind) in _KEPT:
            yield "K", more, _KEPT[state, kind]
        yield "R", REROLE + more, _ALTERNATE[state]


def _with_inserts(costs: list[list[int]]) -> tuple[Vector, ...]:
    """A transition's costs where up to two rows may be inserted before it; more never pay."""
    once = [[min(c, INSERT + b) for c, b in zip(costs[q], costs[_ALTERNATE[q]], strict=True)] for q in STATES]
    return tuple(tuple(min(c, INSERT + b) for c, b in zip(once[q], once[_ALTERNATE[q]], strict=True)) for q in STATES)


@cache
def _power(symbol: int, k: int) -> tuple[Vector, ...]:
    """The min-plus transition of 2 ** k rows of one symbol, from state (row) to state (column)."""
    if k:
        half = _power(symbol, k - 1)
        return tuple(tuple(min(half[q][m] + half[m][r] for m in STATES) for r in STATES) for q in STATES)
    far = 10**15
    costs = [[far] * 4 for _ in STATES]
    for q in STATES:
        for _, cost, to in _edits(symbol, q):
            costs[q][to] = min(costs[q][to], cost)
    return _with_inserts(costs)


def _before(symbol: int, n: int, after: Vector) -> Vector:
    """The costs to the end ahead of ``n`` equal rows, given those behind them."""
    k = 0
    while n:
        if n & 1:
            step = _power(symbol, k)
            after = tuple(min(step[q][r] + after[r] for r in STATES) for q in STATES)
        n, k = n >> 1, k + 1
    return after


#: Costs behind the last row: nothing may be open.
_END: Vector = (0, 2 * INSERT, INSERT, 0)


@lru_cache(100_000)
def _row(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """The ASCII-least cheapest edits at one row, inserts before it included, and the state behind it."""
    here, audit = _before(symbol, 1, after), ""
    while True:
        found = {initial: to for initial, cost, to in _edits(symbol, state) if cost + after[to] == here[state]}
        if INSERT + here[_ALTERNATE[state]] == here[state] and "D" not in found:
            audit, state = audit + "I", _ALTERNATE[state]
        else:
            initial = min(found)
            return audit + initial, found[initial]


@lru_cache(20_000)
def _unrolled(symbol: int, k: int, state: int, after: Vector) -> tuple[str, int]:
    """The edits of 2 ** k equal rows; ``after`` counts from its smallest cost, so few different ones occur."""
    if not k:
        return _row(symbol, state, after)
    middle = _before(symbol, 1 << (k - 1), after)
    first, state = _unrolled(symbol, k - 1, state, _lowered(middle))
    second, state = _unrolled(symbol, k - 1, state, after)
    return first + second, state


def _lowered(costs: Vector) -> Vector:
    least = min(costs)
    return tuple(c - least for c in costs)


def cheapest_repair(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Cost and audit of rows given as (symbol, how many) runs."""
    behind = [_END]
    for symbol, n in reversed(runs):
        behind.append(_before(symbol, n, behind[-1]))
    cost, state, audit = behind.pop()[START], START, []
    for symbol, n in runs:
        after = behind.pop()
        while n:
            k = n.bit_length() - 1
            n -= 1 << k
            part, state = _unrolled(symbol, k, state, _lowered(_before(symbol, n, after)))
            audit.append(part)
    audit.append({START: "", S: "II", U: "I", A: ""}[state])
    return cost, "".join(audit)


@lru_cache(50_000)
def _judged(runs: tuple[tuple[int, int], ...]) -> tuple:
    """(blank, duplicate, truncated, illegal, cost, audit) of a conversation's runs."""
    faults = [sum(n for symbol, n in runs if symbol % 4 == f) for f in (1, 2, 3)]
    kinds = [symbol // 4 for symbol, _ in runs]
    legal = sum(pair in ((0, 1), (1, 2), (2, 1)) for pair in zip(kinds, kinds[1:], strict=False))
    rows = sum(n for _, n in runs)
    return (*faults, max(rows - 1, 0) - legal, *cheapest_repair(list(runs)))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults: conv_id, turn, role, text.

    crc32(``conv_id:turn``) modulo 20 decides: 0 drops a row, 1 empties its text, 2 takes its
    ``.!?``, 3 repeats it, 4 sets its role to user. A null counts as one space.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    changed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    changed = changed.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return changed.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and a digest of role and text, by which rows of one turn are ordered."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, first, rest, n): how many equal rows a turn has, and the symbols of the first and the others.

    Equal rows of a turn are counted before anything moves. Texts in many turns are told by
    their smallest turn, in a broadcast for the few that are very frequent.
    """
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(CLASSES) for x in (c, i))), F.substring("role", 1, 1)), F.lit(OTHER))
    fault = F.when(end == "", 1).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    cells = rows.select("conv_id", "turn", "digest", (4 * kind).alias("kind"), fault.alias("fault"))
    cells = stage(cells.groupBy("conv_id", "turn", "digest", "kind", "fault").agg(F.count("*").alias("n")), "turns")
    several = cells.filter("fault <> 1").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("turns"))
    several = stage(several.filter("turns > 1").withColumnsRenamed({"conv_id": "of", "digest": "text"}), "copies")

    def told(part: DataFrame, known: DataFrame) -> DataFrame:
        same = part["conv_id"].eqNullSafe(known["of"]) & (part["digest"] == known["text"])
        return part.join(known, same, "left")

    hot = told(cells, checked_broadcast(several.filter(F.col("turns") > HOT_TURNS)))
    rest = hot.filter("earliest is null").select(*cells.columns)
    both = hot.filter("earliest is not null").unionByName(told(rest, several.filter(F.col("turns") <= HOT_TURNS)))
    later = F.col("earliest").isNotNull() & ~F.col("earliest.turn").eqNullSafe(F.col("turn"))
    blank = F.col("fault") == 1
    first = F.col("kind") + F.when(~blank & later, 2).otherwise(F.col("fault"))
    return both.select("conv_id", "turn", "digest", first.alias("first"), (F.col("kind") + F.when(blank, 1).otherwise(2)).alias("rest"), "n")


_PIECES = "conv_id {id}, part int, symbols array<int>, counts array<long>, turns long, low long, high long"


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal symbols and the turns of each conversation, as far as they lie in this range of rows."""
    part, current, done, id_type = TaskContext.get().partitionId(), None, [], None

    def rows() -> pa.RecordBatch:
        kinds = (id_type, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 3)
        columns = zip(*((p[0], part, *p[1:]) for p in done), strict=True)
        names = ["conv_id", "part", "symbols", "counts", "turns", "low", "high"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        id_type = batch.column("conv_id").type
        for conv, turn, first, rest, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "first", "rest", "n")), strict=True):
            if current is None or current[0] != conv:
                if current:
                    done.append(current)
                current = [conv, [], [], 0, None, None]
            for symbol, more in ((first, 1), (rest, n - 1)):
                if more and current[1] and current[1][-1] == symbol:
                    current[2][-1] += more
                elif more:
                    current[1].append(symbol)
                    current[2].append(more)
            if turn is not None and turn != current[5]:
                current[3] += 1
                current[4], current[5] = turn if current[4] is None else current[4], turn
        if len(done) > 10_000:
            yield rows()
            done = []
    if current:
        done.append(current)
        yield rows()


_JUDGED = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for pieces in batch.column("pieces").to_pylist():
            runs: list[tuple[int, int]] = []
            turns, low, high = 0, None, None
            for piece in pieces:
                for symbol, n in zip(piece["symbols"], piece["counts"], strict=True):
                    if runs and runs[-1][0] == symbol:
                        n += runs.pop()[1]
                    runs.append((symbol, n))
                if piece["low"] is not None:
                    turns += piece["turns"] - (high == piece["low"])  # a turn cut in two counts once
                    low, high = piece["low"] if low is None else low, piece["high"]
            found.append((0 if low is None else high - low + 1 - turns, *_judged(tuple(runs))))
        columns = zip(*found, strict=True) if found else [[]] * 7
        kinds = [*[pa.int64()] * 6, pa.string()]
        names = ["conv_id", *(c.split()[0] for c in _JUDGED.split(", ")[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)


def judge_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Written once.

    Rows are ranged by conversation and turn, so a long conversation lies in many tasks; what comes
    together is its runs of equal symbols.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ("conv_id", "turn", "digest")
    ranged = _symbols(_ordered(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stage(ranged.drop("digest").mapInArrow(_pieces, _PIECES.format(id=kind)), "runs")
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "symbols", "counts", "turns", "low", "high"))).alias("pieces"))
    return stage(whole.mapInArrow(_judge, _JUDGED.format(id=kind)), "audits")


def _repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, all in one task that reads them once."""
    texts = _ordered(rows).withColumn("audit", F.lit(None).cast("string"))
    heads = judged.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest"), "audit")
    both = heads.unionByName(texts).withColumn("row", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "digest").select("conv_id", "role", "text", "audit")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, str, str, str]]:
    """(conv_id, edit, role, text) of every row of the repaired conversations; edit ``""`` opens one."""
    audit, at, state, conv = "", 0, START, None

    def inserted() -> Iterator[tuple[object, str, str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, _ALTERNATE[state]
            yield conv, "I", _ROLES[state], ""

    for batch in batches:
        for conv_id, role, text, own in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")), strict=True):
            if own is not None:
                audit, at, state, conv = own, 0, START, conv_id
                yield conv, "", "", ""
            else:
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = _KEPT[state, CLASSES.index(role[0])]
                    yield conv, edit, role, text
                elif edit == "R":
                    state = _ALTERNATE[state]
                    yield conv, edit, _ROLES[state], text
            yield from inserted()


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text of the repaired conversations; see ``repair_conversations``."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found, position, id_type = ["conv_id", "position", "edit", "role", "text"], [], 0, None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column("conv_id").type
                yield batch

        def out() -> pa.RecordBatch:
            kinds = (id_type, pa.int64(), *[pa.string()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for conv, edit, role, text in _walk(watched()):
            position = position + 1 if edit else -1
            if edit:
                found.append((conv, position, edit, role, text))
            if len(found) >= 1000:
                yield out()
                found = []
        if found:
            yield out()

    return _repaired(rows, judge_conversations(rows)).mapInArrow(write, f"conv_id {kind}, position long, edit string, role string, text string")


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows stand by turn (null first), rows of one turn by a digest of role and text.
    A row's first fault counts: blank (nothing but ASCII white space), duplicate (role and text seen
    earlier), truncated (not ending in ``. ! ?``). ``illegal`` counts neighbours whose role initials
    are not su, ua or au; ``gaps`` counts missing turns between the smallest and the largest. Edits
    keep a row (0), change its role to user or assistant (2), delete it (3; blank and duplicate rows
    must go), or insert an empty user or assistant row (2); a truncated row that stays costs 1. The
    audit is the initials K, R, D, I of the cheapest edits that give ``(s?(ua)+)?``, of equal ones
    the ASCII-least. repaired_sha256 is of the repaired rows as ``role:text`` lines.

    Equal neighbours form runs; a run of n rows is passed by powers of its min-plus transition.
    Conversations of ``ids`` (column conv_id) without rows get zeros, an empty audit and the hash of
    the empty string. A null role or text is one space; a null conv_id is a conversation of its own;
    repeated rows are duplicates. An empty table gives only ``ids``. Other columns are ignored. The
    digest of one conversation is taken by one task, which reads its rows as a stream.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    judged = judge_conversations(rows)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        current, id_type = None, None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column("conv_id").type
                yield batch

        def out() -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (id_type, pa.string()), strict=True)], ["conv_id", "repaired_sha256"])

        for conv, edit, role, text in _walk(watched()):
            if not edit:
                if current:
                    found.append((current[0], current[1].hexdigest()))
                    if len(found) >= 10_000:
                        yield out()
                        found = []
                current = [conv, hashlib.sha256(), b""]
                continue
            current[1].update(current[2] + f"{role}:{text}".encode())
            current[2] = b"\n"
        if current:
            found.append((current[0], current[1].hexdigest()))
            yield out()

    hashed = _repaired(rows, judged).mapInArrow(digests, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "of")
    report = judged.join(hashed, judged["conv_id"].eqNullSafe(hashed["of"])).drop("of")
    if ids is None:
        return report
    report = report.withColumnRenamed("conv_id", "of").withColumn("found", F.lit(True))
    every = ids.select("conv_id").distinct()
    joined = every.join(report, every["conv_id"].eqNullSafe(report["of"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
