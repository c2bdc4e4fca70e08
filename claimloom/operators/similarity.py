"""Token-overlap matching of claims: best match, top candidates, alignment, clusters.

Tables carry ``tokens``, the distinct content tokens of a claim. A comparison grid keeps
every task bounded: claims of a scope are packed into chunks of about ``CHUNK`` and the
queries of a scope into cells of about ``CELL``; each (chunk, cell) meets once and yields
only the best ``k`` of the chunk per query, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.lexicons import (
    ALIGN_THRESHOLD,
    CANDIDATE_FLOOR,
    CLAIM_RESOLVE_THRESHOLD,
    CLUSTER_THRESHOLD,
    EMBEDDING_GATE_THRESHOLD,
    MAX_CANDIDATES,
)
from ..functions.values import cosine
from ..plans.lineage import stage
from ..plans.ranking import with_global_position

CHUNK = 65536
CELL = 65536
#: Claims and queries of small scopes that share a cell.
PACK = 32768
#: Where an id is repeated in a scope, each part of about so many claims of a cell gives its own best ones.
PART = 256
#: Counts of common tokens that a task holds at once.
BLOCK = 1 << 21


def _bounded(rows: DataFrame, floor: float) -> DataFrame:
    """Sizes that a partner may have for the pair to reach ``floor``.

    A partner's size lies between ``floor`` times and ``1 / floor`` times the own size.
    With ``place``, the pair is looked at where its first common token is: everything
    shared lies at or behind it, so the own remainder must cover the overlap that both
    sizes demand, which caps the partner's size. Rows that no partner fits are dropped.
    """
    size = F.size("tokens")
    rows = rows.withColumn("size", size)
    if floor <= 0:
        return rows.withColumns({"lo": F.lit(0), "hi": F.lit(2**31 - 1)})
    hi = F.floor(size / F.lit(floor) + 1e-9)
    if "place" in rows.columns:
        share = floor / (1 + floor)
        hi = F.least(hi, F.floor((size - F.col("place") + 1) / F.lit(share) - size + 1e-9))
    out = rows.withColumns({"lo": F.ceil(size * F.lit(floor) - 1e-9).cast("int"), "hi": hi.cast("int")})
    return out.filter(F.col("lo") <= F.col("hi")).drop("place")


def _codes(first: pa.Array, second: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of two columns as numbers that are equal where the values are."""
    both = pa.concat_arrays([first, second]).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return both[: len(first)], both[len(first) :]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + length`` of every range, one range after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _distinct(numbers: np.ndarray) -> np.ndarray:
    ordered = np.sort(numbers)
    return ordered[np.diff(ordered, prepend=-1) > 0]


class _Side:
    """Rows of one side, ordered by scope and size, with their distinct tokens as numbers."""

    def __init__(self, table: pa.Table, scope: np.ndarray, tokens: np.ndarray):
        lengths = pc.fill_null(pc.list_value_length(table["tokens"]), 0).to_numpy().astype(np.int64)
        size = table["size"].to_numpy()
        self.order = np.lexsort((size, scope))
        self.scope, self.size = scope[self.order], size[self.order]
        self.starts, self.lengths, self.tokens = (np.cumsum(lengths) - lengths)[self.order], lengths[self.order], tokens

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and token of every entry."""
        return np.repeat(np.arange(len(self.scope)), self.lengths), self.tokens[_ranges(self.starts, self.lengths)]


def _shared_tokens(queries: _Side, claims: _Side, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of ``(query, claim, tokens shared)``: every query with all claims of its scope whose size is within its bounds.

    Claims stand by scope and size, so the fitting ones are one range, and within the list of the
    claims of a token, too.
    """
    width, sizes, tokens = len(claims.scope), int(claims.size.max(initial=0)) + 2, max(int(s.tokens.max(initial=0)) for s in (queries, claims)) + 1
    at = claims.scope * sizes + claims.size
    begin = np.searchsorted(at, queries.scope * sizes + np.clip(lo, 0, sizes - 1), "left")
    window = np.maximum(np.searchsorted(at, queries.scope * sizes + np.clip(hi, 0, sizes - 1), "right") - begin, 0)
    row, token = claims.entries()
    listed = _distinct((claims.scope[row] * tokens + token) * width + row)
    columns = listed % max(width, 1)
    row, token = queries.entries()
    row, token = np.divmod(_distinct(row * tokens + token), tokens)
    first = (queries.scope[row] * tokens + token) * width + begin[row]
    starts = np.searchsorted(listed, first)
    lengths = np.searchsorted(listed, first + window[row]) - starts
    block = (np.cumsum(np.bincount(row, lengths, len(window)) + window) // BLOCK).astype(np.int64)
    cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    for low, high in zip(cuts, [*cuts[1:], len(window)], strict=True):
        own = window[low:high]
        part = slice(*np.searchsorted(row, [low, high]).tolist())
        shift = np.cumsum(own) - own - begin[low:high]
        cells = np.repeat(shift[row[part] - low], lengths[part]) + columns[_ranges(starts[part], lengths[part])]
        yield np.repeat(np.arange(low, high), own), _ranges(begin[low:high], own), np.bincount(cells, minlength=int(own.sum()))


def _best_of_cell(asked: pa.Table, held: pa.Table, k: int, floor: float, skip_self: bool) -> pa.Table:
    """The ``k`` best claims of every query among those of its scope that came to this cell."""
    a_ids, h_ids = asked["query_id"].combine_chunks(), held["match_id"].combine_chunks()
    flat = [pc.list_flatten(t["tokens"]).combine_chunks() for t in (asked, held)]
    scopes, tokens = _codes(asked["scope"].combine_chunks(), held["scope"].combine_chunks()), _codes(*flat)
    queries, claims = _Side(asked, scopes[0], tokens[0]), _Side(held, scopes[1], tokens[1])
    lo, hi = (asked[c].to_numpy()[queries.order] for c in ("lo", "hi"))
    place = np.empty(len(h_ids), np.int64)
    place[pc.array_sort_indices(h_ids, null_placement="at_start").to_numpy()] = np.arange(len(h_ids))
    place = place[claims.order]
    if skip_self:
        own, other = _codes(a_ids, h_ids)
        own, other = np.where(a_ids.is_null(), -1, own)[queries.order], np.where(h_ids.is_null(), -1, other)[claims.order]
    part = np.zeros(len(h_ids), np.int64)
    if k > 1:  # rows of one id fill places of their own part only
        ids = h_ids.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)[claims.order]
        if len(_distinct(claims.scope * (ids.max() + 1) + ids)) < len(ids):
            own_parts = -(-np.bincount(claims.scope) // PART)[claims.scope]
            n_parts = held["n_parts"].to_numpy()[claims.order]
            part = held["part"].to_numpy()[claims.order] % np.where(n_parts > 0, n_parts, own_parts)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    least = np.ceil(queries.size * max(floor, 0) - 1e-9).clip(1 if floor > 0 else 0)
    for q, c, shared in _shared_tokens(queries, claims, lo, hi):
        some = np.flatnonzero(shared >= least[q])
        q, c, shared = q[some], c[some], shared[some]
        union = queries.size[q] + claims.size[c] - shared
        score = np.divide(shared, union, out=np.zeros(len(q)), where=union != 0)
        keep = score >= floor
        if skip_self:
            keep &= (own[q] != other[c]) & (own[q] >= 0) & (other[c] >= 0)
        q, c, score = q[keep], c[keep], score[keep]
        best = np.lexsort((place[c], -score, part[c], q))
        q, c, score = q[best], c[best], score[best]
        group = q * (part.max() + 1) + part[c]
        top = np.arange(len(q)) - np.searchsorted(group, group) < k
        found.append((q[top], c[top], score[top]))
    q, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"query_id": a_ids.take(pa.array(queries.order[q])), "rank": pa.array(-score), "match_id": h_ids.take(pa.array(claims.order[c]))})


def grid_matches(queries: DataFrame, corpus: DataFrame, k: int, floor: float, skip_self: bool = True) -> DataFrame:
    """``(query_id, score, match_id)``: the ``k`` best matches of each query within its
    scopes, by score descending, then id; pairs below ``floor`` are out, and with ``skip_self``
    (both sides are the same rows) so are equal ids.

    ``queries(query_id, scope, tokens)``, ``corpus(match_id, scope, tokens)``. A query may
    appear under several scopes, one per prefix token; both sides then carry ``place``, the
    1-based place of that token in a token order common to all claims.

    Small scopes share a cell, large ones are dealt to several; a cell counts common tokens
    through lists of the claims that hold a token, some queries at a time.
    """
    size = F.coalesce("size", F.lit(0)).cast("long").alias("size")
    queries = _bounded(queries, floor).select("query_id", "scope", "tokens", size, *(F.col(c).cast("long").alias(c) for c in ("lo", "hi")))
    corpus = _bounded(corpus, floor).select("match_id", "scope", "tokens", size)
    asked, held = (rows.filter(F.col("scope").isNotNull()).groupBy("scope").agg(F.count("*").alias(name)) for rows, name in ((queries, "asked"), (corpus, "held")))
    large = (F.col("held") > CHUNK) | (F.col("asked") > CELL)
    counts = stage(asked.join(held, "scope", "full").na.fill(0, ["asked", "held"]), "scopes")
    small = counts.filter(~large).agg(F.sum(F.col("asked") + F.col("held"))).first()[0] or 0
    cells = -(-small // PACK) or 1
    # no more of them than one for each CHUNK or CELL rows, so each task knows them; rows of the others go without a join
    several = F.broadcast(counts.filter(large).select("scope", F.ceil(F.col("held") / CHUNK).cast("int").alias("n_chunks"), F.ceil(F.col("asked") / CELL).cast("int").alias("n_cells"), F.ceil(F.col("held") / PART).alias("n_parts")))
    key = F.when(F.col("n_chunks").isNull(), F.pmod(F.xxhash64("scope"), F.lit(cells))).otherwise(F.xxhash64("scope", "chunk", "cell")).alias("_key")
    # small in bytes but heavy to compare: a fixed number of partitions keeps every core
    # busy where adaptive execution would merge them
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, id_: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        rows = rows.filter(F.col("scope").isNotNull()).join(several, "scope", "left").withColumn(own, F.pmod(F.xxhash64(id_), F.coalesce(n_own, F.lit(1))).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1)))
        columns = [F.col(c).alias(c) for c in (queries.columns if id_ == "query_id" else corpus.columns)]  # renamed, as both sides may be one table
        if id_ == "match_id" and k > 1:
            columns += [F.xxhash64(id_).alias("part"), F.coalesce("n_parts", F.lit(0)).cast("long").alias("n_parts")]  # 0: the cell has the whole scope
        return rows.select(key, *columns).repartition(parts, "_key")

    packed = dealt(corpus, "match_id", "chunk", "n_chunks", "cell", "n_cells")
    asked = dealt(queries, "query_id", "cell", "n_cells", "chunk", "n_chunks")
    kinds = [queries.schema["query_id"].dataType, corpus.schema["match_id"].dataType]

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        if asked.num_rows and held.num_rows:
            return _best_of_cell(asked, held, k, floor, skip_self)
        types = (to_arrow_type(kinds[0]), pa.float64(), to_arrow_type(kinds[1]))
        return pa.table([pa.array([], t) for t in types], ["query_id", "rank", "match_id"])

    names = [kind.simpleString() for kind in kinds]
    best = asked.groupBy("_key").cogroup(packed.groupBy("_key")).applyInArrow(search, f"query_id {names[0]}, rank double, match_id {names[1]}")
    found = best.select("query_id", F.struct("rank", "match_id").alias("m"))
    if k == 1:
        top = found.groupBy("query_id").agg(F.min("m").alias("m"))
    else:
        order = Window.partitionBy("query_id").orderBy("m")
        top = (
            found.distinct()
            .withColumn("_r", F.row_number().over(order))
            .filter(F.col("_r") <= k)
        )
    return top.select("query_id", (-F.col("m.rank")).alias("score"), "m.match_id")


# --- target resolution -------------------------------------------------------------------------


def _smallest_copies(claims: DataFrame, keys: list[str], k: int) -> DataFrame:
    """At most ``k`` claims with the same tokens in a scope: more can never be chosen."""
    order = Window.partitionBy(*keys).orderBy("match_id")
    return claims.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def resolve_targets(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """Target of each relation among the claims of the cited work.

    ``relations(assertion_id, cited_work_id, tokens)``, ``claims(interpretation_id, work_id,
    tokens)``. A best overlap of 0.18 resolves the claim; otherwise the paper is the target
    with up to three candidates of at least 0.05; without a cited work it is unresolved.
    """
    queries = relations.filter(F.col("cited_work_id").isNotNull()).select(
        F.col("assertion_id").alias("query_id"), F.col("cited_work_id").alias("scope"), F.sort_array("tokens").alias("tokens")
    )
    corpus = claims.select(
        F.col("interpretation_id").alias("match_id"), F.col("work_id").alias("scope"), F.sort_array("tokens").alias("tokens")
    )
    corpus = _smallest_copies(corpus, ["scope", "tokens"], MAX_CANDIDATES)
    top = (
        grid_matches(stage(queries, "queries"), stage(corpus, "corpus"), MAX_CANDIDATES, 0.0, skip_self=False)
        .groupBy(F.col("query_id").alias("assertion_id"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), "match_id"))).alias("top"))
    )
    joined = relations.select("assertion_id", "cited_work_id").join(top, "assertion_id", "left")
    best = -F.col("top")[0]["rank"]
    resolved = F.coalesce(best >= CLAIM_RESOLVE_THRESHOLD, F.lit(False))
    candidates = F.transform(
        F.filter("top", lambda c: -c["rank"] >= CANDIDATE_FLOOR),
        lambda c: F.struct(c["match_id"].alias("interpretation_id"), F.bround(-c["rank"], 3).alias("score")),
    )
    empty = F.array().cast("array<struct<interpretation_id:string,score:double>>")
    return joined.select(
        "assertion_id",
        F.when(F.col("cited_work_id").isNull(), "unresolved")
        .when(resolved, "claim_resolved")
        .otherwise("paper_resolved")
        .alias("resolution"),
        F.when(resolved, F.col("top")[0]["match_id"]).alias("target_interpretation_id"),
        F.bround(best, 3).alias("target_link_score"),
        F.when(resolved | F.col("top").isNull(), empty).otherwise(candidates).alias("target_candidates"),
    )


# --- best match over all claims --------------------------------------------------------------------


def _rarest_first(classes: DataFrame) -> DataFrame:
    """``(class_id, tokens)`` with each class's tokens as numbers, by frequency, then text.

    A token's number is its place in that order among those that several classes have; tokens of one
    class have numbers up to 0. It takes four bytes instead of a text wherever the token goes, and
    numbers compare as the tokens do.
    """
    exploded = classes.select("class_id", F.explode("tokens").alias("token"))
    frequency = with_global_position(exploded.groupBy("token").agg(F.count("*").alias("df")), [F.col("df"), F.col("token")])
    n, alone = frequency.agg(F.count("*"), F.count_if(F.col("df") == 1)).first()
    number = (F.col("position") - alone).cast("int" if n < 1 << 31 else "long").alias("number")
    return (
        exploded.join(frequency.select("token", number), "token")
        .groupBy("class_id")
        .agg(F.sort_array(F.collect_list("number")).alias("tokens"))
    )


def _prefixes(ordered: DataFrame, threshold: float) -> DataFrame:
    """Classes once per prefix token.

    Two sets with overlap of at least t share a token among the first
    ``size - ceil(t * size) + 1`` tokens of each under any fixed token order, so joining on
    those tokens misses nothing, and ordering by frequency keeps the join keys rare. A token that
    only one class has leads to no other.
    """
    size = F.size("tokens")
    keep = size - F.ceil(size * F.lit(threshold) - 1e-9).cast("int") + 1
    return ordered.select(
        "class_id", "tokens", F.posexplode(F.slice("tokens", F.lit(1), keep)).alias("place", "scope")
    ).withColumn("place", F.col("place") + 1).filter("scope > 0")


def _search(queries: DataFrame, ordered: DataFrame, threshold: float, k: int) -> DataFrame:
    """Top ``k`` classes at or above the threshold for the query classes."""
    indexed = _prefixes(ordered, threshold)
    asked = _prefixes(ordered.join(queries.select("class_id"), "class_id", "left_semi"), threshold)
    return grid_matches(
        asked.withColumnRenamed("class_id", "query_id"), indexed.withColumnRenamed("class_id", "match_id"), k, threshold
    )


def _classes(claims: DataFrame) -> DataFrame:
    """Claims of one paper group with the same tokens as one class: its smallest id, and the
    second smallest when there is one."""
    order = Window.partitionBy("corpus_id", "tokens").orderBy("claim_id")
    return (
        claims.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= 2)
        .groupBy("corpus_id", "tokens")
        .agg(F.min("claim_id").alias("class_id"), F.max(F.when(F.col("_r") == 2, F.col("claim_id"))).alias("second"))
    )


def embedding_gate(pairs: DataFrame, vectors: DataFrame, threshold: float = EMBEDDING_GATE_THRESHOLD) -> DataFrame:
    """Pairs of papers that may be compared: cosine at or above the threshold, or the same
    paper, or an id or vector that is missing.

    ``pairs`` has ``left_corpus_id`` and ``right_corpus_id``; ``vectors(corpus_id, vector)``.
    """
    from ..plans.skew import spread_nulls

    row = F.monotonically_increasing_id()
    left = vectors.select(F.col("corpus_id").alias("_l"), F.col("vector").alias("_lv"))
    right = vectors.select(F.col("corpus_id").alias("_r"), F.col("vector").alias("_rv"))
    joined = (
        pairs.withColumn("_l", spread_nulls(F.col("left_corpus_id"), row))
        .withColumn("_r", spread_nulls(F.col("right_corpus_id"), row))
        .join(left, "_l", "left")
        .join(right, "_r", "left")
    )
    open_pair = (
        F.col("left_corpus_id").isNull()
        | F.col("right_corpus_id").isNull()
        | (F.col("left_corpus_id") == F.col("right_corpus_id"))
        | F.col("_lv").isNull()
        | F.col("_rv").isNull()
    )
    allowed = F.coalesce(open_pair, F.lit(False)) | (cosine(F.col("_lv"), F.col("_rv")) >= threshold)
    return joined.filter(F.coalesce(allowed, F.lit(True))).drop("_l", "_r", "_lv", "_rv")


def _best_allowed(classes: DataFrame, threshold: float, vectors: DataFrame, first_k: int = 8) -> DataFrame:
    """Best match whose papers pass the gate; a query whose ``k`` best are all closed asks
    for eight times more until it has one or runs out."""
    papers = classes.select("class_id", "corpus_id")
    ordered = stage(_rarest_first(classes), "ordered")
    pending, k, found = classes.select("class_id"), first_k, None
    while True:
        top = stage(_search(pending, ordered, threshold, k), "top")
        pairs = top.join(
            papers.select(F.col("class_id").alias("query_id"), F.col("corpus_id").alias("left_corpus_id")), "query_id"
        ).join(papers.select(F.col("class_id").alias("match_id"), F.col("corpus_id").alias("right_corpus_id")), "match_id")
        allowed = embedding_gate(pairs, vectors).groupBy("query_id").agg(
            F.min(F.struct((-F.col("score")).alias("rank"), "match_id")).alias("m")
        )
        step = stage(allowed.select("query_id", (-F.col("m.rank")).alias("score"), "m.match_id"), "allowed")
        found = step if found is None else found.unionByName(step)
        more = top.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        pending = stage(
            more.join(step, "query_id", "left_anti").select(F.col("query_id").alias("class_id")), "pending"
        )
        if pending.isEmpty():
            return found
        k *= 8


def best_matches(
    claims: DataFrame,
    threshold: float = CLUSTER_THRESHOLD,
    vectors: DataFrame | None = None,
    levels: tuple[float, ...] = (0.7,),
) -> DataFrame:
    """``(claim_id, match_id, score)``: each claim's best other claim at or above the
    threshold; ties go to the smallest id.

    ``claims(claim_id, tokens[, corpus_id])``. Copies collapse into one class first, so a
    group of copies of any size costs one comparison. Higher ``levels`` are tried first:
    a class that finds a match there is done, which keeps long prefixes for the few left.
    With ``vectors`` the paper gate applies.
    """
    if "corpus_id" not in claims.columns or vectors is None:
        claims = claims.withColumn("corpus_id", F.lit(None).cast("string"))
    tokens = stage(
        claims.select("claim_id", "corpus_id", F.sort_array("tokens").alias("tokens")).filter(F.size("tokens") > 0),
        "tokens",
    )
    classes = stage(_classes(tokens), "classes")
    if vectors is not None:
        outside = _best_allowed(classes, threshold, vectors)
    else:
        ordered = stage(_rarest_first(classes), "ordered")
        pending = classes.filter(F.col("second").isNull()).select("class_id")
        outside = None
        for level in (*[v for v in levels if v > threshold], threshold):
            step = stage(_search(pending, ordered, level, 1), "best")
            outside = step if outside is None else outside.unionByName(step)
            pending = pending.join(step.select(F.col("query_id").alias("class_id")), "class_id", "left_anti")
    per_class = classes.join(outside.withColumnRenamed("query_id", "class_id"), "class_id", "left")
    members = tokens.withColumn("_key", F.array_join("tokens", " ")).withColumn(
        "_paper", F.coalesce("corpus_id", F.lit(""))
    )
    per_class = per_class.select(
        F.array_join("tokens", " ").alias("_key"),
        F.coalesce("corpus_id", F.lit("")).alias("_paper"),
        "class_id",
        "second",
        F.when(F.col("match_id").isNotNull(), F.struct((-F.col("score")).alias("rank"), "match_id")).alias("outside"),
    )
    sibling = F.when(F.col("claim_id") == F.col("class_id"), F.col("second")).otherwise(F.col("class_id"))
    inside = F.when(sibling.isNotNull(), F.struct(F.lit(-1.0).alias("rank"), sibling.alias("match_id")))
    best = F.array_min(F.array_compact(F.array("outside", inside)))
    return (
        members.join(per_class, ["_key", "_paper"])
        .select("claim_id", best.alias("b"))
        .filter(F.col("b").isNotNull())
        .select("claim_id", "b.match_id", (-F.col("b.rank")).alias("score"))
    )


# --- clusters -------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node id as component.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so long chains halve; every step is an equi join and a min aggregate.
    """
    both = stage(
        edges.select(F.col("a").alias("node"), F.col("b").alias("peer"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("peer")))
        .distinct(),
        "links",
    )
    labels = stage(both.groupBy("node").agg(F.least(F.col("node"), F.min("peer")).alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("peer"), "component")
        nearest = both.join(seen, "peer").groupBy("node").agg(F.min("component").alias("near"))
        lowered = labels.join(nearest, "node").select(
            "node", "component", F.least("component", "near").alias("lower")
        )
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("next"))
        moved = stage(
            lowered.join(jump, "lower", "left").select(
                "node",
                F.least("lower", F.coalesce("next", "lower")).alias("component"),
                (F.least("lower", F.coalesce("next", "lower")) != F.col("component")).alias("changed"),
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.filter("changed").isEmpty():
            return labels


def claim_clusters(best: DataFrame) -> DataFrame:
    """Soft cluster memberships from best-match edges.

    ``(cluster_id, interpretation_id, membership_confidence)``; claims without a match stay
    unclustered.
    """
    edges = best.select(F.col("claim_id").alias("a"), F.col("match_id").alias("b"))
    return (
        connected_components(edges)
        .join(best.select(F.col("claim_id").alias("node"), "score"), "node")
        .select(
            F.concat(F.lit("cluster_"), "component").alias("cluster_id"),
            F.col("node").alias("interpretation_id"),
            F.lit("automated").alias("method"),
            F.bround("score", 3).alias("membership_confidence"),
            F.lit("active").alias("status"),
        )
    )


# --- alignment -------------------------------------------------------------------------------------------


def align_greedy(gold: DataFrame, predicted: DataFrame, threshold: float = ALIGN_THRESHOLD) -> DataFrame:
    """One-to-one alignment of gold to predicted claims of the same paper, best pairs first.

    ``gold(gold_id, paper, tokens)``, ``predicted(pred_id, paper, tokens)``; ties by gold,
    then predicted id. A gold claim can lose at most as many candidates as its paper has
    other gold claims, so that many of its best pairs decide it. Pairs that are the best of
    both their ends are final; they are taken round by round, which is what taking pairs in
    global order gives.
    """
    most = gold.groupBy("paper").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    queries = gold.select(F.col("gold_id").alias("query_id"), F.col("paper").alias("scope"), F.sort_array("tokens").alias("tokens"))
    corpus = predicted.select(F.col("pred_id").alias("match_id"), F.col("paper").alias("scope"), F.sort_array("tokens").alias("tokens"))
    corpus = _smallest_copies(corpus, ["scope", "tokens"], most)
    pairs = stage(
        grid_matches(stage(queries.filter(F.size("tokens") > 0), "queries"), stage(corpus, "corpus"), most, threshold, skip_self=False).select(
            F.col("query_id").alias("gold_id"), F.col("match_id").alias("pred_id"), "score"
        ),
        "pairs",
    )
    chosen = None
    while True:
        at = F.struct((-F.col("score")).alias("rank"), "gold_id", "pred_id")
        by_gold = pairs.groupBy("gold_id").agg(F.min(at).alias("g"))
        by_pred = pairs.groupBy("pred_id").agg(F.min(at).alias("p"))
        step = stage(
            by_gold.select("gold_id", "g", F.col("g.pred_id").alias("pred_id"))
            .join(by_pred, "pred_id")
            .filter(F.col("g") == F.col("p"))
            .select("gold_id", "pred_id", (-F.col("g.rank")).alias("score")),
            "aligned",
        )
        if step.isEmpty():
            return step if chosen is None else chosen
        chosen = step if chosen is None else chosen.unionByName(step)
        pairs = stage(
            pairs.join(step.select("gold_id"), "gold_id", "left_anti").join(step.select("pred_id"), "pred_id", "left_anti"),
            "pairs",
        )
