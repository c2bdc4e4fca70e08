"""Nearest vectors by blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of query vectors that travel to the tasks at once; more go in passes over the candidates.
QUERY_BYTES = 32 << 20
#: Candidates and queries of one product.
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 512
#: Scores are told apart to so many digits, so that equal vectors tie wherever they stand.
DIGITS = 12


def _unit_rows(vectors: list, width: int) -> np.ndarray:
    """Vectors of ``width`` numbers as unit rows; any other, and one with a null or without length, is a zero row."""
    rows = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width and None not in v:
            rows[i] = v
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


class _Best:
    """The ``k`` best candidates of every query so far, by falling score and then id."""

    def __init__(self, ids: list, vectors: list, k: int):
        self.k, self.groups = k, []
        for width in sorted({len(v) if v is not None else 0 for v in vectors}):
            own = [i for i, v in enumerate(vectors) if (len(v) if v is not None else 0) == width]
            self.groups.append(([ids[i] for i in own], _unit_rows([vectors[i] for i in own], width), [[] for _ in own], np.full(len(own), -np.inf), width))

    def add(self, ids: list, vectors: list) -> None:
        for query_ids, queries, found, worst, width in self.groups:
            block = _unit_rows(vectors, width)
            middle = block.mean(axis=0)
            reach = np.linalg.norm(block - middle, axis=1).max()
            for start in range(0, len(query_ids), QUERY_BLOCK):
                part = slice(start, start + QUERY_BLOCK)
                open_ = np.flatnonzero(queries[part] @ middle + reach >= worst[part] - 1e-9) + start  # else the whole block is worse
                if not len(open_):
                    continue
                scores = np.round(queries[open_] @ block.T, DIGITS) + 0.0
                for q, row in zip(open_.tolist(), scores, strict=True):
                    floor = worst[q]
                    if len(row) > 2 * self.k + 2:  # one more than k: the query itself may be among them
                        floor = max(floor, -np.partition(-row, self.k)[self.k])
                    near = [(-float(row[c]), ids[c]) for c in np.flatnonzero(row >= floor) if ids[c] != query_ids[q]]
                    if near:
                        found[q] = sorted(found[q] + near)[: self.k]
                        if len(found[q]) == self.k:
                            worst[q] = -found[q][-1][0]

    def rows(self) -> Iterator[tuple]:
        for query_ids, _, found, _, _ in self.groups:
            for query_id, near in zip(query_ids, found, strict=True):
                yield from ((query_id, i, -s + 0.0) for s, i in near)


def embedding_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest candidates by cosine for each query vector: query_id, match_id, score, rank; no self-match.

    ``queries``: query_id, vector; ``candidates``: match_id, vector. An empty, null or zero vector,
    or one of another length than the query's, scores 0. Ties go to the smaller id.

    A task multiplies blocks of its candidates with blocks of the queries and keeps ``k`` per
    query; a block is left out for a query where its middle and reach show that none of it can
    come among them. So ``k`` rows a query and task are shuffled. Queries travel in passes of at
    most 32 MB.
    """
    width = queries.agg(F.max(F.size("vector"))).first()[0] or 1
    each = max(1, QUERY_BYTES // (8 * max(width, 1)))
    passes = max(1, -(-queries.count() // each))
    kinds = [queries.schema["query_id"].dataType, candidates.schema["match_id"].dataType]
    out = None
    for i in range(passes):
        part = queries if passes == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        told = part.select("query_id", "vector").toArrow().to_pydict()
        shared = candidates.sparkSession.sparkContext.broadcast((told["query_id"], told["vector"]))  # bounded by QUERY_BYTES

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = _Best(*shared.value, k)
            for batch in batches:
                for start in range(0, batch.num_rows, CANDIDATE_BLOCK):
                    block = batch.slice(start, CANDIDATE_BLOCK)
                    best.add(block.column("match_id").to_pylist(), block.column("vector").to_pylist())
            columns = list(zip(*best.rows(), strict=True)) or [[]] * 3
            types = (*map(to_arrow_type, kinds), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["query_id", "match_id", "score"])

        names = [kind.simpleString() for kind in kinds]
        step = candidates.select("match_id", "vector").mapInArrow(search, f"query_id {names[0]}, match_id {names[1]}, score double")
        out = step if out is None else out.unionByName(step)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
