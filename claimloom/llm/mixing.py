"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stage
from ..plans.ranking import with_global_position
from .common import WORD, apart_from, checked_broadcast

#: Words the dynamic program fits exactly; larger remainders are first brought below it.
FIT_WORDS = 1 << 16


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each distinct size to take so that the words come nearest ``budget``.

    Every size gives its share of the budget rounded down, so the mix keeps the source's length
    profile. What is left is fitted by a bounded knapsack over the documents not yet taken:
    ``first[s]`` is the item (a size, in power-of-two bundles) that first reached sum ``s``, which
    is all that is needed to walk a solution back, so memory does not grow with the number of sizes.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int(sum(int(s) * int(c) for s, c in zip(sizes, counts, strict=True)))
    budget = max(0, min(int(budget), total))
    if not total:
        return np.zeros_like(counts)
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = counts - taken
    rest = budget - sum(int(s) * int(t) for s, t in zip(sizes, taken, strict=True))
    largest_first = np.argsort(-sizes, kind="stable")
    for i in largest_first:  # large remainders: whole documents, largest sizes first
        if rest <= FIT_WORDS:
            break
        size = int(sizes[i])
        more = min(int(left[i]), max(rest - FIT_WORDS // 2, 0) // size if size else 0)
        if not more and left[i] and size <= rest and size > FIT_WORDS // 2:
            more = 1
        taken[i] += more
        left[i] -= more
        rest -= more * size
    open_ = [int(i) for i in largest_first if left[i] > 0 and sizes[i] > 0]
    if rest <= 0 or not open_:
        return taken
    top = min(rest + int(sizes[open_[-1]]), 2 * FIT_WORDS)  # may overshoot by the smallest document
    rest = min(rest, top)
    first = np.full(top + 1, -1, dtype=np.int64)
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in open_:
        size, bundle, stock = int(sizes[i]), 1, int(min(left[i], top // int(sizes[i])))
        while stock > 0 and not reached[rest]:
            n = min(bundle, stock)
            weight = n * size
            if weight <= top:
                new = np.zeros_like(reached)
                new[weight:] = reached[: top + 1 - weight]
                new &= ~reached
                first[new] = len(items)
                reached |= new
            items.append((i, n))
            stock -= n
            bundle *= 2
        if reached[rest]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, n = items[first[at]]
        taken[i] += n
        at -= n * int(sizes[i])
    return taken


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all words by weight, none above ``most`` sizes.

    The weights repeat over the sources in code point order, null last. Resharing the excess of
    full sources by weight settles at one price per unit of weight; each round re-reads the
    table of sources and brings back three sums.
    """
    ranked = with_global_position(sources, [F.col("source").isNull().cast("int"), F.col("source")], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stage(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    limit = F.col("source_size") * F.lit(most)
    price, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(price) >= limit
        got = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, F.col("source_size"))).alias("full"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not got.open or got.n == full:
            break
        full = got.n
        price = (share * (got["all"] or 0) - most * (got["full"] or 0)) / got.open
    return table.withColumn("target", F.least(limit, F.col("weight") * F.lit(price)).cast("double"))


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Per distinct size of one source: whole passes, and how many documents get one pass more."""
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = int(target // size) if size else 0
    more = fit_counts(rows["size"].to_numpy(), rows["n"].to_numpy(), round(target - passes * size))
    return pd.DataFrame(
        {"source": rows["source"], "size": rows["size"], "n": rows["n"], "source_size": rows["source_size"], "target": rows["target"], "passes": passes, "more": more}
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, per_bucket: int = 2000,
) -> DataFrame:
    """How often each row of ``docs`` is taken: doc_id, size, source_size, target, taken, copies.

    Documents are counted by (source, exact word count); one small table per source (its distinct
    sizes, at most the square root of twice its words) goes through the knapsack. Of the documents
    of one size, those with the smallest seeded hash of doc_id get the extra pass. A size with many
    documents is cut into hash buckets: buckets below the count are taken whole, and only inside a
    bucket are rows ranked, so no group of equal sizes meets in one task.

    Nulls: a null text has no words, a null source is one source that comes last, null ids hash
    alike. Rows repeated with one id are separate documents. Rows without words are taken with
    whole passes only (copies), and count nothing. An empty table gives no rows. Other columns
    are ignored.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", F.lit(seed)).alias("luck"))
    rows = stage(rows, "sizes")
    histogram = stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    joined = histogram.alias("h").join(targets.alias("t"), F.expr("h.source <=> t.source")).select("h.source", "size", "n", "source_size", "target")
    schema = "source string, size long, n long, source_size long, target double, passes long, more long"
    buckets = F.ceil(F.col("n") / F.lit(per_bucket)).cast("long")
    plan = stage(
        joined.groupBy("source").applyInPandas(_fit_source, schema).withColumn("buckets", buckets), "mix-plan"
    ).withColumnsRenamed({"source": "p_source", "size": "p_size"})
    on = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    bucket = F.pmod(F.shiftright("luck", 16), F.col("buckets"))
    placed = rows.join(plan, on).withColumn("bucket", bucket)
    crowded = placed.filter((F.col("buckets") > 1) & (F.col("more") > 0) & (F.col("more") < F.col("n")))
    earlier = Window.partitionBy("c_source", "c_size").orderBy("c_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(
        crowded.groupBy(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("bucket").alias("c_bucket")).agg(F.count("*").alias("c_n")), "buckets"
    ).withColumn("c_before", F.coalesce(F.sum("c_n").over(earlier), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("bucket") == F.col("c_bucket"))
    inside = Window.partitionBy("source", "size", "bucket").orderBy("luck", "doc_id")
    ranked = placed.join(counts, same, "left").withColumn("rank", F.row_number().over(inside) + F.coalesce("c_before", F.lit(0)))
    copies = F.col("passes") + (F.col("rank") <= F.col("more")).cast("long")
    return ranked.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")
    )


@apart_from("doc_id", "text", "source")
def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` as the mix takes them: rows left out, once, or repeated, with all their columns.

    How often a row is taken is settled on narrow rows and joined back by doc_id. Rows that share
    an id share the largest number of copies among them that any gets.
    """
    taken = mix_sources(docs, **parameters).groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    taken = stage(taken.filter("_copies > 0"), "copies").withColumnRenamed("doc_id", "_mix_id")
    joined = docs.join(checked_broadcast(taken), docs["doc_id"].eqNullSafe(F.col("_mix_id")))
    again: Column = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return joined.withColumn("_again", again).select(*docs.columns)
