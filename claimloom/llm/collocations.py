"""Phrase collocations from count streams in prefix and in suffix order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import stage
from .rolling import KeyFilter, RangeHash, key_filter, mixed

#: Texts and bytes worked on at once, and keys and phrases a counting task holds before it hands them on.
BLOCK_TEXTS, BLOCK_BYTES, HELD_KEYS, HELD_PHRASES = 1000, 1 << 20, 3_000_000, 250_000
#: A text's mark: so many bits of a hash of it.
MARK_BITS = 24
#: Of the phrases ranked together in one task before the last step, about so many.
RANKED = 50_000
#: Kinds of bytes: 0 in a word, 1 between words, 2 between pieces.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class _Block:
    """The words of some bytes of text: where they are, their language, which may start a piece, and their hash."""

    def __init__(self, data: np.ndarray, first_byte: int, text_ends: np.ndarray, langs: list[str], lang_keys: np.ndarray, marks: np.ndarray):
        kinds = _KINDS[data]
        inside = np.concatenate(([False], kinds == 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.data, self.starts, self.ends, self.langs, self.marks = data, edges[::2], edges[1::2], langs, marks
        breaks = np.cumsum(kinds == 2)
        self.opens = np.ones(len(self.starts), bool)
        self.opens[1:] = breaks[self.starts[1:]] != breaks[self.ends[:-1] - 1]
        self.texts = np.searchsorted(text_ends, self.starts + first_byte, side="right")
        self.words = RangeHash(data).of(self.starts, self.ends) ^ lang_keys[self.texts]

    def grams(self, longest: int, filters: list[KeyFilter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, positions, keys) of the phrases of 1 ... ``longest`` words whose parts all may be frequent."""
        at, sums, opens = np.arange(len(self.words)), self.words, np.append(self.opens, True)
        for size in range(1, longest + 1):
            if size > 1:
                may, kept = filters[size - 2].may_have(keys), np.zeros(len(opens), bool)
                at, sums = at[may], sums[may]
                kept[at] = True
                whole = kept[at + 1] & ~opens[at + size - 1]
                at = at[whole]
                sums = sums[whole] * np.uint64(0xD6E8FEB86659FD93) + self.words[at + size - 1]
            keys = mixed(sums + np.uint64(size))
            yield size, at, keys

    def phrase(self, at: int, size: int) -> str:
        raw = (self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + size], self.ends[at : at + size], strict=True))
        return b" ".join(raw).decode("utf-8", "replace")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    """Blocks of about BLOCK_BYTES, cut only behind a byte that ends a piece, so no phrase is cut."""
    for batch in (whole.slice(i, BLOCK_TEXTS) for whole in batches for i in range(0, whole.num_rows, BLOCK_TEXTS)):
        langs = ["und" if x is None else x for x in batch.column("lang").to_pylist()]
        empty, line_end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        texts = pc.binary_join_element_wise(pc.fill_null(batch.column("text").cast(pa.large_string()), ""), empty, line_end)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
        ends = offsets[1:] - offsets[0]
        lang_keys = np.array([xxhash.xxh64_intdigest(x) for x in langs], np.uint64)
        start = 0
        while start < len(data):
            stop = min(start + BLOCK_BYTES, len(data))
            while stop < len(data):
                if len(cuts := np.flatnonzero(_KINDS[data[start:stop]] == 2)):
                    stop = start + int(cuts[-1]) + 1
                    break
                stop = min(stop + BLOCK_BYTES, len(data))  # a piece longer than a block
            yield _Block(data[start:stop], start, ends, langs, lang_keys, batch.column("mark").to_numpy())
            start = stop


def _frequent_keys(docs: DataFrame, size: int, least: int, filters: list[Broadcast]) -> DataFrame:
    """(key, n, owner): hashes of ``size``-word phrases seen ``least`` times. Written once.

    ``owner`` is the smallest mark of a text with the phrase; only texts with it need to name the phrase.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, held, n = [f.value for f in filters], [], 0

        def rows() -> pa.RecordBatch:
            keys, owners = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, owners = keys[order], owners[order]
            firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts = np.diff(np.append(firsts, len(keys)))
            packed = counts << MARK_BITS | np.minimum.reduceat(owners, firsts)
            return pa.RecordBatch.from_arrays([pa.array(keys[firsts].view(np.int64)), pa.array(packed)], ["key", "packed"])

        for block in _blocks(batches):
            *_, (_, at, keys) = block.grams(size, carried)
            held.append((keys, block.marks[block.texts[at]]))
            if (n := n + len(keys)) > HELD_KEYS:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    made = docs.mapInArrow(count, "key long, packed long").select("key", F.shiftright("packed", MARK_BITS).alias("n"), F.col("packed").bitwiseAND(F.lit(2**MARK_BITS - 1)).alias("owner"))
    return stage(made.groupBy("key").agg(F.sum("n").alias("n"), F.min("owner").alias("owner")).filter(F.col("n") >= least), "frequent")


def count_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> DataFrame:
    """(lang, size, phrase, n): counts of all phrases of up to ``longest`` words seen ``least`` times.

    Size 0, with an empty phrase, counts all words of a language. A phrase can be frequent only
    if both its parts without the last and without the first word are, so the texts are read once
    for each size, counting hashes of phrases whose parts may be frequent, and once more to name the
    phrases, each from few texts. Phrases are told apart by 64-bit hashes; the filters built of
    them, at most 32 MB each, only spare work. Written once.
    """
    mark = F.xxhash64("text").bitwiseAND(F.lit(2**MARK_BITS - 1))
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("mark", mark)
    context, filters, owners, counted = docs.sparkSession.sparkContext, [], [], []
    owned = F.col("key").bitwiseXOR(F.col("owner").bitwiseOR(F.shiftleft("owner", 64 - MARK_BITS)))
    for size in range(1, longest + 1):
        frequent = _frequent_keys(texts, size, least, filters)
        filters.append(context.broadcast(key_filter(frequent)))
        owners.append(context.broadcast(key_filter(frequent.select(owned.alias("key")), 64)))
        counted.append(frequent.select("key", "n"))

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, owning = [f.value for f in filters], [f.value for f in owners]
        words: Counter = Counter()
        held: dict[int, tuple] = {}

        def rows() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
            columns = list(zip(*held.values(), *((None, lang, 0, "", n) for lang, n in words.items()), strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["key", "lang", "size", "phrase", "n"])

        for block in _blocks(batches):
            by_text, n_words = np.unique(block.texts, return_counts=True)
            for text, n in zip(by_text.tolist(), n_words.tolist(), strict=True):
                words[block.langs[text]] += n
            for size, at, keys in block.grams(longest, carried):
                marks = block.marks[block.texts[at]].astype(np.uint64)
                own = owning[size - 1].may_have(keys ^ marks ^ (marks << np.uint64(64 - MARK_BITS)))
                found, firsts = np.unique(keys[own], return_index=True)
                for key, i in zip(found.view(np.int64).tolist(), at[own][firsts].tolist(), strict=True):
                    if key not in held:
                        held[key] = (key, block.langs[block.texts[i]], size, block.phrase(i, size), None)
            if len(held) > HELD_PHRASES:
                yield rows()
                held.clear()
                words.clear()
        yield rows()

    named = stage(texts.mapInArrow(name, "key long, lang string, size int, phrase string, n long"), "named")
    totals = named.filter("size = 0").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    phrases = named.filter("size > 0").groupBy("key").agg(F.min(F.struct("lang", "size", "phrase")).alias("as"))
    phrases = phrases.join(reduce(DataFrame.unionByName, counted), "key").select("as.*", "n")
    return stage(phrases.unionByName(totals), "phrases")


def _lockstep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read sorted phrases of all sizes in lockstep; a stack holds the open phrases that the current one extends.

    A phrase is handed on when the stream has left it: by then its shorter starts are known from
    the stack, and all phrases one word longer have passed.
    """
    place: tuple | None = None
    stack: list[list] = []  # [words, count, counts of the shorter starts, largest count of a longer phrase]
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            words, n, shorter, longer = stack.pop()
            if len(words) > 1:
                out.append((place[1], words, n, shorter, longer))

    def rows() -> pa.RecordBatch:
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64())
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["lang", "words", "n", "shorter", "longer"])

    for batch in batches:
        for part, lang, words, n in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "words", "n")), strict=True):
            if place != (part, lang):
                close(0)
                place = (part, lang)
            if stack and stack[-1][0] == words:  # carried and its own row
                continue
            shared = 0
            while shared < len(stack) and stack[shared][0] == words[: shared + 1]:
                shared += 1
            close(shared)
            if stack:
                stack[-1][3] = max(stack[-1][3], n)
            stack.append([words, n, [s[1] for s in stack], 0])
        if len(out) > 50_000:
            yield rows()
            out.clear()
    close(0)
    yield rows()


def _stream(phrases: DataFrame, words: Column) -> DataFrame:
    """(lang, words, n, shorter, longer) of all phrases of two or more words, in the order of ``words``.

    ``shorter``: counts of its first 1, 2, ... words; ``longer``: the largest count of a phrase one
    word longer that starts with it, or 0. The stream is cut into even ranges wherever they fall;
    the starts of the first phrase of each range, at most one for each size, are carried into it.
    """
    keyed = phrases.select("lang", words.alias("words"), "n")
    cut = stage(keyed.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words").withColumn("part", F.spark_partition_id()), "stream")
    firsts = cut.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("first")).select("part", "first.lang", "first.words")
    starts = firsts.select("part", "lang", F.explode(F.expr("transform(sequence(1, size(words)), i -> slice(words, 1, i))")).alias("words"))
    carried = cut.drop("part").join(F.broadcast(starts), ["lang", "words"])  # a few rows for each part
    dealt = cut.unionByName(carried).repartition("part").sortWithinPartitions("part", "lang", "words")
    read = dealt.mapInArrow(_lockstep, "lang string, words array<string>, n long, shorter array<long>, longer long")
    return read.groupBy("lang", "words").agg(F.max("n").alias("n"), F.max("shorter").alias("shorter"), F.max("longer").alias("longer"))


def mine_collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000) -> DataFrame:
    """Each language's phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    A-Z is lower-cased; pieces end at ``. , ; : ! ?`` and line ends; words are runs of anything but
    space and tab. ``a`` counts the phrase within pieces, overlaps included, and must reach
    ``least``; cutting it after k words gives ``l`` and ``r``, the counts of its two sides, and the
    score floor(1000 * a * n / (l * r)), n being all words of the language. The cut with the lowest
    score counts, ties to the smallest k. A phrase goes if a longer one that contains it is as
    frequent. Each language's first ``top`` phrases (None: all) stay, by score, then ``a``, both
    falling, then phrase.

    The counts lie in two sorted streams: in prefix order a phrase stands right behind its shorter
    starts and before its extensions, in suffix order behind its shorter ends, so one reading of
    each gives all l, r and extension counts; the two are merged by phrase. Products are decimals of 38 digits.

    A null language is ``und``, a null text is empty. Repeated rows count as often as they
    occur. Texts without words, and an empty table, give no rows. Other columns are ignored.
    """
    phrases = count_phrases(docs, least, longest)
    totals = phrases.filter("size = 0").select("lang", F.col("n").alias("total"))
    counted, words = phrases.filter("size > 0"), F.split("phrase", " ")
    starts = _stream(counted, words).withColumnsRenamed({"shorter": "lefts", "longer": "right_longer"})
    ends = _stream(counted, F.reverse(words)).select("lang", F.reverse("words").alias("words"), F.reverse("shorter").alias("rights"), F.col("longer").alias("left_longer"))
    both = starts.hint("merge").join(ends, ["lang", "words"]).filter("greatest(right_longer, left_longer) < n")
    both = both.join(totals, "lang").select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), F.col("total").alias("n"), "lefts", "rights")
    score = """transform(arrays_zip(lefts, rights), (x, k) -> struct(
        (cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(n as decimal(18, 0)))
            div (cast(x.lefts as decimal(19, 0)) * cast(x.rights as decimal(19, 0))) as score, k, x.lefts as l, x.rights as r))"""
    scored = both.withColumn("cut", F.array_min(F.expr(score))).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:  # the best of shares first, so that no task ranks a whole language
        scored = stage(scored, "scored")
        share = F.pmod(F.xxhash64("phrase"), F.lit(1 + scored.count() // RANKED))
        ahead = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
        scored = scored.withColumn("share", share).withColumn("ahead", ahead).filter(F.col("ahead") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
