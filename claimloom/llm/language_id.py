"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart_from

#: Hash buckets of subwords; a document's features are at most this many counts.
BUCKETS = 8192
#: Subwords are 1 to 4 bytes long.
LONGEST = 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = (2654435761, 2246822519, 3266489917, 668265263)  # odd multipliers of the hash
_CHUNK = 1 << 20
#: Everything but letters of ASCII becomes a space; bytes of other letters stay.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def held_out(doc_id: object) -> bool:
    """Whether a document is kept from training; a null id counts as the empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def features(text: str) -> np.ndarray:
    """Counts of the hashed subwords of a whole text, in chunks that overlap by a subword."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data), _CHUNK):
        part = data[start : start + _CHUNK + LONGEST - 1]
        whole = min(_CHUNK, len(data) - start)
        mixed = np.zeros(len(part), np.uint32)
        for n in range(LONGEST):
            if len(part) <= n:
                break
            mixed = (mixed[: len(part) - n] + part[n:] + np.uint32(1)) * np.uint32(_MIX[n])
            mixed ^= mixed >> np.uint32(15)
            out += np.bincount(mixed[:whole] % np.uint32(BUCKETS), minlength=BUCKETS)
    return out

_EXAMPLE = {"doc_id": "string", "lang": "string", "whole": "boolean", "ids": "array<smallint>", "counts": "array<int>"}


@dataclass
class Model:
    """Languages, the table that folds embedding and softmax weights, and the calibration."""

    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    sharpness: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its calibrated probability, and whether that passes the threshold."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        counts = features(text)
        used = np.flatnonzero(counts)
        logits = self.sharpness * (counts[used] @ self.table[used] / counts.sum() + self.bias)
        chance = np.exp(logits - logits.max())
        chance /= chance.sum()
        best = int(chance.argmax())
        return self.languages[best], float(chance[best]), bool(chance[best] >= self.threshold)


def _examples(text: str, doc_id: object) -> Iterator[tuple[bool, np.ndarray]]:
    """Features of the whole text (true) and of some short runs of its words, the same on every run."""
    yield True, features(text)
    words = text.split()
    for k, length in enumerate((1, 3, 8, 24)):
        if len(words) > 2 * length:
            at = zlib.crc32(f"{doc_id}/{k}".encode()) % (len(words) - length)
            run = " ".join(words[at : at + length])
            if _LETTER.search(run):
                yield False, features(run)


def training_examples(docs: DataFrame, sample: int) -> pd.DataFrame:
    """Hashed features of at most ``sample`` labelled documents, those with the smallest hash of doc_id.

    Only documents outside the held-out fifth, with a language and a letter, count. The choice is
    made on ids; features have at most ``BUCKETS`` entries, so what reaches the driver is bounded.
    """
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    usable = docs.select("doc_id", "lang", "text").filter((rest != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    luck = F.xxhash64("doc_id")
    chosen = usable.select(luck.alias("luck")).orderBy("luck").limit(sample).agg(F.max("luck")).first()[0]
    if chosen is None:
        return pd.DataFrame({c: [] for c in _EXAMPLE})

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                if not _LETTER.search(text):
                    continue
                for whole, counts in _examples(text, doc_id):
                    used = np.flatnonzero(counts)
                    for column, value in zip(rows, (str(doc_id), lang, whole, used, counts[used]), strict=True):
                        column.append(value)
            types = (pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int16()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], list(_EXAMPLE))

    near = usable.filter(luck <= chosen)
    got = near.mapInArrow(extract, ", ".join(f"{k} {v}" for k, v in _EXAMPLE.items())).toPandas()
    # rows that share the last id could exceed the sample; ties are all taken
    return got.assign(size=got["counts"].map(sum)).sort_values(["doc_id", "size"], kind="stable").reset_index(drop=True)


def train(examples: pd.DataFrame, width: int = 16, epochs: int = 6, rate: float = 1.0, batch: int = 64, seed: int = 5, wrong: float = 0.01, lost: float = 0.001) -> Model:
    """Fit embedding and softmax by stochastic gradient descent, then calibrate on a fifth left out.

    The sharpness (inverse temperature) minimises log loss on the fifth. The threshold is the
    smallest probability above which at most the share ``wrong`` of its examples, short runs
    included, get a wrong language, but never more than what all but the share ``lost`` of its whole
    texts reach, nor than one half: a language likelier than all others together is not rejected.
    """
    languages = sorted(examples["lang"].unique())
    if len(languages) < 2 or len(examples) < 10:
        return Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0, 0.0)
    wanted = examples["lang"].map({l: i for i, l in enumerate(languages)}).to_numpy()
    apart = np.array([zlib.crc32(b"fold" + d.encode()) % 5 == 0 for d in examples["doc_id"]])
    found_ids, found_counts = examples["ids"].to_list(), examples["counts"].to_list()

    def dense(pick: np.ndarray) -> np.ndarray:
        """The mean over subwords as rows; made for one batch at a time."""
        rows = np.zeros((len(pick), BUCKETS), np.float32)
        for row, i in zip(rows, pick, strict=True):
            row[found_ids[i]] = np.asarray(found_counts[i], np.float32) / np.sum(found_counts[i])
        return rows

    if apart.all() or not apart.any():
        apart[:] = False
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / width, (BUCKETS, width)).astype(np.float32)
    weights, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    fit = np.flatnonzero(~apart)
    steps, done = epochs * -(-len(fit) // batch), 0
    share = np.bincount(wanted[fit], minlength=len(languages)) / len(fit)
    balance = 1 / np.maximum(share, 1e-9) / len(languages)  # rare languages count as much as common ones
    for _ in range(epochs):
        order = rng.permutation(fit)
        for start in range(0, len(order), batch):
            pick = order[start : start + batch]
            x = dense(pick)
            hidden = x @ embed
            logits = hidden @ weights + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(pick)), wanted[pick]] -= 1
            error = (chance * balance[wanted[pick], None] / len(pick)).astype(np.float32)
            step = np.float32(rate * (1 - done / steps))
            down = error @ weights.T
            weights -= step * (hidden.T @ error)
            bias -= np.float32(0.01) * step * error.sum(axis=0)
            embed -= (step * BUCKETS / 64) * (x.T @ down)
            done += 1
    table = (embed @ weights).astype(np.float64)
    test = apart if apart.any() else ~apart
    tested = np.flatnonzero(test)
    logits = np.concatenate([dense(tested[i : i + batch]) @ table for i in range(0, len(tested), batch)]) + bias
    truth = wanted[test]

    def chances(sharpness: float) -> np.ndarray:
        e = np.exp(sharpness * (logits - logits.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)

    loss = {s: -np.log(np.maximum(chances(s)[np.arange(len(truth)), truth], 1e-12)).mean() for s in 2.0 ** np.arange(-3, 5, 0.5)}
    sharpness = min(loss, key=lambda s: (loss[s], s))
    found = chances(sharpness)
    order = np.argsort(-found.max(axis=1), kind="stable")
    sure, missed = found.max(axis=1)[order], np.cumsum(found.argmax(axis=1)[order] != truth[order])
    fine = np.flatnonzero(missed <= wrong * np.arange(1, len(sure) + 1))
    whole = np.sort(found.max(axis=1)[examples["whole"].to_numpy(bool)[test]])
    threshold = min(float(sure[fine[-1]]) if len(fine) else 1.0, float(whole[int(lost * len(whole))]) if len(whole) else 0.0, 0.5)
    return Model(languages, table, bias.astype(np.float64), float(sharpness), threshold)


def fit_model(docs: DataFrame, sample: int = 1000) -> Model:
    """Train on at most ``sample`` labelled documents."""
    return train(training_examples(docs, sample))


def _predicted(docs: DataFrame, model: Model):
    """A column expression ``struct<lang_pred, score, accepted>`` of the text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return predict(F.col("text").cast("string"))


def identify_languages(docs: DataFrame, sample: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted for every row of ``docs``.

    The prediction reads nothing but the whole text. ``accepted`` is false where the calibrated
    probability lies below the threshold or the language is ``und``: a text that is null or has no
    letter, or a model without any language. Null labels are not learned from; rows repeated are
    predicted one by one. An empty table gives no rows. Other columns are ignored.
    """
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    found = docs.select("doc_id", (rest == 0).alias("held_out"), _predicted(docs, fit_model(docs, sample)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")


@apart_from("doc_id", "text", "lang")
def keep_identified(docs: DataFrame, sample: int = 1000) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns.

    A row with a null text, or without a letter, goes. Rows repeated are judged one by one; an empty
    table gives no rows.
    """
    marked = docs.withColumn("_language", _predicted(docs, fit_model(docs, sample)))
    return marked.filter("_language.accepted").drop("_language")
