from __future__ import annotations

import random
import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EXTRAS = (
    "size kept shard key n node row_no component copies digest prefix_key bucket score target length extra0 part words low high mark id moved phrase run anchor "
    "_language _digest _prefix_key _shared _lose_id _lose_digest _twin_id _twin_digest _copies _again _mix_id _node _gone_id _id _of _mixed_id"
).split()


def docs_frame(spark, rows):
    """A documents table whose extra columns bear names the operators use inside."""
    full = [(d, t, lang, source, len(t) if t is not None else None, *["x"] * len(EXTRAS)) for d, t, lang, source in rows]
    extra = ", ".join(f"`{e}` string" for e in EXTRAS)
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    base = sentence(rng, 120)
    rows = [
        (1, base, "en", "b"), (2, base.upper(), "en", "b"), (3, base + " tail", "en", None), (4, base, None, "a"), (4, base, None, "a"),
        (5, None, "de", "a"), (6, "", "de", "c"), (7, " \n\t ", None, None), (None, base, "en", "a"), (None, None, None, None),
        (8, "short", "de", "c"), (9, "short", "de", "c"), (10, sentence(rng, 60_000, 5000), "en", "d"), (11, "x" * 300_000, "fr", "d"),
        (12, "Ünïcode ſtraße ΑΣ 12½ «ok» é <|endoftext|> it's fine\x1cend", "fr", "é"),
        (13, "same line\nsame line\n\nsame line\n" * 30, "en", "Z"),
    ]
    return rows + [(100 + i, sentence(rng, rng.randrange(1, 200)), "en" if i % 3 else "fr", "abcé"[i % 4]) for i in range(60)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return docs_frame(spark, odd_rows).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_frame(spark, [])
