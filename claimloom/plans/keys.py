"""Devices against long keys that joins move: digests instead of them, and filters ahead of the exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGEST_BYTES = 12
#: Bits of a filter: so many a key, within these limits. The upper one bounds what every task is sent (32 MB).
_BITS_PER_KEY, _LEAST_BITS, _MOST_BITS = 16, 1 << 15, 1 << 28
_BITMAP = 1 << 15  # bits of one ``bitmap_construct_agg``


def digest(key: Column | str) -> Column:
    """96 bits of the key's MD5, null where it is null: what a join exchanges of a long id that nobody reads behind it."""
    return F.substring(F.unhex(F.md5(F.col(key) if isinstance(key, str) else key)), 1, _DIGEST_BYTES)


def possibly_in(rows: DataFrame, key: str, wanted: DataFrame, mark: str = "_possible") -> DataFrame:
    """``rows`` with ``mark``, which is false only where ``key`` is null or not among the one column of ``wanted``.

    ``wanted`` is counted and read again, so it should be staged. Its keys become a bitmap of their hashes of at
    most 32 MB, which travels to the tasks; rows that no join can match then need no exchange. A key
    that only shares its bit is marked, too: the join itself decides.
    """
    (name,) = wanted.columns
    bits = _LEAST_BITS
    n = wanted.count()
    while bits < min(_MOST_BITS, n * _BITS_PER_KEY):
        bits *= 2
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    places = wanted.filter(F.col(name).isNotNull()).select(at(name).alias("_at")).select(
        F.floor(F.col("_at") / _BITMAP).cast("int").alias("_part"), (F.col("_at") % _BITMAP).alias("_bit")
    )
    # keys, not bitmaps, go through the exchange
    maps = places.repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    placed = rows.withColumn("_at", F.when(F.col(key).isNotNull(), at(key))).withColumn("_part", F.floor(F.col("_at") / _BITMAP).cast("int"))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.col("_at") % _BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("pow(2, _at % 8)").cast("int")
    found = placed.join(F.broadcast(maps), "_part", "left").withColumn(mark, F.coalesce(byte.bitwiseAND(bit) > 0, F.lit(False)))
    return found.select(*rows.columns, mark)
