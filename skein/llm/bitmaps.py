"""A bitmap of hashed keys that drops rows before a join, so that only rows that may match are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, fixed by Spark's bitmap functions; bits per key; and bytes that may be broadcast.
BITS = 1 << 15
PER_KEY = 16
MOST = 64 << 20


def maybe(rows: DataFrame, keys: DataFrame, on: list[str], most: int = MOST) -> DataFrame:
    """The rows whose columns ``on`` may be among ``keys``, surely all that are; neither has nulls there.

    Bitmaps grow with the keys, which are counted first: where they would take over ``most`` bytes
    all rows pass, and the join that follows does the whole work.
    """
    count = max(1, -(-PER_KEY * keys.count() // BITS))
    if count * BITS // 8 > most:
        return rows
    place = F.pmod(F.xxhash64(*on), F.lit(count * BITS))
    bucket, bit = F.floor(place / BITS).cast("int"), (place % BITS).cast("int")
    made = keys.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    names = [F.col(c) for c in rows.columns]
    met = rows.select(*names, bucket.alias("_bucket"), bit.alias("_bit")).join(F.broadcast(made), "_bucket")
    byte = F.conv(F.hex(F.substr("_bitmap", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, F.col("_bit") % 8) == 1).select(*names)
