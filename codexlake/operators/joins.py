"""Joins whose keys may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.sources.stage import stored

#: Rows of one key that one task should get.
SPLIT_ROWS = 100_000
#: Keys that are split may be broadcast up to so many; beyond, they are joined by shuffle.
BROADCAST_KEYS = 100_000


def split_join(many: DataFrame, few: DataFrame, key: str, by: str, rows: int | None = None) -> DataFrame:
    """``many`` joined with ``few`` on ``key``. Rows of a key that ``many`` has very often are dealt to parts by a hash of the
    column ``by``, and the key's rows of ``few`` go to all parts. Nothing is collected but counts."""
    parts = F.ceil(F.col("n") / (rows or SPLIT_ROWS)).cast("int").alias("parts")
    hot = stored(many.groupBy(key).agg(F.count("*").alias("n")).select(key, parts).filter("parts > 1"), "hot-keys")
    n = hot.count()
    if not n:
        return many.join(few, key)
    hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    parts = F.coalesce("parts", F.lit(1))
    a = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    b = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return a.join(b, [key, "_part"]).drop("_part")
