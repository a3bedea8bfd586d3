"""What the training-data operators share: the word rule, the shared folder, stored tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.sources.stage import scratch, shared_folder, stored

__all__ = ["SPACE", "BROADCAST_ROWS", "documents", "few_by_hash", "file_order", "new_path", "scratch", "shared_folder", "small", "stored", "text_key", "words"]

#: Fixed value: what separates words. A word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"

#: Side tables of at most so many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Array of the text's words; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows are within the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def few_by_hash(df: DataFrame, key: str, n: int, total: int | None = None) -> list:
    """The n rows whose key has the least hash, for fitting a model on a bounded sample. Rows
    far above the n-th are left out before sorting, so tasks send a few times n rows in all. ``total``
    may be a cheaper count of more rows than these; if that leaves too few, they are counted."""
    h = F.xxhash64(key)
    rows = df.count() if total is None else total
    most, near = 4 * n / max(1, rows), df
    if most < 0.5:  # hashes are spread evenly over 64 bits
        near = df.filter(h < F.lit(int(-(1 << 63) + most * (1 << 64))))
    out = near.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h").collect()
    return out if total is None or len(out) == n or near is df else few_by_hash(df, key, n)


def text_key(text: Column) -> Column:
    """64-bit hash of a text, which tells rows with equal or null ids apart."""
    return F.xxhash64(text)


def file_order(docs: DataFrame) -> tuple[Column, ...]:
    """Columns that give the rows of a sorted and stored table their order again: the names of its
    files, and the rows' places in them. None for a table that is not read straight from files."""
    try:
        place = docs.metadataColumn("_metadata")
    except AnalysisException:
        return ()
    return place["file_name"], place["row_index"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
