"""Versioned sets of tables in one folder, written anew only where they change.

The rows of all tables of a store have a key, and lie in buckets of its hash. A snapshot is a list of files for each table and
bucket. An update writes only buckets with a changed key, as files of its own version, which no later one touches; other
buckets keep the files they had. What makes a snapshot the current one is its list, which is written after all its
files: readers see the last whole snapshot, whatever became of a writer. There is one writer at a time.

The number of buckets is that of the first snapshot; about a task's share of the largest table (some 100 MB) is a good size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A row for each bucket's files, and one (bucket -1) for each table, with its schema.
LISTED = "version long, name string, bucket int, buckets int, path string, schema string"


@dataclass(frozen=True)
class Snapshots:
    spark: SparkSession
    path: str
    key: str
    buckets: int = 64

    def listed(self) -> list:
        """The list of the last completed snapshot: a few rows for each table and bucket; empty if there is none."""
        try:
            rows = self.spark.read.schema(LISTED).json(f"{self.path}/snapshots/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        last = rows.agg(F.max("version")).first()[0]
        return rows.filter(F.col("version") == last).collect() if last else []

    def current(self) -> dict[str, DataFrame] | None:
        """The tables of the last completed snapshot."""
        rows = self.listed()
        return {r.name: self._read(r, [x.path for x in rows if x.name == r.name and x.bucket >= 0]) for r in rows if r.bucket < 0} or None

    def _read(self, table, paths: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table.schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def update(self, tables: dict[str, DataFrame], changed: DataFrame | None = None) -> dict[str, DataFrame]:
        """The next snapshot. ``tables`` has rows that are new or replace others; ``changed`` all keys that are inserted,
        replaced or removed (a stored table); None: all rows of the last snapshot go. The new snapshot's tables."""
        old = self.listed()
        version = old[0].version + 1 if old else 1
        n = old[0].buckets if old else self.buckets
        if not old or changed is None:
            touched, old = None, []
        else:
            touched = {r.b for r in changed.select(self._bucket(n).alias("b")).distinct().collect()}
        out = []
        for name, new in tables.items():
            top = f"{self.path}/versions/{version:08d}/{name}"
            kept = [r for r in old if r.name == name and r.bucket >= 0 and r.bucket not in touched]
            again = [r.path for r in old if r.name == name and r.bucket >= 0 and r.bucket in touched]
            if again:
                before = self.spark.read.schema(new.schema).parquet(*again)
                new = new.unionByName(before.join(changed.select(self.key).distinct(), self.key, "left_anti"))
            new.withColumn("_bucket", self._bucket(n)).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(top)
            out += [(version, name, b, n, p, None) for b, p in self._folders(top)] + [(version, name, r.bucket, n, r.path, None) for r in kept]
            out.append((version, name, -1, n, None, new.schema.json()))
        self.spark.createDataFrame(out, LISTED).coalesce(1).write.json(f"{self.path}/snapshots/{version:08d}")
        return self.current()

    def _folders(self, top: str) -> list[tuple[int, str]]:
        """The buckets that were written."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(top)
        found = [x.getPath() for x in there.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(there)]
        return [(int(p.getName().split("=")[1]), p.toString()) for p in found if "=" in p.getName()]
