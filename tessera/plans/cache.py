"""Result cache: keys, and Parquet tables by key prefix."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(content: Column, schema_fingerprint: str, model_id: str) -> Column:
    """SHA-256 of content, schema and model, with zero bytes between."""
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(content.cast("binary"), zero, F.lit(schema_fingerprint).cast("binary"), zero, F.lit(model_id).cast("binary")), 256)


def split_by_cache(docs: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a ``cache_key`` that is cached, and the others."""
    keys = cached.select("cache_key")
    return docs.join(keys, "cache_key", "left_semi"), docs.join(keys, "cache_key", "left_anti")


def _prefix() -> Column:
    """Of 256; a letter first, so that no partition is read as a number."""
    return F.concat(F.lit("k"), F.substring("cache_key", 1, 2))


class TableCache:
    """Rows with ``cache_key``, partitioned by its first two digits; older than ``ttl_s`` they don't count.

    Of a key written twice the later rows count, until ``compact`` drops the others.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_s: float | None = None):
        self.spark, self.path, self.ttl_s = spark, path, ttl_s

    def put(self, rows: DataFrame, now: float | None = None) -> None:
        stamped = rows.withColumns({"cached_at": F.lit(time.time() if now is None else now), "prefix": _prefix()})
        stamped.write.mode("append").partitionBy("prefix").parquet(self.path)

    def get(self, now: float | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """What counts, or None if there is no table; ``keys`` (cache_key): only these, of which only the partitions are read."""
        try:
            rows = self.spark.read.parquet(self.path)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        if self.ttl_s is not None:
            rows = rows.where(F.col("cached_at") >= (time.time() if now is None else now) - self.ttl_s)
        if keys is not None:
            asked = keys.select("cache_key").distinct()
            prefixes = [r[0] for r in asked.select(_prefix()).distinct().collect()]  # at most 256
            rows = rows.where(F.col("prefix").isin(*prefixes)).join(asked, "cache_key", "left_semi")
        last = rows.groupBy("cache_key").agg(F.max("cached_at").alias("cached_at"))
        return rows.join(last, ["cache_key", "cached_at"], "left_semi").drop("prefix")

    def compact(self, now: float | None = None) -> None:
        """Writes what counts to a new folder and puts it in the old one's place: rows that were replaced or are too old go."""
        rows = self.get(now)
        if rows is None:
            return
        fresh = f"{self.path.rstrip('/')}-compact"
        rows.withColumn("prefix", _prefix()).write.mode("overwrite").partitionBy("prefix").parquet(fresh)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(path(self.path), True)
        files.rename(path(fresh), path(self.path))


class MemoryCache:
    """DataFrames by name, kept in executor memory; older than ``ttl_s`` they don't count and are let go."""

    def __init__(self, ttl_s: float | None = None) -> None:
        self.ttl_s = ttl_s
        self.tables: dict[str, tuple[float, DataFrame]] = {}

    def put(self, name: str, rows: DataFrame, now: float | None = None) -> None:
        self.tables[name] = (time.time() if now is None else now, rows.cache())

    def get(self, name: str, now: float | None = None) -> DataFrame | None:
        if name not in self.tables:
            return None
        at, rows = self.tables[name]
        if self.ttl_s is not None and (time.time() if now is None else now) - at > self.ttl_s:
            rows.unpersist()
            del self.tables[name]
            return None
        return rows
