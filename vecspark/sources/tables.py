"""The driver's parquet tables (one file per table under an ``sf`` folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


_CACHE: dict[tuple, tuple[SparkSession, DataFrame]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a (lazy) DataFrame; the resolved relation (file listing and
    footer schema) is kept per session like a catalog entry.

    Keyed by the SparkContext's application id (unique per context) and the
    session object itself, so a stopped and recreated session never sees a
    stale entry.
    """
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, id(spark), path)
    hit = _CACHE.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, spark.read.parquet(path))
        _CACHE[key] = hit
    return hit[1]
