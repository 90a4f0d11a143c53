"""Latency statistics that merge: KLL quantile sketches and moments per group, stored without the raw latencies.

A run's latencies become one row per (engine, worker count): a sketch of a few
KB, the count, the sum, the sum of squares, the extremes.  Rows of any number
of runs merge by the same aggregate, in any order, and give the statistics of
all their latencies: quantiles within the sketch's rank error, the others exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: size parameter of the sketches: a rank error of about 0.7 % (single quantile, 99 % confidence)
SKETCH_K = 400
#: rank error to count on for a sketch of ``SKETCH_K``, with room for merges
RANK_ERROR = 0.02
GROUPS = ("engine", "worker_count")


def latency_sketches(lat: DataFrame, group_cols: Sequence[str] = GROUPS, value_col: str = "latency_s", *, k: int = SKETCH_K) -> DataFrame:
    """One row per group: group cols, sketch, n, total_ms, squares, min_ms, max_ms.  Null and NaN latencies are left out.

    Partial sketches are built where the rows lie, so a hot group moves one row per task.
    """
    ms = (F.col(value_col) * F.lit(1000.0)).alias("ms")
    rows = lat.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double"))).select(*group_cols, ms)
    return rows.groupBy(*group_cols).agg(
        F.kll_sketch_agg_double("ms", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"),
        F.sum(F.col("ms") * F.col("ms")).alias("squares"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def merge_sketches(sketches: DataFrame, group_cols: Sequence[str] = GROUPS, *, k: int = SKETCH_K) -> DataFrame:
    """Rows of the same group, from any runs, as one row of the same form."""
    return sketches.groupBy(*group_cols).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"), F.sum("total_ms").alias("total_ms"),
        F.sum("squares").alias("squares"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"))


def sketch_stats(sketches: DataFrame, group_cols: Sequence[str] = GROUPS) -> DataFrame:
    """group cols, n, p50_ms, p95_ms, p99_ms, mean_ms, std_ms, min_ms, max_ms: the columns of ``latency_stats``."""
    q = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    mean = F.col("total_ms") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean))
    return sketches.select(*group_cols, "n", q(0.5).alias("p50_ms"), q(0.95).alias("p95_ms"), q(0.99).alias("p99_ms"),
                           mean.alias("mean_ms"), std.alias("std_ms"), "min_ms", "max_ms")


def store_sketches(sketches: DataFrame, root: str, run: str) -> None:
    """Keep a run's rows at ``root``; a repeated run replaces its own."""
    (sketches.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(root))


def stored_stats(spark: SparkSession, root: str, group_cols: Sequence[str] = GROUPS) -> DataFrame:
    """Statistics over all stored runs."""
    return sketch_stats(merge_sketches(spark.read.parquet(root), group_cols), group_cols)


def rank_errors(stats: DataFrame, lat: DataFrame, group_cols: Sequence[str] = GROUPS, value_col: str = "latency_s") -> DataFrame:
    """group cols, e50, e95, e99: how far each quantile's share of latencies (below it, or up to it) is from the wanted one."""
    g, ms = list(group_cols), F.col(value_col) * F.lit(1000.0)
    names = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    both = lat.select(*g, ms.alias("_ms")).where(F.col("_ms").isNotNull()).join(stats.select(*g, *names), g)
    aggs = []
    for c, p in names.items():
        below, upto = F.avg((F.col("_ms") < F.col(c)).cast("double")), F.avg((F.col("_ms") <= F.col(c)).cast("double"))
        aggs.append(F.greatest(F.lit(0.0), below - p, p - upto).alias(f"e{c[1:3]}"))
    return both.groupBy(*g).agg(*aggs)
