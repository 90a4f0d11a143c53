"""Report tables over the long measurement table
``(database, operation, metric, value, worker_count, query_id)``.

Pivots name their pivot values explicitly: the distinct values of the
filtered subset are fetched first (one small aggregate; bounded by the number
of databases / metrics, checked) so the plan has a fixed schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.constants import (
    ENGINE_NAMES, HEATMAP_HIGHER_BETTER, HEATMAP_METRICS, LATENCY_THRESHOLD_MS, RECALL_THRESHOLD,
)
from vecspark.functions.text import title_words

MAX_PIVOT_VALUES = 10000


def results_filter(results: DataFrame, operation: str | None = None, metric: str | None = None,
                   worker_count: int | None = None, databases: Sequence[str] | None = None,
                   metric_prefix: Sequence[str] | None = None) -> DataFrame:
    cond = F.lit(True)
    if operation is not None:
        cond &= F.col("operation") == operation
    if metric is not None:
        cond &= F.col("metric") == metric
    if worker_count is not None:
        cond &= F.col("worker_count") == worker_count
    if databases:
        cond &= F.col("database").isin(list(databases))
    if metric_prefix:
        pc = F.lit(False)
        for p in metric_prefix:
            pc |= F.col("metric").startswith(p)
        cond &= pc
    return results.where(cond)


def results_catalog(results: DataFrame) -> DataFrame:
    """(kind, name, n_rows) for every database and every operation."""
    d = results.groupBy(F.col("database").alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    o = results.groupBy(F.col("operation").alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return (d.select(F.lit("database").alias("kind"), "name", "n_rows")
            .unionByName(o.select(F.lit("operation").alias("kind"), "name", "n_rows")))


def pivot_values(df: DataFrame, col: str) -> list:
    vals = [r[0] for r in df.select(col).distinct().orderBy(col).limit(MAX_PIVOT_VALUES + 1).collect()]
    if len(vals) > MAX_PIVOT_VALUES:
        raise ValueError(f"more than {MAX_PIVOT_VALUES} distinct {col} values to pivot")
    return vals


def pivot_mean(subset: DataFrame, index_col: str, decimals: int, pivot_col: str = "database") -> DataFrame:
    """Mean of ``value`` per (index, pivot value), rounded; one column per pivot value."""
    vals = pivot_values(subset, pivot_col)
    return (subset.groupBy(index_col).pivot(pivot_col, vals)
            .agg(F.round(F.avg("value"), decimals)))


def summary_pivot(results: DataFrame, operation: str, metric: str,
                  databases: Sequence[str] | None = None) -> DataFrame:
    return pivot_mean(results_filter(results, operation, metric, databases=databases), "worker_count", 3)


def latency_pivot(results: DataFrame) -> DataFrame:
    return pivot_mean(results_filter(results, "latency", worker_count=1), "metric", 2)


def throughput_pivot(results: DataFrame) -> DataFrame:
    return pivot_mean(results_filter(results, "throughput", "qps"), "worker_count", 1)


def quality_pivot(results: DataFrame, prefixes: Sequence[str] = ("recall", "mAP")) -> DataFrame:
    return pivot_mean(results_filter(results, "quality", metric_prefix=prefixes), "metric", 4)


def report_indexing(results: DataFrame) -> DataFrame:
    """Mean index time and memory per database (memory null when unknown)."""
    it = (F.col("operation") == "index") & (F.col("metric") == "total_time")
    mem = (F.col("operation") == "memory") & (F.col("metric") == "usage_mb")
    return (results.where(it | mem).groupBy("database")
            .agg(F.avg(F.when(it, F.col("value"))).alias("index_time_s"),
                 F.avg(F.when(mem, F.col("value"))).alias("memory_mb")))


def report_scaling(results: DataFrame) -> DataFrame:
    """QPS by worker count with the log2 x-axis value."""
    return (results_filter(results, "throughput", "qps")
            .select("database", "worker_count", F.log2(F.col("worker_count")).alias("log2_workers"),
                    F.col("value").alias("qps")))


def metric_titles(results: DataFrame, metrics: Sequence[str] = ("p50_ms", "p95_ms", "p99_ms")) -> DataFrame:
    return (results_filter(results, "latency", worker_count=1).where(F.col("metric").isin(list(metrics)))
            .select("database", "metric", title_words(F.col("metric")).alias("title"), "value"))


def latency_vs_quality(results: DataFrame, recall_threshold: float = RECALL_THRESHOLD,
                       latency_threshold_ms: float = LATENCY_THRESHOLD_MS) -> DataFrame:
    """p50 at one worker joined with recall@10 per database (inner: both needed)."""
    lat = (results_filter(results, "latency", "p50_ms", worker_count=1)
           .groupBy("database").agg(F.min_by("value", "worker_count").alias("p50_ms")))
    rec = (results_filter(results, "quality", "recall@10")
           .groupBy("database").agg(F.min_by("value", "worker_count").alias("recall_at_10")))
    good = F.col("recall_at_10") >= recall_threshold
    fast = F.col("p50_ms") <= latency_threshold_ms
    quad = (F.when(good & fast, "fast_accurate").when(good, "slow_accurate")
            .when(fast, "fast_inaccurate").otherwise("slow_inaccurate"))
    return lat.join(rec, "database").select("database", "p50_ms", "recall_at_10", quad.alias("quadrant"))


def _cell(op: str, met: str):
    cond = (F.col("operation") == op) & (F.col("metric") == met)
    if op == "throughput":
        return F.max(F.when(cond, F.col("value")))
    if op == "latency":
        cond &= F.col("worker_count") == 1
    # "first row": rows of (database, operation, metric[, 1 worker]) are unique
    # in a measurement table; min_by on worker_count keeps it deterministic
    return F.min_by(F.when(cond, F.col("value")), F.when(cond, F.col("worker_count")))


def performance_matrix(results: DataFrame) -> DataFrame:
    """(metric, database, value) for the 9 heatmap metrics; missing = 0."""
    wide = results.groupBy("database").agg(*[_cell(op, met).alias(f"m{i}")
                                             for i, (_, op, met) in enumerate(HEATMAP_METRICS)])
    cells = F.array(*[F.struct(F.lit(label).alias("metric"), F.col(f"m{i}").alias("value"))
                      for i, (label, _, _) in enumerate(HEATMAP_METRICS)])
    return (wide.select("database", F.explode(cells).alias("c"))
            .select(F.col("c.metric").alias("metric"), "database",
                    F.coalesce(F.col("c.value"), F.lit(0.0)).alias("value")))


def performance_normalized(matrix: DataFrame) -> DataFrame:
    """Higher-better metrics v / max, the others 1 - v / max; max 0 -> null."""
    mx = F.max("value").over(Window.partitionBy("metric"))
    r = F.col("value") / F.when(mx != 0, mx)
    return matrix.select("metric", "database",
                         F.when(F.col("metric").isin(HEATMAP_HIGHER_BETTER), r).otherwise(F.lit(1.0) - r)
                         .alias("score"))


def engine_scorecard(results: DataFrame) -> DataFrame:
    """One row per database: the summary the benchmark prints."""
    def pick(op, met, wc1=False):
        cond = (F.col("operation") == op) & (F.col("metric") == met)
        if wc1:
            cond &= F.col("worker_count") == 1
        return F.min_by(F.when(cond, F.col("value")), F.when(cond, F.col("worker_count")))

    qps = (F.col("operation") == "throughput") & (F.col("metric") == "qps")
    cols = [pick("index", "total_time").alias("total_time_s"),
            pick("memory", "usage_mb").alias("memory_mb"),
            pick("latency", "p50_ms", True).alias("p50_ms"),
            pick("latency", "p95_ms", True).alias("p95_ms"),
            pick("latency", "p99_ms", True).alias("p99_ms"),
            F.max_by(F.when(qps, F.col("value")), F.when(qps, F.col("worker_count"))).alias("max_workers_qps"),
            pick("quality", "recall@1").alias("recall_at_1"),
            pick("quality", "recall@10").alias("recall_at_10"),
            pick("quality", "mAP@10").alias("map_at_10")]
    for k in (1, 5, 10, 20):
        cols.append(pick("evaluation", f"recall@{k}").alias(f"eval_recall_at_{k}"))
    cols.append(pick("evaluation", "mrr").alias("eval_mrr"))
    return results.groupBy("database").agg(*cols)


def engine_classify(df: DataFrame, name_col: str, engines: Sequence[str] = ENGINE_NAMES,
                    out_col: str = "engine") -> DataFrame:
    """First engine name contained in lower(name); rows matching none are dropped."""
    low = F.lower(F.col(name_col))
    e = None
    for name in engines:
        e = F.when(low.contains(name), F.lit(name)) if e is None else e.when(low.contains(name), F.lit(name))
    return df.withColumn(out_col, e).where(F.col(out_col).isNotNull())
