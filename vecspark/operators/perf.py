"""Latency / throughput statistics and indexing rows as aggregations.

Latency stats (per group, in ms = seconds * 1000): exact linear-interpolation
percentiles 50/95/99 (equal to NumPy's default), mean, population std, min,
max.  Percentiles are exact, from counts per (group, value) whatever the size
of a group (``exact_quantiles``).  Throughput = n / sum(latency), 0 when the sum is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.constants import LATENCY_METRICS
from vecspark.schemas import measurement_rows


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], *, partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group, safe for hot groups and hot values.

    Rows are first counted per (group, value), so a repeated value is one row.
    Those are range-partitioned by (group, value), so one group may span many
    tasks, and written with their partition numbers.  Counts before a value in
    its partition and in earlier partitions give the ranks it covers; a
    quantile interpolates the values at ranks floor/ceil(p * (n - 1)), picked
    by a partial aggregate.  -> group cols + ``q0, q1, ...`` (one per prob).
    """
    from pyspark.sql import Window

    from vecspark.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    g = list(group_cols)
    P = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.select(*g, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
         .groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_w"))
         .repartitionByRange(P, *g, "_v").withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    cnt = (s.groupBy("_pid", *g).agg(F.sum("_w").alias("_c"))
           .withColumn("_off", F.sum("_c").over(Window.partitionBy(*g).orderBy("_pid")) - F.col("_c"))
           .withColumn("_n", F.sum("_c").over(Window.partitionBy(*g))))
    at = (s.withColumn("_end", F.sum("_w").over(Window.partitionBy("_pid", *g).orderBy("_v")))
          .join(cnt, ["_pid", *g]).withColumn("_end", F.col("_end") + F.col("_off")))
    picks, out = [], []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        for name, rank in (("a", F.floor(h)), ("b", F.ceil(h))):
            here = (rank >= F.col("_end") - F.col("_w")) & (rank < F.col("_end"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}{i}"))
        picks.append(F.max(h - F.floor(h)).alias(f"_f{i}"))
        out.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(f"q{i}"))
    return at.groupBy(*g).agg(*picks).select(*g, *out)


def latency_stats(lat: DataFrame, group_cols: Sequence[str] = ("engine", "worker_count"),
                  value_col: str = "latency_s", *, method: str = "distributed",
                  accuracy: int = 100000) -> DataFrame:
    """Group stats -> group cols + p50_ms, p95_ms, p99_ms, mean_ms, std_ms, min_ms, max_ms.

    ``method``: ``"distributed"`` = ``exact_quantiles`` (no group held by one
    task); ``"exact"`` = Spark ``percentile`` (the same values, a group's value
    map in one task); ``"approx"`` = ``percentile_approx``.
    Empty input gives no rows (a group exists only if it has latencies).
    """
    g = list(group_cols)
    ms = F.col(value_col) * F.lit(1000.0)
    moments = [F.avg(ms).alias("mean_ms"), F.stddev_pop(ms).alias("std_ms"),
               F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms")]
    if method == "distributed":
        qs = exact_quantiles(lat.select(*g, ms.alias("_ms")), g, "_ms", (0.5, 0.95, 0.99))
        return (qs.join(lat.groupBy(*g).agg(*moments), g)
                .select(*g, F.col("q0").alias("p50_ms"), F.col("q1").alias("p95_ms"),
                        F.col("q2").alias("p99_ms"), "mean_ms", "std_ms", "min_ms", "max_ms"))

    def pct(p):
        return F.percentile_approx(ms, p, accuracy) if method == "approx" else F.percentile(ms, F.lit(p))

    return lat.groupBy(*g).agg(
        pct(0.5).alias("p50_ms"), pct(0.95).alias("p95_ms"), pct(0.99).alias("p99_ms"), *moments)


def throughput(lat: DataFrame, group_cols: Sequence[str] = ("engine", "worker_count"),
               value_col: str = "latency_s") -> DataFrame:
    """queries/s = count / sum(latency); 0 if the sum is 0."""
    total = F.sum(value_col)
    return lat.groupBy(*group_cols).agg(
        F.when(total > 0, F.count(F.lit(1)) / total).otherwise(F.lit(0.0)).alias("qps"))


def performance_rows(lat: DataFrame, *, engine_col: str = "engine", workers_col: str = "worker_count",
                     value_col: str = "latency_s", method: str = "distributed") -> DataFrame:
    """Seven latency rows + one throughput row per (engine, worker_count), long form.

    Statistics and throughput are two aggregations, joined and unpivoted.
    """
    g = [engine_col, workers_col]
    stats = latency_stats(lat, g, value_col, method=method)
    total = F.sum(value_col)
    qps = lat.groupBy(*g).agg(F.when(total > 0, F.count(F.lit(1)) / total).otherwise(F.lit(0.0)).alias("qps"))
    wide = stats.join(qps, g)
    long = wide.unpivot(g, LATENCY_METRICS + ["qps"], "metric", "value")
    return measurement_rows(long.select(
        F.col(engine_col).alias("database"),
        F.when(F.col("metric") == "qps", "throughput").otherwise("latency").alias("operation"),
        "metric", "value", F.col(workers_col).alias("worker_count")))


def indexing_rows(load: DataFrame, *, database_col: str = "database") -> DataFrame:
    """insert_time, index_time, total_time (operation 'index') + usage_mb
    (operation 'memory') where memory is known."""
    idx = load.select(database_col, F.stack(
        F.lit(3),
        F.lit("insert_time"), F.col("insert_time").cast("double"),
        F.lit("index_time"), F.col("index_time").cast("double"),
        F.lit("total_time"), (F.col("insert_time") + F.col("index_time")).cast("double"),
    ).alias("metric", "value")).withColumn("operation", F.lit("index"))
    mem = (load.where(F.col("memory_mb").isNotNull())
           .select(database_col, F.lit("usage_mb").alias("metric"),
                   F.col("memory_mb").cast("double").alias("value"))
           .withColumn("operation", F.lit("memory")))
    return measurement_rows(idx.unionByName(mem).withColumnRenamed(database_col, "database"))


def scaling_efficiency(results: DataFrame) -> DataFrame:
    """100 * qps(n workers) / (qps(1 worker) * n) per database and n > 1; 0 if qps(1) = 0.

    Self-join of the throughput rows on ``database``.
    """
    t = results.where((F.col("operation") == "throughput") & (F.col("metric") == "qps"))
    single = t.where(F.col("worker_count") == 1).groupBy("database").agg(F.avg("value").alias("single_qps"))
    multi = (t.where(F.col("worker_count") > 1).groupBy("database", "worker_count")
             .agg(F.avg("value").alias("multi_qps")))
    theo = F.col("single_qps") * F.col("worker_count")
    return multi.join(single, "database").select(
        "database", "worker_count", "single_qps", "multi_qps",
        F.when((F.col("single_qps") != 0) & (theo > 0), F.col("multi_qps") / theo * 100.0)
        .otherwise(F.lit(0.0)).alias("efficiency_pct"))
