"""Mergeable latency sketches against exact statistics."""

import math

from pyspark.sql import functions as F

from vecspark.operators.perf import latency_stats
from vecspark.operators.sketches import RANK_ERROR, latency_sketches, merge_sketches, rank_errors, sketch_stats, store_sketches, stored_stats
from vecspark.session import scratch_path


def latencies(spark):
    """Two engines, one of them hot, with a value that a third of its rows share."""
    i = F.col("id")
    return spark.range(60_000).select(
        F.when(i % 20 == 0, "rare").otherwise("hot").alias("engine"), F.lit(1).alias("worker_count"), i.alias("query_id"),
        F.when(i % 3 == 1, F.lit(0.25)).otherwise(F.pmod(F.xxhash64(i), F.lit(10_000)) / 20_000.0).alias("latency_s"))


def test_merged_runs_equal_all_latencies_within_the_rank_error(spark):
    lat = latencies(spark)
    parts = [latency_sketches(lat.where(F.col("query_id") % 7 == r)) for r in range(7)]
    forward, back = parts[0], parts[-1]
    for p, q in zip(parts[1:], reversed(parts[:-1])):
        forward = merge_sketches(forward.unionByName(p))                     # one by one, and in the other order
        back = merge_sketches(back.unionByName(q))
    exact = {r["engine"]: r for r in latency_stats(lat).collect()}
    for merged in (forward, back, latency_sketches(lat)):
        stats = sketch_stats(merged)
        for e in rank_errors(stats, lat).collect():
            assert max(e["e50"], e["e95"], e["e99"]) <= RANK_ERROR
        for r in stats.collect():
            x = exact[r["engine"]]
            assert r["n"] == (3000 if r["engine"] == "rare" else 57_000)
            assert (r["min_ms"], r["max_ms"]) == (x["min_ms"], x["max_ms"])
            assert math.isclose(r["mean_ms"], x["mean_ms"], rel_tol=1e-9) and math.isclose(r["std_ms"], x["std_ms"], rel_tol=1e-6)


def test_stored_runs(spark):
    lat, root = latencies(spark).limit(500), scratch_path(spark, "t-sketches")
    rows = lat.withColumn("latency_s", F.when(F.col("query_id") > 0, F.col("latency_s")))
    for run in ("a", "b", "b"):                                             # run b twice: replaced, not added
        store_sketches(latency_sketches(rows), root, run)
    got = {r["engine"]: r["n"] for r in stored_stats(spark, root).collect()}
    one = {r["engine"]: r["n"] for r in sketch_stats(latency_sketches(rows)).collect()}
    assert got == {e: 2 * n for e, n in one.items()} and sum(one.values()) == 499
    assert latency_sketches(rows.limit(0)).count() == 0
