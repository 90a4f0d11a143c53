"""One benchmark run of all engines: measured rows, rejects, repeated runs, reports over the stored table."""

import pytest
from pyspark.sql import functions as F

from vecspark.plans import benchmark as B
from vecspark.plans.reports import engine_scorecard, latency_vs_quality, results_catalog
from vecspark.schemas import MEASUREMENT_COLUMNS
from vecspark.session import scratch_path


@pytest.fixture(scope="module")
def vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ddl = "{} long, embedding array<double>"
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:100])] + [(900, None), (901, [0.0] * 8), (902, [1.0])],
                                  ddl.format("vector_id"))
    return index, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[100:])], ddl.format("query_id"))


def test_every_engine_is_measured(spark, vectors):
    index, queries = vectors
    good = index.where("vector_id < 900")
    passages = good.select("vector_id", F.concat(F.lit("passage "), "vector_id").alias("text"), "embedding")
    asked = queries.select("query_id", F.concat(F.lit("query "), "query_id").alias("text"), "embedding")
    from vecspark.operators.knn import knn_exact
    # the second best passage of each query is the relevant one
    qrels = knn_exact(good, queries, 2, cosine=True).where("rank = 2").select(
        F.concat(F.lit("query "), "query_id").alias("query"), F.concat(F.lit("passage "), "vector_id").alias("passage"))
    root = scratch_path(spark, "t-measurements")
    engines = {"exact": B.exact_engine(), "ivf": B.ivf_engine(3, nlist=6), "lsh": B.lsh_engine(bands=2, bits=3),
               "graph": B.graph_engine(ef=100, degree=8, neighbours=8, rounds=2)}
    judged = B.Judged(passages, asked, qrels)
    rows = B.run_benchmark(spark, good, queries, engines, root, run="a", k=5, repeats=2, judged=judged, ks=(1, 5), judged_ks=(1, 2))
    assert rows.columns == MEASUREMENT_COLUMNS
    got = {(r["database"], r["operation"], r["metric"]): r["value"] for r in rows.collect()}
    assert len(got) == rows.count()
    for e in engines:
        assert {m for d, o, m in got if d == e and o == "index"} == {"insert_time", "index_time", "total_time", "n_rows", "n_rejected"}
        assert got[e, "index", "n_rows"] == 100 and got[e, "index", "n_rejected"] == 0 and got[e, "index", "insert_time"] > 0
        assert got[e, "throughput", "qps"] > 0 and len([1 for d, o, _ in got if d == e and o == "latency"]) == 7
        assert {m for d, o, m in got if d == e and o == "quality"} == {f"{m}@{k}" for m in ("recall", "precision", "mAP", "NDCG") for k in (1, 5)}
    for e in ("exact", "graph"):
        assert got[e, "quality", "recall@5"] == 1.0
        assert (got[e, "evaluation", "recall@1"], got[e, "evaluation", "recall@2"], got[e, "evaluation", "mrr"]) == (0.0, 1.0, 0.5)
    assert 0 < got["lsh", "quality", "recall@5"] < 1
    assert latency_vs_quality(rows.withColumn("metric", F.regexp_replace("metric", "recall@5", "recall@10"))).count() == 4
    card = {r["database"]: r for r in engine_scorecard(rows).collect()}
    assert set(card) == set(engines) and all(r["recall_at_1"] is not None and r["total_time_s"] > 0 for r in card.values())
    # a repeated run replaces its own rows only
    B.run_benchmark(spark, good, queries, {"exact": engines["exact"]}, root, run="b", k=5, repeats=1)
    B.run_benchmark(spark, good, queries, {"exact": engines["exact"]}, root, run="b", k=5, repeats=1)
    both = B.read_measurements(spark, root)
    assert both.where("run = 'a'").count() == len(got)
    assert both.where("run = 'b' AND operation = 'index'").count() == 5 and both.where("run = 'b' AND operation = 'evaluation'").count() == 0
    assert results_catalog(both).where("kind = 'database'").count() == 4


def test_load_counts_and_rejects(spark, vectors):
    index, queries = vectors
    load = B.timed_load(index, scratch_path(spark, "t-load"))
    assert (load.n_rows, load.n_rejected) == (100, 3) and load.insert_time > 0
    from vecspark.sinks import vector_table as vt
    assert vt.read(spark, load.root).count() == 100
    assert B.timed_load(index.limit(0), scratch_path(spark, "t-load")).n_rows == 0


def test_failing_engines_fail_the_run(spark, vectors):
    index, queries = vectors
    with pytest.raises(ValueError):
        B.run_benchmark(spark, index, queries, {}, scratch_path(spark, "t-none"), run="x")

    def broken(*a):
        raise RuntimeError("broken engine")

    with pytest.raises(RuntimeError, match="broken engine"):
        B.run_benchmark(spark, index.where("vector_id < 900"), queries, {"broken": B.Engine(broken, broken)}, scratch_path(spark, "t-broken"), run="x")


def test_no_vectors_are_broadcast(spark):
    """Files of vectors that compress well are far smaller than their rows: Spark must not pick them for a broadcast."""
    from vecspark.operators.ann import centroids_from_rows, ivf_assign, ivf_search, lsh_search

    path = scratch_path(spark, "t-alike")
    spark.range(3000).select(F.col("id").alias("vector_id"), F.array([(F.col("id") % (i + 2)).cast("double") for i in range(16)]).alias("embedding")
                             ).write.parquet(path)
    index = spark.read.parquet(path)
    queries = index.where("vector_id % 10 = 1").withColumnRenamed("vector_id", "query_id")
    cents = centroids_from_rows(index, F.col("vector_id").between(1, 4))
    for found in (lsh_search(index, queries, 3, bands=2, bits=3, cosine=True), ivf_search(ivf_assign(index, cents), queries, cents, 3, 2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        # cell sizes are on the right of their joins, vectors on the left
        assert "BuildRight" in plan and "BuildLeft" not in plan
        assert found.where("rank = 1").count() == 300
    many = lsh_search(index, queries, 3, bands=2, bits=13, cosine=True)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString() and many.where("rank = 1").count() == 300


def test_hash_embed_keeps_columns(spark):
    from vecspark.operators.embed import hash_embed

    texts = spark.createDataFrame([(0, "a b a", 7), (1, "", 8), (2, "c", 9)], "id long, text string, pos int")
    kept = hash_embed(texts, id_col="id", dim=8, keep=["text", "pos"])
    assert kept.columns == ["id", "text", "pos", "embedding"]
    joined = texts.join(hash_embed(texts, id_col="id", dim=8), "id")
    assert sorted(kept.collect()) == sorted(joined.collect())
