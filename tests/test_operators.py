"""Properties of the k-NN operators, sinks, stats and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from vecspark.operators.ann import ivf_assign, ivf_search
from vecspark.operators.knn import knn_exact, search_one
from vecspark.plans.views import Views


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["vector_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF_MID)


def test_ivf_all_lists_equals_exact(views):
    all_lists = views.pred_at(16)
    assert _rows(all_lists) == _rows(views.gt)


def test_recall_non_decreasing_in_nprobe(views):
    from vecspark.operators.ir import quality_scores
    rec = [quality_scores(views.pred_at(p), views.gt, (10,)).first()["recall"] for p in (1, 2, 4, 8, 16)]
    assert rec == sorted(rec) and rec[-1] == 1.0


def test_chunked_queries_equal_single_chunk(views):
    small = knn_exact(views.index, views.queries, 10, max_chunk_bytes=20_000)   # many chunks
    assert _rows(small) == _rows(views.gt)


def test_partition_count_independent(views):
    a = knn_exact(views.index.repartition(7), views.queries, 10)
    assert _rows(a) == _rows(views.gt)


def test_batch_equals_single_searches(spark, views):
    qs = views.queries.orderBy("query_id").limit(3).collect()
    gt = {}
    for r in _rows(views.gt):
        gt.setdefault(r[0], []).append(r[2])
    for q in qs:
        one = search_one(views.index, [float(x) for x in q["embedding"]], 10).collect()
        assert [r["vector_id"] for r in one] == gt[q["query_id"]]


def test_cosine_scale_invariant(spark, views):
    scaled = views.index.select("vector_id", F.transform("embedding", lambda x: x * 3.0).alias("embedding"))
    a = knn_exact(scaled, views.queries, 10, cosine=True)
    assert [r[:3] for r in _rows(a)] == [r[:3] for r in _rows(views.gt)]


def test_ties_broken_by_id(spark):
    idx = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 1)], "vector_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["vector_id"] for r in knn_exact(idx, q, 3).orderBy("rank").collect()] == [1, 3, 5]


def test_plans_have_no_cartesian_product(views):
    for df in (views.gt, views.pred):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "WindowGroupLimit" in plan


def test_scan_is_pruned_and_filtered(views):
    plan = views.index._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), LessThan(vec_id," in plan
    assert "label" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_latency_stats_example(spark):
    from vecspark.operators.perf import latency_stats, throughput
    lat = spark.createDataFrame([("e", 1, i, float(i)) for i in (1, 2, 3, 4)],
                                "engine string, worker_count int, query_id long, latency_s double")
    s = latency_stats(lat).first()
    assert s["p50_ms"] == pytest.approx(2500.0)
    assert s["std_ms"] == pytest.approx(1118.033989, rel=1e-9)
    assert throughput(lat).first()["qps"] == pytest.approx(0.4)


def test_scaling_zero_single_qps(spark):
    from vecspark.operators.perf import scaling_efficiency
    r = spark.createDataFrame([("d", "throughput", "qps", 0.0, 1, None), ("d", "throughput", "qps", 5.0, 4, None)],
                              "database string, operation string, metric string, value double, worker_count int, query_id int")
    assert scaling_efficiency(r).first()["efficiency_pct"] == 0.0


def test_dimension_and_zero_vector_rejected(spark):
    from vecspark.sinks.vector_table import dimension_check
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "id long, embedding array<double>")
    got = {r["id"]: (r["status"], r["reason"]) for r in dimension_check(df, 2).collect()}
    assert got == {1: ("valid", None), 2: ("rejected", "zero_norm"), 3: ("rejected", "dimension")}


def test_l2_normalize_zero_vector_is_null(spark):
    from vecspark.functions.vector import l2_normalize
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    out = [r[0] for r in df.select(l2_normalize("v")).collect()]
    assert out[0] is None and out[1] == pytest.approx([0.6, 0.8])


def test_upsert_idempotent(spark):
    from vecspark.session import scratch_path
    from vecspark.sinks import vector_table as vt
    root = scratch_path(spark, "t-upsert")
    base = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "vector_id long, embedding array<double>")
    vt.overwrite(vt.to_vector_table(base), root)
    new = spark.createDataFrame([(3, [30.0]), (7, [70.0])], "vector_id long, embedding array<double>")
    for _ in range(2):
        vt.upsert(vt.to_vector_table(new), root, 1)
    got = {r["vector_id"]: r["embedding"][0] for r in vt.read(spark, root).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0, 3: 30.0, 4: 4.0, 7: 70.0}


def test_synthetic_is_partition_independent(spark):
    from vecspark.sources.corpus import synthetic_corpus, synthetic_vectors
    a = synthetic_corpus(spark, 50, partitions=1).collect()
    b = synthetic_corpus(spark, 50, partitions=7).collect()
    assert sorted(a) == sorted(b)
    v = synthetic_vectors(spark, 20, 16, partitions=3).collect()
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-12 for r in v)


def test_dense_index_is_gapless(spark):
    from vecspark.operators.ids import dense_index
    df = spark.range(0, 1000, 1, 13).select((F.col("id") * 7 % 1000).alias("k"))
    pos = sorted((r["k"], r["pos"]) for r in dense_index(df, ["k"]).collect())
    assert [p for _, p in pos] == list(range(1000))


def test_embed_hook_runs_encoder_per_task(spark):
    from vecspark.operators.embed import embed

    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abcd"), (2, "ab")], "id long, text string")
    out = {r["id"]: r["embedding"] for r in embed(df, factory).collect()}
    assert out[1] == pytest.approx([4 / np.sqrt(17), 1 / np.sqrt(17)], rel=1e-6)


def test_distributed_quantiles_equal_builtin(spark):
    from vecspark.operators.perf import latency_stats
    lat = Views(spark, SF_MID).lat
    a = {(r["engine"], r["worker_count"]): r for r in latency_stats(lat, method="exact").collect()}
    b = {(r["engine"], r["worker_count"]): r for r in latency_stats(lat, method="distributed").collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in ("p50_ms", "p95_ms", "p99_ms", "mean_ms", "std_ms", "min_ms", "max_ms"):
            assert b[k][c] == pytest.approx(a[k][c], rel=1e-12, abs=1e-9)


def test_distributed_quantiles_hot_group(spark):
    from vecspark.operators.perf import exact_quantiles
    # one group holds most rows and spans many range partitions
    df = spark.range(0, 20000, 1, 8).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 20000).cast("double").alias("v"))
    got = {r["g"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, ["g"], "v", (0.5, 0.99), partitions=16).collect()}
    pdf = df.toPandas()
    for g, grp in pdf.groupby("g"):
        assert got[g][0] == pytest.approx(np.percentile(grp["v"], 50))
        assert got[g][1] == pytest.approx(np.percentile(grp["v"], 99))


def test_quantiles_of_one_repeated_value(spark):
    from vecspark.operators.perf import exact_quantiles
    df = spark.range(0, 5000, 1, 8).select(F.lit("g").alias("g"), F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    q = exact_quantiles(df, ["g"], "v", (0.0, 0.5, 0.8, 1.0), partitions=8).first()
    v = [7.0] * 4000 + [float(i) for i in range(4000, 5000)]
    assert list(q)[1:] == pytest.approx([np.quantile(v, p) for p in (0.0, 0.5, 0.8, 1.0)])


def test_null_id_fails_the_write(spark):
    from vecspark.session import scratch_path
    from vecspark.sinks import vector_table as vt
    df = spark.createDataFrame([(1, [1.0]), (None, [2.0])], "vector_id long, embedding array<double>")
    with pytest.raises(Exception, match="vector_id is null"):
        vt.overwrite(vt.to_vector_table(df), scratch_path(spark, "t-null"))


def test_small_cells_equal_whole_ones(spark, views):
    """Cells of few rows and queries, for every candidate rule, give the rows of large ones."""
    from vecspark.operators.ann import ivf_probes, lsh_search
    from vecspark.operators.blockscan import block_knn
    small = {"max_chunk_bytes": 10_000, "group_bytes": 10_000}
    assert _rows(block_knn(views.index, views.queries, 10, **small)) == _rows(views.gt)
    probes = ivf_probes(views.queries, views.centroids, 4)
    got = block_knn(views.index_lists, probes, 10, mode="ivf", list_col="list_id", probe_col="probes", **small)
    assert _rows(got) == _rows(views.pred)
    assert _rows(lsh_search(views.index, views.queries, 10, max_chunk_bytes=10_000)) == _rows(lsh_search(views.index, views.queries, 10))


def test_null_vectors_take_no_part(spark):
    from vecspark.operators.ann import centroids_from_rows, lsh_search
    idx = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0])], "vector_id long, embedding array<double>")
    qs = spark.createDataFrame([(0, [1.0, 0.5]), (1, None)], "query_id long, embedding array<double>")
    assert _rows(knn_exact(idx, qs, 3)) == [(0, 1, 0), (0, 2, 2)]
    cents = centroids_from_rows(idx, F.col("vector_id") == 0)
    assert _rows(ivf_search(ivf_assign(idx, cents), qs, cents, 3, 1)) == [(0, 1, 0), (0, 2, 2)]
    assert {r[2] for r in _rows(lsh_search(idx, qs, 3, bands=2, bits=1))} <= {0, 2}


def test_all_judged_texts_are_searched(spark):
    v = Views(spark, SF_MID)
    from vecspark.functions.text import stripped_length
    assert v.qtexts.count() == v.examples.queries.where(stripped_length("query") > 5).count()
    assert v.ptexts.count() == v.examples.passages.where(stripped_length("passage_text") > 10).count()


def test_ivf_build_prunes_lists(spark, views):
    from vecspark.operators.ann import ivf_build
    from vecspark.session import scratch_path
    stored = ivf_build(views.index, views.centroids, scratch_path(spark, "t-ivf"))
    got = ivf_search(stored, views.queries, views.centroids, 10, 4)
    assert _rows(got) == _rows(views.pred)


def test_ivf_fit_kmeans_recall_monotone(spark, views):
    from vecspark.operators.ann import ivf_fit
    from vecspark.operators.ir import quality_scores
    c = ivf_fit(views.index, 8)
    assigned = ivf_assign(views.index, c)
    rec = [quality_scores(ivf_search(assigned, views.queries, c, 10, p), views.gt, (10,)).first()["recall"]
           for p in (1, 8)]
    assert rec[0] <= rec[1] and rec[1] == 1.0


def test_vector_table_base_read_has_no_shuffle(spark):
    from vecspark.session import scratch_path
    from vecspark.sinks import vector_table as vt
    root = scratch_path(spark, "t-read")
    base = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "vector_id long, embedding array<double>")
    vt.overwrite(vt.to_vector_table(base), root)
    plan = vt.read(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    vt.upsert(vt.to_vector_table(base.where("vector_id < 5").selectExpr("vector_id", "array(-1d) AS embedding")), root, 1)
    got = {r["vector_id"]: r["embedding"][0] for r in vt.read(spark, root).collect()}
    assert len(got) == 50 and got[3] == -1.0 and got[10] == 10.0


def test_nested_and_flat_examples_agree(spark):
    from vecspark.sources.corpus import (conversation_examples, examples_from_conversations, explode_examples,
                                         passage_extract, qrels_extract)
    conv = Views(spark, SF_SMALL).table("conversations")
    flat = conversation_examples(conv)
    nested = explode_examples(examples_from_conversations(conv))
    assert sorted(passage_extract(flat, 10**6).collect()) == sorted(passage_extract(nested, 10**6).collect())
    key = lambda r: (r["query"], r["passage"])
    assert sorted(map(key, qrels_extract(flat).collect())) == sorted(map(key, qrels_extract(nested).collect()))


def test_ivf_sweep_equals_separate_searches(views):
    from vecspark.operators.ann import ivf_sweep
    sw = ivf_sweep(views.index_lists, views.queries, views.centroids, 10, (1, 4, 16)).collect()
    for p in (1, 4, 16):
        got = sorted((r["query_id"], r["rank"], r["vector_id"]) for r in sw if r["nprobe"] == p)
        assert got == _rows(views.pred_at(p))


def test_hot_bucket_and_hot_list_stay_exact(spark):
    """Two thirds of the index in one LSH bucket / one IVF list: results stay exact."""
    from vecspark.operators.ann import centroids_from_rows, lsh_search
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    X = np.vstack([base + 1e-3 * rng.normal(size=(400, 8)), rng.normal(size=(200, 8))])
    Q = np.vstack([base + 1e-3 * rng.normal(size=(10, 8)), rng.normal(size=(10, 8))])
    idx = spark.createDataFrame([(i, X[i].tolist()) for i in range(600)], "vector_id long, embedding array<double>")
    qs = spark.createDataFrame([(i, Q[i].tolist()) for i in range(20)], "query_id long, embedding array<double>")
    exact = _rows(knn_exact(idx, qs, 5))
    # LSH with 2 bands of 1 bit: the hot bucket admits ~2/3 of all pairs;
    # the result must equal brute force over the same candidate rule
    from vecspark.operators.ann import planes_matrix
    from vecspark.operators.blockscan import band_keys
    P = planes_matrix(spark, 8, 2, 1, 42)
    xk, qk = band_keys((X @ P.T) > 0, 2, 1), band_keys((Q @ P.T) > 0, 2, 1)
    exp = []
    for q in range(20):
        cand = [j for j in range(600) if (xk[j] == qk[q]).any()]
        best = sorted(cand, key=lambda j: (-(Q[q] @ X[j]), j))[:5]
        exp += [(q, r + 1, j) for r, j in enumerate(best)]
    assert _rows(lsh_search(idx, qs, 5, bands=2, bits=1)) == sorted(exp)
    cents = centroids_from_rows(idx, F.col("vector_id").isin(0, 500))
    assigned = ivf_assign(idx, cents)
    sizes = {r["list_id"]: r["count"] for r in assigned.groupBy("list_id").count().collect()}
    assert max(sizes.values()) >= 400
    assert _rows(ivf_search(assigned, qs, cents, 5, 2)) == exact


def test_synthetic_query_stream_is_independent(spark):
    from vecspark.sources.corpus import synthetic_vectors
    a = synthetic_vectors(spark, 5, 8).collect()
    b = synthetic_vectors(spark, 5, 8, stream="query", normalize=False, id_col="query_id").collect()
    assert a[0]["embedding"] != b[0]["embedding"]
    assert abs(np.linalg.norm(b[0]["embedding"]) - 1) > 1e-6


def test_summary_pivot_database_filter(spark):
    from vecspark.plans.reports import summary_pivot
    from vecspark.operators.perf import performance_rows
    res = performance_rows(Views(spark, SF_SMALL).lat)
    full = summary_pivot(res, "latency", "p50_ms")
    two = summary_pivot(res, "latency", "p50_ms", databases=["click", "view"])
    assert set(two.columns) == {"worker_count", "click", "view"}
    a = {r["worker_count"]: (r["click"], r["view"]) for r in full.collect()}
    b = {r["worker_count"]: (r["click"], r["view"]) for r in two.collect()}
    assert a == b


def test_passage_extract_clamp(spark):
    from vecspark.sources.corpus import conversation_examples, passage_extract
    ex = conversation_examples(Views(spark, SF_SMALL).table("conversations"))
    got = passage_extract(ex, 1000, max_n=7).collect()
    assert sorted(r["vector_id"] for r in got) == list(range(7))


def test_register_custom_strategy(spark, views):
    from vecspark.operators.ann import STRATEGIES, compare_strategies, register_strategy
    from vecspark.operators.knn import batch_search

    def first_ids(index, queries, k, **kw):   # a deliberately naive engine: the k lowest ids
        return knn_exact(index.where(F.col("vector_id") < k), queries, k)

    register_strategy("naive", first_ids)
    try:
        got = batch_search(views.index, views.queries, 3, strategy="naive")
        assert {r["vector_id"] for r in got.collect()} == {0, 1, 2}
        both = compare_strategies(views.index, views.queries, 3, ["exact", "naive"])
        assert {r["engine"] for r in both.select("engine").distinct().collect()} == {"exact", "naive"}
        with pytest.raises(ValueError):
            compare_strategies(views.index, views.queries, 3, ["nope"])
    finally:
        STRATEGIES.pop("naive", None)


def test_extraction_keys_over_all_conversations(spark):
    from pyspark.sql import functions as F

    from vecspark.functions.text import stripped_length
    from vecspark.plans.catalog import QUERIES
    from vecspark.plans.views import Views

    v = Views(spark, SF_SMALL)
    passages = v.examples.passages.where(stripped_length("passage_text") > 10).count()
    texts = v.table("documents").where(stripped_length("text") > 10).count()
    n = {k: QUERIES[k](spark, SF_SMALL).count() for k in ("passage_extract_all", "passage_ids_all", "passage_topup_all", "query_extract_all")}
    assert n == {"passage_extract_all": passages, "passage_ids_all": passages, "passage_topup_all": passages + texts,
                 "query_extract_all": v.examples.queries.where(stripped_length("query") > 5).count()}
