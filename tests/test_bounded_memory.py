"""What a task, a plan or the driver holds at once stays bounded, with the same results."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from vecspark.functions.vector import l2_normalize


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_norm_is_summed_once_per_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").repartition(2)
    out = df.select(l2_normalize("v").alias("u"))
    assert optimized(out).count("aggregate(") == 1                     # not once more inside the lambda over the components
    assert sorted(map(str, (r["u"] for r in out.collect()))) == ["None", "None", "[0.6, 0.8]"]


def test_synthetic_vectors_are_generated_once(spark):
    from vecspark.plans.catalog import QUERIES
    assert optimized(QUERIES["synthetic_vectors"](spark, "/root/testdata/sf0.001")).count("md5(") == 2   # the two uniforms of a component


def test_block_scorer_holds_few_candidates():
    from vecspark.operators import blockscan as B

    rng = np.random.default_rng(0)
    queries, rows, k = 12_000, 6_000, 10
    Q, X, ids = np.round(4 * rng.normal(size=(queries, 4))), np.round(4 * rng.normal(size=(rows, 4))), rng.permutation(rows)
    tracemalloc.start()
    acc = B.TopKAccumulator(k, queries)
    for i in range(0, rows, 1500):
        B._score_block(Q, None, ids[i:i + 1500], X[i:i + 1500], None, acc, k)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 40                                     # 12 MB of them are the candidates; all of a block's scores are 100
    r, i, s = (np.concatenate(c) for c in zip(*acc.results()))
    assert (r == np.repeat(np.arange(queries), k)).all()
    for q in range(0, queries, 997):                     # whole numbers: exact scores, many ties
        S = Q[q] @ X.T
        assert (i[q * k:(q + 1) * k] == ids[np.lexsort((ids, -S))[:k]]).all() and (s[q * k:(q + 1) * k] == np.sort(S)[::-1][:k]).all()


def test_judged_texts_are_not_broadcast(spark):
    from vecspark.operators.ir import evaluation_rows
    from vecspark.operators.textjoin import results_by_query_text

    ranked = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 6)], "query_id long, rank int, vector_id long")
    texts = spark.createDataFrame([(5, "five"), (6, "six")], "vector_id long, text string")
    asked = spark.createDataFrame([(0, "q0"), (1, "q1")], "query_id long, text string")
    qrels = spark.createDataFrame([("q0", "six"), ("q1", "six")], "query string, passage string")
    rows = evaluation_rows(results_by_query_text(ranked, asked, texts), qrels, "e", (1, 2))
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r["metric"]: r["value"] for r in rows.collect()} == {"recall@1": 0.5, "recall@2": 1.0, "mrr": 0.75}
