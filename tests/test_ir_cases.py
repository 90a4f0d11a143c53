"""Hand-computed IR metric cases (FIXTURES part 3)."""

import math

import pytest
from pyspark.sql import functions as F

from vecspark.operators.ir import judged_recall, mrr, quality_per_query, quality_scores

RANKED = "query_id long, rank int, vector_id long"


def ranked(spark, lists):
    rows = [(q, r + 1, v) for q, ids in lists.items() for r, v in enumerate(ids)]
    return spark.createDataFrame(rows, RANKED)


def scores(spark, pred, gt, ks=(1, 5, 10)):
    return {r["k"]: r.asDict() for r in quality_scores(ranked(spark, pred), ranked(spark, gt), ks).collect()}


def test_perfect_ten_results(spark):
    ids = list(range(10))
    s = scores(spark, {1: ids}, {1: ids})
    for k in (1, 5, 10):
        assert s[k]["recall"] == 1.0 and s[k]["map"] == 1.0
        assert s[k]["ndcg"] == pytest.approx(1.0)
    # precision divides by len(pred): 0.1, 0.5, 1.0 as in the published run
    assert [s[k]["precision"] for k in (1, 5, 10)] == pytest.approx([0.1, 0.5, 1.0])


def test_best_doc_at_rank_ten(spark):
    gt = list(range(10))
    pred = list(range(100, 109)) + [0]
    s = scores(spark, {1: pred}, {1: gt})
    assert s[1]["recall"] == 1.0              # untruncated prediction
    assert s[1]["recall_standard"] == 0.0     # textbook form
    assert s[1]["map"] == 0.0


def test_short_prediction_divides_by_len(spark):
    s = scores(spark, {1: [0, 1, 2]}, {1: list(range(10))}, (10,))
    assert s[10]["recall"] == 1.0 and s[10]["precision"] == 1.0


def test_no_hit_counts_zero(spark):
    s = scores(spark, {1: [50, 51], 2: [0]}, {1: [0, 1], 2: [0]}, (1,))
    assert s[1]["recall"] == pytest.approx(0.5)       # query 1 scores 0, query 2 scores 1


def test_empty_prediction_leaves_the_mean(spark):
    s = scores(spark, {2: [0]}, {1: [0, 1], 2: [0]}, (1,))
    assert s[1]["recall"] == 1.0                      # query 1 has no prediction rows


def test_k_larger_than_gt(spark):
    pq = {r["k"]: r for r in quality_per_query(ranked(spark, {1: [0, 9, 1]}), ranked(spark, {1: [0, 1, 2]}),
                                               (10,)).collect()}
    idcg = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    dcg = 1 / math.log2(2) + 1 / math.log2(4)
    assert pq[10]["ndcg"] == pytest.approx(dcg / idcg)


def test_duplicates_in_prediction(spark):
    pq = {r["k"]: r for r in quality_per_query(ranked(spark, {1: [1, 1, 2]}), ranked(spark, {1: [1, 2, 3]}),
                                               (3,)).collect()}
    assert pq[3]["recall"] == pytest.approx(2 / 3)      # set semantics
    assert pq[3]["precision"] == pytest.approx(2 / 3)
    assert pq[3]["map"] == pytest.approx((1 / 1 + 2 / 2 + 3 / 3) / 3)  # every position counts


TEXT = "query string, rank int, passage string"
QRELS = "query string, passage string"


def test_mrr_hits_at_two_and_four(spark):
    res = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("q", 4, "d")], TEXT)
    rel = spark.createDataFrame([("q", "b"), ("q", "d")], QRELS)
    assert mrr(res, rel).first()["mrr"] == pytest.approx(0.5)


def test_unjudged_ignored_and_unretrieved_zero(spark):
    res = spark.createDataFrame([("q1", 1, "a"), ("q2", 1, "x"), ("q3", 1, "z")], TEXT)
    rel = spark.createDataFrame([("q1", "a"), ("q2", "b")], QRELS)   # q3 unjudged
    r = {x["k"]: x["recall"] for x in judged_recall(res, rel, (1,)).collect()}
    assert r[1] == pytest.approx(0.5)
    assert mrr(res, rel).first()["mrr"] == pytest.approx(0.5)


def test_no_judgments_gives_zero(spark):
    res = spark.createDataFrame([("q1", 1, "a")], TEXT)
    rel = spark.createDataFrame([], QRELS)
    assert judged_recall(res, rel, (1,)).first()["recall"] == 0.0
    assert mrr(res, rel).first()["mrr"] == 0.0


def test_repeated_query_last_wins_and_rejected_query(spark):
    from vecspark.sources.corpus import explode_examples, qrels_extract
    ex = spark.createDataFrame(
        [(0, "what is spark", (["first relevant passage", "other text here!!"], [1, 0])),
         (1, "what is spark", (["second relevant passage"], [1])),
         (2, "abc", (["short query passage text"], [1]))],
        "example_pos long, query string, passages struct<passage_text:array<string>,is_selected:array<int>>")
    ex = ex.withColumn("query_id", F.col("example_pos"))
    got = sorted((r["query"], r["passage"]) for r in qrels_extract(explode_examples(ex)).collect())
    assert got == [("what is spark", "second relevant passage")]


def test_no_judgments_no_evaluation_rows(spark):
    from vecspark.operators.ir import evaluation_rows
    res = spark.createDataFrame([("q1", 1, "a")], TEXT)
    assert evaluation_rows(res, spark.createDataFrame([], QRELS), "db").count() == 0
    assert evaluation_rows(res, spark.createDataFrame([("q1", "a")], QRELS), "db").count() == 5
