"""Information-retrieval metrics as DataFrame jobs.

Ranked lists come long: ``(query_id, rank, vector_id)``; rank starts at 1.
The metrics put both lists of a query into two arrays with one groupBy (one
shuffle on the query key; each array holds one query's ranked list, i.e. at
most its k results) and evaluate every metric with JVM array functions.

Against exact neighbours (``pred`` vs ``gt``), per query with both lists
non-empty (queries are aligned by ``query_id``; missing on either side = not
counted):

* recall@k     = |set(pred) & set(gt[:k])| / min(len(pred), k)   (pred not truncated)
* recall_std@k = |set(pred[:k]) & set(gt[:k])| / |set(gt[:k])|   (textbook form)
* precision@k  = |set(pred) & set(gt[:k])| / len(pred)
* mAP@k        = sum over hits in pred[:k] of hits_so_far / rank, / min(len(pred), k)
* NDCG@k       = sum over hits in pred[:k] of 1/log2(rank+1), / IDCG(min(len(gt), k))

Duplicate ids in ``pred`` count once for recall/precision, at every position
for mAP/NDCG.  Averages are over counted queries; no counted query -> 0.

Against human judgments (text): judged recall@k and MRR over the queries that
have judgments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.schemas import measurement_rows


def _ks(ks: Sequence[int]):
    return F.explode(F.array(*[F.lit(int(k)) for k in ks]))


def _idcg(n):
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0),
                       lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1)))


def _ranked_pair(pred: DataFrame, gt: DataFrame, key: str, item: str) -> DataFrame:
    """One row per key with both ranked lists as arrays (one shuffle on key).

    Each list holds one query's ranked items (at most its k results), so the
    collected arrays are bounded by the list length, not by the data size.
    """
    p = pred.select(key, F.struct(F.col("rank").cast("int").alias("r"), F.col(item).alias("i")).alias("_e"),
                    F.lit(0).alias("_s"))
    g = gt.select(key, F.struct(F.col("rank").cast("int").alias("r"), F.col(item).alias("i")).alias("_e"),
                  F.lit(1).alias("_s"))
    return (p.unionByName(g).groupBy(key)
            .agg(F.array_sort(F.collect_list(F.when(F.col("_s") == 0, F.col("_e")))).alias("_p"),
                 F.array_sort(F.collect_list(F.when(F.col("_s") == 1, F.col("_e")))).alias("_g"))
            .select(key, F.transform("_p", lambda x: x["i"]).alias("P"),
                    F.transform("_g", lambda x: x["i"]).alias("G")))


def _positions(arr):
    return F.sequence(F.lit(1), F.size(arr))


def quality_per_query(pred: DataFrame, gt: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Per (query_id, k) metric values for queries present and non-empty on both sides.

    Positions are list positions (rank order); all metric arithmetic runs on
    the two per-query arrays inside the JVM.
    """
    per = _ranked_pair(pred, gt, "query_id", "vector_id").where((F.size("P") > 0) & (F.size("G") > 0))
    per = per.withColumn("k", _ks(ks))
    k = F.col("k")
    gk = F.slice("G", 1, k)
    pk = F.slice("P", 1, k)
    per = per.select("query_id", "k", "P", "G", gk.alias("gk"), pk.alias("pk"))
    hit = lambda i: F.array_contains(F.col("gk"), F.element_at(F.col("pk"), i))
    hits_upto = lambda i: F.size(F.filter(F.slice(F.col("pk"), 1, i),
                                          lambda x: F.array_contains(F.col("gk"), x)))
    inter = F.size(F.array_intersect(F.array_distinct("P"), F.col("gk")))
    inter_top = F.size(F.array_intersect(F.col("pk"), F.col("gk")))
    n_hits = hits_upto(F.size("pk"))
    ap_sum = F.aggregate(_positions(F.col("pk")), F.lit(0.0),
                         lambda a, i: a + F.when(hit(i), hits_upto(i) / i).otherwise(F.lit(0.0)))
    dcg = F.aggregate(_positions(F.col("pk")), F.lit(0.0),
                      lambda a, i: a + F.when(hit(i), F.lit(1.0) / F.log2(i + 1)).otherwise(F.lit(0.0)))
    n_pred, n_gt = F.size("P"), F.size("G")
    return per.select(
        "query_id", "k",
        (inter / F.least(n_pred, k)).alias("recall"),
        (inter_top / F.size(F.array_distinct("gk"))).alias("recall_standard"),
        (inter / n_pred).alias("precision"),
        F.when(n_hits > 0, ap_sum / F.least(n_pred, k)).otherwise(F.lit(0.0)).alias("map"),
        (dcg / _idcg(F.least(n_gt, k))).alias("ndcg"))


def quality_scores(pred: DataFrame, gt: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Mean of each metric per k -> (k, recall, recall_standard, precision, map, ndcg)."""
    per_q = quality_per_query(pred, gt, ks)
    names = ["recall", "recall_standard", "precision", "map", "ndcg"]
    means = per_q.groupBy("k").agg(*[F.avg(n).alias(n) for n in names])
    allk = pred.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    # a k with no counted query scores 0 (small literal side: |ks| rows)
    return (allk.join(means, "k", "left")
            .select("k", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names]))


def quality_metric_rows(pred: DataFrame, gt: DataFrame, database, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Measurement rows ``recall@k, precision@k, mAP@k, NDCG@k`` (operation 'quality')."""
    s = quality_scores(pred, gt, ks)
    kstr = F.col("k").cast("string")
    long = s.select("k", F.explode(F.array(
        F.struct(F.lit(0).alias("o"), F.concat(F.lit("recall@"), kstr).alias("metric"), F.col("recall").alias("value")),
        F.struct(F.lit(1).alias("o"), F.concat(F.lit("precision@"), kstr).alias("metric"), F.col("precision").alias("value")),
        F.struct(F.lit(2).alias("o"), F.concat(F.lit("mAP@"), kstr).alias("metric"), F.col("map").alias("value")),
        F.struct(F.lit(3).alias("o"), F.concat(F.lit("NDCG@"), kstr).alias("metric"), F.col("ndcg").alias("value")),
    )).alias("m"))
    db = database if not isinstance(database, str) else F.lit(database)
    return measurement_rows(long.select(db.alias("database"), F.lit("quality").alias("operation"),
                                        "m.metric", "m.value", F.lit(1).alias("worker_count")))


def running_precision(pred: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """Hit flag, running hit count and precision at each rank of pred[:k] vs gt[:k]."""
    g = gt.where(F.col("rank") <= k).select("query_id", "vector_id").distinct().withColumn("_in", F.lit(True))
    w = (Window.partitionBy("query_id").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (pred.where(F.col("rank") <= k).select("query_id", "rank", "vector_id")
            .join(g, ["query_id", "vector_id"], "left")
            .withColumn("hit", F.coalesce(F.col("_in"), F.lit(False)).cast("int"))
            .withColumn("running_hits", F.sum("hit").over(w).cast("long"))
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vector_id", "hit",
                    "running_hits", (F.col("running_hits") / F.col("rank")).alias("precision_at_rank")))


def retrieved_intersection(pred: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """|set(pred) & set(gt[:k])| per query present on both sides (0 if none)."""
    p = pred.select("query_id", "vector_id").distinct()
    g = gt.where(F.col("rank") <= k).select("query_id", "vector_id").distinct()
    common = p.join(g, ["query_id", "vector_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_common"))
    both = p.select("query_id").distinct().join(g.select("query_id").distinct(), "query_id")
    return both.join(common, "query_id", "left").select(
        "query_id", F.coalesce(F.col("n_common"), F.lit(0)).cast("long").alias("n_common"))


# ---------------------------------------------------------------------------
# judged (text) evaluation
# ---------------------------------------------------------------------------

def judged_queries(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Result rows of queries that have judgments (left semi join on query text)."""
    return results.join(qrels.select("query").distinct(), "query", "left_semi")


def _judged_per_query(results: DataFrame, qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(query, n_rel, first, found_<k>...) for judged queries that have results.

    ``first``: least rank of a relevant passage (null if none); ``found_<k>``:
    distinct relevant passages of rank <= k.  Joins on texts, no list of a
    query's passages is collected, and no table of texts is broadcast: several
    such plans may run at once, and the driver would hold each one's texts.
    """
    rel = qrels.select("query", "passage").where(F.col("passage").isNotNull()).distinct()
    n_rel = rel.groupBy("query").agg(F.count(F.lit(1)).alias("n_rel"))
    best = results.groupBy("query", "passage").agg(F.min(F.col("rank").cast("int")).alias("rank"))
    hit = best.join(rel.withColumn("_rel", F.lit(True)).hint("merge"), ["query", "passage"], "left")
    at = F.when(F.col("_rel"), F.col("rank"))
    return (hit.groupBy("query").agg(F.min(at).alias("first"), *[F.count_if(at <= k).alias(f"found_{k}") for k in ks])
            .join(n_rel.hint("merge"), "query"))


def _mean_recalls(ks):
    return [F.coalesce(F.avg(F.col(f"found_{k}") / F.col("n_rel")), F.lit(0.0)).alias(f"r{k}") for k in ks]


def _mean_reciprocal():
    return F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), F.lit(0.0)).alias("mrr")


def judged_recall(results: DataFrame, qrels: DataFrame, ks: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """(k, recall): mean over judged queries of |rel & set(ret[:k])| / |rel|; 0 if none."""
    tot = _judged_per_query(results, qrels, ks).agg(*_mean_recalls(ks))
    cells = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])
    return tot.select(F.explode(cells).alias("c")).select("c.k", "c.recall")


def mrr(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row (mrr): mean over judged queries of 1/first relevant rank (0 if none)."""
    return _judged_per_query(results, qrels, ()).agg(_mean_reciprocal())


def evaluation_rows(results: DataFrame, qrels: DataFrame, database,
                    ks: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Measurement rows ``recall@k`` + ``mrr`` (operation 'evaluation').

    One pass: per judged query the found-count for every k and the first
    relevant position, then a single global aggregate.  Without any
    judgments there are no rows.
    """
    tot = _judged_per_query(results, qrels, ks).agg(*_mean_recalls(ks), _mean_reciprocal())
    cells = F.array(*[F.struct(F.lit(f"recall@{k}").alias("metric"), F.col(f"r{k}").alias("value")) for k in ks],
                    F.struct(F.lit("mrr").alias("metric"), F.col("mrr").alias("value")))
    db = database if not isinstance(database, str) else F.lit(database)
    # no judgments at all -> no evaluation rows (not rows of zeros)
    judged = qrels.limit(1).select(F.count(F.lit(1))).scalar() > 0
    return measurement_rows(tot.where(judged).select(F.explode(cells).alias("c")).select(
        db.alias("database"), F.lit("evaluation").alias("operation"), F.col("c.metric").alias("metric"),
        F.col("c.value").alias("value"), F.lit(1).alias("worker_count")))
