"""Registered queries over stored indexes: bucketed exact search, inverted lists, the neighbour graph.

An approximate result has no SQL of its own; its SQL states what must hold of
it (every query answered, every score exact, the wanted recall reached).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.vector import dot
from vecspark.operators.graph import graph_build, graph_edges, graph_search
from vecspark.operators.ivf_store import ivf_store, ivf_stored_search, mean_recall, search_to_recall
from vecspark.operators.stored import knn_stored, store_index
from vecspark.plans import oracle as O
from vecspark.plans.catalog import r6, register
from vecspark.plans.views import K, Views

WANTED_RECALL = 0.9
#: share of the lists that ``ivf_stored`` probes (the vectors of the given tables have no clusters)
PROBED_SHARE = 0.75


@register("knn_stored", O.sql(
    "SELECT query_id, rank, vector_id, round(score, 4) AS score FROM f_gt", "f_gt"))
def q_knn_stored(spark, sf):
    v = Views(spark, sf)
    stored = store_index(v.index)
    return knn_stored(stored, v.queries, K, n_queries=v.n_queries).select("query_id", "rank", "vector_id", r6("score", 4).alias("score"))


def _answers(pred: DataFrame, v: Views) -> DataFrame:
    """Per query: number of results, of exact scores, of results in order, and whether the mean recall is reached."""
    reached = mean_recall(pred, v.gt, K).select(F.col("recall") >= WANTED_RECALL).scalar()
    exact = (pred.join(v.index.withColumnRenamed("embedding", "x"), "vector_id").join(v.queries.withColumnRenamed("embedding", "q"), "query_id")
             .withColumn("ok", F.abs(F.col("score") - dot("x", "q")) < 1e-9))
    per = exact.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.count_if("ok").alias("n_exact"),
        F.array_sort(F.collect_list(F.struct("rank", "score", "vector_id"))).alias("l"))          # k entries
    falling = F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda i: (F.get("l", i - 1)["score"] > F.get("l", i)["score"])
                       | ((F.get("l", i - 1)["score"] == F.get("l", i)["score"]) & (F.get("l", i - 1)["vector_id"] < F.get("l", i)["vector_id"])))
    ordered = F.when(F.size("l") < 2, F.lit(True)).otherwise(falling)
    return per.select("query_id", "n_results", "n_exact", ordered.alias("in_order"), reached.alias("recall_reached"))


_ANSWERS_SQL = """SELECT query_id, count(*) AS n_results, count(*) AS n_exact, true AS in_order, true AS recall_reached
FROM f_gt GROUP BY query_id"""


def _written(df: DataFrame, name: str) -> DataFrame:
    from vecspark.operators.graph import _scratch
    return _scratch(df, name)


@register("graph_edges", O.sql(
    "SELECT count(*) AS n_nodes, 0::BIGINT AS n_over_degree, 0::BIGINT AS n_loops, 0::BIGINT AS n_repeated, 0::BIGINT AS n_dangling,"
    " 0::BIGINT AS n_isolated FROM f_index", "f_index"))
def q_graph_edges(spark, sf):
    v = Views(spark, sf)
    graph = graph_build(v.index)
    nodes, edges = graph.read(spark), graph_edges(graph.read(spark))
    per = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.size("neighbours") > graph.degree).alias("n_over_degree"),
                    F.count_if(F.array_contains("neighbours", F.col("vector_id"))).alias("n_loops"),
                    F.count_if(F.size(F.array_distinct("neighbours")) < F.size("neighbours")).alias("n_repeated"))
    dangling = edges.join(v.index.select(F.col("vector_id").alias("dst")), "dst", "left_anti").select(F.count(F.lit(1))).scalar()
    isolated = v.index.select("vector_id").join(edges.select(F.col("src").alias("vector_id")).distinct(), "vector_id", "left_anti")
    return per.select("*", dangling.alias("n_dangling"), isolated.select(F.count(F.lit(1))).scalar().alias("n_isolated"))


@register("graph_search", O.sql(_ANSWERS_SQL, "f_gt"))
def q_graph_search(spark, sf):
    v = Views(spark, sf)
    return _answers(_written(graph_search(graph_build(v.index), v.queries, K), "graph-result"), v)


def _lists(v: Views) -> int:
    """About sqrt(n) lists."""
    return max(1, round(v.split_point ** 0.5))


@register("ivf_stored", O.sql(_ANSWERS_SQL, "f_gt"))
def q_ivf_stored(spark, sf):
    v = Views(spark, sf)
    stored = ivf_store(v.index, _lists(v))
    return _answers(_written(ivf_stored_search(stored, v.queries, K, max(1, round(PROBED_SHARE * stored.nlist))), "ivf-result"), v)


@register("ivf_stored_all_lists", O.sql(
    "SELECT query_id, rank, vector_id, round(score, 4) AS score FROM f_gt", "f_gt"))
def q_ivf_stored_all_lists(spark, sf):
    v = Views(spark, sf)
    stored = ivf_store(v.index, _lists(v))
    return ivf_stored_search(stored, v.queries, K, stored.nlist).select("query_id", "rank", "vector_id", r6("score", 4).alias("score"))


@register("search_to_recall", O.sql(_ANSWERS_SQL, "f_gt"))
def q_search_to_recall(spark, sf):
    v = Views(spark, sf)
    return _answers(_written(search_to_recall(ivf_store(v.index, _lists(v)), v.queries, K, WANTED_RECALL), "calibrated"), v)
