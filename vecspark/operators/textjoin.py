"""Ranked ids -> texts (id -> passage, query position -> query text).

The ranked side is |queries| x k rows; the text tables can be the whole
corpus.  Joins are by id and merge sorted sides: no table of texts is
broadcast, which the driver would have to hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def id_to_passage(ranked: DataFrame, passages: DataFrame) -> DataFrame:
    """Replace ids by passage texts; ids outside the passage table are dropped
    and the remaining positions are re-numbered 1.. per query (bounded by k)."""
    p = passages.select("vector_id", F.col("text").alias("passage"))
    j = p.join(ranked.select("query_id", "rank", "vector_id").hint("merge"), "vector_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return j.select("query_id", F.row_number().over(w).alias("rank"), "vector_id", "passage")


def results_by_query_text(ranked: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query, rank, passage) keyed by query text; when two query positions share
    a text the later position wins (dict-overwrite semantics)."""
    q = queries.select("query_id", F.col("text").alias("query"))
    winner = q.groupBy("query").agg(F.max("query_id").alias("query_id"))
    return (id_to_passage(ranked, passages)
            .join(winner.hint("merge"), "query_id")
            .select("query", "query_id", "rank", "passage"))
