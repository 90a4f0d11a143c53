"""Exact k-nearest-neighbour search.

* ``knn_exact``   all queries against the whole index (block scorer, exact);
* ``search_one``  one query vector, global top-k by cosine distance (block
  scorer; a Column query uses the JVM expression path);
* ``batch_search`` ranked id lists per query for any strategy.

Similarity is the dot product (cosine on unit vectors); order is
``score desc, vector_id asc``; ranks start at 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.vector import cosine_distance, dot
from vecspark.operators.blockscan import DEFAULT_MAX_CHUNK_BYTES, block_knn, scan_one


def knn_exact(index: DataFrame, queries: DataFrame, k: int = 10, *,
              id_col: str = "vector_id", vec_col: str = "embedding",
              qid_col: str = "query_id", qvec_col: str = "embedding", cosine: bool = False,
              max_chunk_bytes: int = DEFAULT_MAX_CHUNK_BYTES) -> DataFrame:
    """Exact top-k by dot product (or cosine) -> (query_id, rank, vector_id, score)."""
    return block_knn(index, queries, k, mode="exact", id_col=id_col, vec_col=vec_col,
                     qid_col=qid_col, qvec_col=qvec_col, cosine=cosine,
                     max_chunk_bytes=max_chunk_bytes)


def search_one(index: DataFrame, query, k: int = 10, *,
               id_col: str = "vector_id", vec_col: str = "embedding", qvec_col: str = "embedding",
               keep: Sequence[str] = ()) -> DataFrame:
    """Nearest neighbours of one vector by cosine distance (``<=>``) ->
    (``id_col``, ``keep``..., distance), nearest first.

    ``query`` is a vector (list / array) or a one-row DataFrame with
    ``qvec_col``.  Scoring runs in the block scorer (BLAS per Arrow batch,
    local top-k per task, one small merge); ``keep`` columns are joined back
    for the k winners only (broadcast of k rows).  A Column (e.g. a scalar
    subquery) selects the expression path: distance per row in the JVM plus
    TakeOrderedAndProject.
    """
    if isinstance(query, Column):
        q = query
        return (index.select(F.col(id_col), F.col(vec_col), *[F.col(c) for c in keep], q.alias("_q"))
                .select(F.col(id_col), *[F.col(c) for c in keep],
                        cosine_distance(F.col(vec_col), F.col("_q")).alias("distance"))
                .orderBy(F.col("distance").asc(), F.col(id_col).asc())
                .limit(k))
    if isinstance(query, DataFrame):                # one row
        first = query.select(qvec_col).first()
        query = first[0] if first is not None else None
    if query is None:
        return index.select(id_col, *keep, F.lit(None).cast("double").alias("distance")).where("false")
    res = scan_one(index, query, k, id_col=id_col, vec_col=vec_col, cosine=True)
    out = res.select(F.col("vector_id").alias(id_col), "rank", (F.lit(1.0) - F.col("score")).alias("distance"))
    if keep:
        out = index.select(id_col, *keep).join(F.broadcast(out), id_col)   # k rows: proven bound
    return out.orderBy("rank").select(id_col, *keep, "distance")


def similarity_of_pairs(pairs: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """Dot product of two vector columns on already-paired rows."""
    return pairs.withColumn(out, dot(F.col(a), F.col(b)))


def ranked_lists(ranked: DataFrame, group_cols: Sequence[str] = ("query_id",)) -> DataFrame:
    """Long ranked rows -> one row per query with ``ids`` in rank order.

    Each group holds at most k rows, so the collected array is bounded.
    """
    return (ranked.groupBy(*group_cols)
            .agg(F.array_sort(F.collect_list(F.struct("rank", "vector_id"))).alias("_r"))
            .select(*group_cols, F.transform("_r", lambda x: x["vector_id"]).alias("ids")))


def batch_search(index: DataFrame, queries: DataFrame, k: int = 10,
                 strategy: str = "exact", **kw) -> DataFrame:
    """All queries at once; parallelism comes from partitions, not threads."""
    from vecspark.operators.ann import STRATEGIES
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](index, queries, k, **kw)
