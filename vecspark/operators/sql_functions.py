"""Search in SQL: a distance function and a table function over any table, view or subquery.

``register_sql_functions`` gives a session

* ``cosine_distance(a, b)``: an SQL function, inlined into the query by the
  optimizer; 1 where a vector has no length, null for null components, null
  vectors and vectors of different lengths;
* ``knn(TABLE(t), q, k [, id, vector [, group]])``: a table function giving
  (id long, distance double, grp string).  Every task keeps its own k nearest
  rows while Arrow batches pass, so the table is not moved.  id and vector name
  columns of t (vector_id, embedding).  ``TABLE(t) PARTITION BY (g)`` gives the k
  nearest of every g instead; group names the column that grp shows.

``search_sql`` runs one search through ``spark.sql`` with bound parameters, and
``search_sql_by`` one for every group, with hot groups salted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_NORMS = f"(sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))"
_DISTANCE = f"""CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
RETURN CASE WHEN size(a) = size(b) THEN CASE WHEN {_NORMS} = 0D THEN 1D ELSE 1D - {_DOT.format('a', 'b')} / {_NORMS} END END"""


def _distances(vectors: pa.Array, query: np.ndarray) -> np.ndarray:
    """Cosine distance of each row; NaN for a row that is null, holds a null, or has another length than the query."""
    out = np.full(len(vectors), np.nan)
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == len(query))
    if len(fits):
        flat = vectors.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fits), len(query))
        size = np.sqrt((flat * flat).sum(axis=1)) * np.sqrt(query @ query)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[fits] = 1.0 - np.where(size == 0, 0.0, flat @ query / size)
    return out


class Knn:
    """The ``k`` rows nearest to a vector: of each task, or of each group of PARTITION BY."""

    def __init__(self, *_):
        self.best: pa.Table | None = None

    def eval(self, rows: pa.RecordBatch, query: pa.Array, k: pa.Array, id: pa.Array | None = None, vector: pa.Array | None = None,
             group: pa.Array | None = None) -> Iterator[pa.Table]:
        q, self.k = np.array(_constant(query), float), int(_constant(k))
        if self.k < 1:
            raise ValueError("knn: k is positive")
        distance = _distances(_column(rows, "embedding" if vector is None else _constant(vector)), q)
        new = pa.table({"id": _column(rows, "vector_id" if id is None else _constant(id)).cast(pa.int64()), "distance": distance,
                        "grp": pa.nulls(rows.num_rows, pa.string()) if group is None else _column(rows, _constant(group)).cast(pa.string())})
        new = new.filter(pa.array(~np.isnan(distance)))
        new = new if self.best is None else pa.concat_tables([self.best, new])
        self.best = new.sort_by([("distance", "ascending"), ("id", "ascending")]).slice(0, self.k)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.best is not None and self.best.num_rows:
            yield self.best


def _column(rows: pa.RecordBatch, name: str) -> pa.Array:
    at = rows.schema.get_field_index(name)
    if at < 0:
        raise ValueError(f"knn: the table has no column {name}, or several")
    return rows.column(at)


def _constant(value):
    value = value[0] if isinstance(value, (pa.Array, pa.ChunkedArray)) else value
    return value.as_py() if isinstance(value, pa.Scalar) else value


def register_sql_functions(spark: SparkSession) -> None:
    """``cosine_distance`` and ``knn`` for SQL in this session."""
    spark.sql(_DISTANCE)
    spark.udtf.register("knn", F.arrow_udtf(Knn, returnType="id long, distance double, grp string"))


def _bound(query: Sequence[float], k: int) -> dict:
    if k < 1:
        raise ValueError("k is positive")
    return {"k": k, "q": F.array(*[F.lit(float(x)) for x in query])}


def search_sql(spark: SparkSession, table: DataFrame, query: Sequence[float], k: int = 10, *, id_col: str = "vector_id",
               vec_col: str = "embedding") -> DataFrame:
    """(id, distance) of the ``k`` nearest rows of ``table``, ties to the lesser id: every task's best, then the best of these.

    Rows with a null vector, a null component or another number of components than ``query`` take no part.
    """
    register_sql_functions(spark)
    return spark.sql("SELECT id, distance FROM knn(TABLE(SELECT * FROM {rows}), :q, :k, :id, :vector) ORDER BY distance, id LIMIT :k",
                     rows=table.select(id_col, vec_col), args={**_bound(query, k), "id": id_col, "vector": vec_col})


def search_sql_by(spark: SparkSession, table: DataFrame, query: Sequence[float], group: str, k: int = 10, *, id_col: str = "vector_id",
                  vec_col: str = "embedding", salts: int = 16) -> DataFrame:
    """(grp, id, distance) of the ``k`` nearest rows of every value of ``group``, which is shown as a string.

    A group is searched in ``salts`` parts by a hash of the id, whose best meet
    once more, so a group that holds a third of all rows is no single task.
    """
    register_sql_functions(spark)
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(group).alias("g"),
                        F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("salt"))
    return spark.sql("""SELECT grp, id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY distance, id) AS n
  FROM knn(TABLE(SELECT * FROM {rows}) PARTITION BY (g, salt), :q, :k, 'id', 'vec', 'g')) WHERE n <= :k""",
                     rows=rows, args=_bound(query, k))
