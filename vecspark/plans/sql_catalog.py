"""Registered queries that search in SQL: the vectors nearest to the last one, of all and of every label."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.operators.sql_functions import register_sql_functions, search_sql, search_sql_by
from vecspark.plans import oracle as O
from vecspark.plans.catalog import register
from vecspark.plans.views import K, Views

PER_LABEL = 3
_ROWS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS own, v AS q FROM e ORDER BY vec_id DESC LIMIT 1),
d AS (SELECT vec_id, label, 1 - list_cosine_similarity(v, q) AS distance FROM e, q WHERE vec_id <> own)"""


def _last(v: Views):
    """(the last vector, all others)."""
    e = v.table("embeddings")
    own, vec = e.orderBy(F.desc("vec_id")).select("vec_id", "embedding").first()
    return vec, e.where(F.col("vec_id") != own)


@register("sql_search", O.sql(f"""
WITH {_ROWS}
SELECT vec_id AS id, round(distance, 6) AS distance FROM d ORDER BY d.distance, vec_id LIMIT {K}"""))
def q_sql_search(spark, sf):
    vec, others = _last(Views(spark, sf))
    return search_sql(spark, others, vec, K, id_col="vec_id").select("id", F.round("distance", 6).alias("distance"))


@register("sql_search_by", O.sql(f"""
WITH {_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS n FROM d)
SELECT label::VARCHAR AS grp, vec_id AS id, round(distance, 6) AS distance FROM r WHERE n <= {PER_LABEL}"""))
def q_sql_search_by(spark, sf):
    vec, others = _last(Views(spark, sf))
    return search_sql_by(spark, others, vec, "label", PER_LABEL, id_col="vec_id").select("grp", "id", F.round("distance", 6).alias("distance"))


@register("sql_distance", O.sql(f"""
WITH {_ROWS}
SELECT vec_id, round(distance, 6) AS distance FROM d"""))
def q_sql_distance(spark, sf):
    vec, others = _last(Views(spark, sf))
    register_sql_functions(spark)
    return spark.sql("SELECT vec_id, round(cosine_distance(embedding, :q), 6) AS distance FROM {rows}", rows=others,
                     args={"q": F.array(*[F.lit(float(x)) for x in vec])})
