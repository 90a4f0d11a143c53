"""Registered query: ``embeddings`` through the vector store data source, written in two halves and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.plans import oracle as O
from vecspark.plans.catalog import register
from vecspark.plans.views import Views
from vecspark.session import scratch_path
from vecspark.sinks.vector_store import read_vectors, write_vectors
from vecspark.sinks.vector_table import metadata_json


@register("vector_store_roundtrip", O.sql("""
SELECT vec_id AS vector_id, to_json({'id': vec_id})::VARCHAR AS metadata, len(embedding)::INTEGER AS dims,
       round(list_sum(embedding::DOUBLE[]), 4) AS total, (SELECT count(*) FROM embeddings)::BIGINT AS n_stored FROM embeddings"""))
def q_vector_store_roundtrip(spark, sf):
    e = Views(spark, sf).table("embeddings")
    rows = e.select(F.col("vec_id").alias("vector_id"), "embedding", metadata_json("vec_id").alias("metadata"), "label")
    dim, path = e.agg(F.max(F.size("embedding"))).first()[0], scratch_path(spark, "vector-store")
    stored = sum(write_vectors(part, path, dim)["rows"] for part in (rows.where("label < 5"), rows.where("label >= 5 or label is null")))
    total = F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4)
    return read_vectors(spark, path).select("vector_id", "metadata", F.size("embedding").alias("dims"), total.alias("total"),
                                            F.lit(stored).cast("long").alias("n_stored"))
