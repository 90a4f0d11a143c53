"""Declared schemas of the data model (never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLE = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("passages", T.StructType([
        T.StructField("passage_text", T.ArrayType(T.StringType())),
        T.StructField("is_selected", T.ArrayType(T.IntegerType())),
    ])),
])

FLAT_PASSAGE = T.StructType([T.StructField(n, T.StringType()) for n in
                             ("passage", "text", "content", "body", "document")])

VECTOR_TABLE = T.StructType([
    T.StructField("vector_id", T.IntegerType(), nullable=False),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

RANKED = T.StructType([
    T.StructField("engine", T.StringType()),
    T.StructField("query_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("vector_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])

LATENCIES = T.StructType([
    T.StructField("engine", T.StringType()),
    T.StructField("worker_count", T.IntegerType()),
    T.StructField("query_id", T.LongType()),
    T.StructField("latency_s", T.DoubleType()),
])

MEASUREMENT = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("worker_count", T.IntegerType()),
    T.StructField("query_id", T.IntegerType()),
])
MEASUREMENT_COLUMNS = [f.name for f in MEASUREMENT.fields]


def measurement_rows(df: DataFrame) -> DataFrame:
    """Conform any frame to the 6-column measurement schema (missing -> null,
    ``worker_count`` defaults to 1 like the original record type)."""
    cols = []
    for f in MEASUREMENT.fields:
        if f.name in df.columns:
            c = F.col(f.name)
        elif f.name == "worker_count":
            c = F.lit(1)
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
