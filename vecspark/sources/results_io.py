"""Measurement table <-> CSV with a header, schema declared (never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.schemas import MEASUREMENT, measurement_rows


def write_results_csv(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    measurement_rows(results).write.mode(mode).option("header", True).csv(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASUREMENT).option("header", True).csv(path)
