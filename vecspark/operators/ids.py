"""Dense 0-based positions in a total order, without a single-partition window.

Two passes over a range-sorted frame stored once: per-partition counts ->
running offsets (one row per partition, computed on the driver from a
#partitions-row result) -> position = offset + local index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.session import scratch_path


def dense_index(df: DataFrame, order_cols: Sequence, out_col: str = "pos") -> DataFrame:
    """Add ``out_col`` = 0-based position of each row in ``order_cols`` order.

    ``order_cols`` should form a unique key so positions are reproducible.
    The range-sorted rows are written once, with their partition id and
    in-partition row id, as a table in the shared checkpoint folder (this
    cuts the lineage: retries and both passes read the same rows, and the
    sort is computed once).  Positions follow from the stored ids, so they do
    not depend on how the table is split when read back.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "dense-index")
    (df.orderBy(*order_cols)
     .withColumn("_pid", F.spark_partition_id())
     .withColumn("_mid", F.monotonically_increasing_id())
     .write.parquet(path))
    s = spark.read.parquet(path)
    # one row per partition (bounded by the partition count): fetched once,
    # then joined back as a broadcast local table, so later plans carry no
    # extra aggregation stage
    per_part = (s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
                .orderBy("_pid").collect())
    rows, off = [], 0
    for r in per_part:
        rows.append((int(r["_pid"]), off, int(r["_m0"])))
        off += int(r["_n"])
    offsets = spark.createDataFrame(rows, "_pid int, _off long, _m0 long")
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
            .drop("_pid", "_mid", "_off", "_m0"))
