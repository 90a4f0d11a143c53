"""Streaming ingest that keeps, per id, the row of the greatest position, in whatever order rows arrive.

A stateful operator holds each id's last position; only rows beyond it are
written, so duplicates inside a micro-batch, across micro-batches and late rows
resolve as one batch over all rows would.  Rows of one Arrow batch are reduced
to one per id before the shuffle: a hot id moves a row per batch.  State lies in
the checkpoint (RocksDB), so a restart goes on from it, and the table takes each
epoch once (``sinks.snapshots``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vecspark.sinks import snapshots
from vecspark.sinks.vector_table import to_vector_table

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: the position of a null
_NULL = -(1 << 63)
_KEY, _ROW = "vector_id", ["vector_id", "embedding", "position", "tie"]


def placed(df: DataFrame, id_col: str, vec_col: str, position: str, dim: int | None) -> DataFrame:
    """(vector_id, embedding, position, tie): a null id, or a vector not of ``dim`` components, fails the batch.

    Null positions come first; rows of one id and position are told apart by a
    hash of the vector, so that the order of arrival never matters.
    """
    vec = F.col(vec_col).cast("array<float>")
    if dim is not None:
        vec = F.when(F.size(vec) == dim, vec).otherwise(F.raise_error(F.format_string("a vector of %s has not %s components", F.lit(vec_col), F.lit(dim)))
                                                        .cast("array<float>"))
    key = F.coalesce(F.col(id_col).cast("long"), F.raise_error(F.lit(f"{id_col} is null")).cast("long"))
    return (df.select(key.alias(_KEY), vec.alias("embedding"), F.coalesce(F.col(position).cast("long"), F.lit(_NULL)).alias("position"))
            .withColumn("tie", F.xxhash64("embedding")))


def _last_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.sort_values(["position", "tie"]).drop_duplicates(_KEY, keep="last")


class LastPosition(StatefulProcessor):
    """Per id: the greatest (position, tie) seen, and the row that has it, if it is new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "position long, tie long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            top = part.sort_values(["position", "tie"]).tail(1)
            if best is None or self._place(top) > self._place(best):
                best = top
        if best is not None and (not self.last.exists() or self._place(best) > tuple(self.last.get())):
            self.last.update(self._place(best))
            yield best[_ROW]

    @staticmethod
    def _place(row: pd.DataFrame) -> tuple[int, int]:
        return int(row["position"].iloc[0]), int(row["tie"].iloc[0])

    def close(self) -> None:
        pass


def keyed_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, root: str, checkpoint: str, *, id_col: str = "vector_id",
                 vec_col: str = "embedding", position: str = "position", dim: int | None = None, writer: str = "stream",
                 fan: int = snapshots.FAN, max_files_per_trigger: int = 1, trigger: dict | None = None):
    """Stream Parquet files into the snapshot table at ``root``; per id the row of the greatest ``position`` stays.

    The result is that of one batch over all rows.  The number of parts stays
    below ``fan`` a level.  ``dim``: vectors of other lengths, and null ones, fail
    the query.  The query's state needs the RocksDB provider, set for it alone.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    rows = placed(source, id_col, vec_col, position, dim)
    rows = rows.mapInPandas(_last_of_batch, rows.schema)
    last = rows.groupBy(_KEY).transformWithStateInPandas(LastPosition(), rows.schema, "update", "None")

    def add(batch: DataFrame, epoch: int) -> None:
        table = to_vector_table(batch, extra={"position": F.nullif(F.col("position"), F.lit(_NULL))})
        snapshots.append(batch.sparkSession, table, root, writer, epoch, fan=fan)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (last.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
