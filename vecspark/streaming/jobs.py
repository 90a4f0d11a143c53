"""Streaming jobs built on the batch operators.

* ``stream_ingest``: file source (declared schema) -> ``foreachBatch`` upsert
  into the vector table, one table version per micro-batch (a retried batch
  rewrites its own version, so the sink is idempotent).
* ``stream_search``: a stream of query vectors -> per micro-batch exact (or
  any strategy) k-NN join against the static index -> result files, one
  partition per batch.  Against a ``StoredIndex`` a micro-batch moves its
  queries only.

Both use a checkpoint location under the shared checkpoint folder and
``trigger(availableNow=True)`` in tests; in production pass any trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.operators.stored import StoredIndex, knn_stored
from vecspark.sinks import vector_table as vt


def stream_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, table_root: str,
                  checkpoint: str, *, id_col: str = "vector_id", vec_col: str = "embedding",
                  max_files_per_trigger: int = 1, trigger: dict | None = None):
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))

    def upsert_batch(batch: DataFrame, epoch_id: int):
        vt.upsert(vt.to_vector_table(batch, id_col=id_col, vec_col=vec_col), table_root, epoch_id + 1)

    q = (src.writeStream.foreachBatch(upsert_batch).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    return q


def stream_search(spark: SparkSession, index: DataFrame | StoredIndex, source_dir: str, schema: T.StructType,
                  out_root: str, checkpoint: str, k: int = 10, *, strategy: str = "exact",
                  trigger: dict | None = None, **kw):
    from vecspark.operators.knn import batch_search
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source_dir)

    def search_batch(batch: DataFrame, epoch_id: int):
        if isinstance(index, StoredIndex):
            res = knn_stored(index, batch, k, **kw)
        else:
            res = batch_search(index, batch, k, strategy=strategy, **kw)
        (res.withColumn("epoch", F.lit(int(epoch_id))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_root))

    return (src.writeStream.foreachBatch(search_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
