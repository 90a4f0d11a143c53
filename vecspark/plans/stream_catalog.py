"""Registered query: keyed streaming ingest of ``events``, the last row of each user by event number."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.plans import oracle as O
from vecspark.plans.catalog import register
from vecspark.plans.views import Views
from vecspark.session import scratch_path
from vecspark.sinks import snapshots
from vecspark.streaming.keyed import keyed_ingest

#: files of the stream, one micro-batch each; parts of a level that are folded
FILES, FOLD = 5, 2


@register("stream_last_wins", O.sql("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE user_id IS NOT NULL)
SELECT user_id AS vector_id, event_id AS position, round(value::FLOAT::DOUBLE, 3) AS value, true AS parts_bounded FROM r WHERE n = 1"""))
def q_stream_last_wins(spark, sf):
    rows = (Views(spark, sf).table("events").where("user_id is not null")
            .select(F.col("user_id").alias("vector_id"), F.array("value").alias("embedding"), F.col("event_id").alias("position")))
    src, root, ck = (scratch_path(spark, n) for n in ("keyed-src", "keyed-table", "keyed-ck"))
    rows.repartition(FILES, F.xxhash64("position")).write.parquet(src)              # rows of a user in all files, in no order
    keyed_ingest(spark, src, rows.schema, root, ck, fan=FOLD, dim=1).awaitTermination()
    parts = snapshots.snapshot(spark, root)["parts"]
    bounded = len({p["level"] for p in parts}) == len(parts)                        # fan 2: one part a level
    return (snapshots.read(spark, root)
            .select("vector_id", "position", F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("value"), F.lit(bounded).alias("parts_bounded")))
