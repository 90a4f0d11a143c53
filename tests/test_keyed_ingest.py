"""Keyed streaming ingest against a batch over all rows; snapshot tables."""

import random

import pytest

from vecspark.session import scratch_path
from vecspark.sinks import snapshots
from vecspark.streaming.keyed import keyed_ingest

SCHEMA = "vector_id long, embedding array<double>, position long"


def test_out_of_order_duplicates_resolve_as_in_a_batch(spark):
    rng = random.Random(4)
    src, root, ck = (scratch_path(spark, n) for n in ("k-src", "k-table", "k-ck"))
    batches = [[(7 if rng.random() < .4 else rng.randrange(20), [rng.random()], rng.randrange(30) if rng.random() < .9 else None)
                for _ in range(40)] for _ in range(6)]
    batches[3] += batches[1][:5]                                    # rows that come again
    want: dict = {}
    for rows in batches:
        for i, v, p in rows:
            want.setdefault(i, []).append((-1 if p is None else p, v[0]))
    top = {i: max(p for p, _ in l) for i, l in want.items()}

    def current():
        return {r["vector_id"]: r for r in snapshots.read(spark, root).collect()}

    for part in (batches[:4], batches[4:]):                          # the second run goes on from the first one's state
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        keyed_ingest(spark, src, spark.createDataFrame([], SCHEMA).schema, root, ck, fan=2, dim=1).awaitTermination()
    got = current()
    assert set(got) == set(want)
    for i, r in got.items():
        assert (-1 if r["position"] is None else r["position"]) == top[i]
        assert any(abs(r["embedding"][0] - v) < 1e-6 for p, v in want[i] if p == top[i])
    now = snapshots.snapshot(spark, root)
    assert now["writers"] == {"stream": 5} and len(now["parts"]) <= 3 and [p["level"] for p in now["parts"]] == [2, 1]
    # rows of lesser positions change nothing
    spark.createDataFrame([(i, [9.0], -5) for i in got if top[i] >= 0], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    keyed_ingest(spark, src, spark.createDataFrame([], SCHEMA).schema, root, ck, fan=2, dim=1).awaitTermination()
    assert {i: r["embedding"] for i, r in current().items()} == {i: r["embedding"] for i, r in got.items()}


@pytest.mark.parametrize("bad", [(None, [1.0], 1), (1, [1.0, 2.0], 1), (1, None, 1)])
def test_rows_that_the_table_refuses_fail_the_query(spark, bad):
    src, root, ck = (scratch_path(spark, n) for n in ("k-src", "k-table", "k-ck"))
    df = spark.createDataFrame([bad, (2, [1.0], 1)], SCHEMA)
    df.coalesce(1).write.parquet(src)
    with pytest.raises(Exception):
        keyed_ingest(spark, src, df.schema, root, ck, dim=1).awaitTermination()
    assert snapshots.snapshot(spark, root)["parts"] == []


def test_snapshots_replace_whole_and_take_an_epoch_once(spark):
    root = scratch_path(spark, "k-snap")
    rows = lambda *ids, v=0: spark.createDataFrame([(i, v) for i in ids], "vector_id long, v int")
    now = lambda: sorted(map(tuple, snapshots.read(spark, root).collect()))
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root)
    snapshots.replace(spark, rows(1, 2, 3), root)
    before = snapshots.read(spark, root)
    assert snapshots.append(spark, rows(2, 4, v=1), root, "a", 0)
    assert not snapshots.append(spark, rows(2, 4, v=8), root, "a", 0)       # a retried batch
    assert now() == [(1, 0), (2, 1), (3, 0), (4, 1)]
    assert sorted(map(tuple, before.collect())) == [(1, 0), (2, 0), (3, 0)]   # a reader of the earlier version
    with pytest.raises(Exception):
        snapshots.replace(spark, rows(5).selectExpr("raise_error('lost') AS vector_id"), root)
    assert now() == [(1, 0), (2, 1), (3, 0), (4, 1)]                          # a failed write leaves the table as it was
    snapshots.replace(spark, rows(5), root)
    assert now() == [(5, 0)]
    for e in range(1, 12):
        snapshots.append(spark, rows(e, 5, v=e), root, "a", e, fan=3)
        assert len(snapshots.snapshot(spark, root)["parts"]) <= 6
    assert now() == sorted([(5, 11)] + [(e, e) for e in range(1, 12) if e != 5])
    assert len(snapshots._children(spark, f"{root}/snapshots")) <= 2 * snapshots.KEEP     # with the checksums of a local folder
