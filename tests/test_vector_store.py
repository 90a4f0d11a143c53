"""The vector store data source: checks, requests, failed writes, pushed predicates."""

import os

import pytest
from pyspark.sql import functions as F

from vecspark.session import scratch_path
from vecspark.sinks.vector_store import VectorStoreReader, manifest, read_vectors, write_vectors

SCHEMA = "vector_id long, embedding array<double>, metadata string"


def vectors(spark, ids, parts=3):
    df = spark.createDataFrame([(i, [float(i), 0.5], f"m{i}") for i in ids], SCHEMA)
    return df.repartitionByRange(parts, "vector_id")


def ids(df):
    return sorted(r["vector_id"] for r in df.collect())


def test_write_read_append_and_overwrite(spark):
    path = scratch_path(spark, "t-store")
    first = write_vectors(vectors(spark, range(1000)), path, 2)
    assert first["rows"] == 1000 and first["rejects"] == {} and first["insert_time"] > 0
    assert first["requests"] == sum(-(-f["rows"] // 100) for f in manifest(path)["files"])
    got = {r["vector_id"]: (list(r["embedding"]), r["metadata"]) for r in read_vectors(spark, path).collect()}
    assert got == {i: ([float(i), 0.5], f"m{i}") for i in range(1000)}
    assert write_vectors(vectors(spark, range(1000, 1010)), path, 2, batch=3)["rows"] == 10
    assert ids(read_vectors(spark, path)) == list(range(1010))
    write_vectors(vectors(spark, [5, 6]), path, 2, mode="overwrite")
    assert ids(read_vectors(spark, path)) == [5, 6]
    assert sorted(os.listdir(path)) == sorted(["_store.json", *(f["name"] for f in manifest(path)["files"])])


def test_a_failed_write_leaves_the_store_as_it_was(spark):
    path = scratch_path(spark, "t-store")
    write_vectors(vectors(spark, range(10)), path, 2)
    files = manifest(path)
    lost = vectors(spark, range(10, 400)).withColumn("metadata", F.when(F.col("vector_id") == 399, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        write_vectors(lost, path, 2)
    assert manifest(path) == files and ids(read_vectors(spark, path)) == list(range(10))
    assert write_vectors(vectors(spark, range(10, 400)), path, 2)["rows"] == 390                   # the write once more
    assert ids(read_vectors(spark, path)) == list(range(400))


@pytest.mark.parametrize("bad,reason", [((None, [1.0, 1.0], "m"), "vector_id is null"), ((1, None, "m"), "embedding is null"),
                                        ((1, [1.0], "m"), "dimension"), ((1, [], None), "dimension"), ((1, [1.0, None], "m"), "component is null")])
def test_bad_rows_fail_or_are_counted(spark, bad, reason):
    path = scratch_path(spark, "t-store")
    df = spark.createDataFrame([bad, (2, [1.0, 2.0], None)], SCHEMA)
    with pytest.raises(Exception, match=reason):
        write_vectors(df, path, 2)
    assert manifest(path)["files"] == [] and read_vectors(spark, path).count() == 0
    assert write_vectors(df.coalesce(1), path, 2, on_reject="count")["rejects"] == {reason: 1}
    assert ids(read_vectors(spark, path)) == [2]


def test_empty_tables_and_only_bad_rows(spark):
    path = scratch_path(spark, "t-store")
    assert write_vectors(vectors(spark, range(3)).limit(0), path, 2)["rows"] == 0
    assert write_vectors(spark.createDataFrame([(1, None, None)], SCHEMA), path, 2, on_reject="count")["rejects"] == {"embedding is null": 1}
    assert read_vectors(spark, path).count() == 0


def test_wanted_ids_prune_files_and_rows(spark):
    path = scratch_path(spark, "t-store")
    write_vectors(vectors(spark, range(900)), path, 2)
    reader = VectorStoreReader(path, None, 100, [800, 7, 5, 5])
    parts = reader.partitions()
    assert len(parts) == 1 and [x for rb in reader.read(parts[0]) for x in rb["vector_id"].to_pylist()] == [5, 7]
    assert not VectorStoreReader(path, 5000, None, None).partitions()[0].name
    for kw, want in (({"least": 898}, [898, 899]), ({"most": -1}, []), ({"ids": [1, 899, 2000]}, [1, 899]), ({"ids": []}, []),
                     ({"least": 4, "most": 5}, [4, 5]), ({}, list(range(900)))):
        df = read_vectors(spark, path, **kw)
        assert ids(df) == want, kw
        assert ids(df.where("vector_id < 2").unionByName(df.where("metadata = 'm9'"))) == [i for i in want if i < 2 or i == 9]
        assert df.count() == len(want)
