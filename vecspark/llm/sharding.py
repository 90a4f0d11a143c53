"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered densely in the order of their key; a keyed Feistel network
with cycle walking permutes 0..n-1, and a row's position p gives its shard
p mod s and slot p div s.  Both directions are computable for any row without
the table, and row counts of shards differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import unused, write_table
from .words import mix64

ROUNDS = 6
_U = np.uint64


def _halves(n: int) -> int:
    """Bits of one half of the least even-width domain that holds n values."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> list[np.uint64]:
    with np.errstate(over="ignore"):
        return [mix64(np.array([(seed << 8) + r], dtype=np.uint64))[0] for r in range(ROUNDS)]


def _feistel(x: np.ndarray, half: int, keys, backwards: bool) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    with np.errstate(over="ignore"):
        for key in (reversed(keys) if backwards else keys):
            if backwards:
                left, right = right ^ (mix64(left + key) & mask), left
            else:
                left, right = right, left ^ (mix64(right + key) & mask)
    return (left << _U(half)) | right


def _walk(x: np.ndarray, n: int, seed: int, backwards: bool) -> np.ndarray:
    x = np.asarray(x, dtype=np.uint64)
    half, keys = _halves(n), _keys(seed)
    out = _feistel(x, half, keys, backwards)
    while len(far := np.flatnonzero(out >= _U(n))):           # cycle walking: again until inside
        out[far] = _feistel(out[far], half, keys, backwards)
    return out.astype(np.int64)


def position(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Shuffled position of row numbers in 0..n-1."""
    return _walk(rows, n, seed, False)


def row_at(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number at shuffled positions: the inverse of ``position``."""
    return _walk(positions, n, seed, True)


def _number(part_col: str, at_col: str):
    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for rb in batches:
            n = rb.num_rows
            yield pa.RecordBatch.from_arrays(
                [*rb.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
                names=[*rb.schema.names, part_col, at_col])
            at += n
    return run


def _place(first, n: int, shards: int, seed: int):
    """Rows whose last two columns are the partition and the place in it."""
    def run(batches):
        start = first.value
        for rb in batches:
            part, at = (c.to_numpy() for c in rb.columns[-2:])
            row = start[part] + at
            p = position(row, n, seed)
            yield pa.RecordBatch.from_arrays(
                [*rb.columns[:-2], pa.array(row), pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
                names=[*rb.schema.names[:-2], "row_no", "shard", "slot"])
    return run


def shuffle_into_shards(spark: SparkSession, df: DataFrame, shards: int, order_by: list[Column], seed: int = 0) -> DataFrame:
    """``df`` with row_no (dense, in ``order_by`` order), shard (int) and slot (long, gapless from 0 in each shard).

    Rows that ``order_by`` does not tell apart are interchangeable; give it
    enough columns to tell different rows apart.  Nulls sort first.  Columns
    named row_no, shard or slot are replaced.  An empty table gives no rows;
    with fewer rows than shards some shards stay empty.
    """
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in ("row_no", "shard", "slot")])
    part_col, at_col = unused(df, "__part", "__at")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    numbered = write_table(spark, ranged.mapInArrow(_number(part_col, at_col), f"{fields}, {part_col} int, {at_col} long"), "shard-rows")
    # one count per written partition
    counts = {r[0]: r[1] for r in numbered.groupBy(part_col).count().collect()}
    sizes = np.zeros(max(counts, default=0) + 1, np.int64)
    for part, n in counts.items():
        sizes[part] = n
    first = spark.sparkContext.broadcast(np.cumsum(sizes) - sizes)
    return numbered.mapInArrow(_place(first, int(sizes.sum()), shards, seed), f"{fields}, row_no long, shard int, slot long")


def document_shards(spark: SparkSession, docs: DataFrame, shards: int = 40, seed: int = 20240607, *,
                    text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Size, checksum and place of every document, without moving the texts.

    Null text: no bytes (size 16, checksum 0).  Null ids come first; rows of one
    id follow by checksum and size.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                         F.crc32(body).alias("text_crc32"))
    keys = [F.asc_nulls_first("doc_id"), F.asc("text_crc32"), F.asc("size")]
    return (shuffle_into_shards(spark, narrow, shards, keys, seed)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "row_no"))
