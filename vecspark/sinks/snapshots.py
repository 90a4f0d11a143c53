"""A vector table whose readers always see one whole version: parts of files, listed by numbered snapshots.

Layout: ``<root>/data/<part>/`` holds Parquet files, ``<root>/snapshots/<number>.json``
the parts that make up a version, oldest first, each with its level.  A write
adds its part under a new name and then its snapshot, by one rename: readers
take the greatest number, so they see the table before or after a write, never
between.  ``append`` folds parts as it goes: ``fan`` adjacent parts of one level
become one of the next, so n appends leave at most ``fan - 1`` parts a level and
rewrite a row about log(n) times.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: parts of one level that are folded into one of the next
FAN = 4
#: snapshots that stay readable, the newest among them
KEEP = 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _children(spark, f"{root}/snapshots") if n.endswith(".json") and n[:-5].isdigit())


def _load(spark: SparkSession, root: str, number: int) -> dict:
    fs, p = _fs(spark, f"{root}/snapshots/{number:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def snapshot(spark: SparkSession, root: str) -> dict:
    """The newest version: its number, its parts (oldest first) and the last epoch of every writer."""
    found = _numbers(spark, root)
    return _load(spark, root, found[-1]) if found else {"number": 0, "parts": [], "writers": {}}


def _publish(spark: SparkSession, root: str, version: dict) -> None:
    name = f"{root}/snapshots/{version['number']:012d}.json"
    fs, target = _fs(spark, name)
    _, draft = _fs(spark, f"{root}/snapshots/_{uuid.uuid4().hex}.tmp")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"{name} is there already: another writer?")


def _clean(spark: SparkSession, root: str, keep: int) -> None:
    """Remove snapshots but the newest ``keep``, and parts that none of these lists."""
    numbers = _numbers(spark, root)
    for n in numbers[:-keep]:
        fs, p = _fs(spark, f"{root}/snapshots/{n:012d}.json")
        fs.delete(p, False)
    listed = {part["name"] for n in numbers[-keep:] for part in _load(spark, root, n)["parts"]}
    for name in _children(spark, f"{root}/data"):
        if name not in listed:
            fs, p = _fs(spark, f"{root}/data/{name}")
            fs.delete(p, True)


def _write(df: DataFrame, root: str) -> str:
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{name}")
    return name


def _rows(spark: SparkSession, root: str, parts: list[dict], id_col: str) -> DataFrame:
    """One row per id: that of its newest part.  Only newer parts' rows are aggregated; the oldest part is filtered by their ids."""
    read = [spark.read.parquet(f"{root}/data/{p['name']}") for p in parts]
    if len(read) == 1:
        return read[0]
    cols = [c for c in read[0].columns if c != id_col]
    newer = reduce(DataFrame.unionByName, [d.select(F.col(id_col), F.struct(*cols).alias("r"), F.lit(i).alias("n")) for i, d in enumerate(read[1:])])
    last = newer.groupBy(id_col).agg(F.max_by("r", "n").alias("r")).select(id_col, *[F.col("r")[c].alias(c) for c in cols])
    rest = read[0].select(id_col, *cols).join(newer.select(id_col).distinct(), id_col, "left_anti")
    return rest.unionByName(last).select(*read[0].columns)


def read(spark: SparkSession, root: str, *, id_col: str = "vector_id") -> DataFrame:
    """The newest version's rows, one per id.  It stays readable until ``KEEP`` further writes."""
    parts = snapshot(spark, root)["parts"]
    if not parts:
        raise FileNotFoundError(f"no table at {root}")
    return _rows(spark, root, parts, id_col)


def replace(spark: SparkSession, df: DataFrame, root: str, *, keep: int = KEEP) -> None:
    """Make ``df`` (one row per id) the whole table; readers see the earlier one until this one is complete."""
    now = snapshot(spark, root)
    _publish(spark, root, {**now, "number": now["number"] + 1, "parts": [{"name": _write(df, root), "level": 0}]})
    _clean(spark, root, keep)


def append(spark: SparkSession, df: DataFrame, root: str, writer: str, epoch: int, *, fan: int = FAN, keep: int = KEEP,
           id_col: str = "vector_id") -> bool:
    """Insert or replace the rows of ``df`` (one per id) as ``writer``'s ``epoch``; False if that epoch is in the table already."""
    now = snapshot(spark, root)
    if now["writers"].get(writer, -1) >= epoch:
        return False
    parts = [*now["parts"], {"name": _write(df, root), "level": 0}]
    while len(parts) >= fan and len({p["level"] for p in parts[-fan:]}) == 1:
        folded = _write(_rows(spark, root, parts[-fan:], id_col), root)
        parts[-fan:] = [{"name": folded, "level": parts[-1]["level"] + 1}]
    _publish(spark, root, {"number": now["number"] + 1, "parts": parts, "writers": {**now["writers"], writer: epoch}})
    _clean(spark, root, keep)
    return True
