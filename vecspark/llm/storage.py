"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..memory import give_back, tidy, tidy_group  # noqa: F401
from ..session import scratch_path

#: bytes of input whose intermediate rows one task writes
TASK_BYTES = 4 << 20


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each led by as many underscores as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def tasks_for(spark: SparkSession, n_bytes: int) -> int:
    """Tasks, and files, that tables made from ``n_bytes`` of input are worth: some for each core, then more with the input."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))


def write_table(spark: SparkSession, df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage, survives executors).

    ``tasks``: no more than so many tasks write, each a file; fewer where ``df`` has fewer partitions.
    """
    path = scratch_path(spark, name)
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
