"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_LOCAL_CHECKPOINT_FALLBACK = "/tmp/vecspark-checkpoints"


def get_session(master: str | None = None, app: str = "vecspark",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings this library is tuned for.

    On a cluster, pass ``master=None`` and let spark-submit decide; every
    setting below is only a default that an existing config wins over.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cpus = os.cpu_count() or 8
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # vectors are KB-sized rows: keep Arrow batches to a few MB
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"))
    if shuffle_partitions or master:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor; the default 1g heap
        # makes GC dominate. On a cluster, spark-submit's settings apply.
        b = b.config("spark.driver.memory", os.environ.get("VECSPARK_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Make ``vecspark`` importable in Python workers (the ``--py-files`` route).

    Worker-side functions (block scorer, encoder hook) are pickled by
    reference, so executors need the package; it is zipped once per
    SparkContext on the driver and distributed by Spark.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:            # unique per SparkContext
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="vecspark-lib-"), "vecspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; only when it is unset (local tests) do we set one.
    Also ships the library to the Python workers (once per context).
    """
    ship_library(spark)
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _LOCAL_CHECKPOINT_FALLBACK
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table location under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vecspark/{name}-{uuid.uuid4().hex[:12]}"
