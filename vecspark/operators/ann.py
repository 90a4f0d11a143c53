"""Approximate k-NN: inverted lists (IVF) and random-hyperplane LSH.

Both re-rank every admitted candidate exactly, so an approximate result is a
subset-then-exact top-k; ``nprobe = nlist`` (IVF) is exactly ``knn_exact``.

IVF
    centroids: ``ivf_fit`` (pyspark.ml KMeans on all rows, re-normalized for
    cosine) or ``centroids_from_rows`` (fixed rows, used by the oracle);
    ``ivf_assign`` adds ``list_id`` in one map pass; write the result
    partitioned by ``list_id`` so a probe prunes files.
    ``ivf_search`` probes the ``nprobe`` best lists per query.
LSH
    ``bands * bits`` hyperplanes from md5 Box-Muller normals; a row and a query
    are candidates when they share a bucket in at least one band.
"""

from __future__ import annotations

import weakref
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.memory import tidy
from vecspark.session import ship_library

from vecspark.functions.hashing import gaussian
from vecspark.operators.blockscan import (
    DEFAULT_MAX_CHUNK_BYTES, block_knn, frame_stats, list_matrix, vector_dim,
)
from vecspark.operators.knn import knn_exact

MAX_CENTROID_BYTES = 512 * 1024 * 1024
#: rows that are scored against the centroids at once
PIECE_ROWS = 1024


# ---------------------------------------------------------------------------
# centroids
# ---------------------------------------------------------------------------

def centroids_from_rows(index: DataFrame, where: Column, *, id_col: str = "vector_id",
                        vec_col: str = "embedding") -> DataFrame:
    """Fixed centroids: the selected index rows, ``list_id`` = their id."""
    return index.where(where).select(F.col(id_col).cast("int").alias("list_id"),
                                     F.col(vec_col).cast("array<double>").alias("centroid"))


def ivf_fit(index: DataFrame, nlist: int = 100, *, vec_col: str = "embedding",
            seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Spherical k-means centroids -> (list_id int, centroid array<double>).

    Trains (pyspark.ml KMeans, distributed) on all rows; centroids are
    L2-normalized for cosine assignment.  Only the centroids (nlist x dim)
    come back to the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = index.where(F.col(vec_col).isNotNull())
    features = rows.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="features", initMode="k-means||").fit(features)
    spark = index.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    cdf = spark.createDataFrame(rows, "list_id int, centroid array<double>")
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
    return cdf.select("list_id", F.when(norm > 0, F.transform("centroid", lambda x: x / norm))
                      .otherwise(F.col("centroid")).alias("centroid"))


_CENTROIDS: "weakref.WeakKeyDictionary[DataFrame, tuple]" = weakref.WeakKeyDictionary()


def collect_centroids(centroids: DataFrame, max_bytes: int = MAX_CENTROID_BYTES):
    """Bounded fetch of the centroid table (nlist x dim), ordered by list_id.

    Memoized per centroid DataFrame, so assignment and probing share one fetch.
    """
    hit = _CENTROIDS.get(centroids)
    if hit is not None:
        return hit
    n, dim = frame_stats(centroids, "centroid")
    if n * dim * 8 > max_bytes:
        raise ValueError(f"{n} centroids x {dim} dims exceed {max_bytes} bytes")
    t = centroids.select("list_id", "centroid").orderBy("list_id").toArrow()
    out = (t.column("list_id").to_numpy().astype(np.int64), list_matrix(t.column("centroid"), dim))
    _CENTROIDS[centroids] = out
    return out


def _pieces(X: np.ndarray) -> list[np.ndarray]:
    """X by ``PIECE_ROWS`` rows: scores against all centroids are held for one piece."""
    return [X[i:i + PIECE_ROWS] for i in range(0, len(X), PIECE_ROWS)]


def _int_list_array(m: np.ndarray) -> pa.Array:
    n, w = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * w, w, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1).astype(np.int64)))


def ivf_assign(index: DataFrame, centroids: DataFrame, *, vec_col: str = "embedding",
               out_col: str = "list_id") -> DataFrame:
    """Add the nearest centroid's ``list_id`` (ties: lower list id; null vector: null). Map-only."""
    ship_library(index.sparkSession)
    lids, C = collect_centroids(centroids)
    dim = C.shape[1]
    schema = T.StructType(index.schema.fields + [T.StructField(out_col, T.IntegerType())])

    def assign(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            ok = b.column(vec_col).is_valid()
            X, here = list_matrix(b.column(vec_col).filter(ok), dim), ok.to_numpy(zero_copy_only=False)
            best = np.zeros(b.num_rows, np.int32)
            best[here] = lids[np.concatenate([np.zeros(0, np.int64), *[np.argmax(x @ C.T, axis=1) for x in _pieces(X)]])]     # first max = lowest id
            yield b.append_column(out_col, pa.array(best, pa.int32(), mask=~here))

    return index.mapInArrow(tidy(assign), schema)


def ivf_build(index: DataFrame, centroids: DataFrame, root: str, *, vec_col: str = "embedding",
              list_col: str = "list_id", salts: int = 8) -> DataFrame:
    """Assign lists and store the index partitioned by list id; returns the stored table.

    A list is written by up to ``salts`` tasks, so a hot list is not one task's
    and a list has at most so many files.
    """
    (ivf_assign(index, centroids, vec_col=vec_col, out_col=list_col)
     .repartition(F.col(list_col), F.pmod(F.xxhash64(vec_col), F.lit(salts)))
     .write.mode("overwrite").partitionBy(list_col).parquet(root))
    return index.sparkSession.read.parquet(root)


def ivf_probes(queries: DataFrame, centroids: DataFrame, nprobe: int, *,
               vec_col: str = "embedding", out_col: str = "probes") -> DataFrame:
    """Add the ``nprobe`` best list ids per query (score desc, list id asc)."""
    ship_library(queries.sparkSession)
    lids, C = collect_centroids(centroids)
    dim = C.shape[1]
    p = min(nprobe, len(lids))
    schema = T.StructType(queries.schema.fields + [T.StructField(out_col, T.ArrayType(T.LongType()))])

    def probe(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            X = list_matrix(b.column(vec_col), dim)
            order = np.concatenate([np.argsort(-(x @ C.T), axis=1, kind="stable")[:, :p] for x in _pieces(X)])
            yield b.append_column(out_col, _int_list_array(lids[order]))

    return queries.mapInArrow(tidy(probe), schema)


def ivf_search(index_assigned: DataFrame, queries: DataFrame, centroids: DataFrame,
               k: int = 10, nprobe: int = 4, *, id_col: str = "vector_id",
               vec_col: str = "embedding", qid_col: str = "query_id",
               qvec_col: str = "embedding", list_col: str = "list_id",
               max_chunk_bytes: int = DEFAULT_MAX_CHUNK_BYTES) -> DataFrame:
    """Top-k over the rows of the ``nprobe`` nearest lists of each query."""
    q = ivf_probes(queries.select(qid_col, qvec_col).where(F.col(qvec_col).isNotNull()), centroids, nprobe, vec_col=qvec_col)
    return block_knn(index_assigned, q, k, mode="ivf", id_col=id_col, vec_col=vec_col,
                     qid_col=qid_col, qvec_col=qvec_col, list_col=list_col,
                     probe_col="probes", max_chunk_bytes=max_chunk_bytes)


def ivf_sweep(index_assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10,
              nprobes=(1, 2, 4, 8, 16), *, id_col: str = "vector_id", vec_col: str = "embedding",
              qid_col: str = "query_id", qvec_col: str = "embedding", list_col: str = "list_id",
              max_chunk_bytes: int = DEFAULT_MAX_CHUNK_BYTES) -> DataFrame:
    """IVF results for several probe counts in one scan ->
    (nprobe, query_id, rank, vector_id, score); equals ``ivf_search`` per nprobe."""
    q = ivf_probes(queries.select(qid_col, qvec_col).where(F.col(qvec_col).isNotNull()), centroids, max(nprobes), vec_col=qvec_col)
    return block_knn(index_assigned, q, k, mode="ivf", id_col=id_col, vec_col=vec_col,
                     qid_col=qid_col, qvec_col=qvec_col, list_col=list_col, probe_col="probes",
                     sweep_levels=list(nprobes), max_chunk_bytes=max_chunk_bytes)


# ---------------------------------------------------------------------------
# hyperplane LSH
# ---------------------------------------------------------------------------

def lsh_planes(spark: SparkSession, dim: int, bands: int, bits: int, seed: int = 42) -> DataFrame:
    """(plane int, normal array<double>) from md5 Box-Muller, partition-independent."""
    n = bands * bits
    cells = (spark.range(n * dim)
             .select((F.col("id") / dim).cast("int").alias("plane"),
                     (F.col("id") % dim).cast("int").alias("d"))
             .withColumn("z", gaussian(seed, "lsh", F.col("plane"), F.col("d"))))
    return (cells.groupBy("plane")
            .agg(F.array_sort(F.collect_list(F.struct("d", "z"))).alias("_c"))
            .select("plane", F.transform("_c", lambda x: x["z"]).alias("normal")))


def collect_planes(planes: DataFrame, max_bytes: int = MAX_CENTROID_BYTES) -> np.ndarray:
    n, dim = frame_stats(planes, "normal")
    if n * dim * 8 > max_bytes:
        raise ValueError("hyperplane table exceeds the broadcast bound")
    t = planes.orderBy("plane").toArrow()
    return list_matrix(t.column("normal"), dim)


_PLANES: dict[tuple, np.ndarray] = {}


def planes_matrix(spark: SparkSession, dim: int, bands: int, bits: int, seed: int) -> np.ndarray:
    """The hyperplanes as a (bands*bits, dim) matrix; a pure function of its
    parameters, so it is generated by Spark once per session and reused."""
    key = (spark.sparkContext.applicationId, dim, bands, bits, seed)
    if key not in _PLANES:
        _PLANES[key] = collect_planes(lsh_planes(spark, dim, bands, bits, seed))
    return _PLANES[key]


def lsh_keys(df: DataFrame, planes: np.ndarray, bands: int, bits: int, *,
             vec_col: str = "embedding", out_col: str = "band_keys") -> DataFrame:
    """Add per-band bucket keys (bit j of band b = sign of the plane b*bits+j)."""
    from vecspark.operators.blockscan import band_keys
    ship_library(df.sparkSession)
    dim = planes.shape[1]
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.LongType()))])

    def keys(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            X = list_matrix(b.column(vec_col), dim)
            yield b.append_column(out_col, _int_list_array(band_keys((X @ planes.T) > 0, bands, bits)))

    return df.mapInArrow(keys, schema)


def lsh_search(index: DataFrame, queries: DataFrame, k: int = 10, *, bands: int = 8,
               bits: int = 4, seed: int = 42, id_col: str = "vector_id",
               vec_col: str = "embedding", qid_col: str = "query_id",
               qvec_col: str = "embedding", cosine: bool = False,
               max_chunk_bytes: int = DEFAULT_MAX_CHUNK_BYTES) -> DataFrame:
    """Top-k over rows that share at least one band bucket with the query."""
    from vecspark.operators.blockscan import _first_dim
    dim = _first_dim(queries, qvec_col) or vector_dim(queries, qvec_col)
    P = planes_matrix(index.sparkSession, dim, bands, bits, seed)
    rows, qs = (lsh_keys(df.select(i, v).where(F.col(v).isNotNull()), P, bands, bits, vec_col=v)
                for df, i, v in ((index, id_col, vec_col), (queries, qid_col, qvec_col)))
    return block_knn(rows, qs, k, mode="lsh", id_col=id_col, vec_col=vec_col, qid_col=qid_col, qvec_col=qvec_col,
                     key_col="band_keys", bits=bits, cosine=cosine, max_chunk_bytes=max_chunk_bytes)


# ---------------------------------------------------------------------------
# strategy selection
# ---------------------------------------------------------------------------

def _ivf_strategy(index, queries, k, *, nlist: int = 100, nprobe: int = 10,
                  centroids: DataFrame | None = None, id_col="vector_id",
                  vec_col="embedding", qid_col="query_id", qvec_col="embedding", **kw):
    c = centroids if centroids is not None else ivf_fit(index, nlist, vec_col=vec_col)
    assigned = ivf_assign(index, c, vec_col=vec_col)
    return ivf_search(assigned, queries, c, k, nprobe, id_col=id_col, vec_col=vec_col,
                      qid_col=qid_col, qvec_col=qvec_col, **kw)


def _exact_strategy(index, queries, k, **kw):
    kw = {a: b for a, b in kw.items() if a in ("id_col", "vec_col", "qid_col", "qvec_col", "max_chunk_bytes")}
    return knn_exact(index, queries, k, **kw)


def _lsh_strategy(index, queries, k, **kw):
    kw = {a: b for a, b in kw.items()
          if a in ("bands", "bits", "seed", "id_col", "vec_col", "qid_col", "qvec_col", "max_chunk_bytes")}
    return lsh_search(index, queries, k, **kw)


STRATEGIES = {"exact": _exact_strategy, "ivf": _ivf_strategy, "lsh": _lsh_strategy}


def search_auto(index: DataFrame, queries: DataFrame, k: int = 10, *, strategy: str = "exact", **kw) -> DataFrame:
    """Search by the named strategy, with a ``strategy`` column.

    The caller names it: an exact result never turns approximate by the size of the index.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](index, queries, k, **kw).select(F.lit(strategy).alias("strategy"), "*")


def register_strategy(name: str, fn) -> None:
    """Add a search strategy: ``fn(index, queries, k, **params)`` returning
    ``(query_id, rank, vector_id, score)``; usable by ``batch_search`` and
    ``compare_strategies`` under ``name``."""
    if not callable(fn):
        raise TypeError("strategy must be callable")
    STRATEGIES[name] = fn


def compare_strategies(index: DataFrame, queries: DataFrame, k: int = 10,
                       strategies: dict[str, dict] | Sequence[str] = ("exact", "ivf", "lsh")
                       ) -> DataFrame:
    """Union of ranked results with an ``engine`` column; unknown names raise.

    A failing strategy fails the job (errors are not hidden as empty results).
    """
    from concurrent.futures import ThreadPoolExecutor

    if not isinstance(strategies, dict):
        strategies = {s: {} for s in strategies}
    for name, params in strategies.items():
        if params.get("strategy", name) not in STRATEGIES:
            raise ValueError(f"unknown strategy {params.get('strategy', name)!r}")

    def build(item):
        name, params = item
        p = {a: b for a, b in params.items() if a != "strategy"}
        return STRATEGIES[params.get("strategy", name)](index, queries, k, **p).select(
            F.lit(name).alias("engine"), "*")

    # each strategy's driver-side preparation (query fetch, centroids) runs
    # in its own thread, so their small Spark jobs overlap
    with ThreadPoolExecutor(max_workers=max(1, len(strategies))) as ex:
        parts = list(ex.map(build, strategies.items()))
    out = parts[0]
    for r in parts[1:]:
        out = out.unionByName(r)
    return out
