"""Block k-NN: both sides are dealt to bounded cells, scored by BLAS, merged by joins and windows.

Plan shape::

    index rows   -> (cell, salt) x every query block of the cell --\
                                                                    repartition(cell, salt, block)
    query rows   -> (cell, block) x every salt of the cell --------/
        -> mapInArrow(a cell's queries first, then its rows streamed: local top-k)
        -> top-k per (query, salt of the row) -> top-k per query

A cell of the exact search is the whole index, of the inverted lists one list,
of LSH one bucket of one band: queries and rows meet by an equi-join on the
cell.  Cells of many rows are cut by salts and those of many queries by blocks
(``group_bytes`` and ``max_chunk_bytes`` of vectors), so a hot list or bucket
spreads over tasks.  No vector passes through the driver or is broadcast here:
the joins that add a cell's size say which side is, as files of vectors that
compress well are far smaller than their rows and Spark would plan by the files.

No candidate is dropped: every admitted (query, row) pair is scored and ranked
by ``score desc, vector_id asc`` (ties resolved exactly, not by partition
order).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.memory import tidy
from vecspark.session import ship_library

SCORED_SCHEMA = "query_id long, probe_rank int, vector_id long, score double"
# bytes of query vectors that a task holds at once (float64)
DEFAULT_MAX_CHUNK_BYTES = 32 * 1024 * 1024
# bytes of index vectors (float64) that one cell streams
GROUP_BYTES = 256 * 1024 * 1024
# cells of one dense score block inside a task (8 bytes each), and queries whose candidates are merged together
_BLOCK_CELLS = 1024 * 1024
RUN_ROWS = 2048
# parts that a query's candidates are merged in before the last merge
MERGE_SALTS = 16
# bits of a hash bucket up to which the buckets' sizes (three longs each) are broadcast; more of them are joined by merging
BROADCAST_BITS = 12


# ---------------------------------------------------------------------------
# numpy helpers (run inside Python workers)
# ---------------------------------------------------------------------------

def list_matrix(arr, dim: int) -> np.ndarray:
    """Arrow list<float|double> array -> (n, dim) float64 matrix."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    lengths = np.diff(arr.offsets.to_numpy())
    if arr.null_count or (lengths != dim).any():
        raise ValueError(f"vectors must not be null and have {dim} components; see dimension_check")
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(-1, dim)


def first_k_per_row(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Keep the k best (score desc, id asc) entries of every row group."""
    if len(rows) == 0:
        return rows, ids, scores
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[starts, len(rows)])
    pos = np.arange(len(rows)) - np.repeat(starts, counts)
    keep = pos < k
    return rows[keep], ids[keep], scores[keep]


def dense_candidates(S: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray):
    """All entries of each row of S that can still be in that row's top k.

    ``floor``: per row a score that k entries seen so far reach; it is raised in
    place.  Keeps every entry >= the floor and the row's k-th largest value, so
    exact ties at the boundary survive and are resolved later by id.
    """
    nb, here = S.shape[1], S >= floor[:, None]         # NaN scores rank nowhere
    many = np.flatnonzero(np.count_nonzero(here, axis=1) > k)
    if len(many):
        top = S[many]
        top[np.isnan(top)] = -np.inf
        top.partition(nb - k, axis=1)
        top = top[:, nb - k:]
        here[many] = S[many] >= top[:, :1]
        finite = np.isfinite(top).all(axis=1)
        floor[many[finite]] = top[finite, 0]
    r, c = np.nonzero(here)
    s = S[r, c]
    ok = np.isfinite(s)
    return r[ok], ids[c[ok]], s[ok]


class TopKAccumulator:
    """Running top-k per query row over a stream of candidates, merged by runs of ``RUN_ROWS`` queries.

    It holds some 2 k candidates per query; merging takes room for one run.
    """

    def __init__(self, k: int, nq: int):
        self.k, self.floor = k, np.full(nq, -np.inf)
        self.parts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(0, nq, RUN_ROWS)]
        self.size = [0] * len(self.parts)

    def add(self, run: int, rows, ids, scores):
        if len(rows):
            self.parts[run].append((rows.astype(np.int32), ids, scores))
            self.size[run] += len(rows)
            if self.size[run] > 2 * self.k * RUN_ROWS:
                self._compact(run)

    def _compact(self, run: int):
        if len(self.parts[run]) > 1:
            r, i, s = first_k_per_row(*(np.concatenate(c) for c in zip(*self.parts[run])), self.k)
            last = np.flatnonzero(np.append(r[1:] != r[:-1], True))
            last = last[np.diff(np.append(-1, last)) == self.k]
            self.floor[r[last]] = np.maximum(self.floor[r[last]], s[last])
            self.parts[run], self.size[run] = [(r, i, s)], len(r)

    def results(self):
        """(rows, ids, scores) of one run after the other."""
        for run, parts in enumerate(self.parts):
            if parts:
                yield first_k_per_row(*(np.concatenate(c) for c in zip(*parts)), self.k)


def band_keys(signs: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """(n, bands*bits) boolean signature -> (n, bands) integer bucket keys."""
    n = signs.shape[0]
    w = (1 << np.arange(bits, dtype=np.int64))
    return (signs.reshape(n, bands, bits).astype(np.int64) * w).sum(axis=2)


# ---------------------------------------------------------------------------
# the task functions
# ---------------------------------------------------------------------------

def _score_block(Q, qn, ids, X, xn, acc: TopKAccumulator, k: int) -> None:
    step = min(RUN_ROWS, max(1, _BLOCK_CELLS // max(len(ids), 1)))
    for run, lo in enumerate(range(0, len(Q), RUN_ROWS)):
        end = min(lo + RUN_ROWS, len(Q))
        for a in range(lo, end, step):
            b = min(a + step, end)
            S = Q[a:b] @ X.T
            if qn is not None:
                S /= qn[a:b, None] * xn[None, :]
            r, i, s = dense_candidates(S, ids, k, acc.floor[a:b])
            acc.add(run, r + a, i, s)


def _directed(X: np.ndarray, *cols):
    """Rows with a direction (norm above zero) and their norms."""
    norm = np.concatenate([np.zeros(0), *[np.sqrt((x * x).sum(axis=1)) for x in np.split(X, range(RUN_ROWS, len(X), RUN_ROWS))]])
    ok = norm > 0
    return (X, norm, *cols) if ok.all() else (X[ok], norm[ok], *[c[ok] for c in cols])


def _scored_batch(qids, ranks, i, s):
    return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(ranks, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.float64())],
                                      names=["query_id", "probe_rank", "vector_id", "score"])


def _score_cells(k: int, dim: int, cosine: bool):
    """mapInArrow over rows sorted by (cell, salt, block, side): queries are side 0, index rows side 1."""

    def score(batches):
        key, held, acc = None, [], None
        Q = qn = qids = ranks = None

        def result():
            for r, i, s in acc.results():
                yield _scored_batch(qids[r], ranks[r], i, s)

        for rb in batches:
            if rb.num_rows == 0:
                continue
            cells = np.stack([rb.column(i).to_numpy() for i in range(3)], axis=1)
            side, ids, probe = (rb.column(i).to_numpy() for i in (3, 4, 5))
            X = list_matrix(rb.column(6), dim)
            new = np.append(True, (cells[1:] != cells[:-1]).any(axis=1) | (side[1:] != side[:-1]))
            starts = np.flatnonzero(new)
            for a, b in zip(starts, np.append(starts[1:], rb.num_rows)):
                if key != tuple(cells[a]):
                    if acc is not None:
                        yield from result()
                    key, held, acc = tuple(cells[a]), [], None
                if side[a] == 0:
                    held.append((X[a:b], ids[a:b], probe[a:b]))
                elif held or acc is not None:
                    if acc is None:
                        Q, qids, ranks = (np.concatenate(c) for c in zip(*held))
                        held = []
                        if cosine:
                            Q, qn, qids, ranks = _directed(Q, qids, ranks)
                        acc = TopKAccumulator(k, len(qids))
                    Y, xn, own = X[a:b], None, ids[a:b]
                    if cosine:                          # zero vectors have no direction
                        Y, xn, own = _directed(Y, own)
                    if len(own):
                        _score_block(Q, qn, own, Y, xn, acc, k)
        if acc is not None:
            yield from result()

    return score


def _score_one(q: np.ndarray, k: int, cosine: bool):
    """mapInArrow over (id, vector): the local top-k of one query vector."""

    def score(batches):
        acc = TopKAccumulator(k, 1)
        Q, qn = q[None, :], None
        if cosine:
            Q, qn = _directed(Q)
        for rb in batches:
            rb = rb.filter(pc.is_valid(rb.column(1)))
            ids, X, xn = rb.column(0).to_numpy(), list_matrix(rb.column(1), len(q)), None
            if cosine:
                X, xn, ids = _directed(X, ids)
            if len(ids):
                _score_block(Q, qn, ids, X, xn, acc, k)
        for _, i, s in acc.results():
            yield _scored_batch(np.zeros(len(i)), np.zeros(len(i)), i, s)

    return score


# ---------------------------------------------------------------------------
# plan assembly
# ---------------------------------------------------------------------------

def frame_stats(df: DataFrame, vec_col: str) -> tuple[int, int]:
    """(row count, vector length) in one job; raises on mixed lengths."""
    r = df.select(F.count(F.lit(1)).alias("n"), F.min(F.size(vec_col)).alias("lo"),
                  F.max(F.size(vec_col)).alias("hi")).first()
    if r is None or not r["n"]:
        return 0, 0
    if r["lo"] != r["hi"]:
        raise ValueError(f"{vec_col}: mixed vector lengths {r['lo']}..{r['hi']}; run dimension_check first")
    return int(r["n"]), int(r["lo"])


def vector_dim(df: DataFrame, vec_col: str) -> int:
    return frame_stats(df, vec_col)[1]


def _first_dim(df: DataFrame, vec_col: str) -> int | None:
    """Vector length of the first row (reads one partition, no shuffle)."""
    r = df.select(F.size(vec_col).alias("d")).first()
    return int(r["d"]) if r is not None and r["d"] is not None and r["d"] >= 0 else None


def merge_topk(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Final top-k per ``by``, in two steps: by salted candidates, then whole (k x MERGE_SALTS rows)."""
    order = [F.col("score").desc(), F.col("vector_id").asc()]
    part = Window.partitionBy(*by, F.pmod(F.xxhash64("vector_id"), F.lit(MERGE_SALTS))).orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    return (scored.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
            .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
            .select(*by, "rank", "vector_id", "score"))


def merge_sweep(scored: DataFrame, k: int, levels) -> DataFrame:
    """Top-k per (query, nprobe) from per-(query, probe rank) candidates:
    a row found in the list of probe rank r belongs to every nprobe > r."""
    lv = F.array(*[F.lit(int(x)) for x in sorted(set(levels))])
    ex = scored.withColumn("nprobe", F.explode(F.filter(lv, lambda p: p > F.col("probe_rank"))))
    return merge_topk(ex, k, ("nprobe", "query_id"))


def _vector_type(index: DataFrame, vec_col: str, queries: DataFrame, qvec_col: str) -> str:
    floats = T.ArrayType(T.FloatType())
    both = {index.schema[vec_col].dataType.simpleString(), queries.schema[qvec_col].dataType.simpleString()}
    return "array<float>" if both == {floats.simpleString()} else "array<double>"


def scan_one(index: DataFrame, vector, k: int, *, id_col: str = "vector_id", vec_col: str = "embedding",
             cosine: bool = False) -> DataFrame:
    """Top-k of one given vector -> (query_id 0, rank, vector_id, score): one scan, k rows per task to the merge."""
    ship_library(index.sparkSession)
    q = np.asarray(vector, dtype=np.float64)
    rows = index.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return merge_topk(rows.mapInArrow(_score_one(q, k, cosine), SCORED_SCHEMA), k)


def block_knn(index: DataFrame, queries: DataFrame, k: int, *, mode: str = "exact",
              id_col: str = "vector_id", vec_col: str = "embedding",
              qid_col: str = "query_id", qvec_col: str = "embedding",
              list_col: str | None = None, probe_col: str | None = None,
              key_col: str | None = None, bits: int = 0, cosine: bool = False, sweep_levels=None,
              max_chunk_bytes: int = DEFAULT_MAX_CHUNK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Top-k of every query over ``index`` -> (query_id, rank, vector_id, score).

    ``mode``: ``exact``; ``ivf`` (rows of list ``list_col`` meet the queries whose
    array ``probe_col`` names it); ``lsh`` (arrays ``key_col`` of both sides, one
    key of ``bits`` bits per band, meet by band and key).

    ``sweep_levels`` (IVF only): one pass answers several probe counts; the
    result gets an ``nprobe`` column and is ranked per (query, nprobe).

    ``cosine=True`` scores dot / (||q|| * ||x||) without normalizing first
    (zero vectors are skipped); otherwise the score is the plain dot product.
    Null vectors take no part; vectors of another length than the first query's
    fail the job.
    """
    spark: SparkSession = index.sparkSession
    ship_library(spark)
    dim = _first_dim(queries, qvec_col) or vector_dim(queries, qvec_col)
    block_rows = max(1, max_chunk_bytes // (8 * max(dim, 1)))
    group_rows = max(1, group_bytes // (8 * max(dim, 1)))
    vt = _vector_type(index, vec_col, queries, qvec_col)

    def side(df: DataFrame, number: int, i: str, v: str, keys: str | None) -> DataFrame:
        cols = [F.lit(number).alias("side"), F.col(i).cast("long").alias("id"), F.col(v).cast(vt).alias("v")]
        if keys is None:
            out = df.select(*cols, F.lit(0).alias("probe_rank"), F.lit(0).cast("long").alias("cell"))
        elif isinstance(df.schema[keys].dataType, T.ArrayType):
            out = df.select(*cols, F.posexplode(keys).alias("probe_rank", "cell"))
        else:
            out = df.select(*cols, F.lit(0).alias("probe_rank"), F.col(keys).cast("long").alias("cell"))
        if mode == "lsh":                               # a bucket of each band is a cell of its own
            out = out.withColumn("cell", F.col("probe_rank") * F.lit(1 << bits).cast("long") + F.col("cell")).withColumn("probe_rank", F.lit(0))
        return out.where(F.col("v").isNotNull())

    rows = side(index, 1, id_col, vec_col, list_col if mode == "ivf" else key_col)
    qs = side(queries, 0, qid_col, qvec_col, probe_col if mode == "ivf" else key_col)
    if mode == "exact":
        salts = max(spark.sparkContext.defaultParallelism, -(-index.count() // group_rows))
        blocks = max(1, -(-queries.count() // block_rows))
        size = {"salts": F.lit(salts).cast("long"), "blocks": F.lit(blocks).cast("long")}
        rows, qs = rows.withColumns(size), qs.withColumns(size)
    else:
        # only cells that both sides have; their sizes say into how many salts and blocks they are cut
        size = (rows.groupBy("cell").agg(F.ceil(F.count("*") / group_rows).cast("long").alias("salts"))
                .join(qs.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks")), "cell"))
        # lists are as few as their centroids, which were fetched; buckets as few as their bits allow
        size = size.hint("broadcast" if mode == "ivf" or bits <= BROADCAST_BITS else "merge")
        rows, qs = rows.join(size, "cell"), qs.join(size, "cell")
    h = F.xxhash64("id")
    rows = rows.withColumn("salt", F.pmod(h, "salts")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    qs = qs.withColumn("block", F.pmod(h, "blocks")).withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)")))
    cols = ["cell", "salt", "block", "side", "id", "probe_rank", "v"]
    scored = (qs.select(cols).unionByName(rows.select(cols)).repartition("cell", "salt", "block")
              .sortWithinPartitions("cell", "salt", "block", "side")
              .mapInArrow(tidy(_score_cells(k, dim, cosine)), SCORED_SCHEMA))
    if sweep_levels is not None:
        return merge_sweep(scored, k, sweep_levels)
    if mode == "lsh":                                   # a row may be found in several bands
        scored = scored.groupBy("query_id", "vector_id").agg(F.max("score").alias("score"))
    return merge_topk(scored, k)
