"""Exact top-k inner products by term-at-a-time accumulation.

Queries are cut into blocks and all rows into groups; every (group, block)
cell gets its query block first and then streams its candidates.  A tile of
candidates is inverted into postings (component -> rows and weights); each
component of each query scatters its weighted posting into a dense score
array, and the tile's best rows are selected by partition.  A cell returns
k rows per query; these are merged in two steps (by salted query, by query).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: queries in one block, on average
QUERY_BLOCK = 1024
#: candidates in one group, on average; and the least number of groups
GROUP_ROWS = 8192
LEAST_GROUPS = 48
#: candidates scored at once, and queries of one dense score array
TILE = 2048
TILE_QUERIES = 256
#: larger scaled components fail the query: their products do not fit 64 bits
LIMIT = float(1 << 62)
#: the score of no row
_NONE = np.iinfo(np.int64).min


def quantised(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) for each component, as long; null for null vectors or null / non-finite components.

    A component from +-2^62 on is an error.
    """
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    big = F.raise_error(F.lit("a scaled component is 2^62 or more")).cast("long")

    def weight(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < LIMIT, F.floor(y)).otherwise(big)

    return F.when(vec.isNotNull() & ok, F.transform(vec, weight))


def _halves(v: Column) -> tuple[Column, Column]:
    """Signed low 32 bits of each weight, and the rest (empty where all weights fit 32 bits)."""
    low = lambda x: F.shiftright(F.shiftleft(x, 32), 32)
    rest = F.transform(v, lambda x: F.shiftright(x - low(x), 32).cast("int"))
    return F.transform(v, lambda x: low(x).cast("int")), F.when(F.exists(v, lambda x: low(x) != x), rest).otherwise(F.array().cast("array<int>"))


def _weights(low: pa.Array, rest: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(weights of all rows, number per row) of a batch; 64 bits only where some row needs them."""
    values, lengths = _flat(low)
    high, has = _flat(rest)
    if len(high):
        values = values.astype(np.int64)
        values[np.repeat(has > 0, lengths)] += high.astype(np.int64) << 32
    return values, lengths


def _flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return arr.flatten().to_numpy(zero_copy_only=False), np.diff(arr.offsets.to_numpy())


class _Postings:
    """component -> (rows, weights) of a tile; a component that all rows hold needs no row numbers."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        row = np.repeat(np.arange(len(lengths)), lengths)
        term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keep = values != 0
        row, term, values = row[keep], term[keep], values[keep].astype(np.int64)
        order = np.lexsort((row, term))
        row, term, values = row[order], term[order], values[order]
        cut = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, int)
        self.rows = len(lengths)
        self.most = float(np.abs(values).max(initial=0))
        self.width = int(lengths.max(initial=0))
        self.of = {int(term[a]): (row[a:b] if b - a < self.rows else None, values[a:b])
                   for a, b in zip(cut, np.append(cut[1:], len(term)))}


def _score(queries: "_Postings", tile: "_Postings", lo: int, hi: int, kind=np.int64) -> np.ndarray:
    """Dense scores [query lo..hi) x [tile row], accumulated term by term (modulo 2^64 where ``kind`` is an integer)."""
    score = np.zeros((hi - lo, tile.rows), kind)
    scratch = np.empty_like(score)
    for term, (q_rows, q_weights) in queries.of.items():
        posting = tile.of.get(term)
        if posting is None:
            continue
        rows, weights = posting
        q_weights, weights = q_weights.astype(kind, copy=False), weights.astype(kind, copy=False)
        if q_rows is None:
            qi, qw = None, q_weights[lo:hi]
        else:
            a, b = np.searchsorted(q_rows, (lo, hi))
            qi, qw = q_rows[a:b] - lo, q_weights[a:b]
            if a == b:
                continue
        if qi is None and rows is None:
            np.multiply(qw[:, None], weights[None, :], out=scratch)
            score += scratch
        elif rows is None:
            score[qi] += qw[:, None] * weights[None, :]
        else:
            qi = np.arange(hi - lo) if qi is None else qi
            score[np.ix_(qi, rows)] += qw[:, None] * weights[None, :]
    return score


def _fits(queries: "_Postings", tile: "_Postings", lo: int, hi: int, other: np.ndarray) -> None:
    """Fail if a score of ``other`` pairs does not fit 64 bits; sums that pass the range on their way are exact modulo 2^64."""
    products = queries.most * tile.most * min(queries.width, tile.width)
    if products < LIMIT:
        return
    near = np.abs(_score(queries, tile, lo, hi, np.float64)) + products * 2.0 ** -50 * min(queries.width, tile.width)
    if (near[other] >= 2.0 ** 63).any():
        raise OverflowError("an inner product does not fit 64 bits; use a smaller scale")


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k best per row; ids ascend, so ties go to the smaller column."""
    if score.shape[1] <= k:
        return np.tile(np.arange(score.shape[1]), (score.shape[0], 1))
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    above = score > kth
    need = k - above.sum(axis=1, keepdims=True)
    equal = score == kth
    take = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= need))
    return np.nonzero(take)[1].reshape(score.shape[0], k)


def _cells(k: int):
    def run(batches):
        cell = None
        q_ids: list = []
        q_vals: list = []
        q_lens: list = []
        queries = top_id = top_score = None
        qid = None

        def emit():
            ok = top_score > _NONE
            rows = np.nonzero(ok)[0]
            return pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.array(top_id[ok]), pa.array(top_score[ok])],
                                              names=["query_id", "vec_id", "score"])

        def start():
            nonlocal queries, qid, top_id, top_score
            qid = np.concatenate(q_ids)
            queries = _Postings(np.concatenate(q_vals), np.concatenate(q_lens))
            top_id = np.full((len(qid), k), -1, np.int64)
            top_score = np.full((len(qid), k), _NONE, np.int64)

        def tile(ids, values, lengths):
            post = _Postings(values, lengths)
            for lo in range(0, len(qid), TILE_QUERIES):
                hi = min(lo + TILE_QUERIES, len(qid))
                score, own = _score(queries, post, lo, hi), qid[lo:hi, None] == ids[None, :]
                _fits(queries, post, lo, hi, ~own)
                score[own] = _NONE                                   # not the query's own row
                at = _best(ids, score, k)
                # earlier tiles hold smaller ids, so a stable sort by score keeps ties in order
                s = np.concatenate([top_score[lo:hi], np.take_along_axis(score, at, 1)], axis=1)
                i = np.concatenate([top_id[lo:hi], ids[at]], axis=1)
                order = np.argsort(~s, axis=1, kind="stable")[:, :k]
                top_score[lo:hi] = np.take_along_axis(s, order, 1)
                top_id[lo:hi] = np.take_along_axis(i, order, 1)

        for rb in batches:
            key = rb.column(0).to_numpy() * (1 << 31) + rb.column(1).to_numpy()
            side, ids = rb.column(2).to_numpy(), rb.column(3).to_numpy()
            values, lengths = _weights(rb.column(4), rb.column(5))
            first = np.append(0, np.cumsum(lengths))
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(key))):
                if cell != key[a]:
                    if queries is not None:
                        yield emit()
                    cell, queries = key[a], None
                    q_ids, q_vals, q_lens = [], [], []
                if side[a] == 0:
                    q_ids.append(ids[a:b])
                    q_vals.append(values[first[a]:first[b]])
                    q_lens.append(lengths[a:b])
                elif q_ids:
                    if queries is None:
                        start()
                    for c in range(a, b, TILE):
                        d = min(c + TILE, b)
                        tile(ids[c:d], values[first[c]:first[d]], lengths[c:d])
        if queries is not None:
            yield emit()
    return run


def exact_top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, *, vec_id: str = "vec_id",
                vector: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK,
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row that ``is_query`` selects.

    Vectors are quantised (see ``quantised``); the score is the integer inner
    product over the components both have, so vectors may differ in length.
    Ties go to the smaller id.  Rows with a null id or a vector that is null or
    holds a null or non-finite component take no part.  Rows with a query's id
    are that query's own and no candidates of it; an id that is repeated is
    returned once per row, and a repeated query once for all its rows' best.
    Fewer than k others: all of them.  Other columns are not read.  A component
    from +-2^62 on after scaling, or a score beyond 64 bits, fails the query.
    """
    base = (vectors.withColumn("__q", F.coalesce(is_query, F.lit(False)))
            .select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), "__q")
            .where("id is not null and v is not null"))
    low, rest = _halves(F.col("v"))
    base = base.select("id", low.alias("v"), rest.alias("rest"), "__q")
    n, n_query = base.agg(F.count("*"), F.count_if("__q")).first()
    groups = max(LEAST_GROUPS, -(-n // group_rows))
    blocks = max(1, -(-n_query // query_block))
    h = F.xxhash64("id", F.lit(3))
    queries = (base.where("__q").dropDuplicates(["id", "v", "rest"])
               .withColumn("block", F.pmod(h, F.lit(blocks)).cast("long"))
               .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("side", F.lit(0)))
    rows = (base.withColumn("grp", F.pmod(h, F.lit(groups)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1)))
    cols = [F.col("grp").cast("long").alias("grp"), F.col("block").cast("long").alias("block"), "side", "id", "v", "rest"]
    cells = queries.select(cols).unionByName(rows.select(cols))
    best = (cells.repartition("grp", "block").sortWithinPartitions("grp", "block", "side", "id")
            .mapInArrow(_cells(k), "query_id long, vec_id long, score long"))
    order = [F.desc("score"), "vec_id"]
    salted = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(max(1, groups // 64)))).orderBy(*order)
    best = best.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k).drop("r")
    final = Window.partitionBy("query_id").orderBy(*order)
    return (best.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
