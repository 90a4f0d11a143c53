"""Approximate k-NN by a neighbour graph: built by neighbour-of-neighbour joins, searched best first by joins.

Build (``graph_build``)
    Every node starts with hashed random neighbours.  In each round the nodes'
    neighbours and reverse neighbours meet in their common node's group, score
    each other, and each node keeps its best.  At last a diverse half of the
    degree is chosen per node (a candidate nearer to a chosen one than to the
    node waits), and the other half is filled with reverse edges.
Search (``graph_search``)
    One row per query holds its beam of ``ef`` nodes (ids and scores only).  A
    round takes the best nodes that are not expanded and joins them with the
    stored graph, which is bucketed by node, for their neighbours.  Those outside
    the beam are asked for by parts of the nodes: a query's vector goes once to
    each part, with the ids it asks for there and the score that a full beam
    ends with, and only answers that reach it come back to be merged.

A round moves each vector of the index once (``PART_BYTES`` of them are held
per part), and per query its beam, the neighbours of ``width`` nodes and its
vector once per part, whatever the number of neighbours scored.  While
building, a pair below the score that a node's neighbours end with is not sent.

Groups hold a bounded number of rows (twice the neighbours); nothing passes
through the driver but counts.  Ties go to the smaller id and scores are added
up in a fixed order, so results do not depend on the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.constants import HNSW_EF, HNSW_M
from vecspark.memory import tidy
from vecspark.operators.blockscan import frame_stats, list_matrix
from vecspark.operators.ids import dense_index
from vecspark.session import scratch_path, ship_library
from vecspark.sinks.bucketed import Bucketed, bucket_count, bucket_keys, write_bucketed

#: neighbours per node while building; pairs a member of a group takes home from it
NEIGHBOURS = 24
TAKE = 8
ROUNDS = 4
#: entry nodes of a search, chosen by hash (broadcast: this many vectors), and nodes expanded per round
ENTRIES = 256
WIDTH = 32
#: bytes of the groups of one partition while building, each with its members' vectors
GROUP_BYTES = 256 * 1024 * 1024
#: bytes of vectors (float64) that a part of the nodes holds while searching, pairs scored and queries advanced at once
PART_BYTES = 32 * 1024 * 1024
_PAIRS = 1 << 14
_STEP_ROWS = 1024


@dataclass(frozen=True)
class Graph:
    """The stored graph (vector_id, embedding, neighbours), bucketed by vector_id."""

    table: Bucketed
    rows: int
    dim: int
    degree: int

    def read(self, spark: SparkSession) -> DataFrame:
        return self.table.read(spark)


def _scratch(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------
# inside a task
# ---------------------------------------------------------------------------

def _node_groups(batches, dim: int):
    """(node, member ids, vectors, floors) of runs of rows (node, member, v, floor); one group is held."""
    node, held = None, []
    for rb in batches:
        u, a, floor = rb.column(0).to_numpy(), rb.column(1).to_numpy(), rb.column(3).to_numpy()
        X = list_matrix(rb.column(2), dim)
        cut = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else []
        for lo, hi in zip(cut, np.append(cut[1:], len(u)) if len(u) else []):
            if held and node != u[lo]:
                yield node, *(np.concatenate(c) for c in zip(*held))
                held = []
            node = u[lo]
            held.append((a[lo:hi], X[lo:hi], floor[lo:hi]))
    if held:
        yield node, *(np.concatenate(c) for c in zip(*held))


def _edge_batch(src, dst, score):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64()),
                                       pa.array(np.concatenate(score), pa.float64())], names=["src", "dst", "score"])


def _emit(rows):
    src, dst, score, n = [], [], [], 0
    for s, d, x in rows:
        src.append(s)
        dst.append(d)
        score.append(x)
        n += len(s)
        if n >= 1 << 16:
            yield _edge_batch(src, dst, score)
            src, dst, score, n = [], [], [], 0
    if n:
        yield _edge_batch(src, dst, score)


def _introduce(dim: int, take: int):
    """Members of a group score each other: the group's node takes all home, every other its ``take`` best.

    What lies below a member's floor, the score its neighbours end with, would not be kept and stays behind.
    """

    def run(batches):
        def rows():
            for node, ids, X, floor in _node_groups(batches, dim):
                S = X @ X.T
                np.fill_diagonal(S, -np.inf)
                own = np.flatnonzero(ids == node)
                if len(own):
                    home = np.flatnonzero((ids != node) & ~(S[own[0]] < floor[own[0]]))
                    yield np.full(len(home), node), ids[home], S[own[0], home]
                k = min(take, len(ids) - 1)
                if k > 0:
                    best = np.argsort(-S, axis=1, kind="stable")[:, :k]          # members come by id: ties to the smaller
                    score = np.take_along_axis(S, best, 1)
                    keep = ~(score < floor[:, None])
                    yield np.broadcast_to(ids[:, None], best.shape)[keep], ids[best][keep], score[keep]
        return _emit(rows())

    return run


def _diverse(dim: int, keep: int):
    """Each group's node chooses ``keep`` members: nearest first, passing over those nearer to a chosen one, which fill up."""

    def run(batches):
        def rows():
            for node, ids, X, _ in _node_groups(batches, dim):
                own = np.flatnonzero(ids == node)
                if not len(own) or len(ids) < 2:
                    continue
                S = X @ X.T
                to = S[own[0]]
                order = [i for i in np.lexsort((ids, -to)) if i != own[0]]
                chosen, waiting = [], []
                for i in order:
                    if len(chosen) == keep:
                        break
                    (waiting if chosen and S[i, chosen].max() >= to[i] else chosen).append(i)
                chosen += waiting[:keep - len(chosen)]
                yield np.full(len(chosen), node), ids[chosen], to[chosen]
        return _emit(rows())

    return run


def row_dots(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Dot product of each pair of rows, components added in order (the same for any batch)."""
    out = np.zeros(len(A))
    for j in range(A.shape[1]):
        out += A[:, j] * B[:, j]
    return out


_STATE = pa.schema([("query_id", pa.int64()), ("qv", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())),
                    ("scores", pa.list_(pa.float64())), ("open", pa.list_(pa.bool_())), ("expand", pa.list_(pa.int64())),
                    ("ask", pa.list_(pa.int64()))])


def _ddl(vec: str) -> str:
    return f"query_id long, qv {vec}, ids array<long>, scores array<double>, open array<boolean>, expand array<long>, ask array<long>"


def _each(arr) -> list[np.ndarray]:
    """The rows of an Arrow list array without nulls."""
    off = arr.offsets.to_numpy()
    return np.split(arr.flatten().to_numpy(zero_copy_only=False), off[1:-1] - off[0])


def _slices(batches):
    for rb in batches:
        for lo in range(0, rb.num_rows, _STEP_ROWS):
            yield rb.slice(lo, _STEP_ROWS)


def _state_batch(q, qv, rows):
    cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_STATE)[2:])]
    return pa.RecordBatch.from_arrays([q, qv, *cols], names=_STATE.names)


def _begin(entry, dim: int, ef: int, width: int):
    """(query_id, v) -> the state of the entry nodes, whose neighbours are at hand: the first round asks for them."""

    def run(batches):
        ids, E, neighbours = entry.value
        known = set(ids.tolist())
        for rb in _slices(batches):
            out = []
            for v in list_matrix(rb.column(1), dim):
                s = row_dots(np.broadcast_to(v, E.shape), E)
                order = np.lexsort((ids, -s))[:ef]
                open_, left, ask = np.ones(len(order), bool), width, set()
                for i, e in enumerate(order):
                    if left == 0:
                        break
                    ask.update(x for x in neighbours[e] if x not in known)
                    open_[i] = False
                    left -= 1 if ask else 0               # nothing new so far: go on in the same round
                out.append((ids[order], s[order], open_, [], sorted(ask)))
            yield _state_batch(rb.column(0), rb.column(1), out)

    return run


def _step(ef: int, width: int):
    """(query_id, qv, ids, scores, open, found, got) -> the ``ef`` best, of which the ``width`` best that are open are to be expanded."""

    def run(batches):
        for rb in _slices(batches):
            out = []
            for ids, scores, open_, found, got in zip(*(_each(rb.column(c)) for c in range(2, 7))):
                ids, scores = np.append(ids, found), np.append(scores, got)
                open_ = np.append(open_, np.ones(len(found), bool))
                order = np.lexsort((ids, -scores))[:ef]
                ids, scores, open_ = ids[order], scores[order], open_[order]
                at = np.flatnonzero(open_)[:width if len(found) else None]         # a beam that no longer changes: all at once
                open_[at] = False
                out.append((ids, scores, open_, ids[at], []))
            yield _state_batch(rb.column(0), rb.column(1), out)

    return run


_PRIME = (1 << 31) - 1


def _spread(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of each id; ``_part_of`` is the same as a Column."""
    return ids % _PRIME * 48271 % _PRIME * 48271 % _PRIME * parts // _PRIME


def _part_of(col: str, parts: int):
    return F.expr(f"cast(pmod({col}, {_PRIME}L) * 48271L % {_PRIME}L * 48271L % {_PRIME}L * {parts}L div {_PRIME}L as int)")


def _by_part(keys: list[int]):
    """(query_id, qv, asked ids, floor) -> (part's key, side 1, query_id, qv, the ids asked for there, floor)."""
    key = np.array(keys, np.int64)

    def run(batches):
        for rb in _slices(batches):
            row, part, ids = [], [], []
            for i, new in enumerate(_each(rb.column(2))):
                of = _spread(new, len(key))
                order = np.argsort(of, kind="stable")
                some, first = np.unique(of[order], return_index=True)
                if len(some):
                    row += [i] * len(some)
                    part += key[some].tolist()
                    ids += np.split(new[order], first[1:])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array(np.ones(len(row)), pa.int32()), rb.column(0).take(at), rb.column(1).take(at),
                 pa.array(ids, pa.list_(pa.int64())), rb.column(3).take(at)], names=["part", "side", "id", "v", "ids", "floor"])

    return run


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values))


def _score_asked(dim: int):
    """Rows (part, side, id, v, ids, floor) by part, side and id: a part's nodes (side 0) are held, what it is asked (side 1) streams.

    -> (query_id, ids, scores) of the asked nodes that reach the floor.
    """

    def answers(q, Q, asked, floor, own, X):
        ids, n = asked.flatten().to_numpy(zero_copy_only=False), np.diff(asked.offsets.to_numpy())
        row, lo = np.repeat(np.arange(len(q)), n), np.searchsorted(own, ids, "left")
        many = np.searchsorted(own, ids, "right") - lo
        if (many != 1).any():                             # no such node, or the id repeats
            row, ids, lo = np.repeat(row, many), np.repeat(ids, many), np.repeat(lo, many)
            lo = lo + np.arange(len(lo)) - np.repeat(np.cumsum(many) - many, many)
        cuts = range(0, len(ids), _PAIRS)
        score = np.concatenate([np.zeros(0), *[row_dots(Q[row[c:c + _PAIRS]], X[lo[c:c + _PAIRS]]) for c in cuts]])
        keep = ~(score < floor[row])
        count = np.bincount(row[keep], minlength=len(q))
        some = count > 0
        return pa.RecordBatch.from_arrays([pa.array(q[some]), _lists(ids[keep], count[some]), _lists(score[keep], count[some])],
                                          names=["query_id", "ids", "scores"])

    def run(batches):
        part, held, own, X = None, [], None, None
        for rb in _slices(batches):
            p, side, i, floor = (rb.column(c).to_numpy() for c in (0, 1, 2, 5))
            V = list_matrix(rb.column(3), dim)
            starts = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (side[1:] != side[:-1])))
            for a, b in zip(starts, np.append(starts[1:], rb.num_rows)):
                if part != p[a]:
                    part, held, own, X = p[a], [], None, None
                if side[a] == 0:
                    held.append((i[a:b], V[a:b]))
                elif held or own is not None:
                    if own is None:
                        own, X = (np.concatenate(c) for c in zip(*held))
                        held = []
                    yield answers(i[a:b], V[a:b], rb.column(4).slice(a, b - a), floor[a:b], own, X)

    return run


# ---------------------------------------------------------------------------
# on Spark
# ---------------------------------------------------------------------------

def _best(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def graph_build(index: DataFrame, *, degree: int = HNSW_M, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 42,
                id_col: str = "vector_id", vec_col: str = "embedding") -> Graph:
    """Build and store the graph over (id, vector); no node has more than ``degree`` neighbours.

    Similarity is the dot product (cosine on unit vectors).  Null vectors are
    left out; ids must be unique and vectors equally long.
    """
    spark = index.sparkSession
    ship_library(spark)
    rows = index.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vector_id"), F.col(vec_col).alias("embedding"))
    n, dim = frame_stats(rows, "embedding")
    width = 4 if rows.schema["embedding"].dataType.simpleString() == "array<float>" else 8
    buckets = bucket_count(spark, n * dim * width)
    nodes = write_bucketed(rows, "vector_id", buckets, "graph-vectors").read(spark)

    # members come by dst: with few partitions the copies of a vector that go to one lie side by side and compress
    n_groups = max(spark.sparkContext.defaultParallelism, -(-n * (2 * neighbours + 1) * (dim * width + 48) // GROUP_BYTES))

    place = dense_index(nodes.select("vector_id"), ["vector_id"])
    draw = place.select(F.col("vector_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(neighbours))).alias("j"))
    draw = draw.select("src", F.pmod(F.xxhash64("src", "j", F.lit(seed)), F.lit(max(n, 1))).alias("pos"))
    edges = (draw.join(place.withColumnRenamed("vector_id", "dst"), "pos").where("src != dst").select("src", "dst").distinct()
             .withColumn("score", F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 20)).cast("double")))        # a hash until scored
    edges = _scratch(edges, "graph-edges")

    def grouped(pairs: DataFrame, floors: DataFrame | None = None) -> DataFrame:
        """(src, dst, v, dst's floor) by src and dst, with src itself; the vectors come from the bucketed table."""
        own = nodes.select(F.col("vector_id").alias("src"), F.col("vector_id").alias("dst"))
        members = pairs.select("src", "dst").unionByName(own).repartition(buckets, "dst").distinct()
        held = nodes.select(F.col("vector_id").alias("dst"), F.col("embedding").alias("v"))
        held = held.withColumn("floor", F.lit(None).cast("double")) if floors is None else held.join(floors, "dst", "left")
        return (members.join(held, "dst").select("src", "dst", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
                .repartition(n_groups, "src").sortWithinPartitions("src", "dst"))

    def worst(e: DataFrame) -> DataFrame:
        """The score that a node's neighbours end with, once it has all it may keep."""
        return (e.groupBy(F.col("src").alias("dst")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= neighbours).drop("n"))

    def reverse(e: DataFrame) -> DataFrame:
        return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")

    ddl = "src long, dst long, score double"
    for r in range(rounds):
        floors = worst(edges) if r else None                                     # the first scores are hashes
        met = grouped(edges.unionByName(_best(reverse(edges), neighbours)), floors).mapInArrow(_introduce(dim, TAKE), ddl)
        met = met.repartition("src").groupBy("src", "dst").agg(F.max("score").alias("score"))        # one exchange, by src
        edges = _scratch(_best(met, neighbours), "graph-edges")

    keep = max(1, degree // 2)
    chosen = _scratch(grouped(edges.unionByName(_best(reverse(edges), neighbours))).mapInArrow(_diverse(dim, keep), ddl), "graph-chosen")
    back = reverse(chosen).join(chosen.select("src", "dst"), ["src", "dst"], "left_anti")
    lists = (chosen.unionByName(_best(back, degree - keep)).groupBy("src")
             .agg(F.array_sort(F.collect_list("dst")).alias("neighbours")).withColumnRenamed("src", "vector_id"))
    out = nodes.join(lists, "vector_id", "left").select(
        "vector_id", "embedding", F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"))
    return Graph(write_bucketed(out, "vector_id", buckets, "graph"), n, dim, degree)


def graph_edges(graph: DataFrame) -> DataFrame:
    """The edge table (src, dst)."""
    return graph.select(F.col("vector_id").alias("src"), F.explode("neighbours").alias("dst"))


def graph_search(graph: Graph, queries: DataFrame, k: int = 10, *, ef: int = HNSW_EF, width: int = WIDTH, entries: int = ENTRIES,
                 qid_col: str = "query_id", qvec_col: str = "embedding") -> DataFrame:
    """Best-first search -> (query_id, rank, vector_id, score); scores are exact, the neighbours approximate.

    ``ef`` nodes are kept per query (at least ``k``); null query vectors take no part.
    """
    spark = queries.sparkSession
    ship_library(spark)
    ef = max(ef, k)
    nodes = graph.read(spark)
    first = nodes.orderBy(F.xxhash64("vector_id", F.lit(1)), "vector_id").limit(entries).collect()
    E = np.array([r["embedding"] for r in first], np.float64).reshape(len(first), graph.dim)
    entry = spark.sparkContext.broadcast((np.array([r["vector_id"] for r in first], np.int64), E, [list(r["neighbours"]) for r in first]))
    asked = queries.where(F.col(qvec_col).isNotNull()).select(F.col(qid_col).cast("long").alias("query_id"), F.col(qvec_col).alias("v"))
    kinds = {nodes.schema["embedding"].dataType.simpleString(), asked.schema["v"].dataType.simpleString()}
    vec = kinds.pop() if len(kinds) == 1 else "array<double>"
    n_parts = max(spark.sparkContext.defaultParallelism, -(-graph.rows * graph.dim * 8 // PART_BYTES))
    keys = bucket_keys(spark, n_parts)                                            # one part to a partition
    held = nodes.select(F.get(F.array(*[F.lit(x) for x in keys]), _part_of("vector_id", n_parts)).alias("part"), F.lit(0).alias("side"),
                        F.col("vector_id").alias("id"), F.col("embedding").cast(vec).alias("v"),
                        F.lit(None).cast("array<long>").alias("ids"), F.lit(0.0).alias("floor"))
    asked = asked.withColumn("v", F.col("v").cast(vec))
    state = _scratch(asked.repartition("query_id").mapInArrow(_begin(entry, graph.dim, ef, width), _ddl(vec)), "graph-state")
    parts = []
    nothing = F.array().cast("array<long>")
    while True:
        more = (F.size("expand") > 0) | (F.size("ask") > 0)
        parts.append(state.where(~more).select("query_id", "ids", "scores"))
        on = state.where(more)
        if on.isEmpty():
            break
        lists = (on.select("query_id", F.explode("expand").alias("vector_id")).join(nodes, "vector_id").select("query_id", "neighbours")
                 .groupBy("query_id").agg(F.flatten(F.collect_list("neighbours")).alias("near")))          # of width nodes
        new = F.array_except(F.concat("ask", F.coalesce("near", nothing)), "ids")
        floor = F.when(F.size("ids") >= ef, F.get("scores", F.lit(ef - 1))).otherwise(F.lit(float("-inf")))
        asks = (on.select("query_id", "qv", "ids", "ask", floor.alias("floor")).join(lists, "query_id", "left")
                .select("query_id", "qv", new.alias("new"), "floor")
                .mapInArrow(_by_part(keys), f"part long, side int, id long, v {vec}, ids array<long>, floor double"))
        met = (held.unionByName(asks).repartition(n_parts, "part").sortWithinPartitions("part", "side", "id")
               .mapInArrow(tidy(_score_asked(graph.dim)), "query_id long, ids array<long>, scores array<double>"))
        # at most one row per part, of the answers that a beam may keep
        answers = met.groupBy("query_id").agg(F.flatten(F.collect_list("ids")).alias("found"), F.flatten(F.collect_list("scores")).alias("got"))
        state = _scratch(on.select("query_id", "qv", "ids", "scores", "open").join(answers, "query_id", "left")
                         .select("query_id", "qv", "ids", "scores", "open", F.coalesce("found", nothing).alias("found"),
                                 F.coalesce("got", F.array().cast("array<double>")).alias("got"))
                         .mapInArrow(_step(ef, width), _ddl(vec)), "graph-state")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    found = F.slice(F.arrays_zip("ids", "scores"), 1, k)
    return (out.select("query_id", F.posexplode(found).alias("p", "f"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.ids").alias("vector_id"), F.col("f.scores").alias("score")))
