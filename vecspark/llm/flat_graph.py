"""Near-duplicate vectors by range search in a robust-pruned flat graph.

Vectors are dealt to overlapping shards: cells split by k-means until they are
small, every vector in its two nearest.  In each shard a task builds pruned
adjacency lists; a vector's list in the flat graph is the union of its lists.
Every vector then searches its own shards, from the shard's medoid and from
itself, with a beam that expands whatever lies in range.  A found vector that
is in a further shard too carries the search there, along its other list,
until no search reaches a new shard.  Links are verified by cosine in double
precision as they are found; the recall is audited against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, local_forest
from .storage import write_table

#: rows of a shard at most; rows that a split aims at
SHARD_ROWS = 4096
AIM_ROWS = 2048
#: children of one split at most; sampled rows that its centroids are fitted on, per child
SPLIT = 128
SAMPLE_PER_CHILD = 64
#: after so many rounds of splits by k-means, cells that are still large are cut by hash
SPLIT_ROUNDS = 12
#: rows that one task assigns to children, and visits that it searches
TASK_ROWS = 16384
#: nearest candidates and degree of a list, its random far edges, degree with reverse edges, slack of the prune
CANDIDATES, DEGREE, FAR, FULL_DEGREE, ALPHA = 48, 24, 6, 40, 1.2
#: a node's nearest listed neighbours that always list it too, so that outliers of a dense group are reached from it
MUTUAL = 3
#: beam of the greedy search; queries searched side by side; (query, node) pairs expanded at once
BEAM = 16
QUERIES = 256
PAIRS = 1024
#: numbers held by one gather of vectors
GATHER = 1 << 21
#: rows that a search may bring along as entries into one further shard
ENTRIES = 4
#: audited vectors, on average; the recall to reach; beams tried for it
AUDIT_ROWS = 512
RECALL = 0.9
TRIES = 3


# ---- inside a task ----

def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors (double) of a list column whose rows are valid and equally long."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)          # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a bounded sample; empty clusters keep their old centroid."""
    c = x[np.random.default_rng(len(x)).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            own = x[at == j]
            if len(own):
                m = own.sum(axis=0)
                norm = np.sqrt(m @ m)
                if norm > 0:
                    c[j] = m / norm
    return c


def robust_prune(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Per node the ``degree`` candidates kept: the nearest one stays, and drops those that it is ``alpha`` times nearer to.

    ``cand`` (n, c): candidates by rising distance ``dist``, -1 after the last.
    """
    out = np.full((len(cand), degree), -1, np.int64)
    step = max(1, GATHER // max(1, cand.shape[1] * x.shape[1]))
    for lo in range(0, len(cand), step):
        ids, d = cand[lo:lo + step], dist[lo:lo + step]
        v = x[ids]
        between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (v @ v.transpose(0, 2, 1))))
        alive, rows = ids >= 0, np.arange(len(ids))
        for r in range(min(degree, ids.shape[1])):
            first = np.argmax(alive, axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            out[lo:lo + step, r] = np.where(some, ids[rows, first], -1)
            alive &= alpha * between[rows, first] > d
            alive[rows, first] = False
    return out


def _nearest(x: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    c = min(c, n - 1)
    cand, dist = np.empty((n, c), np.int64), np.empty((n, c))
    step = max(1, GATHER // n)
    for lo in range(0, n, step):
        s = x[lo:lo + step] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        top = np.argpartition(-s, c - 1, axis=1)[:, :c]
        val = np.take_along_axis(s, top, 1)
        order = np.argsort(-val, axis=1, kind="stable")
        cand[lo:lo + step] = np.take_along_axis(top, order, 1)
        dist[lo:lo + step] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.take_along_axis(val, order, 1)))
    return cand, dist


def shard_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency lists, -1 where there is none: pruned nearest candidates and reverse edges, random far edges, and
    the edges that make the nearest ``MUTUAL`` ones mutual."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1, np.int64)
    cand, dist = _nearest(x, CANDIDATES)
    near = robust_prune(x, cand, dist, DEGREE, ALPHA)
    far = np.random.default_rng(n).integers(0, n, (n, FAR))
    a = np.repeat(np.arange(n), DEGREE + FAR)
    b = np.concatenate([near, far], axis=1).ravel()
    ok = (b >= 0) & (a != b)
    pair = np.unique(np.concatenate([a[ok] * n + b[ok], b[ok] * n + a[ok]]))
    a, b = pair // n, pair % n
    s = np.concatenate([np.einsum("ij,ij->i", x[a[i:i + 65536]], x[b[i:i + 65536]]) for i in range(0, len(a), 65536)])
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.searchsorted(a, np.arange(n))
    at = np.arange(len(a)) - first[a]
    keep = at < 2 * FULL_DEGREE                            # nearest first; own far edges are added below
    cand = np.full((n, 2 * FULL_DEGREE), -1, np.int64)
    dist = np.full(cand.shape, np.inf)
    cand[a[keep], at[keep]] = b[keep]
    dist[a[keep], at[keep]] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * s[keep]))
    lists = robust_prune(x, cand, dist, FULL_DEGREE, ALPHA)
    b, a = np.repeat(np.arange(n), min(MUTUAL, FULL_DEGREE)), lists[:, :MUTUAL].ravel()
    b, a = b[a >= 0], a[a >= 0]
    new = ~(lists[a] == b[:, None]).any(axis=1)
    order = np.argsort(a[new], kind="stable")
    a, b = a[new][order], b[new][order]
    at = np.arange(len(a)) - np.searchsorted(a, a)
    back = np.full((n, int(at.max()) + 1 if len(at) else 0), -1, np.int64)
    back[a, at] = b
    return np.concatenate([lists, far, back], axis=1)


class Shard:
    """A shard's vectors (ids ascending), weights and adjacency lists, searched by many queries at once."""

    def __init__(self, ids, x, lists, home, other, weight):
        self.ids, self.home, self.other, self.weight = ids, home, other, weight
        n = len(ids)
        self.x = np.concatenate([x, np.zeros((1, x.shape[1]))])
        self.adj = np.where(lists < 0, n, lists)           # row n: nobody, always seen
        mean = x.sum(axis=0)
        self.medoid = int(np.argmax(x @ mean))

    def _dots(self, q, rows, nodes):
        out, step = np.empty(len(rows)), max(1, GATHER // self.x.shape[1])
        for i in range(0, len(rows), step):
            out[i:i + step] = np.einsum("ij,ij->i", q[rows[i:i + step]], self.x[nodes[i:i + step]])
        return out

    def search(self, q: np.ndarray, entry_rows: np.ndarray, entries: np.ndarray, least: float, beam: int):
        """(query row, node) of all nodes found with a dot product of ``least`` or more.

        Greedy steps from the medoid and the entries, best of the beam first,
        until all of the beam is expanded; then every found node that is in range
        is expanded too, until no new one is in range.
        """
        n, m = len(self.ids), len(q)
        seen, done = np.zeros((m, n + 1), bool), np.zeros((m, n + 1), bool)
        seen[:, n] = True
        rows = np.concatenate([np.arange(m), entry_rows])
        nodes = np.concatenate([np.full(m, self.medoid), entries])
        pair = np.unique(rows * (n + 1) + nodes)
        rows, nodes = pair // (n + 1), pair % (n + 1)
        seen[rows, nodes] = True
        s = self._dots(q, rows, nodes)
        hits = [(rows[s >= least], nodes[s >= least])]
        at = np.arange(len(rows)) - np.searchsorted(rows, rows)
        width = max(beam, int(at.max()) + 1)
        ids, sims, open_ = np.full((m, width), n), np.full((m, width), -np.inf), np.zeros((m, width), bool)
        ids[rows, at], sims[rows, at], open_[rows, at] = nodes, s, True
        live = np.arange(m)
        while len(live):
            best = np.argmax(np.where(open_[live], sims[live], -np.inf), axis=1)
            live, best = (z[open_[live, best]] for z in (live, best))
            if not len(live):
                break
            node = ids[live, best]
            open_[live, best] = False
            done[live, node] = True
            nb = self.adj[node]
            new = ~seen[live[:, None], nb]
            seen[live[:, None], nb] = True
            r, c = np.nonzero(new)
            val = np.full(nb.shape, -np.inf)
            val[r, c] = self._dots(q, live[r], nb[r, c])
            inr = val >= least
            if inr.any():
                r, c = np.nonzero(inr)
                hits.append((live[r], nb[r, c]))
            all_s = np.concatenate([sims[live], val], axis=1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(all_s, top, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], nb], axis=1), top, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], val > -np.inf], axis=1), top, 1)
        # expand what is in range
        hr, hv = (np.concatenate(z) for z in zip(*hits))
        pair = np.unique(hr * (n + 1) + hv)                # a list may name a far neighbour twice
        found, front = [pair], pair[~done[pair // (n + 1), pair % (n + 1)]]
        while len(front):
            take, front = front[:PAIRS], front[PAIRS:]
            r, v = take // (n + 1), take % (n + 1)
            nb = self.adj[v]
            new = ~seen[r[:, None], nb]
            i, c = np.nonzero(new)
            pair = np.unique(r[i] * (n + 1) + nb[i, c])
            r, v = pair // (n + 1), pair % (n + 1)
            seen[r, v] = True
            pair = pair[self._dots(q, r, v) >= least]
            found.append(pair)
            front = np.concatenate([front, pair])
        pair = np.concatenate(found)
        return pair // (n + 1), pair % (n + 1)

    def answers(self, qids, q, entry_rows, entries, least, beam):
        """Rows (kind, a, b, n, entries): 0 links of query a to members at home here; 1 an edge a - b of
        the forest of all links found; 2 query a goes on to shard b with entries."""
        r, v = self.search(q, entry_rows, entries, least, beam)
        other_one = self.ids[v] != qids[r]
        r, v = r[other_one], v[other_one]
        own = self.home[v]
        count = np.bincount(r[own], weights=self.weight[v[own]], minlength=len(qids)).astype(np.int64)
        rows = [(0, int(qids[i]), None, int(count[i]), None) for i in np.flatnonzero(count)]
        if len(r):
            a, b = local_forest(qids[r], self.ids[v])
            rows += [(1, int(x), int(y), None, None) for x, y in zip(a, b)]
        on = self.other[v] != 0
        r, v = r[on], v[on]
        order = np.lexsort((self.other[v], r))
        r, v = r[order], v[order]
        cut = np.flatnonzero(np.append(True, (np.diff(r) != 0) | (np.diff(self.other[v]) != 0))) if len(r) else []
        for a, b in zip(cut, np.append(cut[1:], len(r)) if len(r) else []):
            rows.append((2, int(qids[r[a]]), int(self.other[v[a]]), None, self.ids[v[a:min(b, a + ENTRIES)]].tolist()))
        return rows


# ---- tasks ----

def _groups(batches, keys: int):
    """(key, [record batches]) of runs of rows that agree in their first ``keys`` columns; a run is held."""
    key, held = None, []
    for rb in batches:
        if not rb.num_rows:
            continue
        k = np.stack([rb.column(i).to_numpy() for i in range(keys)], axis=1)
        cut = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(axis=1)))
        for a, b in zip(cut, np.append(cut[1:], len(k))):
            if held and key != tuple(k[a]):
                yield key, held
                held = []
            key = tuple(k[a])
            held.append(rb.slice(a, b - a))
    if held:
        yield key, held


def _fit(batches):
    """From (cell, k, v): the centroids of each cell's sample as (cell, child, v)."""
    for (cell, k), held in _groups(batches, 2):
        x = np.concatenate([matrix(rb.column(2)) for rb in held])
        c = kmeans(x, int(k))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), cell)), pa.array(np.arange(len(c))),
                                          pa.array(list(c), pa.list_(pa.float64()))], names=["cell", "child", "v"])


def _assign(copies: int):
    """From (cell, salt, side, id, home, v), centroids (side 0) first: (node, cell, child, home), ``copies`` rows each."""
    def run(batches):
        place, parts, c = None, [], None
        for (cell, salt, side), held in _runs(batches, 3):
            if place != (cell, salt):
                place, parts, c = (cell, salt), [], None
            if side == 0:
                parts.append((held.column(3).to_numpy(), matrix(held.column(5))))
                continue
            if c is None:
                child, c = (np.concatenate(z) for z in zip(*parts))
            s = matrix(held.column(5)) @ c.T
            n = min(copies, s.shape[1])
            best = np.argsort(-s, axis=1, kind="stable")[:, :n]
            home = held.column(4).to_numpy(zero_copy_only=False)[:, None] & (np.arange(n) == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(held.column(3).to_numpy(), n)), pa.array(np.full(best.size, cell)),
                 pa.array(child[best.ravel()]), pa.array((home if copies > 1 else held.column(4).to_numpy(zero_copy_only=False)[:, None]).ravel()),
                 held.column(5).take(pa.array(np.repeat(np.arange(held.num_rows), n)))],
                names=["node", "cell", "child", "home", "v"])
    return run


def _runs(batches, keys: int):
    """(key, record batch) of runs inside batches; nothing is held."""
    for rb in batches:
        if rb.num_rows:
            k = np.stack([rb.column(i).to_numpy() for i in range(keys)], axis=1)
            cut = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(axis=1)))
            for a, b in zip(cut, np.append(cut[1:], len(k))):
                yield tuple(k[a]), rb.slice(a, b - a)


def _build(batches):
    """From (cell, node, home, other, weight, v) by cell and node: the rows with their lists (node ids)."""
    for _, held in _groups(batches, 1):
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows.column("node").to_numpy()
        lists = shard_graph(matrix(rows.column("v").combine_chunks()))
        size = (lists >= 0).sum(axis=1)                    # boolean indexing below goes row by row
        offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(ids[lists[lists >= 0]]))
        yield from rows.append_column("list", lists).to_batches()


def _shard(rows: pa.Table) -> Shard:
    ids = rows.column("node").to_numpy()
    lists = rows.column("list").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    adj = np.full((len(ids), max(1, int(size.max()))), -1, np.int64)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    adj[np.repeat(np.arange(len(ids)), size), at] = np.searchsorted(ids, lists.flatten().to_numpy())
    return Shard(ids, matrix(rows.column("v").combine_chunks()), adj, rows.column("home").to_numpy(),
                 rows.column("other").to_numpy(), rows.column("weight").to_numpy())


_ANSWER_DDL = "kind int, a long, b long, n long, entries array<long>"
_ANSWER = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("entries", pa.list_(pa.int64()))])


def _answer_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ANSWER)], schema=_ANSWER)


def _search_members(least: float, beam: int):
    """From the graph's rows by (cell, salt) and node: every member of the salt searches its shard."""
    def run(batches):
        for (_, salt), held in _groups(batches, 2):
            rows = pa.Table.from_batches(held).combine_chunks()
            shard = _shard(rows)
            mine = np.flatnonzero(rows.column("asks").to_numpy())
            for lo in range(0, len(mine), QUERIES):
                at = mine[lo:lo + QUERIES]
                out = shard.answers(shard.ids[at], shard.x[at], np.arange(len(at)), at, least, beam)
                if out:
                    yield _answer_batch(out)
    return run


def _search_visits(least: float, beam: int):
    """From (cell, salt, side, ...), the shard's rows (side 0) first, then visits (side 1) in batches."""
    def run(batches):
        place, held, shard = None, [], None
        for (cell, salt, side), rb in _runs(batches, 3):
            if place != (cell, salt):
                place, held, shard = (cell, salt), [], None
            if side == 0:
                held.append(rb)
                continue
            if shard is None:
                shard = _shard(pa.Table.from_batches(held).combine_chunks())
            for lo in range(0, rb.num_rows, QUERIES):
                part = rb.slice(lo, QUERIES)
                entries = part.column(part.schema.get_field_index("list"))
                size = np.diff(entries.offsets.to_numpy())
                nodes = np.searchsorted(shard.ids, entries.flatten().to_numpy())
                out = shard.answers(part.column(part.schema.get_field_index("node")).to_numpy(),
                                    matrix(part.column(part.schema.get_field_index("v"))),
                                    np.repeat(np.arange(part.num_rows), size), nodes, least, beam)
                if out:
                    yield _answer_batch(out)
    return run


# ---- on Spark ----

def usable(v):
    """Whether a vector has a direction: not null or empty, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _keyed(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
    ok = usable(F.col("v")) & F.col("vec_id").isNotNull()
    return rows.select("vec_id", *[F.when(ok, F.xxhash64(F.lit(s), "v")).alias(f"h{s}") for s in (1, 2)], "v")


def _shards(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(cell, node, home, other, weight, v): the nodes in overlapping shards; home: the nearer one, other: 0 if there is none."""
    vtype = nodes.schema["v"].dataType.simpleString()
    cells = nodes.select("node", F.size("v").cast("long").alias("cell"), F.lit(True).alias("home"), "v")
    settled, rounds = None, 0
    while True:
        sizes = write_table(spark, cells.groupBy("cell").agg(F.count("*").alias("n")), "graph-sizes")
        big = sizes.where(F.col("n") > SHARD_ROWS)
        fits = cells.join(sizes.where(F.col("n") <= SHARD_ROWS).select("cell"), "cell", "left_semi").select("node", "cell", "home", "v")
        settled = fits if settled is None else settled.unionByName(fits)
        if big.isEmpty():
            break
        rows = cells.join(big.withColumn("k", F.least(F.lit(SPLIT), F.ceil(F.col("n") * (2 if rounds == 0 else 1) / AIM_ROWS) + 1).cast("long")), "cell")
        if rounds >= SPLIT_ROUNDS:
            part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / AIM_ROWS))
            cells = rows.select("node", F.xxhash64("cell", part).alias("cell"), "home", "v")
        else:
            take = (F.pmod(F.xxhash64("node", F.lit(rounds)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("k") * SAMPLE_PER_CHILD / F.col("n")
            sample = rows.where(take).select("cell", "k", "v")
            means = sample.repartition("cell").sortWithinPartitions("cell", "k").mapInArrow(_fit, "cell long, child long, v array<double>")
            means = write_table(spark, means, "graph-means")
            salts = F.ceil(F.col("n") / TASK_ROWS).cast("long")
            cols = ["cell", "salt", "side", "id", "home", "v"]
            mine = rows.select("cell", F.pmod(F.xxhash64("node"), salts).alias("salt"), F.lit(1).alias("side"), F.col("node").alias("id"),
                               "home", F.col("v").cast("array<double>").alias("v"))
            theirs = (means.join(big, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
                      .select("cell", "salt", F.lit(0).alias("side"), F.col("child").alias("id"), F.lit(True).alias("home"), "v"))
            dealt = (theirs.unionByName(mine).select(cols).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "side")
                     .mapInArrow(_assign(2 if rounds == 0 else 1), "node long, cell long, child long, home boolean, v array<double>"))
            cells = dealt.select("node", F.xxhash64("cell", "child").alias("cell"), "home", F.col("v").cast(vtype).alias("v"))
        cells = write_table(spark, cells, "graph-cells")
        rounds += 1
    settled = write_table(spark, settled, "graph-shards")
    both = settled.groupBy("node").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    other = F.when(F.col("lo") == F.col("hi"), F.lit(0)).when(F.col("cell") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    return (settled.join(both, "node").join(nodes.select("node", "weight"), "node")
            .select("cell", "node", "home", other.cast("long").alias("other"), "weight", "v"))


def build_graph(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """The flat graph, written: (cell, node, home, other, weight, v, list), a row per node and shard with its list there."""
    shards = _shards(spark, nodes)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shards.schema) + ", list array<long>"
    rows = shards.repartition("cell").sortWithinPartitions("cell", "node")
    return write_table(spark, rows.mapInArrow(_build, fields), "flat-graph")


def adjacency(graph: DataFrame) -> DataFrame:
    """(node, neighbours): the union of each node's lists, two shards' at most."""
    return graph.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("list")))).alias("neighbours"))


def range_links(spark: SparkSession, nodes: DataFrame, graph: DataFrame, least: float, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """(node, n): links found by each node, by the others' weights; and edges (a, b) that join all linked nodes."""
    found, visited = [], graph.select(F.col("node").alias("a"), F.col("cell").alias("b"))
    # a member searches in one of four parts of its shard's members
    asks = F.pmod(F.xxhash64("node"), F.lit(4)) == F.col("salt")
    first = (graph.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("asks", asks)
             .select("cell", "salt", "node", "home", "other", "weight", "v", "list", "asks")
             .repartition("cell", "salt").sortWithinPartitions("cell", "salt", "node"))
    answers = write_table(spark, first.mapInArrow(_search_members(least, beam), _ANSWER_DDL), "graph-answers")
    while True:
        found.append(answers.where("kind < 2"))
        visits = (answers.where("kind = 2").join(visited, ["a", "b"], "left_anti").groupBy("a", "b")
                  .agg(F.flatten(F.collect_list("entries")).alias("list")))
        visits = write_table(spark, visits, "graph-visits")
        if visits.isEmpty():
            break
        visited = visited.unionByName(visits.select("a", "b"))
        salts = visits.groupBy(F.col("b").alias("cell")).agg(F.ceil(F.count("*") / TASK_ROWS).cast("long").alias("salts"))
        cols = ["cell", "salt", "side", "node", "home", "other", "weight", "v", "list"]
        theirs = (graph.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
                  .withColumn("side", F.lit(0)).select(cols))
        mine = (visits.join(nodes.select(F.col("node").alias("a"), "v"), "a").withColumn("cell", F.col("b")).join(salts, "cell")
                .select("cell", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.lit(1).alias("side"), F.col("a").alias("node"),
                        F.lit(False).alias("home"), F.lit(0).cast("long").alias("other"), F.lit(0).cast("long").alias("weight"), "v", "list"))
        both = theirs.unionByName(mine).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "side", "node")
        answers = write_table(spark, both.mapInArrow(_search_visits(least, beam), _ANSWER_DDL), "graph-answers")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return (out.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")),
            out.where("kind = 1").select("a", "b"))


def audit_recall(spark: SparkSession, nodes: DataFrame, links: DataFrame, least: float, rows: int = AUDIT_ROWS) -> float:
    """Share of the links of about ``rows`` vectors, chosen by hash, that were found; brute force against all. 1.0 if they have none."""
    n = nodes.count()
    part = (F.pmod(F.xxhash64("node", F.lit(77)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.lit(rows / max(1, n))
    asked = nodes.where(part).select("node", "v")
    held = {}
    for r in asked.join(links, "node", "left").select("node", "v", F.coalesce("n", F.lit(0)).alias("n")).collect():
        held.setdefault(len(r["v"]), []).append(r)
    if not held:
        return 1.0
    asked = spark.sparkContext.broadcast({d: (np.array([r["node"] for r in rs]), matrix(pa.array([r["v"] for r in rs], pa.list_(pa.float64()))))
                                          for d, rs in held.items()})

    def scan(batches):
        for rb in batches:
            size = np.diff(rb.column(2).offsets.to_numpy())
            for d, (ids, q) in asked.value.items():
                some = rb.filter(pa.array(size == d))
                for lo in range(0, some.num_rows, 1024):
                    b = some.slice(lo, 1024)
                    hit = (matrix(b.column(2)) @ q.T >= least) & (b.column(0).to_numpy()[:, None] != ids)
                    n = (hit * b.column(1).to_numpy()[:, None]).sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["node", "n"])

    true = nodes.select("node", "weight", "v").mapInArrow(scan, "node long, n long").agg(F.sum("n")).first()[0]
    return sum(r["n"] for rs in held.values() for r in rs) / true if true else 1.0


def near_duplicate_vectors(spark: SparkSession, vectors: DataFrame, *, least: float = 0.9, vec_id: str = "vec_id",
                           vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row: links with cosine >= ``least`` found in the flat graph.

    n_links: other rows linked directly; component_id: the smallest vec_id
    reachable by links; kept: whether it is the row's own.  Vectors that are
    null, empty, all zero or hold a null or non-finite component link with
    nothing, nor do vectors of different lengths with each other.  A row without
    id links with nothing either, has no component_id and is kept.  Equal vectors
    are one node that counts as often as it occurs.  No other column is read.

    If the audited recall is below ``RECALL`` the search is run again with twice
    the beam, and fails after ``TRIES`` runs.
    """
    keyed = _keyed(vectors, vec_id, vector)
    classes = (keyed.where("h1 is not null").groupBy("h1", "h2")
               .agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("weight"))
               .withColumn("node", F.monotonically_increasing_id()))
    classes = write_table(spark, classes, "graph-nodes")
    nodes = classes.select("node", "weight", "v")
    graph = build_graph(spark, nodes)
    for attempt in range(TRIES):
        links, edges = range_links(spark, nodes, graph, least, BEAM << attempt)
        links = write_table(spark, links, "graph-links")
        recall = audit_recall(spark, nodes, links, least)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"the graph search found only {recall:.3f} of the audited links")
    parts = connected_components(spark, edges)
    named = parts.join(classes.select("node", "least"), "node")
    names = named.groupBy("label").agg(F.min("least").alias("component"))
    parts = named.join(names, "label").select("node", "component")
    of = (classes.drop("v").join(links, "node", "left").join(parts, "node", "left")
          .select("h1", "h2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component")))
    out = keyed.select("vec_id", "h1", "h2").join(of, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
