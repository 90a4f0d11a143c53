"""Stored indexes: bucketed exact search, pruned inverted lists, calibration, the neighbour graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vecspark.operators import graph as G
from vecspark.operators.ivf_store import calibrate, ivf_store, ivf_stored_search, mean_recall, open_lists, search_to_recall
from vecspark.operators.knn import knn_exact
from vecspark.operators.stored import knn_stored, open_index, store_index
from vecspark.plans.views import Views
from vecspark.sinks.bucketed import bucket_keys


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vector_id"], round(r["score"], 9)) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(text, scan, stop):
    """The plan's nodes from the scan whose line holds ``scan`` up to ``stop``."""
    lines = text.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    at = next(i for i, line in enumerate(lines) if scan in line)
    out = [lines[at]]
    for line in reversed(lines[:at]):
        if line.strip(" :") and depth(line) < depth(out[-1]):
            out.append(line)
            if stop in line:
                return out
    raise AssertionError(f"no {stop} above {scan}")


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF_SMALL)


@pytest.fixture(scope="module")
def clustered(spark):
    """(index, queries): 12 clusters of unit vectors, one of them a third of all rows, with repeated vectors."""
    rng = np.random.default_rng(5)
    c = rng.normal(size=(12, 16))
    at = np.concatenate([np.zeros(200, int), rng.integers(0, 12, 400)])
    x = c[at] + 0.25 * rng.normal(size=(600, 16))
    x[590:] = x[0]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q = c[rng.integers(0, 12, 40)] + 0.25 * rng.normal(size=(40, 16))
    q = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
    index = spark.createDataFrame([(i * 7, r.tolist()) for i, r in enumerate(x)], "vector_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, embedding array<float>")
    return index.cache(), queries.cache()


# ---- bucketed exact search ----

def test_bucket_keys_fill_every_bucket(spark):
    keys = bucket_keys(spark, 13)
    at = spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(13))).collect()
    assert sorted(r[0] for r in at) == list(range(13))


def test_knn_stored_equals_exact_and_does_not_move_the_index(spark, v, clustered):
    for index, queries in ((v.index, v.queries), clustered):
        stored = store_index(index)
        res = knn_stored(stored, queries, 10)
        assert rows(res) == rows(knn_exact(index, queries, 10))
        text = plan(res)
        index_side = above(text, stored.table.name, "FlatMapCoGroupsInArrow")
        assert "Bucketed: true" in index_side[0] and not any("Exchange" in line for line in index_side)


def test_knn_stored_blocks_nulls_cosine_and_reopening(spark, v):
    stored = store_index(v.index.unionByName(spark.createDataFrame([(10**6, None)], "vector_id long, embedding array<float>")))
    want = rows(knn_exact(v.index, v.queries, 3))
    asked = v.queries.unionByName(spark.createDataFrame([(10**6, None)], "query_id long, embedding array<float>"))
    assert rows(knn_stored(stored, asked, 3, query_bytes=64 * 8 * 9)) == want
    again = open_index(spark, stored.table.path, stored.table.buckets)
    assert (again.rows, again.dim) == (stored.rows, stored.dim) and rows(knn_stored(again, v.queries, 3)) == want
    scaled = v.index.withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    assert [r[:3] for r in rows(knn_stored(store_index(scaled), v.queries, 3, cosine=True))] == [r[:3] for r in want]
    assert rows(knn_stored(store_index(v.index, buckets=3), v.queries, 3)) == want           # fewer buckets than partitions
    assert knn_stored(stored, v.queries.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="null"):
        store_index(v.index.unionByName(v.index.limit(1).withColumn("vector_id", F.lit(None).cast("long"))))


# ---- inverted lists ----

def test_lists_prune_at_run_time_and_are_exact_with_all(spark, clustered):
    index, queries = clustered
    stored = ivf_store(index, 12)
    res = ivf_stored_search(stored, queries.limit(1), 5, 2)
    assert "dynamicpruningexpression" in plan(res)
    res.collect()
    scans = [line for line in plan(res).split("\n") if "/rows]" in line]
    assert scans and res.count() == 5
    assert rows(ivf_stored_search(stored, queries, 5, stored.nlist)) == rows(knn_exact(index, queries, 5))
    opened = open_lists(spark, stored.root)
    assert opened == stored and opened.centroids(spark).agg(F.sum("n_rows")).first()[0] == 600
    assert mean_recall(ivf_stored_search(opened, queries, 5, 3), knn_exact(index, queries, 5), 5).first()[0] >= 0.9


def test_hot_list_is_split(spark, clustered):
    index, queries = clustered
    one = spark.createDataFrame([(4, [1.0] * 16)], "list_id int, centroid array<double>")
    stored = ivf_store(index, centroids=one)                              # one list with all rows
    small = ivf_stored_search(stored, queries, 5, 1, group_bytes=16 * 8 * 50, max_chunk_bytes=16 * 8 * 7)
    assert rows(small) == rows(knn_exact(index, queries, 5))


def test_calibration_on_clustered_and_structureless_vectors(spark, clustered, v):
    index, queries = clustered
    stored, exact = ivf_store(index, 12), knn_exact(index, queries, 10)
    c = calibrate(stored, queries, 10, 0.9)
    assert c.sampled == 40 and 0 < c.nprobe <= 4 and c.strategy == f"ivf:nprobe={c.nprobe}"
    assert [x[0] for x in c.levels] == [1, 2, 4, 8] and all(a[1] <= b[1] + 1e-12 for a, b in zip(c.levels, c.levels[1:]))
    found = search_to_recall(stored, queries, 10, 0.9, calibration=c)
    assert mean_recall(found, exact, 10).first()[0] >= 0.9
    assert {r[0] for r in found.select("strategy").distinct().collect()} == {c.strategy}
    assert calibrate(stored, queries, 10, 0.9, sample=10).sampled == 10
    low = dict((x[0], x[2]) for x in calibrate(stored, queries, 10, 0.9, sample=10).levels)
    assert all(low[n] < m for n, m, _ in c.levels if m == 1.0)             # a sample never claims certainty
    # vectors without clusters: few lists do not reach it
    hard = ivf_store(v.index, 20)
    few = calibrate(hard, v.queries, 10, 0.95, levels=[1, 2, 4])
    assert few.nprobe == 0 and few.strategy == "exact"
    assert rows(search_to_recall(hard, v.queries, 10, 0.95, calibration=few).drop("strategy")) == rows(knn_exact(v.index, v.queries, 10))


# ---- neighbour graph ----

@pytest.fixture(scope="module")
def built(clustered):
    return G.graph_build(clustered[0], degree=12, neighbours=12, rounds=3)


def test_graph_is_bounded_and_searches_well(spark, clustered, built):
    index, queries = clustered
    nodes = built.read(spark)
    assert nodes.count() == 600 and nodes.where(F.size("neighbours") > 12).count() == 0
    assert nodes.where(F.size("neighbours") == 0).count() == 0
    res, exact = G.graph_search(built, queries, 10, ef=60, entries=40), knn_exact(index, queries, 10)
    assert mean_recall(res, exact, 10).first()[0] >= 0.9
    true = {(r[0], r[2]): r[3] for r in rows(knn_exact(index, queries, 600))}
    got = rows(res)
    assert len(got) == 400 and all(true[(q, i)] == pytest.approx(s, abs=1e-9) for q, _, i, s in got)
    wide = G.graph_search(built, queries, 10, ef=600, entries=600)
    assert [r[:3] for r in rows(wide)] == [r[:3] for r in rows(exact)]    # a beam of all nodes is exact


def test_graph_does_not_depend_on_partitions(spark, clustered, built):
    index, queries = clustered
    other = G.graph_build(index.repartition(7), degree=12, neighbours=12, rounds=3)
    lists = lambda g: sorted((r["vector_id"], tuple(r["neighbours"])) for r in g.read(spark).collect())
    assert lists(other) == lists(built)
    one = rows(G.graph_search(built, queries.repartition(1), 5, ef=30, entries=20))
    assert one == rows(G.graph_search(other, queries.repartition(5), 5, ef=30, entries=20))


def test_search_rounds_move_no_nodes(spark, clustered, built):
    nodes = built.read(spark)
    asks = spark.range(0, 4200, 7).select(F.col("id").alias("vector_id"))
    text = plan(asks.hint("merge").join(nodes, "vector_id"))
    side = above(text, built.table.name, "SortMergeJoin")
    assert "Bucketed: true" in side[0] and not any("Exchange" in line for line in side)


def test_search_asks_by_part_and_gets_back_what_a_beam_may_keep(spark):
    import pyarrow as pa
    # one query, 300 asked ids: its vector goes once to each of 4 parts, every id to the part of its node
    ids = np.arange(-150, 150) * 64
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([[1.0, 0.0]]), pa.array([ids]), pa.array([0.25])], names=["q", "v", "new", "floor"])
    asks = [r for b in G._by_part([10, 20, 30, 40])([batch]) for r in b.to_pylist()]
    assert [r["part"] for r in asks] == [10, 20, 30, 40] and {(r["id"], *r["v"], r["floor"]) for r in asks} == {(7, 1.0, 0.0, 0.25)}
    assert sorted(i for r in asks for i in r["ids"]) == ids.tolist()
    where = spark.createDataFrame([(int(i),) for i in ids], "id long").select("id", G._part_of("id", 4).alias("p")).collect()
    assert {r["id"]: (r["p"] + 1) * 10 for r in where} == {i: r["part"] for r in asks for i in r["ids"]}
    # the part's nodes, then its asks: an unknown id, one that repeats, ties with the floor and a score that is not a number
    part = [(10, 0, 1, [0.5, 0.0], None, 0.0), (10, 0, 2, [0.2, 0.0], None, 0.0), (10, 0, 3, [0.25, 0.0], None, 0.0), (10, 0, 3, [0.7, 0.0], None, 0.0),
            (10, 0, 4, [float("nan"), 0.0], None, 0.0), (10, 1, 7, [1.0, 0.0], [1, 2, 3, 4, 9], 0.25), (10, 1, 8, [1.0, 0.0], [2], 0.25),
            (20, 0, 5, [0.1, 0.0], None, 0.0), (20, 1, 8, [1.0, 0.0], [5], float("-inf"))]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.float64()]
    cols = [pa.array(c, t) for c, t in zip(zip(*part), types)]
    whole = pa.RecordBatch.from_arrays(cols, names=["part", "side", "id", "v", "ids", "floor"])
    for cut in (len(part), 1, 2):
        got = [r for b in G._score_asked(2)([whole.slice(a, cut) for a in range(0, len(part), cut)]) for r in b.to_pylist()]
        assert [(r["query_id"], r["ids"]) for r in got] == [(7, [1, 3, 3, 4]), (8, [5])]
        assert got[0]["scores"][:3] == pytest.approx([0.5, 0.25, 0.7])


def test_building_sends_no_pair_below_the_floor():
    import pyarrow as pa
    X, floor = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]], [0.5, 0.95, float("-inf")]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1]), pa.array([1, 2, 3]), pa.array(X), pa.array(floor)], names=["src", "dst", "v", "floor"])
    sent = {(r["src"], r["dst"]) for b in G._introduce(2, 8)([batch]) for r in b.to_pylist() if r["src"] != r["dst"]}
    assert sent == {(1, 2), (3, 1), (3, 2)}


def test_search_moves_a_query_once_per_part(spark, clustered, built, monkeypatch):
    """What a round's exchange holds: a row per node, and per query not more rows than parts."""
    index, queries = clustered
    counted = spark.sparkContext.accumulator(0)
    score = G._score_asked

    def counting(dim):
        run = score(dim)

        def over(batches):
            def seen():
                for rb in batches:
                    counted.add(rb.num_rows)
                    yield rb
            return run(seen())
        return over

    monkeypatch.setattr(G, "_score_asked", counting)
    rounds = []
    scratch = G._scratch
    monkeypatch.setattr(G, "_scratch", lambda df, name: (rounds.append(name), scratch(df, name))[1])
    assert len(rows(G.graph_search(built, queries, 10, ef=60, entries=40))) == 400
    assert 0 < counted.value <= (len(rounds) - 1) * (600 + 40 * spark.sparkContext.defaultParallelism)


def test_graph_of_few_nodes(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vector_id long, embedding array<double>")
    queries = spark.createDataFrame([(5, [1.0, 0.1]), (6, None)], "query_id long, embedding array<double>")
    g = G.graph_build(index, degree=4, neighbours=3, rounds=1)
    assert [r[:3] for r in rows(G.graph_search(g, queries, 10))] == [(5, 1, 1), (5, 2, 2)]


def test_row_dots_are_the_same_in_any_batch():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 33)), rng.normal(size=(50, 33))
    whole = G.row_dots(a, b)
    assert all(G.row_dots(a[i:i + 1], b[i:i + 1])[0] == whole[i] for i in range(50))
