"""Near-duplicate vectors: prune, shards, search and links against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import flat_graph as fg


def brute(rows, least=0.9):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {i: [] for i in range(len(rows))}
    for d in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in own], float)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                link[own[a]].append(own[b])
    out, part = [], {}
    for i in range(len(rows)):
        if i not in part:
            seen, todo = {i}, [i]
            while todo:
                for j in link[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least_id = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            part.update({j: least_id for j in seen})
        k = rows[i][0]
        out.append((k, len(link[i]), part[i], k is None or k == part[i]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 24))
    near = lambda v, n, e: v + e * np.linalg.norm(v) / np.sqrt(24) * rng.normal(size=(n, 24))
    x = np.concatenate([x, near(x[0], 250, 0.1), near(x[1], 40, 0.3), near(x[2], 3, 0.2) * 1e3, near(x[3], 1, 0.05), x[4:7], x[4:5], x[4:5]])
    for i in range(12):                                    # a chain: neighbours link, ends do not
        x = np.concatenate([x, (x[-1] if i else x[8])[None] + 0.35 * np.linalg.norm(x[8]) / np.sqrt(24) * rng.normal(size=(1, 24))])
    out = [(int(i), [float(y) for y in v]) for i, v in zip(rng.permutation(len(x)) * 3 - 50, x)]
    out += [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [None] + [1.0] * 23), (9004, [float("inf")] + [1.0] * 23),
            (9005, []), (None, out[0][1]), (9006, [1.0, 2.0]), (9007, [2.0, 4.1]), (9008, [1e200] * 24), (9009, [1e-200] * 24),
            (out[0][0], out[0][1]), (out[5][0], [-y for y in out[5][1]])]
    return out


def frame(spark, rows):
    return (spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
            .withColumn("Cell", F.lit(1)).withColumn("n_links", F.lit(2)))


def test_links_match_brute_force(spark, rows):
    got = fg.near_duplicate_vectors(spark, frame(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_many_small_shards(spark, rows, monkeypatch):
    for name, value in (("SHARD_ROWS", 120), ("AIM_ROWS", 60), ("SPLIT", 8), ("TASK_ROWS", 200), ("QUERIES", 16), ("PAIRS", 32)):
        monkeypatch.setattr(fg, name, value)
    got = sorted((tuple(r) for r in fg.near_duplicate_vectors(spark, frame(spark, rows)).collect()), key=str)
    want = brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.98 * there and all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(sorted(got, key=lambda r: str(r[0])), sorted(want, key=lambda r: str(r[0]))))
    assert sum(a[2:] == b[2:] for a, b in zip(got, want)) >= 0.98 * len(rows) or found == there


def test_empty_and_one(spark, rows):
    assert fg.near_duplicate_vectors(spark, frame(spark, rows).limit(0)).count() == 0
    one = fg.near_duplicate_vectors(spark, frame(spark, [(4, [1.0, 0.0]), (3, [1.0, 0.0]), (2, None)])).collect()
    assert sorted(map(tuple, one)) == [(2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]


def test_graph_is_bounded_and_connected(spark):
    x = np.random.default_rng(2).normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = fg.shard_graph(x)
    assert (lists[:, :fg.FULL_DEGREE + fg.FAR] >= 0).sum() <= 600 * (fg.FULL_DEGREE + fg.FAR)
    assert (lists[:, fg.FULL_DEGREE + fg.FAR:] >= 0).sum() <= fg.MUTUAL * 600 and (lists[:, 0] == np.argmax(x @ x.T - 2 * np.eye(600), axis=1)).all()
    shard = fg.Shard(np.arange(600), x, lists, np.ones(600, bool), np.zeros(600, int), np.ones(600, int))
    q = np.random.default_rng(3).normal(size=(100, 16))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    r, v = shard.search(q, np.zeros(0, int), np.zeros(0, int), 0.5, 32)              # foreign queries, from the medoid alone
    true = np.nonzero(q @ x.T >= 0.5)
    assert len(set(zip(r, v))) == len(r) and set(zip(r, v)) <= set(zip(*true)) and len(r) >= 0.9 * len(true[0])


def test_prune_rule():
    x = np.array([[1.0, 0], [0.995, 0.0999], [0.98, 0.199], [0, 1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = lambda a, b: np.sqrt(2 - 2 * x[a] @ x[b])
    kept = fg.robust_prune(x, np.array([[1, 2, 3]]), np.array([[d(0, 1), d(0, 2), d(0, 3)]]), 3, 1.0)
    assert kept.tolist() == [[1, -1, -1]]                                            # 1 is nearer to 2 and to 3 than 0 is
    kept = fg.robust_prune(x, np.array([[1, 2, 3]]), np.array([[d(0, 1), d(0, 2), d(0, 3)]]), 3, 3.0)
    assert kept.tolist() == [[1, 2, 3]]


def test_audit_sees_missing_links(spark, rows, monkeypatch):
    nodes = spark.createDataFrame([(i, 1, list(v)) for i, v in enumerate({tuple(v) for _, v in rows[:1000]})], "node long, weight long, v array<double>")
    none = spark.createDataFrame([], "node long, n long")
    assert fg.audit_recall(spark, nodes, none, 0.9, 10_000) == 0.0
    links, _ = fg.range_links(spark, nodes, fg.build_graph(spark, nodes), 0.9)
    assert fg.audit_recall(spark, nodes, links, 0.9, 10_000) > 0.999
    monkeypatch.setattr(fg, "audit_recall", lambda *a: 0.5)
    with pytest.raises(RuntimeError):
        fg.near_duplicate_vectors(spark, frame(spark, rows[:50]))
