"""Prefix trie: queue, paths and totals against a plain version over Python sequences."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vecspark.llm import prefix_trie as pt


def plain_trie(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            k = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
            convs.setdefault(c, []).append((t is not None, t or 0, k, (r, x)))
    convs = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = convs.get(source, [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        up = nodes[key[:-1]] if key else None
        ends = sorted(c for c in members if len(built[c]) == len(key))
        out.append((min(members), len(key), min(up) if up else None, len(members),
                    sum(len(k) == len(key) + 1 for k in below),
                    sum(not any(len(m) == len(k) + 1 and m[:len(k)] == k for m in below) for k in below),
                    sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    say = ["hi", "no", "grüß dich", "", None, "ok then", "a\nb"]
    out = []
    for c in [*range(0, 60), -3, -5, -7, 1003, 1 << 41]:
        for t in range(rng.randrange(1, 14)):
            out.append((c, t, rng.choice(["user", "assistant", None]) if t > 3 else "user", rng.choice(say[:2] if t < 4 else say)))
    out += [(5, None, "system", "null turn"), (6, 2, "user", "same turn"), (6, 2, "user", "same turn"), (6, 2, "tool", "x"),
            (None, 0, "user", "no id"), (7000, None, None, None)]
    out += [(c, t, "user", "copied %d" % t) for c in range(2000, 2040) for t in range(12)]          # a hot conversation
    rng.shuffle(out)
    return out


def digest(spark, rows, n=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = (df.repartition(n) if n else df).withColumn("depth", F.lit("clash")).withColumn("KEY", F.lit(1)).withColumn("digest", F.lit(2))
    return sorted((str(tuple(r)) for r in pt.conversation_trie(spark, df).drop("key", "parent").collect()))


def test_trie_matches_plain_version(spark, rows):
    want = [str(x) for x in plain_trie(rows)]
    assert digest(spark, rows) == sorted(want)
    assert digest(spark, rows, 5) == sorted(want)


def test_shared_paths_longer_than_the_range_key(spark, rows, monkeypatch):
    some = [r for r in rows if r[0] is not None and (r[0] >= 2000 or r[0] < 20)]
    monkeypatch.setattr(pt, "PATH_TURNS", 1)                  # deals conversations by their ids: many nodes across shards
    df = spark.createDataFrame(some, "conv_id long, turn long, role string, text string")
    got = sorted(str(tuple(r)) for r in pt.conversation_trie(spark, df).drop("key", "parent").collect())
    assert got == sorted(str(x) for x in plain_trie(some))


def test_empty_and_turnless(spark, rows):
    assert digest(spark, [r for r in rows if r[0] is None]) == []
    one = [(7, t, "user", "x%d" % t) for t in range(zlib.crc32(b"7") % 9)]         # all its turns go, conversation 5 is absent
    assert one and digest(spark, one) == [str((7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest()))]
    as_is = pt.conversation_trie(spark, spark.createDataFrame(one, "conv_id long, turn long, role string, text string"), rebuilt=False)
    assert as_is.count() == len(one) + 1


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_queue_spills_in_order(limit, monkeypatch):
    monkeypatch.setattr(pt, "RUN_CHUNK", 3)
    rng, queue, held, out, want = random.Random(limit), pt.SpillingQueue(limit), [], [], []
    for i in range(600):
        if rng.random() < 0.6 or not held:
            m = (rng.randrange(50), bytes([rng.randrange(3)]), i)
            queue.push(m)
            held.append(m)
        else:
            assert queue.peek() == min(held)
            out.append(queue.pop())
            want.append(min(held))
            held.remove(want[-1])
    while queue.peek() is not None:
        out.append(queue.pop())
    assert out == want + sorted(held)


def test_totals_with_a_small_queue(spark, rows, monkeypatch):
    import pyarrow as pa
    rng = random.Random(3)
    nodes, names = {(): None}, {(): pt.ROOT}
    for _ in range(400):
        p = rng.choice(list(nodes))
        k = (*p, rng.randrange(4))
        nodes[k], names[k] = p, hashlib.md5(str(k).encode()).digest()
    there = sorted(nodes, key=lambda k: (-len(k), names[k]))
    own = {k: rng.randrange(9) for k in nodes}
    rb = pa.RecordBatch.from_pydict({
        "shard": [0] * len(there), "depth": [len(k) for k in there], "key": [names[k] for k in there],
        "parent": [names[nodes[k]] if k else None for k in there], "own": [own[k] for k in there],
        "n_children": [0] * len(there), "n_leaves": [0] * len(there), "saved": [0] * len(there)})
    monkeypatch.setattr(pt, "QUEUE_LIMIT", 5)
    got = {r["key"]: r for b in pt._time_forward([rb.slice(0, 100), rb.slice(100)]) for r in b.to_pylist()}
    for k in nodes:
        below = [m for m in nodes if m[:len(k)] == k]
        r = got[names[k]]
        assert not r["up"] and r["saved"] == sum(own[m] for m in below)
        assert r["n_children"] == sum(nodes[m] == k for m in below if m)
        assert r["n_leaves"] == sum(not any(nodes[x] == m for x in nodes if x) for m in below)
