"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns.  Conversations are dealt to
shards by ranges of their paths (so a subtree's conversations lie together and
a hot one spans shards); a node is local if all its conversations lie in one
shard.  Within a shard the local nodes come externally sorted by reverse level
order: each sends its subtree's totals to its parent through a priority queue
that spills sorted runs, and the parent, which comes later, takes them off.
Totals of parents that are not local leave the shard, are added up by parent,
and the nodes across shards are passed through in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import write_table

#: messages that a priority queue holds in memory; more are spilled as sorted runs
QUEUE_LIMIT = 1 << 18
#: messages read at once from a spilled run
RUN_CHUNK = 1 << 12
#: turns of a path that decide on its shard (longer common paths are dealt by conversation)
PATH_TURNS = 64
ROOT = bytes(16)
#: result rows of one Arrow batch
BATCH = 1 << 14


# ---- turns ----

def turn_digests(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, n_bytes): the turns in order, from pos 0; texts as md5 of (role, text) and UTF-8 size.

    Ordered by turn (null first), equal turns by digest; null role or text is
    empty; rows without conv_id take no part; repeated rows are turns of their own.
    """
    r, x = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, x)))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"),
        F.octet_length(x).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "digest", "n_bytes")


def with_shared_heads(turns: DataFrame, block: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of rebuilt conversations: the first h turns of conversation c - c % block, then c's own after its first h.

    h = crc32(decimal c) % heads; fewer turns are taken if there are fewer, none
    if the other conversation is absent.  ``members`` has every conv_id: a
    rebuilt conversation may have no turn.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(heads)
    members = turns.where("pos = 0").select("conv_id")
    source = turns.where(F.col("pos") < heads - 1).where(F.col("conv_id") % block == 0).withColumnRenamed("conv_id", "source")
    head = (members.withColumn("source", F.col("conv_id") - F.col("conv_id") % block).join(source, "source")
            .where(F.col("pos") < h).select("conv_id", "pos", "digest", "n_bytes"))
    own = turns.where(F.col("pos") >= h).withColumn("pos", F.col("pos") + F.lit(heads).cast("long"))
    return head.unionByName(own), members


# ---- paths ----

_PATH_DDL = "key binary, parent binary, depth long, conv_id long, n_bytes long, ends boolean, path binary"
_PATH_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
_PATH_NAMES = ["key", "parent", "depth", "conv_id", "n_bytes", "ends", "path"]


def _batches(rows, names, types):
    """Record batches of at most ``BATCH`` of the tuples ``rows``."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _paths(batches):
    """From (conv_id, digest, n_bytes) in order, a null digest first: a row per prefix of each conversation.

    A prefix's key is a 128-bit hash of its parent's key and its last turn; the
    root's row comes last and has the path's first bytes.  One row is held.
    """
    def rows():
        conv = last = None
        key, depth, path = ROOT, 0, b""
        for rb in batches:
            for c, d, n in zip(*(rb.column(i).to_pylist() for i in range(3))):
                if c != conv:
                    if conv is not None:
                        if last:
                            yield (*last, True, None)
                        yield ROOT, None, 0, conv, 0, last is None, path
                    conv, last, key, depth, path = c, None, ROOT, 0, b""
                if d is None:
                    continue
                if last:
                    yield (*last, False, None)
                up, depth = key, depth + 1
                key = hashlib.blake2b(up + d, digest_size=16).digest()
                last = key, up, depth, conv, n
                if depth <= PATH_TURNS:
                    path += d[:4]
        if conv is not None:
            if last:
                yield (*last, True, None)
            yield ROOT, None, 0, conv, 0, last is None, path
    return _batches(rows(), _PATH_NAMES, _PATH_TYPES)


# ---- time-forward processing ----

class SpillingQueue:
    """A priority queue of tuples that keeps ``limit`` of them in memory and the others in sorted runs."""

    def __init__(self, limit: int | None = None):
        self.limit = limit or QUEUE_LIMIT
        self.heap: list = []
        self.heads: list = []                    # (least message, run number)
        self.runs: list = []

    def push(self, item) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        f = tempfile.TemporaryFile()             # has no name, goes with the task
        self.heap.sort()
        for i in range(0, len(self.heap), RUN_CHUNK):
            pickle.dump(self.heap[i:i + RUN_CHUNK], f, pickle.HIGHEST_PROTOCOL)
        f.seek(0)
        self.heap = []
        self.runs.append(self._read(f))
        heapq.heappush(self.heads, (next(self.runs[-1]), len(self.runs) - 1))

    @staticmethod
    def _read(f):
        with f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def peek(self):
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return self.heap[0]
        return self.heads[0][0] if self.heads else None

    def pop(self):
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        item, run = self.heads[0]
        after = next(self.runs[run], None)
        if after is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (after, run))
        return item


_TOTAL_DDL = "key binary, up boolean, n_children long, n_leaves long, saved long"
_TOTAL_TYPES = [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
_TOTAL_NAMES = ["key", "up", "n_children", "n_leaves", "saved"]


def _time_forward(batches):
    """From (shard, depth, key, parent, own, n_children, n_leaves, saved) by shard, falling depth and key: subtree totals.

    The last three are totals that came from other shards.  A row (key, up
    false, ...) per node; a row (parent's key, up true, ...) for what is sent
    to a parent that is not here.
    """
    def past(queue, place):
        """Messages to nodes before ``place`` that have not come: their parents are not here."""
        while (m := queue.peek()) is not None and (place is None or m[:2] < place):
            queue.pop()
            yield m[1], True, *m[2:]

    def rows():
        queue, shard = SpillingQueue(), None
        for rb in batches:
            for s, depth, key, parent, own, children, leaves, saved in zip(*(rb.column(i).to_pylist() for i in range(8))):
                if s != shard:
                    yield from past(queue, None)
                    shard = s
                place = (-depth, key)
                yield from past(queue, place)
                while (m := queue.peek()) is not None and m[:2] == place:
                    queue.pop()
                    children, leaves, saved = children + m[2], leaves + m[3], saved + m[4]
                leaves, saved = leaves if children else 1, saved + own
                yield key, False, children, leaves, saved
                if parent is not None:
                    queue.push((1 - depth, parent, 1, leaves, saved))
        yield from past(queue, None)
    return _batches(rows(), _TOTAL_NAMES, _TOTAL_TYPES)


def _subtrees(nodes: DataFrame) -> DataFrame:
    cols = ["shard", "depth", "key", "parent", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"),
            "n_children", "n_leaves", "saved"]
    return nodes.select(*cols).mapInArrow(_time_forward, _TOTAL_DDL)


def _ends(batches):
    """From (key, conv_id) in order: the hash of each key's ids, comma-joined; one id at a time."""
    def rows():
        key, h = None, None
        for rb in batches:
            for k, c in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        yield key, h.hexdigest()
                    key, h = k, hashlib.sha256(b"%d" % c)
                else:
                    h.update(b",%d" % c)
        if key is not None:
            yield key, h.hexdigest()
    return _batches(rows(), ["key", "ends_sha256"], [pa.binary(), pa.string()])


def prefix_trie(spark: SparkSession, turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The trie's nodes: key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv_id, pos, digest, n_bytes); ``members``: ids of conversations
    without turns too (a row each; others are added).  conv_id is the least
    member, n_convs the number of members; n_leaves and saved_tokens, the sum of
    (n_convs - 1) * n_bytes, are over the subtree, top included; ends_sha256 is
    the hash of the ids that end here.  No conversations: no rows.

    A conversation passes through one task as a stream, and so do the ids that
    end at one node (SHA-256 has no parallel form).  All other work on a node
    with many conversations is partial sums.  Nodes across shards are on the
    paths between neighbouring shards: one path per shard at most, unless
    conversations agree in their first ``PATH_TURNS`` turns.
    """
    ids = turns.select("conv_id") if members is None else turns.select("conv_id").unionByName(members.select("conv_id"))
    first = ids.distinct().select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
                                  F.lit(0).cast("long").alias("n_bytes"))
    ordered = (turns.select("conv_id", "pos", "digest", "n_bytes").unionByName(first).repartition("conv_id")
               .sortWithinPartitions("conv_id", "pos").select("conv_id", "digest", "n_bytes"))
    paths = write_table(spark, ordered.mapInArrow(_paths, _PATH_DDL), "trie-paths")

    near = (paths.where("depth = 0").select("conv_id", "path").repartitionByRange("path", F.xxhash64("conv_id"))
            .select("conv_id", F.spark_partition_id().alias("shard")))
    near = write_table(spark, near, "trie-shards")
    nodes = paths.join(near, "conv_id").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"),
        F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"), F.min("shard").alias("shard"),
        F.max("shard").alias("last_shard"))
    nodes = write_table(spark, nodes, "trie-nodes")

    zero = {c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved")}
    local = (nodes.where("shard = last_shard").withColumns(zero).repartition("shard")
             .sortWithinPartitions("shard", F.desc("depth"), "key"))
    inner = write_table(spark, _subtrees(local), "trie-inner")
    up = inner.where("up").groupBy("key").agg(*[F.sum(c).alias(c) for c in zero])
    across = (nodes.where("shard < last_shard").join(up, "key", "left").na.fill(0, list(zero))
              .withColumn("shard", F.lit(0)).repartition(1).sortWithinPartitions(F.desc("depth"), "key"))
    totals = inner.where("not up").unionByName(_subtrees(across)).drop("up")

    ends = (paths.where("ends").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
            .mapInArrow(_ends, "key binary, ends_sha256 string"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "key").join(ends, "key", "left").join(parents, "parent", "left")
    return out.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(spark: SparkSession, conversations: DataFrame, *, rebuilt: bool = True, **columns) -> DataFrame:
    """``prefix_trie`` of the conversations, rebuilt with shared heads or as they are."""
    turns = write_table(spark, turn_digests(conversations, **columns), "trie-turns")
    members = None
    if rebuilt:
        turns, members = with_shared_heads(turns)
    return prefix_trie(spark, turns, members)
