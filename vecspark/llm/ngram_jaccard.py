"""Exact Jaccard self-join of documents on word shingles, by prefix trees.

1. One pass over the texts hashes each document's distinct shingles (48 bits)
   and sorts them into blocks; each block is cut by token range.
2. Each token range counts in how many documents a token occurs and sends the
   tokens of two or more documents back to their block.  A document links with
   another only if at least the threshold share of its own tokens is shared,
   so documents with fewer shared tokens are finished here.
3. The others are reduced to one per distinct set and their shared tokens put
   in one global order (rare first).  Two sets that link share a token within
   their prefixes; sets connected by prefix tokens form a candidate cluster.
4. Clusters are cut into cells of bounded size.  Within a cell the sets go into
   a prefix tree that is traversed with partial overlaps and length bounds.
   Representatives of the merged groups are joined again, and at last every set
   outside a cluster's largest group meets every set of the cluster, so that no
   link between different groups is lost while a group of near copies never
   gives all its pairs.
5. The links' connected components are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import tasks_for, tidy, tidy_group, write_table
from .trie import link_cell
from .words import NON_SPACE, mix64, shingle_hashes, word_hashes

TOKEN_BITS = 48
#: tokens in one block, and on average in one token range
BLOCK_TOKENS = 1 << 21
#: documents in one block (their index is kept in 16 bits)
BLOCK_DOCS = 1 << 16
#: sets in one cell of the tree join
CELL_SETS = 256
#: stands for a document without an id, above all real ids
NO_ID = 1 << 62
_U = np.uint64
_LOW48 = _U((1 << 48) - 1)


# ---- packed (token, document) lists -------------------------------------------------------------

def _pack(tokens: np.ndarray, docs: np.ndarray, code: np.ndarray | None = None) -> bytes:
    """Token-sorted rows as byte planes of token differences, document numbers (and frequency codes)."""
    diff = np.diff(tokens, prepend=_U(0))
    planes = [diff.view(np.uint8).reshape(-1, 8).T[:6].reshape(-1), docs.astype("<u2").view(np.uint8).reshape(-1, 2).T.reshape(-1)]
    if code is not None:
        planes.append(code.astype(np.uint8))
    raw = np.concatenate(planes).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(payload: bytes, coded: bool = False):
    size = int.from_bytes(payload[:8], "little")
    raw = np.frombuffer(pa.decompress(payload[8:], size, codec="zstd", asbytes=True), np.uint8)
    n = size // (9 if coded else 8)
    diff = np.zeros((n, 8), np.uint8)
    diff[:, :6] = raw[:6 * n].reshape(6, n).T
    with np.errstate(over="ignore"):
        tokens = np.cumsum(diff.reshape(-1).view(np.uint64), dtype=np.uint64)
    docs = np.ascontiguousarray(raw[6 * n:8 * n].reshape(2, n).T).reshape(-1).view("<u2").astype(np.int64)
    return (tokens, docs, raw[8 * n:]) if coded else (tokens, docs)


# ---- step 1: texts to blocks --------------------------------------------------------------------

def _blocks(parts: int, k: int):
    """mapInArrow (doc_id, text, text hash) -> (part, kind, block, payload); kind 0: a block's documents, 1: its tokens in a range."""
    shift = TOKEN_BITS - (parts.bit_length() - 1)

    def run(batches):
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        keys, docs, held = [], 0, 0
        ids, valid, sizes, d1, d2, hashes = [], [], [], [], [], []

        def flush():
            nonlocal seq, keys, docs, held
            block = (task << 24) | seq
            seq += 1
            meta = np.stack([np.concatenate(x).astype(np.uint64) for x in (ids, valid, sizes, d1, d2, hashes)])
            rows = [(block % parts, 0, block, meta.tobytes())]
            if keys:
                key = np.concatenate(keys)
                # (document << 48 | token) -> (token << 16 | document), sorted by token
                key = np.sort((key << _U(16)) | (key >> _U(48)))
                cut = np.searchsorted(key >> _U(16), np.arange(parts, dtype=np.uint64) << _U(shift))
                cut = np.append(cut, len(key))
                for p in np.flatnonzero(np.diff(cut)):
                    part = key[cut[p]:cut[p + 1]]
                    rows.append((int(p), 1, block, _pack(part >> _U(16), (part & _U(0xFFFF)))))
            keys, docs, held = [], 0, 0
            for x in (ids, valid, sizes, d1, d2, hashes):
                x.clear()
            cols = list(zip(*rows))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["part", "kind", "block", "payload"])

        for rb in batches:
            doc_ids, texts = rb.column(0), rb.column(1)
            for i, j, counts, words in word_hashes(texts, NON_SPACE):
                for a in range(i, j, BLOCK_DOCS):          # at most BLOCK_DOCS texts at once
                    b = min(a + BLOCK_DOCS, j)
                    c = counts[a - i:b - i]
                    w0 = int(counts[:a - i].sum())
                    d, h = shingle_hashes(c, words[w0:w0 + int(c.sum())], k)
                    if docs and (docs + (b - a) > BLOCK_DOCS or held + len(h) > BLOCK_TOKENS):
                        yield flush()
                    key = np.sort((d.astype(np.uint64) << _U(48)) | (h & _LOW48))
                    if len(key):
                        key = key[np.append(True, key[1:] != key[:-1])]
                    owner = (key >> _U(48)).astype(np.int64)
                    n = np.bincount(owner, minlength=b - a)
                    tok = key & _LOW48
                    with np.errstate(over="ignore"):
                        # order-free digests of the set: sums of mixed tokens
                        dig = []
                        for salt in (0x1F83D9AB, 0x5BE0CD19):
                            total = np.append(_U(0), np.cumsum(mix64(tok + _U(salt) * _U(0x9E3779B97F4A7C15)), dtype=np.uint64))
                            at = np.searchsorted(owner, np.arange(b - a + 1))
                            dig.append(total[at[1:]] - total[at[:-1]])
                        keys.append(key + (_U(docs) << _U(48)))
                    sl = doc_ids.slice(a, b - a)
                    ids.append(sl.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                    valid.append(sl.is_valid().to_numpy(zero_copy_only=False))
                    sizes.append(n)
                    d1.append(dig[0])
                    d2.append(dig[1])
                    hashes.append(rb.column(2).slice(a, b - a).to_numpy().view(np.uint64))
                    docs += b - a
                    held += len(key)
        if docs:
            yield flush()

    return run


# ---- step 2: document frequencies by token range, and back ---------------------------------------

def _shared_tokens(t: pa.Table) -> pa.Table:
    """One token range: its tokens that two or more documents hold, by block (the blocks' documents pass through)."""
    out = []
    blocks, tokens, docs, where = [], [], [], []
    for kind, block, payload in zip(t["kind"].to_pylist(), t["block"].to_pylist(), t["payload"]):
        if kind == 0:
            out.append((block, 0, payload.as_py()))
            continue
        tok, doc = _unpack(payload.as_py())
        where.append(np.full(len(tok), len(blocks), np.int32))
        blocks.append(block)
        tokens.append(tok)
        docs.append(doc.astype(np.uint16))
    if blocks:
        tok, doc, src = np.concatenate(tokens), np.concatenate(docs), np.concatenate(where)
        del tokens, docs, where
        order = np.argsort(tok, kind="stable")
        tok, doc, src = tok[order], doc[order], src[order]
        first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        count = np.diff(np.append(first, len(tok)))
        df = np.repeat(count, count)
        keep = df > 1
        tok, doc, src, df = tok[keep], doc[keep], src[keep], df[keep]
        code = np.minimum(255, np.floor(8 * np.log2(np.maximum(df, 1)))).astype(np.uint8)
        order = np.argsort(src, kind="stable")
        src = src[order]
        cut = np.searchsorted(src, np.arange(len(blocks) + 1))
        for b in np.flatnonzero(np.diff(cut)):
            o = order[cut[b]:cut[b + 1]]
            out.append((blocks[b], 1, _pack(tok[o], doc[o], code[o])))
    cols = list(zip(*out)) if out else ((), (), ())
    return pa.table({"block": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()),
                     "payload": pa.array(cols[2], pa.binary())})


_DOC = "rid long, doc_id long, text_hash long, n long, d1 long, d2 long, n_prefix int, toks binary"


def _documents(num: int, den: int):
    """One block: a row per document; ``toks`` (globally ordered shared tokens) where links are possible, once per set."""
    def run(t: pa.Table) -> pa.Table:
        meta, hits = None, []
        for kind, payload in zip(t["kind"].to_pylist(), t["payload"]):
            if kind == 0:
                meta = np.frombuffer(payload.as_py(), np.uint64).reshape(6, -1)
            else:
                hits.append(_unpack(payload.as_py(), coded=True))
        ids, valid, n, d1, d2 = meta[0].view(np.int64), meta[1] > 0, meta[2].astype(np.int64), meta[3], meta[4]
        text_hash = meta[5].view(np.int64)
        rid = np.where(valid, ids, NO_ID + (d1 >> _U(3)).astype(np.int64))
        toks: list[bytes | None] = [None] * len(ids)
        prefix: list[int | None] = [None] * len(ids)
        if hits:
            tok, doc, code = (np.concatenate([h[i] for h in hits]) for i in range(3))
            del hits
            shared = np.bincount(doc, minlength=len(ids))
            # of equal sets in a block the one of least id speaks for all
            order = np.lexsort((rid, d2, d1, n))
            same = np.zeros(len(ids), bool)
            same[order[1:]] = (n[order[1:]] == n[order[:-1]]) & (d1[order[1:]] == d1[order[:-1]]) & (d2[order[1:]] == d2[order[:-1]])
            active = (shared * den >= num * n) & (n > 0) & ~same
            keep = active[doc]
            tok, doc, code = tok[keep], doc[keep], code[keep]
            key = (code.astype(np.uint64) << _U(48)) | tok
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            cut = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i in np.flatnonzero(active):
                own = key[cut[i]:cut[i + 1]]
                toks[i] = own.astype("<u8").tobytes()
                # a linked set shares at least need tokens: one is among the first n - need + 1
                need = -(-num * int(n[i]) // den)
                prefix[i] = int(n[i]) - need + 1 - (int(n[i]) - len(own))
        return pa.table({"rid": pa.array(rid, pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=~valid),
                         "text_hash": pa.array(text_hash, pa.int64()),
                         "n": pa.array(n, pa.int64()), "d1": pa.array(d1.view(np.int64)), "d2": pa.array(d2.view(np.int64)),
                         "n_prefix": pa.array(prefix, pa.int32()), "toks": pa.array(toks, pa.binary())})
    return run


def _postings(batches: Iterator[pa.RecordBatch]):
    """(cid, n_prefix, toks) -> (token, cid) for the prefix tokens."""
    for rb in batches:
        tok, cid = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, p, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2)):
            own = np.frombuffer(t.as_py(), np.int64)[:p]
            tok.append(own)
            cid.append(np.full(len(own), c, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok)), pa.array(np.concatenate(cid))], names=["token", "cid"])


# ---- step 4: cells --------------------------------------------------------------------------------

def _cells(keys: list[str]):
    """Iterate over (key, pandas-free columns) of runs of rows with equal keys; a cell is bounded by its maker."""
    def run(batches):
        held, key = [], None
        for rb in batches:
            if not rb.num_rows:
                continue
            cols = [rb.column(rb.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(rb.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.append(np.flatnonzero(np.append(True, change[1:])), rb.num_rows)
            for s, e in zip(starts[:-1], starts[1:]):
                k = tuple(c[s] for c in cols)
                if held and k != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = k
                held.append(rb.slice(s, e - s))
        if held:
            yield key, pa.Table.from_batches(held)
    return run


def _load(t: pa.Table):
    cid = t["cid"].to_numpy()
    n = t["n"].to_numpy().astype(np.int64)
    raw = [np.frombuffer(x.as_py(), np.uint64) for x in t["toks"]]
    cat = np.concatenate(raw) if raw else np.zeros(0, np.uint64)
    rank = np.unique(cat, return_inverse=True)[1].reshape(-1)
    cut = np.cumsum([len(r) for r in raw])[:-1]
    return cid, n, np.split(rank, cut)


def _join_within(num: int, den: int):
    """Cells of whole chunks: (cid, sub), sub the least cid of its merged group in the chunk."""
    def run(batches):
        for _, t in _cells(["cluster", "chunk"])(batches):
            cid, n, sets = _load(t)
            lab = np.unique(cid, return_inverse=True)[1].reshape(-1)     # repeated rows are one node
            every = np.arange(len(cid))
            lab, _ = link_cell(sets, n, lab, every, every, num, den)
            least = np.full(lab.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, lab, cid)
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(least[lab], pa.int64())], names=["cid", "sub"])
    return run


def _join_across(num: int, den: int):
    """Cells of a chunk of rest sets (side 0) against a chunk of the cluster (side 1): links (a, b)."""
    def run(batches):
        for _, t in _cells(["cluster", "i", "j"])(batches):
            cid, n, sets = _load(t)
            side, lab = t["side"].to_numpy(), t["lab"].to_numpy()
            lab = np.unique(lab, return_inverse=True)[1].reshape(-1)
            _, links = link_cell(sets, n, lab, np.flatnonzero(side == 1), np.flatnonzero(side == 0), num, den)
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(cid[a], pa.int64()), pa.array(cid[b], pa.int64())], names=["a", "b"])
    return run


def _chunked(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``chunk`` so that a cluster of m sets has about m / CELL_SETS chunks of random sets."""
    return (df.join(sizes, "cluster")
            .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("m") / CELL_SETS).cast("long")))
            .drop("m"))


def _link_clusters(spark: SparkSession, sets: DataFrame, members: DataFrame, num: int, den: int,
                   tasks: int | None = None) -> DataFrame:
    """Links (a, b) that connect all sets of each cluster that any links connect.

    sets: rid, d1, n, toks; members: cluster, node, cid (whose set stands for the
    node).  Only sets of clusters of several cells move more than once.
    """
    sizes = write_table(spark, members.groupBy("cluster").agg(F.count("*").alias("m")), "nj-sizes", tasks)
    names = members.join(sizes, "cluster").withColumnsRenamed({"cid": "rid", "node": "d1"})
    every = write_table(spark, sets.join(names, ["rid", "d1"]).withColumnRenamed("d1", "cid")
                        .select("cluster", "cid", "n", "m", "toks"), "nj-sets", tasks)
    large = every.where(F.col("m") > CELL_SETS).drop("m")

    def placed(names: DataFrame) -> DataFrame:
        return large.join(names.withColumnRenamed("node", "cid"), ["cluster", "cid"])

    todo = every.withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(7)), F.ceil(F.col("m") / CELL_SETS).cast("long")))
    found: list[DataFrame] = []
    big = sizes.where(F.col("m") > CELL_SETS).select("cluster")
    label, rounds, before = None, 0, 0                # label: node -> group so far
    while True:
        sub = (todo.select("cluster", "chunk", "cid", "n", "toks")
               .repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "cid")
               .mapInArrow(tidy(_join_within(num, den)), "cid long, sub long"))
        sub = write_table(spark, sub.distinct(), "nj-sub", tasks)
        found.append(sub.where("cid != sub").select(F.col("cid").alias("a"), F.col("sub").alias("b")))
        if rounds == 0:
            if big.isEmpty():
                return found[0]
            inside = write_table(spark, members.join(big, "cluster").select("cluster", "node"), "nj-inside", tasks)
            label = inside.select("cluster", "node").join(sub.toDF("node", "lab"), "node")
        else:
            label = label.join(sub.toDF("lab", "next"), "lab", "left").select("cluster", "node", F.coalesce("next", "lab").alias("lab"))
        label = write_table(spark, label, "nj-label", tasks)
        groups = write_table(spark, label.groupBy("cluster", "lab").agg(F.count("*").alias("members")), "nj-groups", tasks)
        now = groups.count()
        rounds += 1
        # representatives of the groups meet until that merges little more
        if rounds > 1 and now > 0.7 * before:
            break
        before = now
        many = write_table(spark, groups.groupBy("cluster").agg(F.count("*").alias("m")).where("m > 1"), "nj-many", tasks)
        if many.isEmpty():
            return _all(found)
        reps = groups.join(many.select("cluster"), "cluster").select("cluster", F.col("lab").alias("node"))
        todo = placed(_chunked(reps, many))
    # exact end: every set outside its cluster's largest group against every set of the cluster
    lead = groups.groupBy("cluster").agg(F.max(F.struct("members", "lab")).alias("g"), F.count("*").alias("k")).where("k > 1")
    lead = write_table(spark, lead.select("cluster", F.col("g.lab").alias("main")), "nj-main", tasks)
    if lead.isEmpty():
        return _all(found)
    marked = write_table(spark, inside.join(label, ["cluster", "node"]).join(lead, "cluster")
                         .withColumn("rest", F.col("lab") != F.col("main")).drop("main"), "nj-marked", tasks)
    n_sets = marked.groupBy("cluster").agg(F.ceil(F.count("*") / CELL_SETS).cast("long").alias("chunks"),
                                           F.ceil(F.count_if("rest") / CELL_SETS).cast("long").alias("rests"))
    marked = marked.join(write_table(spark, n_sets, "nj-chunks", tasks), "cluster")
    h = F.xxhash64("node", F.lit(11))
    build = (marked.where("rest").withColumn("i", F.pmod(h, F.col("rests"))).withColumn("side", F.lit(0))
             .withColumn("j", F.explode(F.expr("sequence(0L, chunks - 1)"))))
    probe = (marked.withColumn("j", F.pmod(h, F.col("chunks"))).withColumn("side", F.lit(1))
             .withColumn("i", F.explode(F.expr("sequence(0L, rests - 1)"))))
    cols = ["cluster", "i", "j", "side", "node", "lab"]
    cells = placed(build.select(cols).unionByName(probe.select(cols))).select("cluster", "i", "j", "side", "cid", "n", "toks", "lab")
    last = (cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "cid")
            .mapInArrow(tidy(_join_across(num, den)), "a long, b long"))
    found.append(write_table(spark, last, "nj-last", tasks))
    return _all(found)


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 5,
                       num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs of non-space characters, A-Z lowered; a document's set holds
    its distinct ``k``-word shingles, or its whole word sequence if that is
    shorter; sets link when ``den * |x & y| >= num * |x | y|``.

    * null or wordless text: empty set, linked with nothing, component_id = doc_id;
    * null doc_id: the row takes part; its component_id is the least id it
      reaches, null if it reaches none;
    * rows that share a doc_id each keep their own component;
    * other columns of ``docs`` are not read; an empty table gives no rows.

    Shingles count as equal when their 48-bit hashes are (for a pair of sets of
    500 shingles a false match has probability 1e-9), sets that may link when
    their 64-bit digests are.  ``docs`` must give the
    same rows in the same order when a lost task reads it again, as files do.
    """
    groups = ngram_jaccard_groups(spark, docs, text=text, doc_id=doc_id, k=k, num=num, den=den)
    return groups.select("doc_id", "n_shingles", "component_id")


def text_hash(text: str) -> Column:
    """64-bit hash that tells the texts of one id apart (null has one of its own)."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def ngram_jaccard_groups(spark: SparkSession, docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 5,
                         num: int = 75, den: int = 100) -> DataFrame:
    """``ngram_jaccard_join`` with ``text_hash`` and ``component``.

    ``component`` names a row's component also where component_id does not tell
    it: without any id, or where components share their least id.  It is null
    for a null or wordless text, which is linked with nothing.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("text_hash", text_hash("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = tasks_for(spark, n_bytes)                # the tables after the texts are small: no file for each shuffle partition
    parts = 64                                       # token ranges; a byte of text gives less than 1/4 token
    while parts * BLOCK_TOKENS * 4 < n_bytes:
        parts *= 2
    rows = docs.mapInArrow(tidy(_blocks(parts, k)), "part long, kind int, block long, payload binary")
    shared = rows.groupBy("part").applyInArrow(tidy_group(_shared_tokens), "block long, kind int, payload binary")
    every = write_table(spark, shared.groupBy("block").applyInArrow(tidy_group(_documents(num, den)), _DOC), "nj-docs")

    # classes of equal sets; the least id stands for the class, the digest d1 names it as a node
    classes = (every.where("n > 0").groupBy("n", "d1", "d2")
               .agg(F.min("rid").alias("cid"), F.count("*").alias("copies"), F.max("n_prefix").alias("n_prefix")))
    classes = write_table(spark, classes.where("copies > 1 or n_prefix is not null"), "nj-classes", tasks)

    # sets meet on their prefix tokens; those connected by such tokens form a cluster
    sets = every.where("toks is not null")
    posts = sets.select("d1", "n_prefix", "toks").mapInArrow(tidy(_postings), "token long, cid long")
    hubs = posts.groupBy("token").agg(F.min("cid").alias("hub"), F.max("cid").alias("other"))
    hubs = write_table(spark, hubs.where("hub < other").select("token", "hub"), "nj-hubs", tasks)
    candidates = posts.join(hubs, "token").where("cid != hub").select("cid", "hub")
    clusters = connected_components(spark, candidates, tasks).select("node", F.col("label").alias("cluster"))
    members = write_table(spark, clusters.join(classes.select(F.col("d1").alias("node"), "cid"), "node"), "nj-members", tasks)
    links = _link_clusters(spark, sets.select("rid", "d1", "n", "toks"), members, num, den, tasks)
    group = connected_components(spark, links, tasks).select(F.col("node").alias("d1"), F.col("label").alias("grp"))

    # a group's label is the least id of its classes
    grouped = write_table(spark, classes.join(group, "d1").select("n", "d1", "d2", "cid", "grp"), "nj-grouped", tasks)
    least = write_table(spark, grouped.groupBy("grp").agg(F.min("cid").alias("label")), "nj-least", tasks)
    label = grouped.join(least, "grp").select("n", "d1", "d2", "label", "grp")

    named = write_table(spark, classes.join(label, ["n", "d1", "d2"], "left")
                        .select("n", "d1", "d2", F.coalesce("label", "cid").alias("label"), "grp"), "nj-named", tasks)
    out = every.join(named, ["n", "d1", "d2"], "left").withColumn("label", F.coalesce("label", "rid"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                      F.when((F.col("n") > 0) & (F.col("label") < NO_ID), F.col("label"))
                      .otherwise(F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"),
                      F.when(F.col("n") > 0, F.coalesce("grp", "d1")).alias("component"))
