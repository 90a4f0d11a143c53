"""Benchmark decontamination with an FM-index per training shard.

Each shard (the texts of one Arrow batch, or less) is written in the alphabet
of the benchmark's words; a word that no item holds, or two neighbours that no
item has side by side, ends a run, since no phrase can go across.  The shard's
FM-index is searched backwards for every phrase, occurrences are located
through sampled suffix positions, and their word spans are merged.  Nothing is
shuffled: the phrases travel to the shards in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .storage import tidy, write_table
from .words import LOWER

#: words of a window
WINDOW = 10
#: benchmark bytes that one block of items holds (a block is broadcast; several are searched one after another)
BLOCK_BYTES = 8 << 20
#: benchmark-alphabet symbols that one shard's index holds
SHARD_SYMBOLS = 1 << 20
#: bytes of a text that are cut into words at once
PIECE = 1 << 22

_WORDS = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _WORDS[_lo:_hi] = LOWER[_lo:_hi]
_TABLE = _WORDS.tobytes()

_OUT = ("n_words long, spans array<struct<start:int,stop:int>>, items array<string>")


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of ASCII digits, ASCII letters (lowered) and non-ASCII characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a long text in bounded pieces, cut between words."""
    at, n = 0, len(data)
    while at < n:
        stop = min(at + PIECE, n)
        while stop < n and data[stop] != 0x20:
            gap = data.find(b" ", stop)
            stop = n if gap < 0 else gap
        yield data[at:stop].split()
        at = stop


class Phrases:
    """The windows of some benchmark items, in an alphabet of their words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.alphabet: dict[bytes, int] = {}
        seqs = [(name, [self.alphabet.setdefault(w, len(self.alphabet) + 1) for w in words_of(text)])
                for name, text in items]
        owners: dict[tuple[int, ...], set[str]] = {}
        pairs = set()
        for name, seq in seqs:
            pairs.update(zip(seq, seq[1:]))
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                owners.setdefault(tuple(seq[i:i + window]), set()).add(name)
        self.base = len(self.alphabet) + 1
        self.pairs = np.sort(np.array([a * self.base + b for a, b in pairs], np.int64))
        #: words that are a phrase by themselves
        self.single = np.zeros(self.base, bool)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.patterns = np.full((len(owners), int(self.lengths.max(initial=0))), -1, np.int64)
        self.owners = [tuple(sorted(o)) for o in owners.values()]
        for i, p in enumerate(owners):
            self.patterns[i, :len(p)] = p
            if len(p) == 1:
                self.single[p[0]] = True

    def symbols(self, words: list[bytes]) -> np.ndarray:
        get = self.alphabet.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def adjoining(self, sym: np.ndarray) -> np.ndarray:
        """Of each two neighbours: may a phrase hold them side by side?"""
        if len(sym) < 2 or not len(self.pairs):
            return np.zeros(max(0, len(sym) - 1), bool)
        code = sym[:-1] * self.base + sym[1:]
        both = np.flatnonzero((sym[:-1] > 0) & (sym[1:] > 0))
        out = np.zeros(len(code), bool)
        at = np.searchsorted(self.pairs, code[both])
        at[at == len(self.pairs)] = 0
        out[both] = self.pairs[at] == code[both]
        return out


class _Shard:
    """Texts in the phrases' alphabet, until they are searched."""

    def __init__(self, phrases: Phrases):
        self.p = phrases
        self.text: list[np.ndarray] = []       # runs, each ended by 0
        self.where: list[np.ndarray] = []      # (document, word) of each symbol
        self.size = 0

    def add(self, doc: int, sym: np.ndarray) -> None:
        """sym: the symbols of all words of a document."""
        join = self.p.adjoining(sym)
        left, right = np.append(False, join), np.append(join, False)
        keep = np.flatnonzero(left | right | self.p.single[sym])
        if not len(keep):
            return
        ends = ~right[keep]                     # a separator follows the last symbol of a run
        at = np.arange(len(keep)) + np.cumsum(ends) - ends
        out = np.zeros(len(keep) + int(ends.sum()), np.int64)
        out[at] = sym[keep]
        where = np.full((len(out), 2), -1, np.int64)
        where[at, 0], where[at, 1] = doc, keep
        self.text.append(out)
        self.where.append(where)
        self.size += len(out)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, phrase) of every occurrence of every phrase."""
        empty = np.zeros(0, np.int64)
        if not self.size or not len(self.p.patterns):
            return empty, empty, empty
        index = FMIndex(np.concatenate(self.text))
        where = np.concatenate(self.where)
        lo, hi = index.find(self.p.patterns, self.p.lengths)
        count = hi - lo
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = index.locate(rows)
        return where[at, 0], where[at, 1], phrase


def _merge(start: np.ndarray, stop: np.ndarray) -> list[dict]:
    """Disjoint spans that cover the given ones."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.append(True, start[1:] > stop[:-1])
    last = np.append(first[1:], True)
    return [{"start": int(a), "stop": int(b)} for a, b in zip(start[first], stop[last])]


def _search(phrases, text_col: str, more: bool):
    """mapInArrow over the documents; ``more``: spans and items of earlier blocks of items are there already."""
    def run(batches):
        p: Phrases = phrases.value
        for rb in batches:
            texts = rb.column(rb.schema.get_field_index(text_col))
            n = rb.num_rows
            n_words = np.zeros(n, np.int64)
            spans: list[list] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]

            def search(shard):
                doc, word, phrase = shard.hits()
                order = np.argsort(doc, kind="stable")
                doc, word, phrase = doc[order], word[order], phrase[order]
                cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
                for a, b in zip(cut, np.append(cut[1:], len(doc)) if len(doc) else []):
                    d = int(doc[a])
                    spans[d] += _merge(word[a:b], word[a:b] + p.lengths[phrase[a:b]])
                    for i in np.unique(phrase[a:b]):
                        items[d].update(p.owners[i])

            shard = _Shard(p)
            for d in range(n):
                text = texts[d].as_py()
                if text is None:
                    continue
                data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
                sym = [p.symbols(w) for w in _pieces(data)] or [np.zeros(0, np.int64)]
                sym = sym[0] if len(sym) == 1 else np.concatenate(sym)
                n_words[d] = len(sym)
                shard.add(d, sym)
                if shard.size >= SHARD_SYMBOLS:
                    search(shard)
                    shard = _Shard(p)
            search(shard)
            if more:
                old_spans = rb.column(rb.schema.get_field_index("spans")).to_pylist()
                old_items = rb.column(rb.schema.get_field_index("items")).to_pylist()
                for d in range(n):
                    if spans[d] and old_spans[d]:
                        both = spans[d] + old_spans[d]
                        spans[d] = _merge(np.array([s["start"] for s in both]), np.array([s["stop"] for s in both]))
                    else:
                        spans[d] = spans[d] or old_spans[d]
                    items[d].update(old_items[d])
            keep = [i for i, c in enumerate(rb.schema.names) if c not in ("n_words", "spans", "items")]
            span_t = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [rb.column(i) for i in keep] + [pa.array(n_words), pa.array(spans, span_t),
                                                pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=[rb.schema.names[i] for i in keep] + ["n_words", "spans", "items"])
    return run


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of bounded size, one block on the driver at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text)).where(F.col(text).isNotNull())
    for name, body in rows.toLocalIterator():
        if held and size + len(body) > block_bytes:
            yield held
            held, size = [], 0
        held.append(("" if name is None else name, body))
        size += len(body.encode("utf-8", "surrogatepass"))
    if held:
        yield held


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES, then=None) -> DataFrame:
    """``docs`` with n_words, spans (merged word ranges that benchmark windows cover) and items (sorted ids).

    A window is ``window`` consecutive words of an item, or the whole item if it
    has fewer words (but any).  Null texts have no words; null items are left
    out; an item without id counts as ''.  Repeated documents and items each
    count for themselves.  Columns of ``docs`` named like the three new ones are
    replaced; all others pass through.  Items fill as many bounded blocks as
    they need; between blocks the result so far lies in the shared folder.
    ``then``: a function over the resulting batches, of the same schema, run in
    the last pass's tasks.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "items")]
    docs = docs.select(*[f"`{c}`" for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + _OUT
    out, more, held = docs, False, None
    search = lambda block, more: _search(spark.sparkContext.broadcast(Phrases(block, window)), text, more)
    for block in item_blocks(benchmark, item_id, item_text, block_bytes):
        if held is not None:
            out, more = write_table(spark, out.mapInArrow(tidy(search(held, more)), schema), "decontaminate"), True
        held = block
    last = search(held or [], more)
    return out.mapInArrow(tidy(last if then is None else lambda batches: then(last(batches))), schema)


def _cut(text_col: str):
    """Remove the words of the spans, with what stands between them, from the texts."""
    def run(batches):
        for rb in batches:
            at = rb.schema.get_field_index(text_col)
            texts, spans = rb.column(at), rb.column(rb.schema.get_field_index("spans"))
            out = []
            for t, s in zip(texts, spans):
                cuts = s.as_py()
                out.append(t.as_py() if not cuts else remove_spans(t.as_py(), cuts))
            cols = [pa.array(out, rb.schema.field(at).type) if i == at else rb.column(i) for i in range(rb.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=rb.schema.names)
    return run


def remove_spans(text: str, spans: list[dict]) -> str:
    """``text`` without the bytes from the first to the last word of each span; a blank line marks the place."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = np.frombuffer(raw.translate(_TABLE), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts, at = [], 0
    for s in spans:
        parts.append(raw[at:first[s["start"]]])
        at = int(last[s["stop"] - 1])
    parts.append(raw[at:])
    return b"\n\n".join(parts).decode("utf-8", "surrogatepass")


def remove_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **kw) -> DataFrame:
    """``docs`` with the contaminated word spans cut out of the texts (others are left as they are)."""
    return find_contamination(spark, docs, benchmark, text=text, then=_cut(text), **kw)


def contamination_digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]).cast("long"))
    return found.select(F.col(doc_id).cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))
