"""Fill-in-middle transformation over piece tables.

A document is a list of descriptors (buffer, start, end) over two immutable
buffers: its UTF-8 text and the sentinels.  Cutting splits a descriptor, a
form is a permutation of the descriptors, and the inverse permutation of a
transformed text's descriptors gives the document back.  Bytes are never moved
before the result is written, and hashes stream over the descriptors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import flat_text, text_groups

#: sentinels before the prefix, the suffix and the middle
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: order of (prefix, middle, suffix, <P>, <S>, <M>) in the forms
FORMS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
#: bytes of text that one result batch holds (a longer text is a batch of its own)
BATCH = 4 << 20
#: bytes of one long text whose units are looked at together
WINDOW = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80          # first byte of a code point
_SENTINEL_BUFFER = b"".join(SENTINELS)


class PieceTable:
    """A byte sequence as descriptors (buffer, start, end) over immutable buffers."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, buffers, pieces):
        self.buffers, self.pieces = tuple(memoryview(b) for b in buffers), list(pieces)

    def __len__(self) -> int:
        return sum(e - s for _, s, e in self.pieces)

    def cut(self, at: int) -> None:
        """Split the descriptor that holds offset ``at`` in two (either may be empty)."""
        for i, (b, s, e) in enumerate(self.pieces):
            if at <= e - s:
                self.pieces[i:i + 1] = [(b, s, s + at), (b, s + at, e)]
                return
            at -= e - s
        raise ValueError("cut beyond the end")

    def arranged(self, order) -> "PieceTable":
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def spans(self):
        return (self.buffers[b][s:e] for b, s, e in self.pieces if e > s)

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.spans():
            h.update(part)
        return h.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.spans())


def transformed(text, prefix_end: int, middle_end: int, form: str) -> PieceTable:
    """The descriptors of ``text`` (bytes) in the given form; offsets in bytes."""
    table = PieceTable((text, _SENTINEL_BUFFER), [(0, 0, len(text))])
    if form == "plain":
        return table
    table.cut(prefix_end)
    table.cut(middle_end)                        # prefix, middle, suffix (a cut at their border leaves an empty one)
    at = np.cumsum([0, *map(len, SENTINELS)]).tolist()
    table.pieces += [(1, a, b) for a, b in zip(at, at[1:])]
    return table.arranged(FORMS[form])


def restored(output: bytes, form: str) -> PieceTable:
    """The descriptors, over a transformed text, of the document it was made from."""
    table = PieceTable((output,), [(0, 0, len(output))])
    if form == "plain":
        return table
    order, at = FORMS[form], 0
    for which in order:
        if which >= 3:                           # a sentinel: cut before and behind it
            mark = SENTINELS[which - 3]
            found = output.find(mark, at)
            if found < 0:
                raise ValueError(f"no {mark.decode()} in a text of form {form}")
            if at:
                table.cut(found)
            elif found:
                raise ValueError(f"a text of form {form} must open with {mark.decode()}")
            at = found + len(mark)
            table.cut(at)
    back = [order.index(i) for i in range(3)]    # inverse permutation, without the sentinels
    return table.arranged(back)


def seeds(doc_id, seed: int = 1) -> tuple[int, int, int, int]:
    """The first four 32-bit groups of sha256('<seed>:<doc_id>'); a null id counts as ''."""
    h = hashlib.sha256(b"%d:%s" % (seed, b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12))


def _unit_starts(c: np.ndarray, inner: np.ndarray, after_letter: bool = False) -> np.ndarray:
    """Positions where a unit (letter run or other code point) starts; ``inner``: starts of further texts."""
    letter = _LETTER[c]
    before = np.empty_like(letter)
    before[:1], before[1:] = after_letter, letter[:-1]
    before[inner] = False
    return np.flatnonzero(np.where(letter, ~before, _HEAD[c]))


def _cuts_of_long(c: np.ndarray, pick) -> tuple[int, list[int]]:
    """Number of units of one long text, and the byte offsets where the units ``pick(n)`` start."""
    none, edges, counts = np.zeros(0, np.int64), range(0, len(c), WINDOW), []
    starts = lambda a: _unit_starts(c[a:a + WINDOW], none, a > 0 and bool(_LETTER[c[a - 1]]))
    for a in edges:
        counts.append(len(starts(a)))
    first = np.append(0, np.cumsum(counts))
    n, out = int(first[-1]), []
    for unit in pick(n):
        if unit >= n:
            out.append(len(c))
        else:
            w = int(np.searchsorted(first, unit, "right")) - 1
            out.append(w * WINDOW + int(starts(w * WINDOW)[unit - first[w]]))
    return n, out


def cuts(data: np.ndarray, off: np.ndarray, hashes) -> tuple[list[int], list[tuple[int, int]]]:
    """Per text of ``data[off[i]:off[i + 1]]``: its number of units and the byte offsets of its two cuts."""
    ends = lambda h, n: sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if len(off) == 2 and off[1] - off[0] > WINDOW:
        n, at = _cuts_of_long(data[off[0]:off[1]], lambda n: ends(hashes[0], n))
        return [n], [tuple(at)]
    rel = off - off[0]
    inner = rel[:-1][(rel[:-1] < rel[-1])]
    starts = _unit_starts(data[off[0]:off[-1]], inner)
    first = np.searchsorted(starts, rel)
    counts, out = np.diff(first).tolist(), []
    for i, (n, h) in enumerate(zip(counts, hashes)):
        out.append(tuple(int(starts[first[i] + u] if u < n else rel[i + 1]) - int(rel[i]) for u in ends(h, n)))
    return counts, out


def _form_of(raw: bytes, h, plain_from: int, spm_below: int) -> str:
    if not raw or any(s in raw for s in SENTINELS) or h[2] % 100 >= plain_from:
        return "plain"
    return "spm" if h[3] % 100 < spm_below else "psm"


_OUT = [("fim_text", pa.string()), ("fim_form", pa.string()), ("fim_units", pa.int64()), ("fim_prefix_chars", pa.int64()),
        ("fim_middle_chars", pa.int64()), ("fim_sha256", pa.string())]
_OUT_DDL = "fim_text string, fim_form string, fim_units long, fim_prefix_chars long, fim_middle_chars long, fim_sha256 string"


def _transform(text: str, doc_id: str, keep: list[str], seed: int, plain_from: int, spm_below: int):
    def run(batches):
        for rb in batches:
            data, off = flat_text(rb.column(rb.schema.get_field_index(text)))
            ids = rb.column(rb.schema.get_field_index(doc_id)).to_pylist()
            passed = [rb.column(rb.schema.get_field_index(c)) for c in keep]
            for i, j in text_groups(off, BATCH):
                hashes = [seeds(x, seed) for x in ids[i:j]]
                units, at = cuts(data, off[i:j + 1], hashes)
                rows = []
                for k, (n, (a, b), h) in enumerate(zip(units, at, hashes)):
                    raw = data[off[i + k]:off[i + k + 1]].tobytes()
                    form = _form_of(raw, h, plain_from, spm_below)
                    table = transformed(raw, a, b, form)
                    head = (None, None) if form == "plain" else (len(raw[:a].decode()), len(raw[a:b].decode()))
                    rows.append((bytes(table), form, n, *head, table.sha256()))
                cols = [pa.array(c, pa.binary() if t == pa.string() and name == "fim_text" else t).cast(t)
                        for (name, t), c in zip(_OUT, zip(*rows))]
                yield pa.RecordBatch.from_arrays([p.slice(i, j - i) for p in passed] + cols, names=keep + [n for n, _ in _OUT])
    return run


def fim_transform(spark: SparkSession, docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: int = 1,
                  plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``docs`` without ``text`` and with fim_text, fim_form, fim_units, fim_prefix_chars, fim_middle_chars, fim_sha256.

    Units are runs of ASCII letters and single other code points.  The two cuts
    and the form come from ``seeds``: plain (the text itself, for empty texts,
    texts that hold a sentinel, and ``100 - plain_from`` % of the others), spm
    (``spm_below`` % of the rest) or psm.  A null text counts as empty; a null
    id as ''; rows that share an id and a text get the same result.  Columns
    named like the new ones are replaced, all others pass through.  Map-only:
    one task holds one Arrow batch and a result batch of ``BATCH`` bytes.
    """
    new = {n for n, _ in _OUT}
    keep = [c for c in docs.columns if c.lower() not in new and c.lower() != text.lower()]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    need = keep + [c for c in (text,) if c not in keep]
    return docs.select(*[f"`{c}`" for c in need]).mapInArrow(_transform(text, doc_id, keep, seed, plain_from, spm_below),
                                                             ", ".join([*fields, _OUT_DDL]))


def _restore(text: str, form: str, keep: list[str]):
    def run(batches):
        for rb in batches:
            data, off = flat_text(rb.column(rb.schema.get_field_index(text)))
            forms = rb.column(rb.schema.get_field_index(form)).to_pylist()
            passed = [rb.column(rb.schema.get_field_index(c)) for c in keep]
            for i, j in text_groups(off, BATCH):
                tables = [restored(data[off[k]:off[k + 1]].tobytes(), forms[k]) for k in range(i, j)]
                cols = [pa.array([bytes(t) for t in tables], pa.binary()).cast(pa.string()),
                        pa.array([t.sha256() for t in tables], pa.string())]
                yield pa.RecordBatch.from_arrays([p.slice(i, j - i) for p in passed] + cols,
                                                 names=keep + ["restored_text", "restored_sha256"])
    return run


def fim_restore(spark: SparkSession, df: DataFrame, *, text: str = "fim_text", form: str = "fim_form") -> DataFrame:
    """``df`` without ``text`` and with restored_text, restored_sha256: the documents that ``fim_transform`` was given.

    Reads nothing but the transformed text and its form.  A text that does not
    have its form's sentinels fails the job.  Null texts count as empty.
    """
    keep = [c for c in df.columns if c.lower() not in ("restored_text", "restored_sha256") and c.lower() != text.lower()]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    return df.select(*[f"`{c}`" for c in [*keep, text]]).mapInArrow(
        _restore(text, form, keep), ", ".join([*fields, "restored_text string, restored_sha256 string"]))


def fim_digest(out: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: n, form, prefix_chars, middle_chars and the hashes of output and restored text."""
    return out.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("fim_units").alias("n"), F.col("fim_form").alias("form"),
                      F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
                      F.col("fim_sha256").alias("output_sha256"), "restored_sha256")
