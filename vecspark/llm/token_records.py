"""Token ids in length-delimited binary records, with a separate offset index.

A record file is a row of frames: payload length (unsigned 64 bits), masked
checksum of the length, payload, masked checksum of the payload.  A masked
checksum is the CRC-32 turned right by 15 bits plus a constant, so that a
checksum stored among checksummed bytes does not look like one.  The payload:
one byte telling whether there is a document id, the id (signed 64 bits), the
bytes per token id (2 or 4) and the ids, all little-endian.  ``<file>.idx``
holds each record's offset and token count (pairs of signed 64 bits): any order
of reading needs one seek per record.  ``_manifest.json`` names the files of
the writing tasks that succeeded, in order; files of lost attempts are ignored.
An appended write's records follow the earlier ones, an overwriting one's replace them.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import commit_manifest, filesystem, read_manifest, write_bytes
from .storage import tidy

_MASK = 0xA282EAD8                      # fixed value of the record format
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
#: pieces that a worker remembers
MEMO_PIECES = 400_000
#: bytes of text that are encoded at once
PART_BYTES = 2 << 20
#: one record file of a task, at most (a longer record has its own)
ROLL_BYTES = 256 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(buf: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, offset of the next record); raises ValueError where a checksum does not hold."""
    head = buf[at:at + 8]
    if len(head) < 8 or struct.unpack_from("<I", buf, at + 8)[0] != masked_crc(head):
        raise ValueError(f"corrupt record length at {at}")
    n = struct.unpack("<Q", head)[0]
    payload = buf[at + 12:at + 12 + n]
    if len(payload) < n or struct.unpack_from("<I", buf, at + 12 + n)[0] != masked_crc(payload):
        raise ValueError(f"corrupt record at {at}")
    return payload, at + 16 + n


def pack_document(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<?qB", doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack_document(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = struct.unpack_from("<?qB", payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


# ---- data source ----------------------------------------------------------------------------------

@dataclass
class _File(WriterCommitMessage):
    files: list


@dataclass
class _Records(InputPartition):
    path: str
    start: int


class TokenRecordWriter(DataSourceArrowWriter):
    """Rows (doc_id, ids as little-endian unsigned 32-bit integers) to one or more record files per task, in order."""

    def __init__(self, path: str, width: int, overwrite: bool):
        self.path, self.width, self.overwrite = path.rstrip("/"), width, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, files = TaskContext.get().partitionId(), []
        out = name = None
        index: list[int] = []
        size = 0

        def close():
            out.close()
            write_bytes(f"{self.path}/{name}.idx", np.array(index, "<i8").tobytes())
            files.append({"name": name, "task": task, "part": len(files), "records": len(index) // 2,
                          "tokens": sum(index[1::2])})

        store, base = filesystem(self.path)
        for rb in iterator:
            for doc_id, raw in zip(rb.column(0).to_pylist(), rb.column(1)):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                rec = frame(pack_document(doc_id, ids, self.width))
                if out is not None and size + len(rec) > ROLL_BYTES:
                    close()
                    out = None
                if out is None:
                    name, index, size = f"part-{task:06d}-{len(files):04d}-{uuid.uuid4().hex[:12]}.rec", [], 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                out.write(rec)
                index += (size, len(ids))
                size += len(rec)
        if out is not None:
            close()
        return _File(files)

    def commit(self, messages) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["task"], f["part"]))
        commit_manifest(self.path, files, self.overwrite)

    def abort(self, messages) -> None:
        """Files of an aborted job are in no manifest."""


class TokenRecordReader(DataSourceReader):
    """One partition per record file; ``shuffle_seed`` reads each file's records in a seeded random order."""

    def __init__(self, path: str, seed: str | None):
        self.path, self.seed = path.rstrip("/"), seed

    def partitions(self):
        start, parts = 0, []
        for f in read_manifest(self.path) or []:
            parts.append(_Records(f"{self.path}/{f['name']}", start))
            start += f["tokens"]
        return parts or [_Records("", 0)]

    def read(self, part: _Records):
        if not part.path:
            return
        store, p = filesystem(part.path)
        with store.open_input_stream(f"{p}.idx") as f:
            index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
        starts = part.start + np.cumsum(index[:, 1]) - index[:, 1]
        with store.open_input_file(p) as f:
            stops = np.append(index[1:, 0], f.size())
            order = np.arange(len(index))
            if self.seed is not None:
                order = np.random.default_rng(int(self.seed) + part.start).permutation(order)
            rows, held = [], 0
            for i in order:
                f.seek(int(index[i, 0]))
                doc_id, ids = unpack_document(unframe(f.read(int(stops[i] - index[i, 0])))[0])
                rows.append((doc_id, int(starts[i]), len(ids), ids.tobytes()))
                held += ids.nbytes
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      names=["doc_id", "start", "n_tokens", "ids"])


class TokenRecords(DataSource):
    """``format("token_records")``; options: path, width (bytes per id when writing), shuffle_seed."""

    @classmethod
    def name(cls):
        return "token_records"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TokenRecordReader(self.options["path"], self.options.get("shuffle_seed"))

    def writer(self, schema, overwrite):
        return TokenRecordWriter(self.options["path"], int(self.options.get("width", 4)), overwrite)


# ---- tokenizing -----------------------------------------------------------------------------------

#: classes of characters; texts of the first four are cut alike by all versions of Unicode, others go to the library whole
_LETTER, _NUMBER, _MARK, _SPACE, _OTHER = range(5)
_APOSTROPHE = ord("'")
#: what follows the apostrophe of a contraction that is a piece by itself
_SHORT = ((ord("s"),), (ord("t"),), (ord("r"), ord("e")), (ord("v"), ord("e")), (ord("m"),), (ord("l"), ord("l")), (ord("d"),))


def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    of = {"L": _LETTER, "N": _NUMBER, "P": _MARK, "S": _MARK, "M": _MARK, "C": _MARK}
    for lo, hi in ((0x20, 0x7F), (0xA1, 0xAD), (0xAE, 0x250), (0x2010, 0x2028), (0x2030, 0x203B), (0x20AC, 0x20AD)):
        for c in range(lo, hi):
            out[c] = of.get(unicodedata.category(chr(c))[0], _OTHER)
    out[[9, 10, 13, 32]] = _SPACE
    return out


_CLASS = _classes()


def cut_pieces(chars: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer's pieces begin, in plain texts laid end to end (``first``: a text's first character).

    The rule: ``'(?:s|t|re|ve|m|ll|d)| ?L+| ?N+| ?[^ LN]+|\\s+(?!\\S)|\\s+``.  A run of
    white space leaves its last character over to what follows it; a space joins that.
    """
    n = len(chars)
    start = first.copy()
    start[1:] |= cls[1:] != cls[:-1]
    after = np.flatnonzero(~first[1:] & (cls[1:] != _SPACE) & (cls[:-1] == _SPACE)) + 1
    start[after - 1] = True
    start[after] = chars[after - 1] != 32
    own = np.flatnonzero(start & (chars == _APOSTROPHE))
    for tail in _SHORT:
        at = own[own + len(tail) < n]
        for j, c in enumerate(tail, 1):
            at = at[(chars[at + j] == c) & ~first[at + j]]
        start[at + 1] = False
        end = at + 1 + len(tail)
        start[end[end < n]] = True
    return np.flatnonzero(start)


def _strings(offsets: np.ndarray, data) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), data)


def _gather(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of the pieces ``take`` one after another, their number before each piece and at the end); piece i has ``size[i]`` from ``begin[i]``."""
    n = size[take]
    at = np.append(0, np.cumsum(n))
    where = np.repeat(begin[take] - at[:-1], n)
    where += np.arange(at[-1])
    return ids[where], at


class Encoder:
    """Token ids of texts with a ``tokenizers`` byte-level BPE; repeated pieces are encoded once per worker.

    The memory stops growing at its bound; by then it holds the frequent pieces.
    """

    def __init__(self, tokenizer_json: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        #: pieces may be encoded by themselves: plain byte-level BPE and nothing else
        self.by_piece = (spec.get("normalizer") is None and spec.get("post_processor") is None
                         and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
                         and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: the remembered pieces with their numbers, where the ids of each begin and how many they are, and the ids
        self.pieces: dict[str, int] = {}
        self.begin, self.size, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")
        #: by id: whether the token begins with the byte of a space
        vocab = spec["model"]["vocab"]
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each piece's) of pieces of the form space and letters: laid end to end they are cut back into these pieces."""
        ids = np.array(self.tok.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))       # a space only opens a piece

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the pieces, where each piece's begin, their number)."""
        word = np.fromiter((p[0] == " " and p[1:].isalpha() for p in pieces), bool, len(pieces))
        size, parts = np.zeros(len(pieces), np.int64), []
        if word.any():
            ids, size[word] = self._words([p for p, w in zip(pieces, word) if w])
            parts.append(ids)
        others = [e.ids for e in self.tok.encode_batch_fast([p for p, w in zip(pieces, word) if not w], add_special_tokens=False)]
        size[~word] = [len(x) for x in others]
        parts.append(np.fromiter(chain.from_iterable(others), "<u4"))
        at = np.zeros(len(pieces), np.int64)
        order = np.append(np.flatnonzero(word), np.flatnonzero(~word))
        at[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(parts), at, size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        ids, cut = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, cut[1:-1])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the last one's end); a null text is empty."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = np.frombuffer(b"".join(t.as_buffer() for t in texts).decode().encode("utf-32-le"), "<u4")
        cls = _CLASS[chars]
        width = np.uint8(1) + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        begin = np.append(0, np.cumsum(width, dtype=np.int64))                                  # bytes before each character
        text_at = np.searchsorted(begin, np.append(0, np.cumsum(size)))         # characters before each text
        other = np.append(0, np.cumsum(cls == _OTHER, dtype=np.int64))[text_at]
        plain = other[1:] == other[:-1] if self.by_piece else np.zeros(len(texts), bool)
        for s in self.special:
            plain &= ~pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        keep = np.repeat(plain, np.diff(text_at))
        out, sizes = self._plain(chars[keep], cls[keep], width[keep], np.diff(text_at)[plain])
        cut = np.append(0, np.cumsum(sizes))
        if plain.all():
            return out, cut
        parts, mine = [], iter(zip(cut, cut[1:]))
        for i, p in enumerate(plain):
            parts.append(out[slice(*next(mine))] if p else self._whole(texts[i].as_py()))
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))

    def _plain(self, chars: np.ndarray, cls: np.ndarray, width: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of plain texts of so many characters laid end to end, number of ids of each)."""
        if not len(chars):
            return np.zeros(0, "<u4"), np.zeros(len(lengths), np.int64)
        text_at = np.append(0, np.cumsum(lengths))
        first = np.zeros(len(chars), bool)
        first[text_at[:-1][lengths > 0]] = True
        at = cut_pieces(chars, cls, first)
        data = pa.py_buffer(chars.tobytes().decode("utf-32-le").encode())
        pieces = _strings(np.append(0, np.cumsum(width, dtype=np.int64))[np.append(at, len(chars))], data)
        named = pieces.dictionary_encode()
        begin, size, ids = self._lookup(named.dictionary)
        out, before = _gather(ids, begin, size, named.indices.to_numpy())
        return out, np.diff(before[np.searchsorted(at, text_at)])

    def _lookup(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each of different pieces begin, their number, and all ids."""
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.pieces.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        begin, size = (np.append(x, 0)[number].astype(np.int64) for x in (self.begin, self.size))
        if not len(new):
            return begin, size, self.ids
        names = [names[i] for i in new]
        fresh, at, size[new] = self._pieces(names)
        begin[new] = len(self.ids) + at
        ids = np.append(self.ids, fresh)
        if len(self.pieces) < MEMO_PIECES:
            self.pieces.update(zip(names, range(len(self.pieces), len(self.pieces) + len(new))))
            self.begin, self.size = np.append(self.begin, begin[new].astype(np.int32)), np.append(self.size, size[new].astype(np.int32))
            self.ids = ids
        return begin, size, ids


_encoders: dict[int, Encoder] = {}


def _encode(spec, end_id: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = _encoders.get(hash(spec.value))
        if enc is None:
            _encoders.clear()
            enc = _encoders[hash(spec.value)] = Encoder(spec.value)
        for rb in batches:
            ids, texts = rb.column(0), rb.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < rb.num_rows:                      # about PART_BYTES of text at once, a longer text by itself
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PART_BYTES, side="right")))
                tokens, cut = enc.encode_column(texts.slice(a, b - a))
                tokens = np.insert(tokens, cut[1:], end_id)
                cut = (cut + np.arange(len(cut))) * 4
                col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cut), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), col.cast(pa.binary())], names=["doc_id", "ids"])
                a = b
    return run


def write_token_records(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0,
                        text: str = "text", doc_id: str = "doc_id", mode: str = "append") -> None:
    """Encode every whole text, append ``end_id`` and write record files to ``path`` in ascending doc_id order.

    ``tokenizer``: path of a ``tokenizers`` JSON file on the driver; its text is
    sent to the workers.  Null text: only the end id.  Null ids come first;
    rows of one id are ordered by text.  Other columns are not read.  An empty
    table writes an empty manifest.  ``mode``: "append" puts the records after
    those that ``path`` holds, "overwrite" in their place.
    """
    import json

    spark.dataSource.register(TokenRecords)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    model = json.loads(spec)
    top = max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ids = rows.mapInArrow(tidy(_encode(spark.sparkContext.broadcast(spec), end_id)), "doc_id long, ids binary")
    ids.write.format("token_records").option("path", path).option("width", 2 if top < 1 << 16 else 4).mode(mode).save()


def read_token_records(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the records; every frame's checksums are verified."""
    spark.dataSource.register(TokenRecords)
    r = spark.read.format("token_records").option("path", path)
    return (r if shuffle_seed is None else r.option("shuffle_seed", str(shuffle_seed))).load()


def token_digest(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
