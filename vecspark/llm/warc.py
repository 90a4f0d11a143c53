"""WARC archives as a PySpark Python data source.

Writing: one gzip member per record (WARC/1.1), files of bounded size per task,
each with ``<file>.idx`` (the records' offsets); ``_manifest.json`` names the
files of the tasks that succeeded.  Reading: the driver plans partitions over
files; equality, IN and range predicates on header columns are pushed down.  A
record is inflated up to the end of its headers first, the predicates are
tried, and the payload is inflated only for records that pass and only if
payloads are asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
                                    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

from .files import commit_manifest, filesystem, read_manifest, write_bytes
from .storage import write_table

#: a task begins another file beyond this size
ROLL_BYTES = 64 << 20
#: a reading partition holds files up to this size together
PARTITION_BYTES = 64 << 20
#: payload bytes from which equal payloads are stored once
LEAST_DEDUP = 1000
_HEAD = 2048
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("record_type string, record_id string, page_id long, target_uri string, date string, payload_digest string, "
          "payload_bytes long, refers_to long, content_type string, payload binary")
_FIELDS = [x.strip().rsplit(" ", 1)[0] for x in SCHEMA.split(",")]
_ARROW = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string()))
                    for n, t in (x.strip().rsplit(" ", 1) for x in SCHEMA.split(","))])


def _record_id(page: int | None, digest: str, uri: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}|{uri}')}>"


def build_record(page_id: int | None, uri: str | None, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) has HTTP headers only and the full payload's digest and size."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id, digest, uri)}", f"WARC-Date: {date}"]
    if uri is not None:
        # a header's value is one line: control characters and % are percent-encoded, and a header of our own says so
        line = re.sub(r"[\x00-\x20%\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)
        head += [f"WARC-Target-URI: {line}"] + ["X-Target-URI-Escaped: yes"] * (line != uri)
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict:
    """The header columns of a record (its header block without the blank line)."""
    h = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        h[name.strip().lower()] = value.strip()
    number = lambda k: int(h[k]) if k in h else None
    digest = h.get("warc-payload-digest")
    if digest and digest.startswith("sha1:") and len(digest) == 37:
        digest = base64.b32decode(digest[5:]).hex()
    uri = h.get("warc-target-uri")
    if uri is not None and h.get("x-target-uri-escaped") == "yes":        # other writers' escapes are part of the URI
        uri = re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), uri)
    return {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "page_id": number("x-page-id"),
            "target_uri": uri, "date": h.get("warc-date"), "payload_digest": digest, "payload_bytes": number("x-payload-length"),
            "refers_to": number("x-refers-to-page-id"), "content_type": h.get("content-type"),
            "content_length": number("content-length")}


# ---- predicates -------------------------------------------------------------------------------------

_TESTS = {
    EqualTo: lambda v, x: v is not None and v == x, EqualNullSafe: lambda v, x: v == x,
    GreaterThan: lambda v, x: v is not None and v > x, GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x, LessThanOrEqual: lambda v, x: v is not None and v <= x,
    In: lambda v, x: v is not None and v in x, IsNull: lambda v, x: v is None, IsNotNull: lambda v, x: v is not None,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x), StringEndsWith: lambda v, x: v is not None and v.endswith(x),
    StringContains: lambda v, x: v is not None and x in v,
}
_BY_NAME = {cls.__name__: test for cls, test in _TESTS.items()}


def can_push(f) -> tuple | None:
    """(kind, column, value) of a predicate that headers alone decide."""
    if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _FIELDS and f.attribute[0] != "payload":
        return type(f).__name__, f.attribute[0], getattr(f, "value", None)
    return None


# ---- data source ------------------------------------------------------------------------------------

@dataclass
class _Written(WriterCommitMessage):
    files: list = field(default_factory=list)


@dataclass
class _Files(InputPartition):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, payload, digest, refers_to) to record files."""

    def __init__(self, path: str, date: str, overwrite: bool):
        self.path, self.date, self.overwrite = path.rstrip("/"), date, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), _Written()
        store, base = filesystem(self.path)
        out = name = None
        offsets: list[int] = []
        size = 0

        def close():
            out.close()
            write_bytes(f"{self.path}/{name}.idx", np.array(offsets, "<i8").tobytes())
            done.files.append({"name": name, "bytes": size, "records": len(offsets)})

        for rb in iterator:
            for page, uri, payload, digest, refers in zip(*(rb.column(i) for i in range(5))):
                rec = build_record(page.as_py(), uri.as_py(), self.date, payload.as_py(), digest.as_py(), refers.as_py())
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = z.compress(rec) + z.flush()
                if out is not None and size + len(member) > ROLL_BYTES:
                    close()
                    out = None
                if out is None:
                    name, offsets, size = f"part-{task:06d}-{len(done.files):04d}-{uuid.uuid4().hex[:12]}.warc.gz", [], 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                offsets.append(size)
                size += len(member)
        if out is not None:
            close()
        return done

    def commit(self, messages) -> None:
        commit_manifest(self.path, sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"]), self.overwrite)

    def abort(self, messages) -> None:
        """Files of an aborted job are in no manifest."""


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path.rstrip("/"), payload, []

    def pushFilters(self, filters):
        for f in filters:
            test = can_push(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        """Files, small ones together; without a manifest every ``*.warc.gz`` in the folder."""
        files = read_manifest(self.path)
        if files is None:
            store, p = filesystem(self.path)
            files = [{"name": x.path.rsplit("/", 1)[1], "bytes": x.size} for x in store.get_file_info(fs.FileSelector(p))
                     if x.path.endswith(".warc.gz")]
        parts, held, size = [], [], 0
        for f in sorted(files, key=lambda f: f["name"]):
            if held and size + f["bytes"] > PARTITION_BYTES:
                parts.append(_Files(held))
                held, size = [], 0
            held.append(f"{self.path}/{f['name']}")
            size += f["bytes"]
        return [*parts, _Files(held)]

    def wanted(self, head: dict) -> bool:
        return all(_BY_NAME[kind](head[column], value) for kind, column, value in self.tests)

    def read(self, part: _Files):
        rows, held = [], 0
        for path in part.files:
            for head, payload in self._records(path):
                rows.append([head[c] for c in _FIELDS[:-1]] + [payload])
                held += 500 + len(payload or b"")
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, path: str):
        store, p = filesystem(path)
        with store.open_input_file(p) as f:
            try:
                with store.open_input_stream(f"{p}.idx", compression=None) as x:
                    offsets = np.frombuffer(x.read(), "<i8")
            except FileNotFoundError:
                offsets = None
            if offsets is not None:
                stops = np.append(offsets[1:], f.size())
                for a, b in zip(offsets.tolist(), stops.tolist()):
                    f.seek(a)
                    got = self._one(f.read(b - a))
                    if got is not None:
                        yield got
                return
            # no index: the end of a member is only found by inflating it
            left = b""
            while True:
                if not left:
                    left = f.read(1 << 20)
                    if not left:
                        return
                z, parts = zlib.decompressobj(31), []
                while not z.eof:
                    parts.append(z.decompress(left))
                    left = z.unused_data if z.eof else f.read(1 << 20)
                    if not z.eof and not left:
                        raise ValueError(f"{path} ends within a record")
                got = self._split(b"".join(parts))
                if got is not None:
                    yield got

    def _one(self, member: bytes):
        """Headers first; the rest of the record is inflated only if it is wanted."""
        z = zlib.decompressobj(31)
        data = z.decompress(member, _HEAD)
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = z.decompress(z.unconsumed_tail, _HEAD)
            if not more:
                raise ValueError("a record without the end of its headers")
            data += more
        head = parse_headers(data[:end])
        if not self.wanted(head):
            return None
        if not self.payload or head["record_type"] != "response":
            return head, None
        return self._body(head, data[end + 4:] + z.decompress(z.unconsumed_tail) + z.flush())

    def _split(self, record: bytes):
        end = record.index(b"\r\n\r\n")
        head = parse_headers(record[:end])
        if not self.wanted(head):
            return None
        if not self.payload or head["record_type"] != "response":
            return head, None
        return self._body(head, record[end + 4:])

    @staticmethod
    def _body(head: dict, rest: bytes):
        block = rest[:head["content_length"]]
        if len(block) < head["content_length"]:
            raise ValueError("a record is shorter than its Content-Length")
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if head["payload_digest"] is not None and hashlib.sha1(payload).hexdigest() != head["payload_digest"]:
            raise ValueError(f"payload of {head['record_id']} does not match its digest")
        return head, payload


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class Warc(DataSource):
    """``format("warc")``; options: path, payload ("false": headers only), date (of written records)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), overwrite)


# ---- operators --------------------------------------------------------------------------------------

def write_warc(spark: SparkSession, pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url",
               html: str = "html", least_dedup: int = LEAST_DEDUP, mode: str = "append") -> None:
    """A record per row of ``pages``; of equal payloads of ``least_dedup`` bytes or more one is stored.

    That one is the largest page_id's; the others become revisits of it.  Null
    html is an empty payload; a null url is left out; a row without page_id is a
    revisit where an equal payload has an id, else a response.  Rows that share
    the largest page_id and the payload are all responses.  Other columns are
    not read.  An empty table writes an empty manifest.  ``mode``: "append" adds
    archives to those at ``path`` (payloads are compared within one write),
    "overwrite" replaces them.
    """
    spark.dataSource.register(Warc)
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # only digests that occur again meet the payloads once more
    known = (rows.where(F.col("size") >= least_dedup).groupBy("digest", "size")
             .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    known = write_table(spark, known.drop("n"), "warc-known")
    out = (rows.join(known, ["digest", "size"], "left")
           .withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))))
    out.select("page_id", "url", "payload", "digest", "refers_to").write.format("warc").option("path", path).mode(mode).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives; predicates on header columns reach the reader (the session's setting is switched on).

    Spark keeps pushed predicates with a DataFrame: two branches of one query
    need a DataFrame of their own each, as in ``warc_digest``.
    """
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
    # Spark keeps pushed predicates with a DataFrame until others are pushed: one that always holds goes with every query
    return rows.where(~F.col("record_type").eqNullSafe(""))


def warc_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per page, from the archives: responses from their payloads, revisits from their headers."""
    full = read_warc(spark, path).where("record_type = 'response'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
                       "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return full.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
