"""A vector store as a Spark data source: ``format("vector_store")``.

Writing checks every row (id not null, vector not null, without null components,
of ``dim`` components) and sends the good ones in requests of ``batch`` rows; a
request becomes a row group of the task's file.  Bad rows fail the write, or are
counted by reason with ``on_reject=count``.  Each task reports its file, rows,
range of ids and rejects in its commit message; the commit lists them in
``_store.json``, so that files of failed attempts are never read.  Reading plans
a partition per listed file; with a range or a list of ids, files are pruned by
their range of ids and row groups by their statistics.  These are options of the
read, not pushed predicates: Spark keeps pushed ones with the DataFrame, and its
next query, or another branch of the same one, would lose rows.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from vecspark.constants import INGEST_BATCH
from vecspark.session import ensure_checkpoint_dir

SCHEMA = "vector_id long, embedding array<float>, metadata string"
_ARROW = pa.schema([("vector_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("metadata", pa.string())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    """The committed files, and what each holds."""
    files, base = _store(path.rstrip("/"))
    try:
        with files.open_input_stream(f"{base}/_store.json") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {"files": []}


@dataclass
class _Sent(WriterCommitMessage):
    files: list = field(default_factory=list)


@dataclass
class _File(InputPartition):
    name: str


class VectorStoreWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dim: int, batch: int, count_rejects: bool, overwrite: bool):
        self.path, self.dim, self.batch, self.count_rejects, self.overwrite = path.rstrip("/"), dim, batch, count_rejects, overwrite

    def _checked(self, rows: pa.Table, rejects: Counter) -> pa.Table:
        vec = rows["embedding"].combine_chunks()
        sizes = vec.value_lengths()
        holes = pc.is_in(pa.array(range(len(vec)), pa.int64()), pc.list_parent_indices(vec).filter(pc.is_null(vec.flatten())).cast(pa.int64()))
        reason = pc.case_when(pc.make_struct(pc.is_null(rows["vector_id"].combine_chunks()), pc.is_null(vec), holes, pc.not_equal(sizes, self.dim)),
                              "vector_id is null", "embedding is null", "component is null", "dimension")
        bad = reason.drop_null()
        if len(bad):
            if not self.count_rejects:
                raise ValueError(f"vector_store refuses a row: {bad[0].as_py()}")
            rejects.update(bad.to_pylist())
        return rows.filter(pc.is_null(reason))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import pyarrow.parquet as pq

        files, base = _store(self.path)
        name, rejects, out, held = f"{uuid.uuid4().hex}.parquet", Counter(), None, _ARROW.empty_table()
        rows = requests = 0
        least = most = None

        def send(request: pa.Table) -> None:
            nonlocal out, rows, requests, least, most
            if out is None:
                files.create_dir(base, recursive=True)
                out = pq.ParquetWriter(f"{base}/{name}", _ARROW, filesystem=files)
            out.write_table(request, row_group_size=self.batch)
            ids = pc.min_max(request["vector_id"])
            least = ids["min"].as_py() if least is None else min(least, ids["min"].as_py())
            most = ids["max"].as_py() if most is None else max(most, ids["max"].as_py())
            rows, requests = rows + request.num_rows, requests + 1

        for rb in iterator:
            new = self._checked(pa.Table.from_batches([rb]).select(_ARROW.names).cast(_ARROW), rejects)
            held = pa.concat_tables([held, new])
            while held.num_rows >= self.batch:
                send(held.slice(0, self.batch))
                held = held.slice(self.batch)
        if held.num_rows:
            send(held)
        if out is not None:
            out.close()
        return _Sent([{"name": name if rows else None, "rows": rows, "requests": requests, "least": least, "most": most,
                       "rejects": dict(rejects)}] if rows or rejects else [])

    def commit(self, messages) -> None:
        new = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["least"] is None, f["least"], f["name"]))
        earlier = manifest(self.path)["files"]
        files, base = _store(self.path)
        files.create_dir(base, recursive=True)
        draft = f"{base}/_{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"files": new if self.overwrite else earlier + new}).encode())
        files.move(draft, f"{base}/_store.json")
        for f in earlier if self.overwrite else []:
            if f["name"]:
                files.delete_file(f"{base}/{f['name']}")

    def abort(self, messages) -> None:
        """Files of an aborted write are in no list."""


class VectorStoreReader(DataSourceReader):
    def __init__(self, path: str, least: int | None, most: int | None, ids: list[int] | None):
        self.path, self.least, self.most, self.ids = path.rstrip("/"), least, most, None if ids is None else sorted(set(ids))

    def _may_hold(self, least: int, most: int) -> bool:
        """Whether a file of ids from ``least`` to ``most`` can have a wanted one."""
        if (self.least is not None and most < self.least) or (self.most is not None and least > self.most):
            return False
        if self.ids is None:
            return True
        at = bisect_left(self.ids, least)
        return at < len(self.ids) and self.ids[at] <= most

    def partitions(self):
        files = [f for f in manifest(self.path)["files"] if f["name"] and self._may_hold(f["least"], f["most"])]
        return [_File(f["name"]) for f in files] or [_File("")]

    def read(self, part: _File):
        import pyarrow.dataset as ds

        if not part.name:
            return
        files, base = _store(self.path)
        key, keep = pc.field("vector_id"), None
        for test in (None if self.least is None else key >= self.least, None if self.most is None else key <= self.most,
                     None if self.ids is None else key.isin(self.ids)):
            if test is not None:
                keep = test if keep is None else keep & test
        for rb in ds.dataset(f"{base}/{part.name}", schema=_ARROW, format="parquet", filesystem=files).to_batches(filter=keep):
            if rb.num_rows:
                yield rb


class VectorStore(DataSource):
    """Options: path; when reading least, most and ids (comma-joined); when writing dim, batch (rows of a request) and on_reject ("fail" or "count")."""

    @classmethod
    def name(cls):
        return "vector_store"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        number = lambda k: int(self.options[k]) if k in self.options else None
        wanted = self.options.get("ids")
        return VectorStoreReader(self.options["path"], number("least"), number("most"),
                                 None if wanted is None else [int(x) for x in wanted.split(",") if x])

    def writer(self, schema, overwrite):
        how = self.options.get("on_reject", "fail")
        if how not in ("fail", "count"):
            raise ValueError("on_reject: fail or count")
        return VectorStoreWriter(self.options["path"], int(self.options["dim"]), int(self.options.get("batch", INGEST_BATCH)), how == "count", overwrite)


def write_vectors(df: DataFrame, path: str, dim: int, *, mode: str = "append", batch: int = INGEST_BATCH, on_reject: str = "fail") -> dict:
    """Write (vector_id, embedding, metadata) rows; what this write stored and rejected, and its seconds."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    spark.dataSource.register(VectorStore)
    before = 0 if mode == "overwrite" else len(manifest(path)["files"])
    start = time.perf_counter()
    (df.select("vector_id", "embedding", "metadata").write.format("vector_store").mode(mode)
     .options(path=path, dim=dim, batch=batch, on_reject=on_reject).save())
    taken, files = time.perf_counter() - start, manifest(path)["files"][before:]
    rejects = sum((Counter(f["rejects"]) for f in files), Counter())
    return {"rows": sum(f["rows"] for f in files), "requests": sum(f["requests"] for f in files), "rejects": dict(rejects), "insert_time": taken}


def read_vectors(spark: SparkSession, path: str, *, least: int | None = None, most: int | None = None, ids: Iterable[int] | None = None) -> DataFrame:
    """The stored rows; with ids from ``least`` to ``most``, or among ``ids``, only files and row groups that may hold such are read."""
    ensure_checkpoint_dir(spark)
    spark.dataSource.register(VectorStore)
    options = {"path": path, "least": least, "most": most, "ids": None if ids is None else ",".join(str(int(x)) for x in ids)}
    return spark.read.format("vector_store").options(**{k: v for k, v in options.items() if v is not None}).load()
