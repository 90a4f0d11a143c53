"""Removal of repeated line passages, found by overlapping windows of consecutive lines.

Every run of three consecutive lines is hashed; a window's first occurrence in
(doc_id, position) order stays and the lines that any later occurrence covers
go.  First occurrences come from partial minima, and the windows meet only the
repeated hashes again, in a join that adaptive execution can split, so a window
that a third of all documents hold is no bottleneck.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import unused, write_table

WINDOW = 3
#: the place in the order of documents without an id
_NO_ID = -(1 << 63)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(id, th, h1, h2, pos) of every window; th tells texts of one id apart."""
    lines = F.split("text", "\n", -1)
    at = F.sequence(F.lit(0), F.size("lines") - window)
    parts = lambda i: [F.get("lines", i + s) for s in range(window)]
    hashed = F.transform(at, lambda i: F.struct(F.xxhash64(*parts(i)).alias("h1"), F.xxhash64(F.lit("b"), *parts(i)[::-1]).alias("h2")))
    return (docs.where(F.col("text").isNotNull()).select("id", "th", lines.alias("lines"))
            .where(F.size("lines") >= window).select("id", "th", F.posexplode(hashed).alias("pos", "h"))
            .select("id", "th", "h.h1", "h.h2", "pos"))


def _rewrite(window: int, text_col: str, starts_col: str):
    def run(batches):
        for rb in batches:
            at = rb.schema.get_field_index(text_col)
            out, total, gone = [], [], []
            for text, starts in zip(rb.column(at), rb.column(rb.schema.get_field_index(starts_col))):
                t, s = text.as_py(), starts.as_py()
                if t is None:
                    out.append(None), total.append(0), gone.append(0)
                    continue
                if not s:
                    out.append(t), total.append(t.count("\n") + 1), gone.append(0)
                    continue
                lines = t.split("\n")
                s = np.array(s)
                change = np.zeros(len(lines) + 1, np.int64)      # merged cover of all later windows
                np.add.at(change, s, 1)
                np.add.at(change, s + window, -1)
                covered = np.cumsum(change[:-1]) > 0
                out.append("\n".join(x for x, c in zip(lines, covered) if not c))
                total.append(len(lines)), gone.append(int(covered.sum()))
            names = [c for c in rb.schema.names if c != starts_col]
            cols = [pa.array(out, rb.schema.field(at).type) if c == text_col else rb.column(rb.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                             names=[*names, "n_lines", "n_removed"])
    return run


def dedup_lines(spark: SparkSession, docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages of ``window`` or more lines cut from the texts, plus n_lines and n_removed.

    Lines end at ``\\n`` and are compared as they are.  Texts of fewer lines, and
    null texts (n_lines 0), stay as they are.  Rows of equal id and text count as
    one document; null ids come first in the order.  Columns named n_lines or
    n_removed are replaced; all others pass through.  Windows are told apart by
    128 hashed bits.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    at_id, at_th, at_starts = unused(docs, "__id", "__th", "__starts")
    key = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("th"),
                      F.col(text).alias("text"))
    windows = _windows(key, window)
    place = F.struct("id", "th", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = write_table(spark, first.where("first != last").select("h1", "h2", "first"), "line-windows")
    later = windows.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    starts = later.groupBy("id", "th").agg(F.collect_set("pos").alias(at_starts))
    starts = write_table(spark, starts, "line-starts")
    # merged at every size: the starts grow with the documents, so they are never broadcast
    joined = (docs.withColumns({at_id: F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)), at_th: F.xxhash64(text)})
              .join(starts.withColumnsRenamed({"id": at_id, "th": at_th}).hint("merge"), [at_id, at_th], "left")
              .drop(at_id, at_th))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(_rewrite(window, text, at_starts), f"{fields}, n_lines long, n_removed long")


def dedup_digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))
