"""Passages from JSON records whose shape is not known beforehand, as VARIANT values.

One scan: each line is parsed, its shape looked at, its texts taken out, and
what gives no text goes to a rejects table with the reason.  Nothing is
inferred over the file, and no record fails the job.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.constants import PASSAGE_MIN_CHARS, TEXT_FIELDS
from vecspark.functions.text import py_strip


class Ingested(NamedTuple):
    """passages: (id, pos, field, text); rejects: (id, reason, value)."""

    passages: DataFrame
    rejects: DataFrame


def _kind(v: Column) -> Column:
    """'object', 'array', 'null', 'scalar', or null where there is no such field."""
    s = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None).cast("string")).when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
            .when(s == "VOID", "null").otherwise("scalar"))


def _get(v: str, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _truthy(v: Column) -> Column:
    """Whether a field counts as given: not missing, null, '', 0, false, [] or {}."""
    as_json = F.to_json(v)
    return v.isNotNull() & ~as_json.isin("null", '""', "0", "0.0", "false", "[]", "{}")


def ingest_examples(lines: DataFrame, *, value: str = "value", id_path: str = "$.id", fields: Sequence[str] = TEXT_FIELDS,
                    min_chars: int = PASSAGE_MIN_CHARS) -> Ingested:
    """Texts of JSON records (one per row of ``value``), stripped, longer than ``min_chars``.

    * ``passages`` is an object with ``passage_text``: a list gives a text per
      element (``pos`` is its position), a scalar one text, null none; the other
      fields are not looked at.
    * otherwise the first of ``fields`` that is given and not empty.
    * numbers and booleans count as their JSON text; lists and objects are no texts.

    Reasons of rejects: ``not_json``, ``not_object``, ``no_text`` (nothing given,
    or a list without any usable element), ``not_text`` (the chosen field is a
    list or an object), ``too_short``.  A null line is ``not_json``.
    """
    if lines.schema[value].dataType.simpleString() != "string":
        raise ValueError(f"{value} must be a string column")
    rows = lines.select(F.col(value).alias("value"), F.try_parse_json(F.col(value)).alias("v"))
    rows = rows.withColumns({"top": _kind(F.col("v")), "id": _get("v", id_path, "string"), "inner": _kind(_get("v", "$.passages"))})
    nested = _get("v", "$.passages.passage_text")
    rows = rows.withColumn("nested", F.when(F.col("inner") == "object", nested))
    chosen, name = None, None
    for f in fields:
        field = _get("v", f"$.{f}")
        chosen = F.when(_truthy(field), field) if chosen is None else chosen.when(_truthy(field), field)
        name = F.when(_truthy(field), F.lit(f)) if name is None else name.when(_truthy(field), F.lit(f))
    is_nested = F.col("nested").isNotNull()
    rows = rows.withColumns({
        "shape": _kind(F.col("nested")),
        "field": F.when(is_nested, F.lit("passages.passage_text")).otherwise(name),
        "one": F.when(is_nested, F.col("nested")).otherwise(chosen)})
    listed = F.when(F.col("shape") == "array", F.col("nested").try_cast("array<variant>")).otherwise(F.array("one"))
    text_of = lambda x: py_strip(F.when(_kind(x) == "scalar", F.try_variant_get(x, "$", "string")))
    texts = F.transform(listed, lambda x, i: F.struct(i.cast("long").alias("pos"), text_of(x).alias("text")))
    rows = rows.withColumn("found", F.filter(texts, lambda t: F.coalesce(F.char_length(t["text"]) > min_chars, F.lit(False))))
    given = _kind(F.col("one"))
    reason = (F.when(F.col("top").isNull(), "not_json").when(F.col("top") != "object", "not_object")
              .when(F.size("found") > 0, F.lit(None).cast("string"))
              .when(F.col("one").isNull() | (given == "null") | (F.col("shape") == "array"), "no_text")
              .when(given.isin("array", "object"), "not_text").otherwise("too_short"))
    rows = rows.select("id", "field", "found", "value", reason.alias("reason"))
    passages = (rows.where(F.col("reason").isNull()).select("id", "field", F.explode("found").alias("f"))
                .select("id", "f.pos", "field", "f.text"))
    return Ingested(passages, rows.where(F.col("reason").isNotNull()).select("id", "reason", "value"))


def read_json_examples(spark: SparkSession, path: str, **kw) -> Ingested:
    """``ingest_examples`` of the JSON-lines files at ``path``."""
    return ingest_examples(spark.read.text(path), **kw)
