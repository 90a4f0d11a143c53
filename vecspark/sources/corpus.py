"""Query / passage corpora from nested examples, flat records or generators.

Source order is an explicit position column everywhere (``example_pos``,
``pos``); "first n" means ``position < n`` after a distributed dense
numbering, never a single-partition window or a driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.constants import (
    ACTIONS, OBJECTS, PASSAGE_ID_FMT, PASSAGE_MIN_CHARS, QUERY_MIN_CHARS, RANDOM_SEED,
    SYNTHETIC_QUERY_FMT, SYNTHETIC_TEMPLATE, SYNTHETIC_TEXT_FMT, TEXT_FIELDS, TOPICS,
)
from vecspark.functions.hashing import gaussian, md5_u32
from vecspark.functions.text import py_strip
from vecspark.functions.vector import l2_normalize
from vecspark.operators.ids import dense_index
from vecspark.schemas import EXAMPLE


# ---------------------------------------------------------------------------
# nested examples
# ---------------------------------------------------------------------------

def read_examples(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Examples with the declared nested schema plus a dense ``example_pos``."""
    df = spark.read.schema(EXAMPLE).format(fmt).load(path)
    return dense_index(df.withColumn("_in", F.monotonically_increasing_id()), ["_in"], "example_pos").drop("_in")


def examples_from_conversations(conv: DataFrame) -> DataFrame:
    """Conversations in the nested example model (``passages`` struct of arrays).

    query = first user turn, passages = assistant turns in turn order,
    is_selected = (turn % 4 == 1); only conversations with both roles.  This
    builds one array per conversation; the evaluation pipeline uses the flat
    ``conversation_examples`` instead, which never groups texts.
    """
    user = F.col("role") == "user"
    asst = F.col("role") == "assistant"
    g = conv.groupBy("conv_id").agg(
        F.min_by(F.col("text"), F.when(user, F.col("turn"))).alias("query"),
        F.array_sort(F.collect_list(F.when(asst, F.struct("turn", "text")))).alias("_a"))
    return (g.where(F.col("query").isNotNull() & (F.size("_a") > 0))
            .select(F.col("conv_id").alias("example_pos"), F.col("conv_id").alias("query_id"), "query",
                    F.struct(F.transform("_a", lambda x: x["text"]).alias("passage_text"),
                             F.transform("_a", lambda x: (x["turn"] % 4 == 1).cast("int")).alias("is_selected"))
                    .alias("passages")))


def as_text_list(df: DataFrame, path: str) -> Column:
    """A passage-text field as array<string>; a scalar string becomes a 1-element list."""
    dt = df.select(path).schema.fields[0].dataType
    c = F.col(path)
    if isinstance(dt, T.ArrayType):
        return c
    return F.when(c.isNotNull(), F.array(c.cast("string")))


class Examples(NamedTuple):
    """Judged examples as two flat tables (no per-example arrays needed).

    queries:  (example_pos, query_id, query)                       one row per example
    passages: (example_pos, pos, passage_text, is_selected)        one row per passage
    """
    queries: DataFrame
    passages: DataFrame


def explode_examples(nested: DataFrame) -> Examples:
    """Nested examples (``passages`` struct of arrays) -> flat tables; map-only."""
    q = nested.select("example_pos", "query_id", "query")
    p = (nested.select("example_pos", F.posexplode(F.arrays_zip(
            as_text_list(nested, "passages.passage_text").alias("t"),
            F.col("passages.is_selected").alias("s"))).alias("pos", "z"))
         .select("example_pos", F.col("pos").cast("long").alias("pos"),
                 F.col("z.t").alias("passage_text"), F.col("z.s").alias("is_selected")))
    return Examples(q, p)


def conversation_examples(conv: DataFrame) -> Examples:
    """Conversation turns as judged examples, without grouping any texts.

    query = first user turn (``min_by``, a partial aggregate: a conversation
    with a huge number of turns is combined map-side), passages = the
    assistant turns themselves (position = turn), is_selected = turn % 4 == 1;
    only conversations with both roles.
    """
    user = F.col("role") == "user"
    asst = F.col("role") == "assistant"
    q = (conv.groupBy("conv_id")
         .agg(F.min_by(F.col("text"), F.when(user, F.col("turn"))).alias("query"),
              F.max(asst.cast("int")).alias("_a"))
         .where(F.col("query").isNotNull() & (F.col("_a") == 1))
         .select(F.col("conv_id").alias("example_pos"), F.col("conv_id").alias("query_id"), "query"))
    p = (conv.where(asst)
         .join(q.select(F.col("example_pos").alias("conv_id")), "conv_id", "left_semi")
         .select(F.col("conv_id").alias("example_pos"), F.col("turn").cast("long").alias("pos"),
                 F.col("text").alias("passage_text"), (F.col("turn") % 4 == 1).cast("int").alias("is_selected")))
    return Examples(q, p)


def _valid_passages(passages: DataFrame, min_chars: int) -> DataFrame:
    return (passages.withColumn("text", py_strip("passage_text"))
            .where(F.col("passage_text").isNotNull() & (F.char_length("text") > min_chars)))


def passage_extract(examples: Examples, n: int | None = None, *, min_chars: int = PASSAGE_MIN_CHARS,
                    max_n: int | None = None) -> DataFrame:
    """First ``n`` stripped passages longer than ``min_chars`` in document order
    (also stopping after ``n`` examples; None: all) -> (vector_id, text).

    ``max_n`` clamps the request (``n = min(n, max_n)``) like the CLI limit.
    """
    if max_n is not None:
        n = max_n if n is None else min(n, max_n)
    p = examples.passages if n is None else examples.passages.where(F.col("example_pos") < n)
    out = dense_index(_valid_passages(p, min_chars).select("example_pos", "pos", "text"), ["example_pos", "pos"], "vector_id")
    return (out if n is None else out.where(F.col("vector_id") < n)).select("vector_id", "text")


def passage_field_fallback(flat: DataFrame, *, id_col: str, fields: Sequence[str] = TEXT_FIELDS,
                           min_chars: int = PASSAGE_MIN_CHARS) -> DataFrame:
    """First non-empty of the text fields present, stripped, longer than min_chars."""
    present = [f for f in fields if f in flat.columns]
    if not present:
        raise ValueError(f"none of {list(fields)} in {flat.columns}")
    first = F.coalesce(*[F.nullif(F.col(f).cast("string"), F.lit("")) for f in present])
    return (flat.select(F.col(id_col), py_strip(first).alias("text"))
            .where(F.char_length("text") > min_chars))


def passage_topup(first: DataFrame, second: DataFrame, n: int | None, *, second_pos: str,
                  second_field: str = "passage", min_chars: int = PASSAGE_MIN_CHARS) -> DataFrame:
    """First-pass passages, then a second pass over ``second_field`` until n rows (None: all)."""
    a = first.select(F.lit(0).alias("pass"), F.col("vector_id").alias("pos"), "text")
    b = (second.select(F.lit(1).alias("pass"), F.col(second_pos).cast("long").alias("pos"),
                       py_strip(F.col(second_field)).alias("text"))
         .where(F.char_length("text") > min_chars))
    out = dense_index(a.unionByName(b), ["pass", "pos"], "vector_id")
    return (out if n is None else out.where(F.col("vector_id") < n)).select("vector_id", "text", "pass")


def query_extract(examples: Examples, n: int | None = None, *, min_chars: int = QUERY_MIN_CHARS) -> DataFrame:
    """First ``n`` (None: all) stripped queries longer than ``min_chars`` -> (query_id, text, example_pos)."""
    q = (examples.queries.select("example_pos", py_strip("query").alias("text"))
         .where(F.char_length("text") > min_chars))
    out = dense_index(q, ["example_pos"], "query_id")
    return (out if n is None else out.where(F.col("query_id") < n)).select("query_id", "text", "example_pos")


def passage_ids(passages: DataFrame) -> DataFrame:
    """Stable named ids ``p_<position>``."""
    return passages.select("vector_id", F.format_string(PASSAGE_ID_FMT, F.col("vector_id")).alias("passage_id"),
                           "text")


def last_wins(df: DataFrame, key_cols: Sequence[str], pos_col: str) -> DataFrame:
    """Per key, the row with the greatest position (dict-overwrite semantics).

    ``max_by`` is a partial aggregate, so a hot key is combined map-side.
    """
    others = [c for c in df.columns if c not in key_cols]
    return (df.groupBy(*key_cols).agg(F.max_by(F.struct(*others), F.col(pos_col)).alias("_w"))
            .select(*key_cols, *[F.col("_w")[c].alias(c) for c in others]))


def qrels_extract(examples: Examples, *, min_query_chars: int = QUERY_MIN_CHARS,
                  min_passage_chars: int = PASSAGE_MIN_CHARS) -> DataFrame:
    """Relevant passages per query text -> (query, example_pos, pos, passage).

    Relevant = is_selected == 1 and stripped length > min_passage_chars, from
    examples whose own stripped query is longer than min_query_chars.  For a
    repeated query text the last example that has relevant passages wins.
    Joins are on ``example_pos`` (one query row per example); a hot example
    is split by AQE's skew-join handling.
    """
    q = (examples.queries.select("example_pos", py_strip("query").alias("query"))
         .where(F.char_length("query") > min_query_chars))
    rel = (_valid_passages(examples.passages.where(F.col("is_selected") == 1), min_passage_chars)
           .select("example_pos", "pos", F.col("text").alias("passage")))
    v = rel.join(q, "example_pos").select("query", "example_pos", "pos", "passage")
    winner = v.groupBy("query").agg(F.max("example_pos").alias("example_pos"))
    return v.join(winner, ["query", "example_pos"], "left_semi")


# ---------------------------------------------------------------------------
# generators (sized by the caller from real tables)
# ---------------------------------------------------------------------------

def _pick(words: Sequence[str], seed: int, slot: str) -> Column:
    arr = F.array(*[F.lit(w) for w in words])
    return F.element_at(arr, (md5_u32(seed, F.col("id"), slot) % len(words) + 1).cast("int"))


def synthetic_corpus(spark: SparkSession, n: int, *, seed: int = RANDOM_SEED,
                     partitions: int | None = None) -> DataFrame:
    """n template passages; word choice by md5 of (seed, id, slot): the same
    rows on any cluster size."""
    t, a, o = _pick(TOPICS, seed, "topic"), _pick(ACTIONS, seed, "action"), _pick(OBJECTS, seed, "object")
    fmt = (SYNTHETIC_TEMPLATE.replace("{topic}", "%1$s").replace("{action}", "%2$s")
           .replace("{obj}", "%3$s"))
    return (spark.range(0, n, numPartitions=partitions)
            .select(F.col("id").alias("vector_id"), F.format_string(fmt, t, a, o).alias("text")))


def synthetic_vectors(spark: SparkSession, n: int, dim: int, *, seed: int = RANDOM_SEED,
                      normalize: bool = True, partitions: int | None = None,
                      stream: str | None = None, id_col: str = "vector_id") -> DataFrame:
    """n Gaussian vectors (md5 Box-Muller per (seed, id, d)), optionally unit length.

    ``stream`` names an independent sequence (e.g. ``"query"`` for random
    query vectors, which the original leaves un-normalized: pass
    ``normalize=False``).
    """
    parts = (seed,) if stream is None else (seed, stream)
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: gaussian(*parts, F.col("id"), d))
    df = spark.range(0, n, numPartitions=partitions).select(F.col("id").alias(id_col), v.alias("embedding"))
    if normalize:
        df = df.select(id_col, l2_normalize("embedding").alias("embedding"))
    return df


def placeholder_texts(spark: SparkSession, n: int, kind: str = "query") -> DataFrame:
    fmt = SYNTHETIC_QUERY_FMT if kind == "query" else SYNTHETIC_TEXT_FMT
    idc = "query_id" if kind == "query" else "vector_id"
    return spark.range(0, n).select(F.col("id").alias(idc), F.format_string(fmt, F.col("id")).alias("text"))


def corpus_or_synthetic(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """``real`` if it has any row, else ``synthetic``; decided inside the plan by
    a scalar subquery (no driver branch)."""
    empty = real.limit(1).select(F.count(F.lit(1))).scalar() == 0
    return real.unionByName(synthetic.where(empty))
