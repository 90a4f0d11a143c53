"""Registered query over JSON lines of mixed shapes, written from ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.plans import oracle as O
from vecspark.plans.catalog import register
from vecspark.plans.views import Views
from vecspark.session import scratch_path
from vecspark.sources.variant import read_json_examples


def _lines(v: Views):
    """A JSON line per turn and per document, its shape by turn or id."""
    s = lambda *a: F.to_json(F.struct(*a), {"ignoreNullFields": "false"})
    t, none = F.col("text"), F.lit(None).cast("string")
    turn = v.table("conversations").withColumn("id", F.concat_ws("-", F.lit("c"), "conv_id", "turn"))
    shape = F.col("turn") % 8
    rows = turn.select(
        F.when(shape == 0, s("id", F.struct(F.array(t, none, F.lit("short"), t).alias("passage_text")).alias("passages")))
        .when(shape == 1, s("id", F.struct(t.alias("passage_text")).alias("passages")))
        .when(shape == 2, s("id", F.struct(F.lit(1).alias("n")).alias("passages"), F.lit("").alias("passage"), t.alias("content"), F.lit("a later field").alias("body")))
        .when(shape == 3, s("id", F.lit(None).cast("int").alias("passage"), t.alias("text"), F.lit("not this one").alias("content")))
        .when(shape == 4, s("id", F.array(t).alias("passages"), t.alias("document")))
        .when(shape == 5, s("id", F.struct(none.alias("passage_text")).alias("passages"), t.alias("text")))
        .when(shape == 6, s("id", F.array(t).alias("body")))
        .otherwise(F.concat(F.lit('{"id": "'), F.col("id"))).alias("value"))
    docs = v.table("documents").withColumn("id", F.concat_ws("-", F.lit("d"), "doc_id"))
    kind = F.col("doc_id") % 4
    more = docs.select(
        F.when(kind == 0, s("id", t.alias("document"))).when(kind == 1, s("id", F.lit(1234567890123).alias("body"), t.alias("document")))
        .when(kind == 2, F.to_json(F.array("id", "text"))).otherwise(s("id", F.lit("tiny").alias("passage"))).alias("value"))
    return rows.unionByName(more)


O.cte("vx_c", [], """SELECT 'c-' || conv_id || '-' || turn AS id, turn % 8 AS s, text FROM conversations""")
O.cte("vx_d", [], """SELECT 'd-' || doc_id AS id, doc_id % 4 AS s, text FROM documents""")
O.cte("vx_t", ["vx_c", "vx_d"], f"""SELECT id, pos, field, {O.strip('text')} AS text FROM (
  SELECT id, unnest([0, 3]) AS pos, 'passages.passage_text' AS field, text, s FROM vx_c WHERE s = 0 UNION ALL
  SELECT id, 0, 'passages.passage_text', text, s FROM vx_c WHERE s = 1 UNION ALL
  SELECT id, 0, CASE WHEN text <> '' THEN 'content' ELSE 'body' END, coalesce(nullif(text, ''), 'a later field'), s FROM vx_c WHERE s = 2 UNION ALL
  SELECT id, 0, CASE WHEN text <> '' THEN 'text' ELSE 'content' END, coalesce(nullif(text, ''), 'not this one'), s FROM vx_c WHERE s = 3 UNION ALL
  SELECT id, 0, 'document', nullif(text, ''), s FROM vx_c WHERE s = 4 UNION ALL
  SELECT id, 0, 'document', nullif(text, ''), s FROM vx_d WHERE s = 0 UNION ALL
  SELECT id, 0, 'body', '1234567890123', s FROM vx_d WHERE s = 1)""")


@register("variant_examples", O.sql("""
SELECT id, pos::BIGINT AS pos, field, length(text)::INTEGER AS n_chars, md5(text) AS text_md5, NULL::VARCHAR AS reason FROM vx_t WHERE length(text) > 10
UNION ALL
SELECT CASE WHEN s < 7 THEN id END, -1::BIGINT, NULL, 0::INTEGER, NULL,
       CASE s WHEN 7 THEN 'not_json' WHEN 6 THEN 'not_text' WHEN 5 THEN 'no_text' WHEN 0 THEN 'no_text'
              ELSE CASE WHEN s = 4 AND coalesce(text, '') = '' THEN 'no_text' WHEN s = 1 AND text IS NULL THEN 'no_text' ELSE 'too_short' END END
FROM vx_c WHERE s >= 5 OR NOT EXISTS (SELECT 1 FROM vx_t WHERE vx_t.id = vx_c.id AND length(vx_t.text) > 10)
UNION ALL
SELECT CASE WHEN s <> 2 THEN id END, -1::BIGINT, NULL, 0::INTEGER, NULL,
       CASE WHEN s = 2 THEN 'not_object' WHEN s = 3 THEN 'too_short' WHEN coalesce(text, '') = '' THEN 'no_text' ELSE 'too_short' END
FROM vx_d WHERE s >= 2 OR NOT EXISTS (SELECT 1 FROM vx_t WHERE vx_t.id = vx_d.id AND length(vx_t.text) > 10)
""", "vx_t"))
def q_variant_examples(spark, sf):
    path = scratch_path(spark, "json-lines")
    _lines(Views(spark, sf)).write.text(path)
    got = read_json_examples(spark, path)
    none = lambda kind: F.lit(None).cast(kind)
    return (got.passages.select("id", "pos", "field", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"), none("string").alias("reason"))
            .unionByName(got.rejects.select("id", F.lit(-1).cast("long").alias("pos"), none("string").alias("field"), F.lit(0).alias("n_chars"),
                                            none("string").alias("text_md5"), "reason")))
