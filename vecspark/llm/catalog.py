"""The registered queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import decontaminate, fim, flat_graph, langid, licenses, line_dedup, mixing, ngram_jaccard, prefix_trie, sharding, token_records, topk, warc
from .storage import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file that the environment provides."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination_digest(decontaminate.find_contamination(spark, docs, items))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_join(spark, table(spark, sf_dir, "documents"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-records")
    token_records.write_token_records(spark, table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_records.token_digest(token_records.read_token_records(spark, path))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(spark, table(spark, sf_dir, "pages"), path)
    return warc.warc_digest(spark, path)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language_model(spark, docs, vocabulary("piece_bpe_32k.model"))
    return (langid.predict_language(spark, docs.select("doc_id", "text"), model)
            .select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(spark, table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_digest(line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(spark, table(spark, sf_dir, "documents"))


#: shares of all tokens that the mixture should have
MIX_TARGETS = {"good": 0.8, "poor": 0.19, "toxic": 0.01}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixing.mix_to_targets(spark, docs, table(spark, sf_dir, "labels"), mixing.label_domain(), MIX_TARGETS)
    part = lambda i: F.round(F.get("posterior", F.lit(i)), 6)
    return out.select("doc_id", "n_tokens", part(0).alias("p_good"), part(1).alias("p_poor"), part(2).alias("p_toxic"),
                      F.round("rate", 6).alias("rate"), "copies")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark, table(spark, sf_dir, "conversations")).drop("key", "parent")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.fim_digest(fim.fim_restore(spark, fim.fim_transform(spark, docs)))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicate_vectors(spark, table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_exact_topk, op3_ngram_jaccard, op4_token_records, op5_warc,
                            op6_language_id, op7_license_scan, op8_line_dedup, op9_sharding, op10_mixing, op11_prefix_trie, op12_fim, op13_embedding_dedup,
                            pipeline)}

#: crc32 of a decimal number's digits {s}
_CRC32 = """xor(4294967295, list_reduce(list_transform(range(1, len({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT), lambda c, b:
list_reduce(range(8), lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT))"""
_WORDS1 = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS3 = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS1.format(t='text')}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS1.format(t='text')}, []) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p, least(10, len(w)) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
cand AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
         FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM d, sizes)),
hit AS (SELECT doc_id, item_id, i, win.n FROM cand JOIN win USING (p, n)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s
          FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_exact_topk": """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM q),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score
      FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS3.format(t='text')}, []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h
       FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach(doc_id, r) AS (SELECT x, x FROM link UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) c USING (doc_id)""",
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op8_line_dedup": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i - 1 AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS t
      FROM (SELECT doc_id, ls, unnest(range(1, greatest(1, len(ls) - 1))) AS i FROM d)),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + s AS pos FROM later, (VALUES (0), (1), (2)) v(s)),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id)::BIGINT AS n_removed,
       CASE WHEN text IS NOT NULL THEN md5(coalesce(t, '')) END AS kept_md5
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, strlen(coalesce(text, ''))::BIGINT AS b,
                  md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'k': k, 'b': b}} ORDER BY turn NULLS FIRST, k) AS l FROM t GROUP BY conv_id),
c AS (SELECT conv_id, l, conv_id - conv_id % 5 AS src, {_CRC32.format(s='conv_id::VARCHAR')} % 9 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(s.l, [])[1:c.h], c.l[c.h + 1:]) AS l FROM c LEFT JOIN o s ON s.conv_id = c.src),
p AS (SELECT conv_id, d, len(l) AS n, array_to_string(list_transform(l[1:d], lambda x: x.k), ',') AS key,
             array_to_string(list_transform(l[1:d + 1], lambda x: x.k), ',') AS next, CASE WHEN d > 0 THEN l[d].b ELSE 0 END AS b
      FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM r)),
v AS (SELECT key, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(b) AS b,
             count(DISTINCT CASE WHEN n > d THEN next END) AS n_children,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS e FROM p GROUP BY key),
up AS (SELECT p.key, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n_convs - 1) * v.b) AS saved
       FROM v JOIN p ON p.conv_id = v.conv_id AND p.d <= v.depth GROUP BY p.key),
par AS (SELECT v.key, w.conv_id AS parent_conv_id FROM v JOIN p ON p.conv_id = v.conv_id AND p.d = v.depth - 1 JOIN v w ON w.key = p.key)
SELECT v.conv_id, v.depth::BIGINT AS depth, par.parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(e) AS ends_sha256
FROM v JOIN up USING (key) LEFT JOIN par USING (key)""",
    "op12_fim": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
                  THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
             array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s""",
    "op13_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x),
reach(vec_id, r) AS (SELECT x, x FROM link UNION SELECT reach.vec_id, link.y FROM reach JOIN link ON link.x = reach.r),
c AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, e.vec_id) AS component_id,
       coalesce(c.c, e.vec_id) IS NOT DISTINCT FROM e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id""",
}
