"""Registered queries: one Spark plan + (when SQL-expressible) one DuckDB oracle each.

Every query reads the driver tables under ``sf_dir`` (through ``Views``) and
runs over whole tables.  Computed columns carry the same alias on both
sides; doubles are rounded to the same number of places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.vector import cosine_distance, dot, l2_normalize
from vecspark.operators.knn import ranked_lists, search_one
from vecspark.plans import oracle as O
from vecspark.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle_sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLE[name] = oracle_sql
        return fn
    return deco


def r6(c, n: int = 6):
    return F.round(c, n)


# =============================================================================
# phase 1: vectors and exact k-NN
# =============================================================================

@register("knn_exact", O.sql(
    "SELECT query_id, rank, vector_id, round(score, 4) AS score FROM f_gt", "f_gt"))
def q_knn_exact(spark, sf):
    return Views(spark, sf).gt.select("query_id", "rank", "vector_id", r6("score", 4).alias("score"))


@register("l2_normalize", O.sql("""
SELECT vec_id, unnest(range(len(s)))::INTEGER AS d,
       unnest(list_transform(s, lambda x: round(x / sqrt(list_inner_product(s, s)), 6))) AS value
FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 2)) AS s FROM embeddings)
"""))
def q_l2_normalize(spark, sf):
    e = Views(spark, sf).table("embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("label") + 2))
    return (e.select("vec_id", F.posexplode(l2_normalize(scaled)).alias("d", "x"))
            .select("vec_id", F.col("d").cast("int").alias("d"), r6("x").alias("value")))


@register("index_query_split", O.sql("""
SELECT vec_id, CASE WHEN vec_id < (SELECT c FROM sp) THEN 'index' ELSE 'query' END AS part FROM embeddings
""", "sp"))
def q_index_query_split(spark, sf):
    v = Views(spark, sf)
    return (v.index.select(F.col("vector_id").alias("vec_id"), F.lit("index").alias("part"))
            .unionByName(v.queries.select(F.col("query_id").alias("vec_id"), F.lit("query").alias("part"))))


@register("pairwise_similarity", O.sql(f"""
SELECT a.vec_id, b.vec_id AS next_id, round({O.dot('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""))
def q_pairwise_similarity(spark, sf):
    e = Views(spark, sf).table("embeddings")
    a, b = e.alias("a"), e.alias("b")
    return (a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
            .select(F.col("a.vec_id"), F.col("b.vec_id").alias("next_id"),
                    r6(dot(F.col("a.embedding"), F.col("b.embedding"))).alias("similarity")))


@register("cosine_distance", O.sql("""
WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 2)) AS v FROM embeddings)
SELECT a.vec_id, b.vec_id AS next_id,
       round(1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS distance
FROM s a JOIN s b ON b.vec_id = a.vec_id + 1
"""))
def q_cosine_distance(spark, sf):
    e = Views(spark, sf).table("embeddings")
    s = e.select("vec_id", F.transform(F.col("embedding").cast("array<double>"),
                                       lambda x: x * (F.col("label") + 2)).alias("v"))
    a, b = s.alias("a"), s.alias("b")
    return (a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
            .select(F.col("a.vec_id"), F.col("b.vec_id").alias("next_id"),
                    r6(cosine_distance(F.col("a.v"), F.col("b.v"))).alias("distance")))


_FIRST_Q = "(SELECT v FROM f_query ORDER BY query_id LIMIT 1)"
O.cte("f_one", ["f_index", "f_query"], f"""SELECT vector_id,
  1 - list_inner_product(v, {_FIRST_Q}) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product({_FIRST_Q}, {_FIRST_Q}))) AS distance
  FROM f_index""")


def _first_query_vector(v: Views):
    """The single query: the first row of the query split (one-row DataFrame)."""
    return v.queries.orderBy("query_id").limit(1)


@register("search_one", O.sql(
    "SELECT vector_id, round(distance, 6) AS distance FROM f_one ORDER BY distance, vector_id LIMIT 10", "f_one"))
def q_search_one(spark, sf):
    v = Views(spark, sf)
    return search_one(v.index, _first_query_vector(v), 10).select("vector_id", r6("distance").alias("distance"))


@register("search_one_ids", O.sql(
    "SELECT vector_id FROM f_one ORDER BY distance, vector_id LIMIT 10", "f_one"))
def q_search_one_ids(spark, sf):
    v = Views(spark, sf)
    return search_one(v.index, _first_query_vector(v), 10).select("vector_id")


@register("search_one_payload", O.sql(
    """SELECT vector_id, to_json({'vector_id': vector_id::INTEGER, 'metadata': {'id': vector_id::INTEGER}})::VARCHAR AS payload
FROM f_one ORDER BY distance, vector_id LIMIT 10""", "f_one"))
def q_search_one_payload(spark, sf):
    v = Views(spark, sf)
    vid = F.col("vector_id").cast("int")
    idx = v.index.withColumn("payload", F.to_json(F.struct(vid.alias("vector_id"),
                                                           F.struct(vid.alias("id")).alias("metadata"))))
    return search_one(idx, _first_query_vector(v), 10, keep=["payload"]).select("vector_id", "payload")


@register("batch_search", O.sql("""
SELECT query_id, count(*) AS n_results, string_agg(vector_id::VARCHAR, ',' ORDER BY rank) AS ids
FROM f_gt GROUP BY query_id""", "f_gt"))
def q_batch_search(spark, sf):
    v = Views(spark, sf)
    return ranked_lists(v.gt).select("query_id", F.size("ids").cast("long").alias("n_results"),
                                     F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# =============================================================================
# phase 2: IR metrics against exact neighbours (pred = inverted lists, nprobe 4)
# =============================================================================

def _scores(spark, sf):
    from vecspark.operators.ir import quality_scores
    v = Views(spark, sf)
    return quality_scores(v.pred, v.gt, (1, 5, 10))


def _metric_query(name: str, col: str):
    @register(name, O.sql(f"SELECT k, round({col}, 6) AS {col} FROM qp_sc", "qp_sc"))
    def q(spark, sf):
        return _scores(spark, sf).select("k", r6(col).alias(col))
    q.__name__ = f"q_{name}"
    return q


_metric_query("recall_at_k", "recall")
_metric_query("recall_at_k_standard", "recall_standard")
_metric_query("precision_at_k", "precision")
_metric_query("map_at_k", "map")
_metric_query("ndcg_at_k", "ndcg")


@register("running_precision", O.sql("""
SELECT p.query_id, p.rank, p.vector_id, (g.vector_id IS NOT NULL)::INTEGER AS hit,
       sum((g.vector_id IS NOT NULL)::INTEGER) OVER (PARTITION BY p.query_id ORDER BY p.rank
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running_hits,
       round(sum((g.vector_id IS NOT NULL)::INTEGER) OVER (PARTITION BY p.query_id ORDER BY p.rank
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / p.rank, 6) AS precision_at_rank
FROM f_pred p LEFT JOIN (SELECT DISTINCT query_id, vector_id FROM f_gt WHERE rank <= 10) g
  USING (query_id, vector_id) WHERE p.rank <= 10""", "f_pred", "f_gt"))
def q_running_precision(spark, sf):
    from vecspark.operators.ir import running_precision
    v = Views(spark, sf)
    return running_precision(v.pred, v.gt, 10).withColumn("precision_at_rank", r6("precision_at_rank"))


O.cte("ri_p", ["f_pred"], "SELECT DISTINCT query_id, vector_id FROM f_pred")
O.cte("ri_g", ["f_gt"], "SELECT DISTINCT query_id, vector_id FROM f_gt WHERE rank <= 10")


@register("retrieved_intersection", O.sql("""
SELECT b.query_id, coalesce(c.n, 0)::BIGINT AS n_common
FROM (SELECT DISTINCT query_id FROM ri_p INTERSECT SELECT DISTINCT query_id FROM ri_g) b
LEFT JOIN (SELECT query_id, count(*) AS n FROM ri_p JOIN ri_g USING (query_id, vector_id) GROUP BY 1) c USING (query_id)
""", "ri_p", "ri_g"))
def q_retrieved_intersection(spark, sf):
    from vecspark.operators.ir import retrieved_intersection
    v = Views(spark, sf)
    return retrieved_intersection(v.pred, v.gt, 10)


@register("quality_metrics", O.sql(
    "SELECT database, operation, metric, round(value, 6) AS value, worker_count FROM m_quality",
    "m_quality"))
def q_quality_metrics(spark, sf):
    # query_id (always null for aggregate rows) is left out of the comparison
    return Views(spark, sf).quality_rows.withColumn("value", r6("value")).drop("query_id")


# =============================================================================
# phase 3: approximate search
# =============================================================================

@register("ivf_assign", O.sql("SELECT vector_id, list_id FROM f_assign", "f_assign"))
def q_ivf_assign(spark, sf):
    return Views(spark, sf).index_lists.select("vector_id", "list_id")


@register("ivf_search", O.sql(
    "SELECT query_id, rank, vector_id, round(score, 4) AS score FROM f_pred", "f_pred"))
def q_ivf_search(spark, sf):
    return Views(spark, sf).pred.select("query_id", "rank", "vector_id", r6("score", 4).alias("score"))


@register("ivf_recall_by_nprobe", O.sql("""
SELECT n.nprobe::INTEGER AS nprobe, round(avg(h.n / 10.0), 6) AS recall_at_10
FROM (SELECT p.nprobe, p.query_id, count(g.vector_id) AS n
      FROM f_pred_np p LEFT JOIN f_gt g ON g.query_id = p.query_id AND g.vector_id = p.vector_id
      GROUP BY 1, 2) h JOIN (SELECT unnest([1, 2, 4, 8, 16]) AS nprobe) n USING (nprobe)
GROUP BY n.nprobe""", "f_pred_np", "f_gt"))
def q_ivf_recall_by_nprobe(spark, sf):
    # one scan for all probe counts, then recall@10 per (query, nprobe) against gt
    from vecspark.operators.ann import ivf_sweep
    v = Views(spark, sf)
    sw = ivf_sweep(v.index_lists, v.queries, v.centroids, 10, (1, 2, 4, 8, 16))
    g = v.gt.select("query_id", "vector_id", F.lit(True).alias("_hit"))
    per_q = (sw.join(g, ["query_id", "vector_id"], "left")
             .groupBy("nprobe", "query_id")
             .agg(F.count(F.when(F.col("_hit"), 1)).alias("n"), F.count(F.lit(1)).alias("m")))
    # recall@10 with untruncated predictions of length m: |pred & gt[:10]| / min(m, 10)
    return (per_q.groupBy("nprobe")
            .agg(r6(F.avg(F.col("n") / F.least(F.col("m"), F.lit(10)))).alias("recall_at_10")))


def _lsh(v: Views):
    from vecspark.operators.ann import lsh_search
    return lsh_search(v.index, v.queries, 10, bands=O.LSH_BANDS, bits=O.LSH_BITS, seed=O.LSH_SEED)


@register("lsh_search", O.sql(
    "SELECT query_id, rank, vector_id, round(score, 4) AS score FROM f_lsh", "f_lsh"))
def q_lsh_search(spark, sf):
    return _lsh(Views(spark, sf)).select("query_id", "rank", "vector_id", r6("score", 4).alias("score"))


@register("search_auto", O.sql("""
SELECT 'exact' AS strategy, query_id, rank, vector_id, round(score, 4) AS score FROM f_gt""", "f_gt"))
def q_search_auto(spark, sf):
    from vecspark.operators.ann import search_auto
    v = Views(spark, sf)
    return (search_auto(v.index, v.queries, 10, strategy="exact")
            .select("strategy", "query_id", "rank", "vector_id", r6("score", 4).alias("score")))


@register("compare_strategies", O.sql("""
SELECT 'exact' AS engine, query_id, rank, vector_id, round(score, 4) AS score FROM f_gt UNION ALL
SELECT 'ivf', query_id, rank, vector_id, round(score, 4) FROM f_pred UNION ALL
SELECT 'lsh', query_id, rank, vector_id, round(score, 4) FROM f_lsh""", "f_gt", "f_pred", "f_lsh"))
def q_compare_strategies(spark, sf):
    from vecspark.operators.ann import compare_strategies
    v = Views(spark, sf)
    strategies = {
        "exact": {},
        "ivf": {"centroids": v.centroids, "nprobe": 4},
        "lsh": {"bands": O.LSH_BANDS, "bits": O.LSH_BITS, "seed": O.LSH_SEED},
    }
    return compare_strategies(v.index, v.queries, 10, strategies).select(
        "engine", "query_id", "rank", "vector_id", r6("score", 4).alias("score"))


# =============================================================================
# phase 4: judged evaluation over texts (conversations as judged examples)
# =============================================================================

@register("passage_extract", O.sql("SELECT vector_id, text FROM f_passages", "f_passages"))
def q_passage_extract(spark, sf):
    return Views(spark, sf).passages


@register("passage_field_fallback", O.sql(
    f"SELECT doc_id, {O.strip('nullif(text, %s)' % repr(''))} AS text FROM documents "
    f"WHERE length({O.strip('nullif(text, %s)' % repr(''))}) > 10"))
def q_passage_field_fallback(spark, sf):
    from vecspark.sources.corpus import passage_field_fallback
    return passage_field_fallback(Views(spark, sf).table("documents"), id_col="doc_id")


O.cte("f_topup", ["f_passages"], f"""SELECT vector_id, text, pass FROM (
  SELECT row_number() OVER (ORDER BY pass, pos) - 1 AS vector_id, text, pass FROM (
    SELECT 0 AS pass, vector_id AS pos, text FROM f_passages UNION ALL
    SELECT 1, doc_id, {O.strip('text')} FROM documents WHERE length({O.strip('text')}) > 10))
  WHERE vector_id < {O.N_VEC}""")


@register("passage_topup", O.sql("SELECT vector_id, text, pass FROM f_topup", "f_topup"))
def q_passage_topup(spark, sf):
    from vecspark.sources.corpus import passage_topup
    v = Views(spark, sf)
    return passage_topup(v.passages, v.table("documents"), v.n_vectors, second_pos="doc_id",
                         second_field="text")


@register("query_extract", O.sql("SELECT query_id, text, example_pos FROM f_qfirst", "f_qfirst"))
def q_query_extract(spark, sf):
    return Views(spark, sf).first_queries


@register("passage_ids", O.sql(
    "SELECT vector_id, 'p_' || vector_id AS passage_id, text FROM f_passages", "f_passages"))
def q_passage_ids(spark, sf):
    from vecspark.sources.corpus import passage_ids
    return passage_ids(Views(spark, sf).passages)


# the same over all conversations and documents; the keys above keep their first n rows, as their SQL does

@register("passage_extract_all", O.sql("SELECT vector_id, text FROM f_ptexts", "f_ptexts"))
def q_passage_extract_all(spark, sf):
    return Views(spark, sf).ptexts


O.cte("f_topup_all", ["f_ptexts"], f"""SELECT row_number() OVER (ORDER BY pass, pos) - 1 AS vector_id, text, pass FROM (
    SELECT 0 AS pass, vector_id AS pos, text FROM f_ptexts UNION ALL
    SELECT 1, doc_id, {O.strip('text')} FROM documents WHERE length({O.strip('text')}) > 10)""")


@register("passage_topup_all", O.sql("SELECT vector_id, text, pass FROM f_topup_all", "f_topup_all"))
def q_passage_topup_all(spark, sf):
    from vecspark.sources.corpus import passage_topup
    v = Views(spark, sf)
    return passage_topup(v.ptexts, v.table("documents"), None, second_pos="doc_id", second_field="text")


@register("query_extract_all", O.sql("SELECT query_id, text, example_pos FROM f_qtexts", "f_qtexts"))
def q_query_extract_all(spark, sf):
    return Views(spark, sf).qtexts


@register("passage_ids_all", O.sql(
    "SELECT vector_id, 'p_' || vector_id AS passage_id, text FROM f_ptexts", "f_ptexts"))
def q_passage_ids_all(spark, sf):
    from vecspark.sources.corpus import passage_ids
    return passage_ids(Views(spark, sf).ptexts)


@register("qrels_extract", O.sql("SELECT query, example_pos, pos, passage FROM f_qrels", "f_qrels"))
def q_qrels_extract(spark, sf):
    return Views(spark, sf).qrels


@register("last_wins", O.sql(f"""
SELECT {O.strip('query')} AS query, max(example_pos) AS example_pos FROM f_exq
WHERE length({O.strip('query')}) > 5 GROUP BY 1""", "f_exq"))
def q_last_wins(spark, sf):
    from vecspark.functions.text import py_strip, stripped_length
    from vecspark.sources.corpus import last_wins
    ex = Views(spark, sf).examples.queries
    q = ex.where(stripped_length("query") > 5).select(py_strip("query").alias("query"), "example_pos")
    return last_wins(q, ["query"], "example_pos")


@register("id_to_passage", O.sql("SELECT query_id, rank, vector_id, passage FROM f_id2p", "f_id2p"))
def q_id_to_passage(spark, sf):
    from vecspark.operators.textjoin import id_to_passage
    v = Views(spark, sf)
    return id_to_passage(v.retrieved, v.ptexts)


@register("results_by_query_text", O.sql("SELECT query, query_id, rank, passage FROM f_restext", "f_restext"))
def q_results_by_query_text(spark, sf):
    return Views(spark, sf).results_text


@register("judged_queries", O.sql(
    "SELECT query, rank, passage FROM f_restext WHERE query IN (SELECT query FROM f_qrels)",
    "f_restext", "f_qrels"))
def q_judged_queries(spark, sf):
    from vecspark.operators.ir import judged_queries
    v = Views(spark, sf)
    return judged_queries(v.results_text.select("query", "rank", "passage"), v.qrels)


@register("judged_recall", O.sql("SELECT k, round(recall, 6) AS recall FROM j_recall", "j_recall"))
def q_judged_recall(spark, sf):
    from vecspark.operators.ir import judged_recall
    v = Views(spark, sf)
    return judged_recall(v.results_text, v.qrels, (1, 5, 10, 20)).select("k", r6("recall").alias("recall"))


@register("mrr", O.sql("SELECT round(mrr, 6) AS mrr FROM j_mrr", "j_mrr"))
def q_mrr(spark, sf):
    from vecspark.operators.ir import mrr
    v = Views(spark, sf)
    return mrr(v.results_text, v.qrels).select(r6("mrr").alias("mrr"))


@register("evaluation_metrics", O.sql(
    "SELECT database, operation, metric, round(value, 6) AS value, worker_count FROM m_eval", "m_eval"))
def q_evaluation_metrics(spark, sf):
    return Views(spark, sf).evaluation_rows.withColumn("value", r6("value")).drop("query_id")


# =============================================================================
# phase 5: corpus creation (sized from the tables)
# =============================================================================

def _synthetic_sql(n_sql: str) -> str:
    from vecspark.constants import ACTIONS, OBJECTS, SYNTHETIC_TEMPLATE, TOPICS
    fmt = (SYNTHETIC_TEMPLATE.replace("{topic}", "%1$s").replace("{action}", "%2$s")
           .replace("{obj}", "%3$s"))
    key = "'42:' || id || ':{}'"
    return f"""SELECT id AS vector_id, printf('{fmt}', {O.pick(TOPICS, key.format('topic'))},
  {O.pick(ACTIONS, key.format('action'))}, {O.pick(OBJECTS, key.format('object'))}) AS text
  FROM (SELECT unnest(range({n_sql})) AS id)"""


O.cte("f_synth", [], _synthetic_sql("(SELECT count(*) FROM documents)"))


@register("synthetic_corpus", O.sql("SELECT vector_id, text FROM f_synth", "f_synth"))
def q_synthetic_corpus(spark, sf):
    from vecspark.sources.corpus import synthetic_corpus
    n = Views(spark, sf).table("documents").count()
    return synthetic_corpus(spark, n)


@register("synthetic_vectors", O.sql(f"""
WITH g AS (SELECT i AS vector_id, d, {O.gaussian("'42:' || i || ':' || d")} AS z
  FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS i) a,
       (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS d) b)
SELECT vector_id, d::INTEGER AS d, round(z / sqrt(sum(z * z) OVER (PARTITION BY vector_id)), 6) AS value FROM g"""))
def q_synthetic_vectors(spark, sf):
    from vecspark.operators.blockscan import vector_dim
    from vecspark.sources.corpus import synthetic_vectors
    e = Views(spark, sf).table("embeddings")
    n, dim = e.count(), vector_dim(e, "embedding")
    # outer: before an inner one Spark filters by size, and generates every vector once more for it
    return (synthetic_vectors(spark, n, dim)
            .select("vector_id", F.posexplode_outer("embedding").alias("d", "x")).where("d is not null")
            .select("vector_id", F.col("d").cast("int").alias("d"), r6("x").alias("value")))


@register("placeholder_queries", O.sql(
    f"SELECT id AS query_id, 'synthetic_query_' || id AS text FROM (SELECT unnest(range(({O.N_VEC} - (SELECT c FROM sp))::BIGINT)) AS id)",
    "sp"))
def q_placeholder_queries(spark, sf):
    from vecspark.sources.corpus import placeholder_texts
    return placeholder_texts(spark, Views(spark, sf).n_queries, "query")


@register("corpus_or_synthetic", O.sql(f"""
WITH r AS (SELECT doc_id AS vector_id, {O.strip('text')} AS text FROM documents WHERE length({O.strip('text')}) > 10)
SELECT vector_id, text FROM r UNION ALL
SELECT vector_id, text FROM f_synth WHERE NOT EXISTS (SELECT 1 FROM r)""", "f_synth"))
def q_corpus_or_synthetic(spark, sf):
    from vecspark.sources.corpus import corpus_or_synthetic, passage_field_fallback, synthetic_corpus
    v = Views(spark, sf)
    docs = v.table("documents")
    real = passage_field_fallback(docs, id_col="doc_id").withColumnRenamed("doc_id", "vector_id")
    return corpus_or_synthetic(real, synthetic_corpus(spark, docs.count()))


O.cte("f_docs", [], f"SELECT doc_id, {O.strip('text')} AS text FROM documents WHERE length({O.strip('text')}) > 10")
O.hash_embed_ctes("f_dvec", "f_docs", "doc_id")


@register("embed_text_hash", O.sql("""
SELECT doc_id, d::INTEGER AS d, round(w / sqrt(list_inner_product(v, v)), 6) AS weight FROM (
  SELECT doc_id, v, unnest(range(len(v))) AS d, unnest(v) AS w FROM f_dvec) WHERE w <> 0""", "f_dvec"))
def q_embed_text_hash(spark, sf):
    from vecspark.operators.embed import hash_embed
    from vecspark.sources.corpus import passage_field_fallback
    docs = passage_field_fallback(Views(spark, sf).table("documents"), id_col="doc_id")
    vec = hash_embed(docs, id_col="doc_id", dim=64).select("doc_id", l2_normalize("embedding").alias("u"),
                                                            "embedding")
    return (vec.select("doc_id", F.posexplode(F.arrays_zip("embedding", "u")).alias("d", "z"))
            .where(F.col("z.embedding") != 0)
            .select("doc_id", F.col("d").cast("int").alias("d"), r6(F.col("z.u")).alias("weight")))


# =============================================================================
# phase 6: performance rows (events as a latency table)
# =============================================================================

_LAT_COLS = ["p50_ms", "p95_ms", "p99_ms", "mean_ms", "std_ms", "min_ms", "max_ms"]


@register("latency_stats", O.sql(
    "SELECT engine, worker_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in _LAT_COLS) + " FROM f_lstats",
    "f_lstats"))
def q_latency_stats(spark, sf):
    from vecspark.operators.perf import latency_stats
    s = latency_stats(Views(spark, sf).lat)
    return s.select("engine", "worker_count", *[r6(c).alias(c) for c in _LAT_COLS])


@register("throughput", O.sql("SELECT engine, worker_count, round(qps, 6) AS qps FROM f_lstats", "f_lstats"))
def q_throughput(spark, sf):
    from vecspark.operators.perf import throughput
    return throughput(Views(spark, sf).lat).withColumn("qps", r6("qps"))


@register("performance_metrics", O.sql(
    "SELECT database, operation, metric, round(value, 6) AS value, worker_count FROM m_perf", "m_perf"))
def q_performance_metrics(spark, sf):
    return Views(spark, sf).perf_rows.withColumn("value", r6("value")).drop("query_id")


@register("indexing_metrics", O.sql(
    "SELECT database, operation, metric, round(value, 6) AS value, worker_count FROM m_index", "m_index"))
def q_indexing_metrics(spark, sf):
    return Views(spark, sf).index_rows.withColumn("value", r6("value")).drop("query_id")


@register("scaling_efficiency", O.sql("""
WITH t AS (SELECT * FROM m_perf WHERE operation = 'throughput' AND metric = 'qps'),
     s AS (SELECT database, avg(value) AS single_qps FROM t WHERE worker_count = 1 GROUP BY 1),
     m AS (SELECT database, worker_count, avg(value) AS multi_qps FROM t WHERE worker_count > 1 GROUP BY 1, 2)
SELECT m.database, m.worker_count, round(s.single_qps, 6) AS single_qps, round(m.multi_qps, 6) AS multi_qps,
       round(CASE WHEN s.single_qps <> 0 AND s.single_qps * m.worker_count > 0
                  THEN m.multi_qps / (s.single_qps * m.worker_count) * 100.0 ELSE 0.0 END, 6) AS efficiency_pct
FROM m JOIN s USING (database)""", "m_perf"))
def q_scaling_efficiency(spark, sf):
    from vecspark.operators.perf import scaling_efficiency
    s = scaling_efficiency(Views(spark, sf).perf_rows)
    return s.select("database", "worker_count", r6("single_qps").alias("single_qps"),
                    r6("multi_qps").alias("multi_qps"), r6("efficiency_pct").alias("efficiency_pct"))


# =============================================================================
# phase 7: measurement table and reports
# =============================================================================

def _results(spark, sf) -> DataFrame:
    return Views(spark, sf).results


@register("results_union", O.sql(
    "SELECT database, operation, metric, round(value, 6) AS value, worker_count FROM f_results", "f_results"))
def q_results_union(spark, sf):
    return _results(spark, sf).withColumn("value", r6("value")).drop("query_id")


@register("results_filter", O.sql("""
SELECT database, round(value, 6) AS value FROM f_results
WHERE operation = 'latency' AND metric = 'p50_ms' AND worker_count = 1""", "f_results"))
def q_results_filter(spark, sf):
    from vecspark.plans.reports import results_filter
    return results_filter(_results(spark, sf), "latency", "p50_ms", 1).select("database", r6("value").alias("value"))


@register("results_catalog", O.sql("""
SELECT 'database' AS kind, database AS name, count(*) AS n_rows FROM f_results GROUP BY database UNION ALL
SELECT 'operation', operation, count(*) FROM f_results GROUP BY operation""", "f_results"))
def q_results_catalog(spark, sf):
    from vecspark.plans.reports import results_catalog
    return results_catalog(_results(spark, sf))


@register("results_roundtrip", O.sql(
    "SELECT database, operation, metric, round(value, 6) AS value, worker_count, query_id FROM f_results", "f_results"))
def q_results_roundtrip(spark, sf):
    from vecspark.session import scratch_path
    from vecspark.sources.results_io import read_results_csv, write_results_csv
    path = scratch_path(spark, "results-csv")
    write_results_csv(_results(spark, sf), path)
    back = read_results_csv(spark, path)
    # query_id is null in every row: compare it as a string column
    return back.withColumn("value", r6("value")).withColumn("query_id", F.col("query_id").cast("int"))


O.cte("cls", [], """SELECT event_id, 'svc-' || ['Postgres', 'WEAVIATE', 'qdrant', 'redis'][user_id % 4 + 1]
  || '-' || (user_id % 3) AS container FROM events""")


@register("engine_classify", O.sql("""
SELECT event_id, container, CASE WHEN contains(lower(container), 'postgres') THEN 'postgres'
  WHEN contains(lower(container), 'weaviate') THEN 'weaviate'
  WHEN contains(lower(container), 'qdrant') THEN 'qdrant' END AS engine
FROM cls WHERE contains(lower(container), 'postgres') OR contains(lower(container), 'weaviate')
  OR contains(lower(container), 'qdrant')""", "cls"))
def q_engine_classify(spark, sf):
    from vecspark.plans.reports import engine_classify
    ev = Views(spark, sf).table("events")
    names = F.element_at(F.array(*[F.lit(x) for x in ("Postgres", "WEAVIATE", "qdrant", "redis")]),
                         (F.col("user_id") % 4 + 1).cast("int"))
    c = ev.select("event_id", F.concat(F.lit("svc-"), names, F.lit("-"),
                                       (F.col("user_id") % 3).cast("string")).alias("container"))
    return engine_classify(c, "container")


#: the event types, which stand for the databases; quality rows exist for the first
_DATABASES = ("click", "error", "purchase", "signup", "view")


def _pivot_sql(where: str, index: str, decimals: int, databases: tuple[str, ...] = _DATABASES) -> str:
    cols = ",\n  ".join(f"round(avg(value) FILTER (WHERE database = '{d}'), {decimals}) AS \"{d}\"" for d in databases)
    return O.sql(f"SELECT {index},\n  {cols}\nFROM f_results WHERE {where} GROUP BY {index}", "f_results")


@register("summary_pivot", _pivot_sql("operation = 'latency' AND metric = 'p50_ms'", "worker_count", 3))
def q_summary_pivot(spark, sf):
    from vecspark.plans.reports import summary_pivot
    return summary_pivot(_results(spark, sf), "latency", "p50_ms")


@register("latency_pivot", _pivot_sql("operation = 'latency' AND worker_count = 1", "metric", 2))
def q_latency_pivot(spark, sf):
    from vecspark.plans.reports import latency_pivot
    return latency_pivot(_results(spark, sf))


@register("throughput_pivot", _pivot_sql("operation = 'throughput' AND metric = 'qps'", "worker_count", 1))
def q_throughput_pivot(spark, sf):
    from vecspark.plans.reports import throughput_pivot
    return throughput_pivot(_results(spark, sf))


@register("quality_pivot", _pivot_sql(
    "operation = 'quality' AND (starts_with(metric, 'recall') OR starts_with(metric, 'mAP'))", "metric", 4, _DATABASES[:1]))
def q_quality_pivot(spark, sf):
    from vecspark.plans.reports import quality_pivot
    return quality_pivot(_results(spark, sf))


@register("report_indexing", O.sql("""
SELECT database,
  round(avg(value) FILTER (WHERE operation = 'index' AND metric = 'total_time'), 6) AS index_time_s,
  round(avg(value) FILTER (WHERE operation = 'memory' AND metric = 'usage_mb'), 6) AS memory_mb
FROM f_results WHERE (operation = 'index' AND metric = 'total_time') OR (operation = 'memory' AND metric = 'usage_mb')
GROUP BY database""", "f_results"))
def q_report_indexing(spark, sf):
    from vecspark.plans.reports import report_indexing
    r = report_indexing(_results(spark, sf))
    return r.select("database", r6("index_time_s").alias("index_time_s"), r6("memory_mb").alias("memory_mb"))


@register("report_scaling", O.sql("""
SELECT database, worker_count, round(log2(worker_count), 6) AS log2_workers, round(value, 6) AS qps
FROM f_results WHERE operation = 'throughput' AND metric = 'qps'""", "f_results"))
def q_report_scaling(spark, sf):
    from vecspark.plans.reports import report_scaling
    r = report_scaling(_results(spark, sf))
    return r.select("database", "worker_count", r6("log2_workers").alias("log2_workers"), r6("qps").alias("qps"))


@register("metric_titles", O.sql("""
SELECT database, metric,
  list_aggr(list_transform(string_split(replace(metric, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title,
  round(value, 6) AS value
FROM f_results WHERE operation = 'latency' AND worker_count = 1 AND metric IN ('p50_ms', 'p95_ms', 'p99_ms')""",
    "f_results"))
def q_metric_titles(spark, sf):
    from vecspark.plans.reports import metric_titles
    return metric_titles(_results(spark, sf)).withColumn("value", r6("value"))


@register("latency_vs_quality", O.sql("""
WITH l AS (SELECT database, arg_min(value, worker_count) AS p50_ms FROM f_results
           WHERE operation = 'latency' AND metric = 'p50_ms' AND worker_count = 1 GROUP BY 1),
     q AS (SELECT database, arg_min(value, worker_count) AS recall_at_10 FROM f_results
           WHERE operation = 'quality' AND metric = 'recall@10' GROUP BY 1)
SELECT database, round(p50_ms, 6) AS p50_ms, round(recall_at_10, 6) AS recall_at_10,
  CASE WHEN recall_at_10 >= 0.9 AND p50_ms <= 10 THEN 'fast_accurate' WHEN recall_at_10 >= 0.9 THEN 'slow_accurate'
       WHEN p50_ms <= 10 THEN 'fast_inaccurate' ELSE 'slow_inaccurate' END AS quadrant
FROM l JOIN q USING (database)""", "f_results"))
def q_latency_vs_quality(spark, sf):
    from vecspark.plans.reports import latency_vs_quality
    r = latency_vs_quality(_results(spark, sf))
    return r.select("database", r6("p50_ms").alias("p50_ms"), r6("recall_at_10").alias("recall_at_10"), "quadrant")


def _matrix_sql() -> str:
    from vecspark.constants import HEATMAP_METRICS
    parts = []
    for label, op, met in HEATMAP_METRICS:
        cond = f"operation = '{op}' AND metric = '{met}'"
        if op == "throughput":
            agg = f"max(value) FILTER (WHERE {cond})"
        else:
            if op == "latency":
                cond += " AND worker_count = 1"
            agg = f"arg_min(value, worker_count) FILTER (WHERE {cond})"
        parts.append(f"SELECT '{label}' AS metric, database, coalesce({agg}, 0.0) AS value FROM f_results GROUP BY database")
    return " UNION ALL ".join(parts)


O.cte("f_matrix", ["f_results"], _matrix_sql())


@register("performance_matrix", O.sql("SELECT metric, database, round(value, 6) AS value FROM f_matrix", "f_matrix"))
def q_performance_matrix(spark, sf):
    from vecspark.plans.reports import performance_matrix
    return performance_matrix(_results(spark, sf)).withColumn("value", r6("value"))


@register("performance_normalized", O.sql(f"""
SELECT metric, database, round(CASE WHEN metric IN ({', '.join(repr(x) for x in __import__('vecspark.constants', fromlist=['x']).HEATMAP_HIGHER_BETTER)})
  THEN value / nullif(max(value) OVER (PARTITION BY metric), 0)
  ELSE 1 - value / nullif(max(value) OVER (PARTITION BY metric), 0) END, 6) AS score FROM f_matrix""", "f_matrix"))
def q_performance_normalized(spark, sf):
    from vecspark.plans.reports import performance_matrix, performance_normalized
    return performance_normalized(performance_matrix(_results(spark, sf))).withColumn("score", r6("score"))


def _scorecard_sql() -> str:
    def pick(op, met, wc1=False):
        cond = f"operation = '{op}' AND metric = '{met}'" + (" AND worker_count = 1" if wc1 else "")
        return f"arg_min(value, worker_count) FILTER (WHERE {cond})"
    cols = [f"round({pick('index', 'total_time')}, 6) AS total_time_s",
            f"round({pick('memory', 'usage_mb')}, 6) AS memory_mb",
            f"round({pick('latency', 'p50_ms', True)}, 6) AS p50_ms",
            f"round({pick('latency', 'p95_ms', True)}, 6) AS p95_ms",
            f"round({pick('latency', 'p99_ms', True)}, 6) AS p99_ms",
            "round(arg_max(value, worker_count) FILTER (WHERE operation = 'throughput' AND metric = 'qps'), 6) AS max_workers_qps",
            f"round({pick('quality', 'recall@1')}, 6) AS recall_at_1",
            f"round({pick('quality', 'recall@10')}, 6) AS recall_at_10",
            f"round({pick('quality', 'mAP@10')}, 6) AS map_at_10"]
    cols += [f"round({pick('evaluation', f'recall@{k}')}, 6) AS eval_recall_at_{k}" for k in (1, 5, 10, 20)]
    cols.append(f"round({pick('evaluation', 'mrr')}, 6) AS eval_mrr")
    return "SELECT database, " + ", ".join(cols) + " FROM f_results GROUP BY database"


@register("engine_scorecard", O.sql(_scorecard_sql(), "f_results"))
def q_engine_scorecard(spark, sf):
    from vecspark.plans.reports import engine_scorecard
    s = engine_scorecard(_results(spark, sf))
    return s.select("database", *[r6(c).alias(c) for c in s.columns if c != "database"])


# =============================================================================
# phase 8: vector-table writes (write -> read back -> compare)
# =============================================================================

def _table_summary(df: DataFrame) -> DataFrame:
    return df.select(F.col("vector_id").cast("int").alias("vector_id"), "metadata",
                     F.size("embedding").alias("dims"),
                     r6(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0),
                                    lambda a, x: a + x)).alias("emb_sum"))


_TABLE_SUMMARY_SQL = """SELECT vector_id::INTEGER AS vector_id, to_json({'id': vector_id::INTEGER})::VARCHAR AS metadata,
  len(embedding)::INTEGER AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS emb_sum FROM f_index"""


@register("vector_table_overwrite", O.sql(_TABLE_SUMMARY_SQL, "f_index"))
def q_vector_table_overwrite(spark, sf):
    from vecspark.session import scratch_path
    from vecspark.sinks import vector_table as vt
    v = Views(spark, sf)
    root = scratch_path(spark, "vectors")
    vt.overwrite(vt.to_vector_table(v.table("embeddings"), id_col="vec_id"), root)   # stale content
    vt.overwrite(vt.to_vector_table(v.index), root)                                 # replaced entirely
    return _table_summary(vt.read(spark, root))


@register("vector_table_documents", O.sql(
    "SELECT vector_id::INTEGER AS vector_id, 'Document ' || vector_id AS text FROM f_index", "f_index"))
def q_vector_table_documents(spark, sf):
    from vecspark.session import scratch_path
    from vecspark.sinks import vector_table as vt
    v = Views(spark, sf)
    root = scratch_path(spark, "documents")
    vt.overwrite(vt.with_document_text(vt.to_vector_table(v.index)), root)
    return vt.read(spark, root).select("vector_id", "text")


@register("vector_table_upsert", O.sql("""
WITH u AS (SELECT vec_id AS vector_id, embedding FROM embeddings WHERE label < 5)
SELECT vector_id::INTEGER AS vector_id, to_json({'id': vector_id::INTEGER, 'rev': 2})::VARCHAR AS metadata,
       len(embedding)::INTEGER AS dims FROM u
UNION ALL
SELECT vector_id::INTEGER, to_json({'id': vector_id::INTEGER})::VARCHAR, len(embedding)::INTEGER
FROM f_index WHERE vector_id NOT IN (SELECT vector_id FROM u)""", "f_index"))
def q_vector_table_upsert(spark, sf):
    from vecspark.session import scratch_path
    from vecspark.sinks import vector_table as vt
    v = Views(spark, sf)
    root = scratch_path(spark, "upsert")
    vt.overwrite(vt.to_vector_table(v.index), root)
    upd = v.table("embeddings").where(F.col("label") < 5)
    meta = F.to_json(F.struct(F.col("vec_id").cast("int").alias("id"), F.lit(2).alias("rev")))
    batch = vt.to_vector_table(upd, id_col="vec_id", metadata=meta)
    vt.upsert(batch, root, 1)
    vt.upsert(batch, root, 1)          # a retried batch: idempotent
    return vt.read(spark, root).select("vector_id", "metadata", F.size("embedding").alias("dims"))


@register("dimension_check", O.sql("""
WITH d AS (SELECT max(len(embedding)) AS dim FROM embeddings),
     x AS (SELECT vec_id, CASE WHEN label = 0 THEN embedding[1:len(embedding) - 1]
                              WHEN label = 1 THEN list_transform(embedding, lambda e: 0.0::FLOAT)
                              ELSE embedding END AS v FROM embeddings)
SELECT vec_id,
  CASE WHEN v IS NULL OR len(v) <> (SELECT dim FROM d) OR list_inner_product(v::DOUBLE[], v::DOUBLE[]) = 0
       THEN 'rejected' ELSE 'valid' END AS status,
  CASE WHEN v IS NULL THEN 'null' WHEN len(v) <> (SELECT dim FROM d) THEN 'dimension'
       WHEN list_inner_product(v::DOUBLE[], v::DOUBLE[]) = 0 THEN 'zero_norm' END AS reason
FROM x"""))
def q_dimension_check(spark, sf):
    from vecspark.operators.blockscan import vector_dim
    from vecspark.sinks.vector_table import dimension_check
    e = Views(spark, sf).table("embeddings")
    dim = e.select(F.max(F.size("embedding"))).first()[0]
    v = (F.when(F.col("label") == 0, F.slice("embedding", 1, F.size("embedding") - 1))
         .when(F.col("label") == 1, F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
         .otherwise(F.col("embedding")))
    return dimension_check(e.select("vec_id", v.alias("v")), int(dim), vec_col="v").select("vec_id", "status", "reason")


@register("metadata_json", O.sql("""
SELECT vector_id::INTEGER AS vector_id, to_json({'id': vector_id::INTEGER})::VARCHAR AS metadata,
  to_json({'vector_id': vector_id::INTEGER, 'metadata': {'id': vector_id::INTEGER}})::VARCHAR AS payload FROM f_index""",
    "f_index"))
def q_metadata_json(spark, sf):
    from vecspark.sinks.vector_table import metadata_json, payload
    return Views(spark, sf).index.select(F.col("vector_id").cast("int").alias("vector_id"),
                                         metadata_json().alias("metadata"), F.to_json(payload()).alias("payload"))


@register("ingest_batches", O.sql("""
SELECT (vector_id // 100)::BIGINT AS batch, count(*) AS n_rows, min(vector_id) AS min_id, max(vector_id) AS max_id
FROM f_index GROUP BY 1""", "f_index"))
def q_ingest_batches(spark, sf):
    from vecspark.sinks.vector_table import ingest_batches
    return ingest_batches(Views(spark, sf).index)


# =============================================================================
# phase 9: streaming (file stream -> foreachBatch), results equal the batch ones
# =============================================================================

def _stage_files(df: DataFrame, path: str, files: int, key: str) -> None:
    """Write ``df`` as several files so the stream sees several micro-batches."""
    df.repartitionByRange(files, key).write.mode("overwrite").parquet(path)


@register("stream_ingest", O.sql(_TABLE_SUMMARY_SQL, "f_index"))
def q_stream_ingest(spark, sf):
    from vecspark.session import scratch_path
    from vecspark.sinks import vector_table as vt
    from vecspark.streaming.jobs import stream_ingest
    v = Views(spark, sf)
    src, root, ck = (scratch_path(spark, n) for n in ("ingest-src", "ingest-table", "ingest-ck"))
    _stage_files(v.index, src, 4, "vector_id")
    q = stream_ingest(spark, src, v.index.schema, root, ck)
    q.awaitTermination()
    return _table_summary(vt.read(spark, root))


@register("stream_search", O.sql(
    "SELECT query_id, rank, vector_id, round(score, 4) AS score FROM f_gt", "f_gt"))
def q_stream_search(spark, sf):
    from vecspark.operators.stored import store_index
    from vecspark.session import scratch_path
    from vecspark.streaming.jobs import stream_search
    v = Views(spark, sf)
    src, out, ck = (scratch_path(spark, n) for n in ("search-src", "search-out", "search-ck"))
    _stage_files(v.queries, src, 3, "query_id")
    q = stream_search(spark, store_index(v.index), src, v.queries.schema, out, ck, 10)
    q.awaitTermination()
    return spark.read.parquet(out).select("query_id", "rank", "vector_id", r6("score", 4).alias("score"))


# =============================================================================
# stored indexes and the benchmark run (modules of their own; importing them registers them)
# =============================================================================

from vecspark.plans import benchmark_catalog, source_catalog, sql_catalog, store_catalog, stored_catalog, stream_catalog  # noqa: E402,F401
