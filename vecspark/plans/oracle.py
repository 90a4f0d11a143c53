"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each named CTE mirrors one view of ``plans.views``; ``sql(body, *needs)``
prepends the CTEs a statement depends on (transitively, in order).  The
tables ``embeddings events conversations documents ...`` are views in the
checking DuckDB session.
"""

from __future__ import annotations

from vecspark.functions.text import whitespace_sql_literal

WS = whitespace_sql_literal()


def strip(expr: str) -> str:
    """Python ``str.strip()`` in DuckDB (same character set as Spark side)."""
    return f"trim({expr}, {WS})"


def md5_u32(expr: str, a: int = 1, n: int = 8) -> str:
    return f"('0x' || substr(md5({expr}), {a}, {n}))::BIGINT"


def gaussian(parts_sql: str) -> str:
    """Box-Muller over two md5 uniforms of ``parts_sql || ':a'`` / ``':b'``."""
    u1 = f"(({md5_u32(parts_sql + " || ':a'")})::DOUBLE + 0.5) / 4294967296.0"
    u2 = f"(({md5_u32(parts_sql + " || ':b'")})::DOUBLE + 0.5) / 4294967296.0"
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


TOKENS = "list_filter(regexp_split_to_array(lower({t}), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


# -- vectors -----------------------------------------------------------------
cte("sp", [], "SELECT floor(count(*) * 0.8) AS c FROM embeddings")
cte("f_index", ["sp"], """SELECT vec_id AS vector_id, embedding::DOUBLE[] AS v, embedding AS embedding
  FROM embeddings WHERE vec_id < (SELECT c FROM sp)""")
cte("f_query", ["sp"], """SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, embedding AS embedding
  FROM embeddings WHERE vec_id >= (SELECT c FROM sp)""")
cte("f_gt", ["f_index", "f_query"], f"""SELECT query_id, rank::INTEGER AS rank, vector_id, s AS score FROM (
  SELECT q.query_id, i.vector_id, {dot('q.v', 'i.v')} AS s,
         row_number() OVER (PARTITION BY q.query_id ORDER BY {dot('q.v', 'i.v')} DESC, i.vector_id) AS rank
  FROM f_query q, f_index i) WHERE rank <= 10""")
cte("f_cent", ["f_index"], "SELECT vector_id::INTEGER AS list_id, v AS c FROM f_index WHERE vector_id < 16")
cte("f_assign", ["f_index", "f_cent"], f"""SELECT vector_id, v, list_id FROM (
  SELECT i.vector_id, i.v, c.list_id,
         row_number() OVER (PARTITION BY i.vector_id ORDER BY {dot('i.v', 'c.c')} DESC, c.list_id) AS r
  FROM f_index i, f_cent c) WHERE r = 1""")
cte("f_qprobe", ["f_query", "f_cent"], f"""SELECT q.query_id, q.v, c.list_id,
  row_number() OVER (PARTITION BY q.query_id ORDER BY {dot('q.v', 'c.c')} DESC, c.list_id) AS pr
  FROM f_query q, f_cent c""")
cte("f_cand", ["f_qprobe", "f_assign"], f"""SELECT p.query_id, p.pr, a.vector_id, {dot('p.v', 'a.v')} AS s
  FROM f_qprobe p JOIN f_assign a ON a.list_id = p.list_id""")
cte("f_pred", ["f_cand"], """SELECT query_id, rank::INTEGER AS rank, vector_id, s AS score FROM (
  SELECT query_id, vector_id, s,
         row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) AS rank
  FROM f_cand WHERE pr <= 4) WHERE rank <= 10""")


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    body = body.strip()
    if not order:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if body[:5].upper() == "WITH ":        # merge the statement's own CTEs
        return head + ",\n" + body[5:]
    return head + "\n" + body


# -- IR metrics over long ranked lists ----------------------------------------
def quality_ctes(p: str, pred: str, gt: str, ks=(1, 5, 10)) -> None:
    """CTEs ``{p}_pq`` (per query, k) and ``{p}_sc`` (means per k) for pred vs gt."""
    kl = "[" + ", ".join(str(int(k)) for k in ks) + "]"
    cte(f"{p}_j", [pred, gt], f"""SELECT p.query_id, p.rank, p.vector_id, g.gt_rank FROM {pred} p
  LEFT JOIN (SELECT query_id, vector_id, min(rank) AS gt_rank FROM {gt} GROUP BY 1, 2) g USING (query_id, vector_id)""")
    cte(f"{p}_jk", [f"{p}_j"], f"""SELECT j.*, kk.k,
  coalesce(j.gt_rank <= kk.k, false) AS hit, coalesce(j.gt_rank <= kk.k, false) AND j.rank <= kk.k AS hit_k
  FROM {p}_j j, (SELECT unnest({kl}) AS k) kk""")
    cte(f"{p}_jr", [f"{p}_jk"], f"""SELECT *, sum(hit_k::INTEGER) OVER (PARTITION BY query_id, k ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {p}_jk""")
    cte(f"{p}_agg", [f"{p}_jr"], f"""SELECT query_id, k,
  count(DISTINCT CASE WHEN hit THEN vector_id END) AS inter,
  count(DISTINCT CASE WHEN hit_k THEN vector_id END) AS inter_top,
  sum(CASE WHEN hit_k THEN 1 ELSE 0 END) AS hits,
  sum(CASE WHEN hit_k THEN run / rank ELSE 0.0::DOUBLE END) AS ap_sum,
  sum(CASE WHEN hit_k THEN 1.0 / log2(rank + 1) ELSE 0.0::DOUBLE END) AS dcg
  FROM {p}_jr GROUP BY query_id, k""")
    cte(f"{p}_pq", [f"{p}_agg", pred, gt], f"""SELECT a.query_id, a.k,
  a.inter / least(n.n_pred, a.k) AS recall,
  a.inter_top / least(m.n_gt, a.k) AS recall_standard,
  a.inter / n.n_pred AS precision,
  CASE WHEN a.hits > 0 THEN a.ap_sum / least(n.n_pred, a.k) ELSE 0.0::DOUBLE END AS map,
  a.dcg / list_sum(list_transform(range(1, least(m.n_gt, a.k) + 1), lambda i: 1.0 / log2(i + 1))) AS ndcg
  FROM {p}_agg a
  JOIN (SELECT query_id, count(*) AS n_pred FROM {pred} GROUP BY 1) n USING (query_id)
  JOIN (SELECT query_id, count(*) AS n_gt FROM {gt} GROUP BY 1) m USING (query_id)""")
    cte(f"{p}_sc", [f"{p}_pq"], f"""SELECT kk.k::INTEGER AS k,
  coalesce(avg(q.recall), 0.0) AS recall, coalesce(avg(q.recall_standard), 0.0) AS recall_standard,
  coalesce(avg(q.precision), 0.0) AS precision, coalesce(avg(q.map), 0.0) AS map,
  coalesce(avg(q.ndcg), 0.0) AS ndcg
  FROM (SELECT unnest({kl}) AS k) kk LEFT JOIN {p}_pq q ON q.k = kk.k GROUP BY kk.k""")


quality_ctes("qp", "f_pred", "f_gt")

FIRST_ENGINE = "(SELECT min(event_type) FROM events)"
cte("m_quality", ["qp_sc"], f"""SELECT {FIRST_ENGINE} AS database, 'quality' AS operation, metric, value,
  1::INTEGER AS worker_count, NULL::INTEGER AS query_id FROM (
  SELECT k, 0 AS o, 'recall@' || k AS metric, recall AS value FROM qp_sc UNION ALL
  SELECT k, 1, 'precision@' || k, precision FROM qp_sc UNION ALL
  SELECT k, 2, 'mAP@' || k, map FROM qp_sc UNION ALL
  SELECT k, 3, 'NDCG@' || k, ndcg FROM qp_sc)""")

# -- IVF for several probe counts, LSH --------------------------------------
cte("f_pred_np", ["f_cand"], """SELECT nprobe, query_id, rank::INTEGER AS rank, vector_id, s AS score FROM (
  SELECT np.nprobe, c.query_id, c.vector_id, c.s,
         row_number() OVER (PARTITION BY np.nprobe, c.query_id ORDER BY c.s DESC, c.vector_id) AS rank
  FROM f_cand c JOIN (SELECT unnest([1, 2, 4, 8, 16]) AS nprobe) np ON c.pr <= np.nprobe) WHERE rank <= 10""")

LSH_BANDS, LSH_BITS, LSH_SEED = 8, 4, 42
cte("lsh_p", ["f_index"], f"""SELECT j AS plane, list(z ORDER BY d) AS h FROM (
  SELECT a.j, b.d, {gaussian(f"'{LSH_SEED}:lsh:' || a.j || ':' || b.d")} AS z
  FROM range({LSH_BANDS * LSH_BITS}) a(j), (SELECT DISTINCT unnest(range(len(v))) AS d FROM f_index) b)
  GROUP BY j""")
cte("lsh_ik", ["f_index", "lsh_p"], f"""SELECT i.vector_id, p.plane // {LSH_BITS} AS band,
  sum(((list_inner_product(i.v, p.h) > 0)::BIGINT) << (p.plane % {LSH_BITS})) AS key
  FROM f_index i, lsh_p p GROUP BY 1, 2""")
cte("lsh_qk", ["f_query", "lsh_p"], f"""SELECT q.query_id, p.plane // {LSH_BITS} AS band,
  sum(((list_inner_product(q.v, p.h) > 0)::BIGINT) << (p.plane % {LSH_BITS})) AS key
  FROM f_query q, lsh_p p GROUP BY 1, 2""")
cte("lsh_cand", ["lsh_ik", "lsh_qk"], """SELECT DISTINCT q.query_id, i.vector_id
  FROM lsh_qk q JOIN lsh_ik i ON i.band = q.band AND i.key = q.key""")
cte("f_lsh", ["lsh_cand", "f_index", "f_query"], f"""SELECT query_id, rank::INTEGER AS rank, vector_id, s AS score FROM (
  SELECT c.query_id, c.vector_id, {dot('q.v', 'i.v')} AS s,
         row_number() OVER (PARTITION BY c.query_id ORDER BY {dot('q.v', 'i.v')} DESC, c.vector_id) AS rank
  FROM lsh_cand c JOIN f_query q USING (query_id) JOIN f_index i USING (vector_id)) WHERE rank <= 10""")


# -- judged text evaluation ----------------------------------------------------
N_VEC = "(SELECT count(*) FROM embeddings)"
cte("f_exq", [], """SELECT conv_id AS example_pos, conv_id AS query_id,
  arg_min(text, turn) FILTER (WHERE role = 'user') AS query
  FROM conversations GROUP BY conv_id
  HAVING arg_min(text, turn) FILTER (WHERE role = 'user') IS NOT NULL
     AND count(*) FILTER (WHERE role = 'assistant') > 0""")
cte("f_exp", ["f_exq"], """SELECT conv_id AS example_pos, turn AS pos, text AS raw, (turn % 4 = 1)::INTEGER AS sel
  FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT example_pos FROM f_exq)""")
cte("f_pex", ["f_exp"], f"""SELECT example_pos, pos, raw, {strip('raw')} AS text FROM f_exp
  WHERE example_pos < {N_VEC} AND raw IS NOT NULL AND length({strip('raw')}) > 10""")
cte("f_passages", ["f_pex"], f"""SELECT vector_id, text FROM (
  SELECT row_number() OVER (ORDER BY example_pos, pos) - 1 AS vector_id, text FROM f_pex)
  WHERE vector_id < {N_VEC}""")
cte("f_ptexts", ["f_exp"], f"""SELECT row_number() OVER (ORDER BY example_pos, pos) - 1 AS vector_id, {strip('raw')} AS text
  FROM f_exp WHERE raw IS NOT NULL AND length({strip('raw')}) > 10""")
cte("f_qtexts", ["f_exq"], f"""SELECT example_pos, {strip('query')} AS text, row_number() OVER (ORDER BY example_pos) - 1 AS query_id
  FROM f_exq WHERE length({strip('query')}) > 5""")
cte("f_qfirst", ["f_qtexts", "sp"], f"""SELECT query_id, text, example_pos FROM f_qtexts
  WHERE query_id < {N_VEC} - (SELECT c FROM sp)""")
cte("f_rel", ["f_exq", "f_exp"], f"""SELECT q.example_pos, {strip('q.query')} AS query, p.pos, {strip('p.raw')} AS passage
  FROM f_exp p JOIN f_exq q USING (example_pos)
  WHERE length({strip('q.query')}) > 5 AND p.sel = 1 AND p.raw IS NOT NULL AND length({strip('p.raw')}) > 10""")
cte("f_qrels", ["f_rel"], """SELECT r.query, r.example_pos, r.pos, r.passage FROM f_rel r
  JOIN (SELECT query, max(example_pos) AS example_pos FROM f_rel GROUP BY 1) w USING (query, example_pos)""")


def hash_embed_ctes(name: str, src: str, id_col: str, dim: int = 64) -> None:
    """``{name}`` = (id, v DOUBLE[dim]) signed md5 feature-hash counts of ``src.text``."""
    tok = TOKENS.format(t="text")
    cte(f"{name}_tok", [src], f"SELECT {id_col} AS id, unnest({tok}) AS tok FROM {src}")
    cte(f"{name}_cell", [f"{name}_tok"], f"""SELECT id, ({md5_u32('tok')} % {dim})::INTEGER AS b,
  sum(CASE WHEN {md5_u32('tok', 9, 1)} % 2 = 0 THEN 1 ELSE -1 END) AS w
  FROM {name}_tok GROUP BY 1, 2""")
    cte(name, [f"{name}_cell"], f"""SELECT d.id AS {id_col}, list(coalesce(c.w, 0)::DOUBLE ORDER BY r.i) AS v
  FROM (SELECT DISTINCT id FROM {name}_cell) d CROSS JOIN range({dim}) r(i)
  LEFT JOIN {name}_cell c ON c.id = d.id AND c.b = r.i GROUP BY d.id""")


hash_embed_ctes("f_pvec", "f_ptexts", "vector_id")
hash_embed_ctes("f_qvec", "f_qtexts", "query_id")
cte("f_retrieved", ["f_pvec", "f_qvec"], """SELECT query_id, rank::INTEGER AS rank, vector_id, s AS score FROM (
  SELECT q.query_id, p.vector_id,
         list_inner_product(q.v, p.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(p.v, p.v))) AS s,
         row_number() OVER (PARTITION BY q.query_id ORDER BY
           list_inner_product(q.v, p.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(p.v, p.v))) DESC,
           p.vector_id) AS rank
  FROM f_qvec q, f_pvec p
  WHERE list_inner_product(q.v, q.v) > 0 AND list_inner_product(p.v, p.v) > 0) WHERE rank <= 10""")
cte("f_id2p", ["f_retrieved", "f_ptexts"], """SELECT r.query_id,
  row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank)::INTEGER AS rank, r.vector_id, p.text AS passage
  FROM f_retrieved r JOIN f_ptexts p USING (vector_id)""")
cte("f_restext", ["f_id2p", "f_qtexts"], """SELECT w.query, i.query_id, i.rank, i.passage FROM f_id2p i
  JOIN (SELECT text AS query, max(query_id) AS query_id FROM f_qtexts GROUP BY 1) w USING (query_id)""")
cte("j_rel", ["f_qrels"], "SELECT DISTINCT query, passage FROM f_qrels")
cte("j_hits", ["f_restext", "j_rel"], """SELECT r.query, r.rank, r.passage, (l.passage IS NOT NULL) AS isrel
  FROM f_restext r LEFT JOIN j_rel l USING (query, passage)
  WHERE r.query IN (SELECT query FROM j_rel)""")
cte("j_recall", ["j_hits", "j_rel"], """SELECT kk.k::INTEGER AS k, coalesce(avg(x.found / n.n_rel), 0.0) AS recall
  FROM (SELECT unnest([1, 5, 10, 20]) AS k) kk
  LEFT JOIN (SELECT h.query, kk2.k, count(DISTINCT CASE WHEN h.isrel AND h.rank <= kk2.k THEN h.passage END) AS found
             FROM j_hits h, (SELECT unnest([1, 5, 10, 20]) AS k) kk2 GROUP BY 1, 2) x ON x.k = kk.k
  LEFT JOIN (SELECT query, count(*) AS n_rel FROM j_rel GROUP BY 1) n ON n.query = x.query
  GROUP BY kk.k""")
cte("j_mrr", ["j_hits"], """SELECT coalesce(avg(coalesce(1.0 / f, 0.0)), 0.0) AS mrr FROM (
  SELECT query, min(CASE WHEN isrel THEN rank END) AS f FROM j_hits GROUP BY 1)""")
cte("m_eval", ["j_recall", "j_mrr", "j_rel"], f"""SELECT {FIRST_ENGINE} AS database, 'evaluation' AS operation, metric, value,
  1::INTEGER AS worker_count, NULL::INTEGER AS query_id FROM (
  SELECT 'recall@' || k AS metric, recall AS value FROM j_recall UNION ALL
  SELECT 'mrr', mrr FROM j_mrr) WHERE EXISTS (SELECT 1 FROM j_rel)""")


# -- generators -----------------------------------------------------------------
def pick(words, key_sql: str) -> str:
    arr = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    return f"{arr}[({md5_u32(key_sql)} % {len(words)}) + 1]"


# -- measurements -----------------------------------------------------------------
cte("f_lat", [], """SELECT event_type AS engine, [1, 4, 8, 16][user_id % 4 + 1]::INTEGER AS worker_count,
  event_id AS query_id, value / 1000.0 AS latency_s FROM events""")
cte("f_lstats", ["f_lat"], """SELECT engine, worker_count,
  quantile_cont(latency_s * 1000.0, 0.5) AS p50_ms, quantile_cont(latency_s * 1000.0, 0.95) AS p95_ms,
  quantile_cont(latency_s * 1000.0, 0.99) AS p99_ms, avg(latency_s * 1000.0) AS mean_ms,
  stddev_pop(latency_s * 1000.0) AS std_ms, min(latency_s * 1000.0) AS min_ms, max(latency_s * 1000.0) AS max_ms,
  CASE WHEN sum(latency_s) > 0 THEN count(*) / sum(latency_s) ELSE 0.0 END AS qps
  FROM f_lat GROUP BY 1, 2""")
_PERF_METRICS = ["p50_ms", "p95_ms", "p99_ms", "mean_ms", "std_ms", "min_ms", "max_ms", "qps"]
cte("m_perf", ["f_lstats"], " UNION ALL ".join(
    f"""SELECT engine AS database, '{'throughput' if m == 'qps' else 'latency'}' AS operation, '{m}' AS metric,
  {m} AS value, worker_count, NULL::INTEGER AS query_id FROM f_lstats""" for m in _PERF_METRICS))
cte("f_load", ["f_lat"], f"""SELECT engine AS database, sum(latency_s) AS insert_time, max(latency_s) AS index_time,
  CASE WHEN engine = {FIRST_ENGINE} THEN max(latency_s) * 1000.0 END AS memory_mb
  FROM f_lat GROUP BY engine""")
cte("m_index", ["f_load"], """
  SELECT database, 'index' AS operation, 'insert_time' AS metric, insert_time AS value, 1::INTEGER AS worker_count, NULL::INTEGER AS query_id FROM f_load UNION ALL
  SELECT database, 'index', 'index_time', index_time, 1, NULL FROM f_load UNION ALL
  SELECT database, 'index', 'total_time', insert_time + index_time, 1, NULL FROM f_load UNION ALL
  SELECT database, 'memory', 'usage_mb', memory_mb, 1, NULL FROM f_load WHERE memory_mb IS NOT NULL""")
cte("f_results", ["m_perf", "m_index", "m_quality", "m_eval"], """
  SELECT * FROM m_perf UNION ALL SELECT * FROM m_index UNION ALL SELECT * FROM m_quality UNION ALL SELECT * FROM m_eval""")
