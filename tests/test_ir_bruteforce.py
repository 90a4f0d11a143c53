"""IR metrics vs a brute-force Python evaluation of the definitions (random fixtures)."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vecspark.operators.ir import judged_recall, mrr, quality_scores

KS = (1, 3, 5, 10)


def brute_quality(pred, gt, k):
    """Definitions, one query at a time; queries need both lists non-empty."""
    out = {m: [] for m in ("recall", "recall_standard", "precision", "map", "ndcg")}
    for q in pred:
        p, g = pred[q], gt.get(q, [])
        if not p or not g:
            continue
        gk = g[:k]
        inter = len(set(p) & set(gk))
        out["recall"].append(inter / min(len(p), k))
        out["recall_standard"].append(len(set(p[:k]) & set(gk)) / len(set(gk)))
        out["precision"].append(inter / len(p))
        hits, ap = 0, 0.0
        for i, d in enumerate(p[:k]):
            if d in gk:
                hits += 1
                ap += hits / (i + 1)
        out["map"].append(ap / min(len(p), k) if hits else 0.0)
        dcg = sum(1 / math.log2(i + 2) for i, d in enumerate(p[:k]) if d in gk)
        idcg = sum(1 / math.log2(i + 2) for i in range(min(len(g), k)))
        out["ndcg"].append(dcg / idcg)
    return {m: (sum(v) / len(v) if v else 0.0) for m, v in out.items()}


lists = st.dictionaries(st.integers(0, 4), st.lists(st.integers(0, 12), max_size=12), max_size=5)
gts = st.dictionaries(st.integers(0, 4), st.lists(st.integers(0, 12), max_size=12, unique=True), max_size=5)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pred=lists, gt=gts)
def test_quality_matches_definitions(spark, pred, gt):
    def ranked(d):
        rows = [(q, r + 1, v) for q, ids in d.items() for r, v in enumerate(ids)]
        return spark.createDataFrame(rows, "query_id long, rank int, vector_id long")
    got = {r["k"]: r.asDict() for r in quality_scores(ranked(pred), ranked(gt), KS).collect()}
    for k in KS:
        exp = brute_quality(pred, gt, k)
        for m, v in exp.items():
            assert got[k][m] == pytest.approx(v, abs=1e-12), (k, m)


texts = st.sampled_from(["a", "b", "c", "d", "e", "f"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(res=st.dictionaries(st.sampled_from(["q1", "q2", "q3", "q4"]), st.lists(texts, min_size=1, max_size=8),
                           max_size=4),
       rel=st.dictionaries(st.sampled_from(["q1", "q2", "q3", "q5"]), st.lists(texts, min_size=1, max_size=4),
                           max_size=4))
def test_judged_metrics_match_definitions(spark, res, rel):
    r = spark.createDataFrame([(q, i + 1, p) for q, ps in res.items() for i, p in enumerate(ps)],
                              "query string, rank int, passage string")
    j = spark.createDataFrame([(q, p) for q, ps in rel.items() for p in ps], "query string, passage string")
    judged = [q for q in res if q in rel]
    for k in (1, 5, 20):
        exp = (sum(len(set(rel[q]) & set(res[q][:k])) / len(set(rel[q])) for q in judged) / len(judged)
               if judged else 0.0)
        got = {x["k"]: x["recall"] for x in judged_recall(r, j, (k,)).collect()}[k]
        assert got == pytest.approx(exp, abs=1e-12)
    rr = []
    for q in judged:
        first = next((i + 1 for i, p in enumerate(res[q]) if p in set(rel[q])), None)
        rr.append(1 / first if first else 0.0)
    assert mrr(r, j).first()["mrr"] == pytest.approx(sum(rr) / len(rr) if rr else 0.0, abs=1e-12)


def test_knn_matches_numpy_with_duplicates(spark):
    import numpy as np

    from vecspark.operators.knn import knn_exact
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 16))
    X[100:110] = X[5]                       # exact duplicates -> exact score ties
    Q = rng.normal(size=(25, 16))
    idx = spark.createDataFrame([(int(i), X[i].tolist()) for i in range(300)], "vector_id long, embedding array<double>")
    qs = spark.createDataFrame([(int(i), Q[i].tolist()) for i in range(25)], "query_id long, embedding array<double>")
    for cosine in (False, True):
        for max_bytes in (1 << 28, 2000):
            got = {}
            for r in knn_exact(idx.repartition(5), qs, 12, cosine=cosine, max_chunk_bytes=max_bytes).collect():
                got.setdefault(r["query_id"], []).append((r["rank"], r["vector_id"]))
            S = Q @ X.T
            if cosine:
                S = S / (np.linalg.norm(Q, axis=1)[:, None] * np.linalg.norm(X, axis=1)[None, :])
            for q in range(25):
                exp = sorted(range(300), key=lambda j: (-S[q, j], j))[:12]
                assert [v for _, v in sorted(got[q])] == exp
