"""Search in SQL against NumPy, with awkward rows; the plan of a search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators.sql_functions import register_sql_functions, search_sql, search_sql_by

QUERY = [1.0, 2.0, 0.5]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = [(i, rng.normal(size=3).round(1).tolist(), "hot" if i % 3 else f"g{i % 5}") for i in range(300)]
    out += [(1000 + i, out[i][1], out[i][2]) for i in range(40)]                    # ties
    return out + [(2000, None, "hot"), (2001, [1.0, None, 1.0], "hot"), (2002, [1.0], "hot"), (2003, [0.0, 0.0, 0.0], "zero"),
                  (2004, [float("nan"), 1.0, 1.0], "hot"), (2005, QUERY, None), (2006, QUERY, None)]


def distance(v):
    if v is None or len(v) != 3 or any(x is None or x != x for x in v):
        return None
    n = np.linalg.norm(v) * np.linalg.norm(QUERY)
    return 1.0 if n == 0 else 1.0 - float(np.dot(v, QUERY)) / n


def ranked(rows, k):
    """(id, distance) in order; distances that differ by rounding only are ties, as equal vectors are."""
    return sorted((round(d, 9), i) for i, v, _ in rows if (d := distance(v)) is not None)[:k]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vector_id long, embedding array<double>, kind string").repartition(5)


def test_search_in_sql_matches_numpy(spark, rows):
    df = frame(spark, rows)
    for k in (1, 7, 1000):
        got = [(round(r["distance"], 9), r["id"]) for r in search_sql(spark, df, QUERY, k).collect()]
        want = ranked(rows, k)
        assert [d for d, _ in got] == pytest.approx([d for d, _ in want], abs=1e-8)
        assert sorted(i for d, i in got if d < want[-1][0] - 1e-8) == sorted(i for d, i in want if d < want[-1][0] - 1e-8)
    plan = search_sql(spark, df.where("vector_id >= 0"), QUERY, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPythonUDTF") < plan.index("Exchange") and plan.count("Exchange") == 1      # the test's own repartition
    assert search_sql(spark, df.limit(0), QUERY, 3).count() == 0


def test_search_of_every_group(spark, rows):
    for salts in (1, 7):
        got: dict = {}
        for r in search_sql_by(spark, frame(spark, rows), QUERY, "kind", 4, salts=salts).collect():
            got.setdefault(r["grp"], []).append(r["distance"])
        kinds = {g for _, v, g in rows if distance(v) is not None}
        assert set(got) == kinds
        for g in kinds:
            want = [d for d, _ in ranked([r for r in rows if r[2] == g], 4)]
            assert sorted(got[g]) == pytest.approx(want, abs=1e-8)


def test_distance_function(spark, rows):
    register_sql_functions(spark)
    got = spark.sql("SELECT vector_id, cosine_distance(embedding, :q) AS d FROM {rows}", rows=frame(spark, [r for r in rows if r[0] != 2004]),
                    args={"q": F.array(*map(F.lit, QUERY))}).collect()
    assert len(got) == len(rows) - 1
    want = {i: distance(v) for i, v, _ in rows}
    for r in got:
        assert r["d"] == (None if want[r["vector_id"]] is None else pytest.approx(want[r["vector_id"]], abs=1e-9)), r


def test_wrong_calls_fail(spark, rows):
    with pytest.raises(Exception, match="positive"):
        search_sql(spark, frame(spark, rows), QUERY, 0).collect()
    register_sql_functions(spark)
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM knn(TABLE(SELECT 1L AS a), array(1D), 3)").collect()
