"""Every registered query against its DuckDB oracle (sf0.001), like the driver's gate."""

import math

import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

from vecspark.plans.catalog import QUERIES as LIBRARY_QUERIES

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def _canon(v):
    if v is None or v is pd.NA:
        return (0, "")
    if isinstance(v, float):
        return (0, "") if math.isnan(v) else (1, repr(round(v, 9)))
    if isinstance(v, bool):
        return (1, repr(float(v)))
    if isinstance(v, int):
        return (1, repr(float(v)))
    return (3, str(v))


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


def test_every_query_has_an_oracle():
    missing = sorted(set(LIBRARY_QUERIES) - set(ORACLE))
    assert missing == [], missing


@pytest.mark.parametrize("key", sorted(set(ORACLE) & set(LIBRARY_QUERIES)))
def test_query_matches_oracle(spark, duck, key):
    sp = QUERIES[key](spark, SF_SMALL).toPandas()
    duck.execute(f"CREATE OR REPLACE VIEW oracle_view AS {ORACLE[key]}")     # as the driver's gate does
    dp = duck.sql("SELECT * FROM oracle_view").df()
    sc, sr = _rows(sp)
    dc, dr = _rows(dp)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "vector_id", "score"]
    assert df.count() >= 0
