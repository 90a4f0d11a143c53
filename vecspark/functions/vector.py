"""Dense-vector expressions on ``array<float|double>`` columns.

All arithmetic is done in double.  These run as higher-order functions inside
the JVM; the block scorer in ``operators.blockscan`` is the fast path for
large all-against-all scoring.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of element-wise products, accumulated left to right in double."""
    prods = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _sum_squares(v) -> Column:
    return F.aggregate(as_double_array(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def l2_norm(v) -> Column:
    return F.sqrt(_sum_squares(v))


def l2_normalize(v) -> Column:
    """v / ||v||; a zero or null vector gives null (callers route it to rejects).

    The norm is bound to a lambda's variable: inside the lambda over the
    components it would be summed anew for each of them.
    """
    norms = F.filter(F.array(l2_norm(v)), lambda n: n > 0)
    return F.get(F.transform(norms, lambda n: F.transform(as_double_array(v), lambda x: x / n)), F.lit(0))


def cosine_similarity(a, b) -> Column:
    """dot / (||a|| * ||b||); works on un-normalized input; null for zero vectors."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den)


def cosine_distance(a, b) -> Column:
    """1 - cosine similarity (the ``<=>`` operator of the SQL vector store)."""
    return F.lit(1.0) - cosine_similarity(a, b)
