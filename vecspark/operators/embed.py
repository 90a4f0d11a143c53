"""Text -> vector.

``hash_embed`` is map-only (no shuffle): tokens are split and md5-hashed
into ``dim`` signed buckets by JVM expressions, and an Arrow-batched pandas
helper sums them into a dense ``array<double>`` of integer counts (one
``bincount`` per batch).  Normalize with ``functions.l2_normalize`` (or score with
cosine) afterwards; keeping integer counts makes dot products exact.

``embed`` is the hook for a real encoder: a ``mapInPandas`` job where the
model is built once per task by ``encoder_factory`` and applied to Arrow
batches of ``batch_size`` texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.session import ship_library

TOKEN_SPLIT = "[ \\t\\n\\r\\f]+"


def tokens(text_col) -> "F.Column":
    """Lower-cased tokens split on ASCII whitespace runs, empty tokens removed."""
    return F.filter(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT), lambda t: t != "")


def signed_buckets(text_col: str, dim: int):
    """Per token ``+(b+1)`` or ``-(b+1)``: md5 bucket b in [0, dim) and md5 sign (JVM-side)."""
    def code(t):
        h = F.md5(t)
        b = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int")
        neg = F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 1
        return F.when(neg, -(b + 1)).otherwise(b + 1)
    return F.transform(tokens(text_col), code)


def _bucket_sum_udf(dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def bucket_sum(codes: pd.Series) -> pd.Series:
        # one vectorized bincount per Arrow batch over (row, bucket) keys
        n = len(codes)
        lens = codes.map(len).to_numpy()
        flat = (np.concatenate([np.asarray(c, dtype=np.int64) for c in codes])
                if lens.sum() else np.zeros(0, dtype=np.int64))
        rows = np.repeat(np.arange(n), lens)
        m = np.bincount(rows * dim + np.abs(flat) - 1, weights=np.sign(flat).astype(np.float64),
                        minlength=n * dim).reshape(n, dim)
        return pd.Series(list(m))
    return bucket_sum


def hash_embed(df: DataFrame, *, id_col: str, text_col: str = "text", dim: int = 64,
               out_col: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """(id, ``keep``..., embedding array<double>) signed feature-hash counts; map-only.

    Tokenizing and md5 hashing run in the JVM; the Python helper only adds
    the +-1 codes into ``dim`` buckets, a whole Arrow batch per bincount.
    A row without tokens gets the zero vector (cosine scoring skips it).
    """
    return df.select(F.col(id_col), *keep, _bucket_sum_udf(dim)(signed_buckets(text_col, dim)).alias(out_col))


def embed(df: DataFrame, encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]], *,
          text_col: str = "text", out_col: str = "embedding", batch_size: int = 32,
          normalize: bool = True) -> DataFrame:
    """Apply an encoder (built once per task) to every text; adds ``out_col``."""
    ship_library(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(frames):
        enc = encoder_factory()
        for pdf in frames:
            texts = pdf[text_col].fillna("").tolist()
            parts = [np.asarray(enc(texts[i:i + batch_size]), dtype=np.float64)
                     for i in range(0, len(texts), batch_size)]
            M = np.vstack(parts) if parts else np.zeros((0, 0))
            if normalize and len(M):
                n = np.linalg.norm(M, axis=1, keepdims=True)
                M = np.where(n > 0, M / np.where(n > 0, n, 1), np.nan)
            pdf = pdf.copy()
            pdf[out_col] = pd.Series([r.astype(np.float32) for r in M], index=pdf.index, dtype=object)
            yield pdf

    return df.mapInPandas(run, schema)
