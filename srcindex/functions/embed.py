"""Hashed token-count embedding (IX-9 / IX-10), built from JVM functions only.

A text becomes a sparse vector over ``dim`` buckets: tokens are runs of
letters, digits and underscore in the lower-cased text; a token's bucket is
the first eight hex digits of its MD5 read as an integer, modulo ``dim``; the
weight is the token count. Each row keeps its vector as two parallel sorted
arrays ``buckets`` / ``tfs`` plus ``norm2 = sum(tf*tf)``, so embedding is a
per-row projection: no shuffle, and all postings of an entry stay together.

Dot products and norms are integers, so the squared L2 distance of the unit
vectors, ``2 - 2*dot/sqrt(n1*n2)``, does not depend on summation order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the embedding contract (shared with the SQL oracle).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
DEFAULT_DIM = 1024


def tokens(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def token_bucket(tok: Column, dim: int = DEFAULT_DIM) -> Column:
    head = F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(dim)).cast("int")


def embed(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """Add ``buckets``, ``tfs``, ``norm2`` computed from ``text_col`` (no shuffle).

    The sorted bucket array is materialised in its own projection before the
    run-length step: lambdas that index into it then read a column instead of
    re-evaluating the tokenizer and hashes for every element.
    """
    s = F.col("_s")
    n = F.size(s)
    # Every vector column is non-nullable (coalesce): otherwise Catalyst infers
    # ``isnotnull(norm2)`` from later distance filters and pushes it down with
    # the whole tokenizer chain inlined into the scan filter.
    empty = F.array().cast("array<int>")
    staged = df.withColumn("_s", F.coalesce(
        F.sort_array(F.transform(tokens(text_col), lambda t: token_bucket(t, dim))), empty))
    # 1-based positions where a new run of equal buckets starts
    staged = staged.withColumn("_starts", F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (i <= n) & ((i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1))))),
    ))
    starts = F.col("_starts")
    tfs = F.transform(
        starts,
        lambda i, j: (F.when(j + 2 <= F.size(starts), F.element_at(starts, F.least(j + 2, F.size(starts))))
                      .otherwise(n + 1) - i).cast("int"),
    )
    out = (staged.withColumn("buckets", F.coalesce(F.transform(starts, lambda i: F.element_at(s, i)), empty))
                 .withColumn("tfs", F.coalesce(tfs, empty))
                 .drop("_s", "_starts"))
    return out.withColumn(
        "norm2", F.coalesce(F.aggregate("tfs", F.lit(0).cast("long"), lambda acc, x: acc + (x * x).cast("long")),
                            F.lit(0).cast("long")))


def postings(df: DataFrame, id_col: str, keep: tuple[str, ...] = ("norm2",)) -> DataFrame:
    """Long form ``(id, bucket, tf, *keep)`` of an embedded table."""
    z = F.explode(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("tfs").alias("tf")))
    return (df.select(id_col, *keep, z.alias("_p"))
              .select(id_col, F.col("_p.bucket").alias("bucket"), F.col("_p.tf").alias("tf"), *keep))


def idf_weights(index: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """Per-bucket inverse document frequency ``ln(N / df)``; at most ``dim`` rows.

    ``N`` is a single scalar computed by one count job; the bucket table is
    bounded by the embedding dimension, so it is safe to broadcast.
    """
    n_entries = index.count()
    return (postings(index, id_col, keep=()).groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("df"))
            .select("bucket", F.log(F.lit(float(max(n_entries, 1))) / F.col("df")).alias("idf")))


def dense_embedder(fn, dim: int):
    """Wrap ``fn(list[str]) -> array-like (n, dim)`` as an Arrow-batched pandas UDF.

    The pluggable slot for a dense text model (IX-9): the function runs once
    per Arrow batch inside the tasks (load the model lazily inside ``fn``), and
    the result is an ``array<float>`` column usable by ``dense_knn``.
    """
    @F.pandas_udf("array<float>")
    def _embed(texts: pd.Series) -> pd.Series:
        import numpy as np
        out = np.asarray(fn(texts.fillna("").tolist()), dtype=np.float32).reshape(len(texts), dim)
        return pd.Series(list(out))

    return _embed
