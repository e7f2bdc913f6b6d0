"""Dense embedding learned from the corpus (IX-9): buckets that occur together lie close.

The count vectors, weighted by ln(N / df) and scaled to length 1, are the rows of a large
sparse matrix X. Its leading right singular vectors are found by a randomised range
finder: a random matrix of a few columns is multiplied by X^T X a few times and made
orthonormal in between. A product is one Spark job over the staged vectors; a task adds up
its own part of ``dim`` x ``columns`` numbers, Spark sums the parts, and only this matrix,
whose size does not depend on the corpus, comes to the driver. A text's vector is its row
of X times the singular vectors, scaled to length 1, so it needs no other text.

Defined results: a text without a token, or with none that tells texts apart, has no
vector (null). Equal texts have equal vectors. The sign of each singular vector is fixed
(its largest entry is positive).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.functions.embed import DEFAULT_DIM, idf_weights

#: Length of the learned vectors, further columns of the range finder, products of it, rows multiplied at once.
RANK, EXTRA, PRODUCTS, ROWS = 64, 16, 3, 2048


class DenseModel(NamedTuple):
    """Weight of every bucket, and the singular vectors (dim x rank)."""

    idf: np.ndarray
    basis: np.ndarray


def weighted_rows(part, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of a batch of count vectors as unit rows; entries of no weight are left out."""
    lists = part.column("buckets")
    size = np.diff(lists.offsets.to_numpy())
    bucket = lists.flatten().to_numpy()
    row = np.repeat(np.arange(part.num_rows), size)
    weight = part.column("tfs").flatten().to_numpy() * idf[bucket]
    norm = np.sqrt(np.bincount(row, weight * weight, part.num_rows))
    keep = weight > 0
    row, bucket, weight = row[keep], bucket[keep], weight[keep]
    return row, bucket, weight / norm[row]


def times(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """The sparse rows times a matrix."""
    out = np.zeros((n, matrix.shape[1]))
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.add.reduceat(matrix[bucket] * weight[:, None], first)
    return out


def gram_times(vectors: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """X^T X times a matrix of ``dim`` rows and few columns."""
    dim, columns = matrix.shape

    def run(batches):
        total = np.zeros((dim, columns))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                row, bucket, weight = weighted_rows(part, idf)
                if not len(row):
                    continue
                z = times(row, bucket, weight, part.num_rows, matrix)
                order = np.argsort(bucket, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
                total[bucket[order][first]] += np.add.reduceat(z[row[order]] * weight[order][:, None], first)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, columns), pa.int32()), pa.array(np.tile(np.arange(columns), len(used)), pa.int32()), pa.array(total[used].ravel())],
            names=["i", "j", "x"])

    sums = (vectors.select("buckets", "tfs").mapInArrow(run, "i int, j int, x double")
            .groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas())  # at most dim x columns rows
    out = np.zeros((dim, columns))
    out[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["x"].to_numpy()
    return out


def learn(vectors: DataFrame, rank: int = RANK, dim: int = DEFAULT_DIM, products: int = PRODUCTS, seed: int = 11) -> DenseModel:
    """Learn from staged count vectors (``buckets``, ``tfs``); ``rank`` is cut to what they span."""
    idf = np.zeros(dim)
    w = idf_weights(vectors.select(F.lit(0).alias("entry_id"), "buckets", "tfs")).toPandas()  # at most dim rows
    idf[w["bucket"].to_numpy()] = w["idf"].to_numpy()
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, min(dim, rank + EXTRA))))[0]
    for _ in range(products - 1):
        basis = np.linalg.qr(gram_times(vectors, idf, basis))[0]
    value, turn = np.linalg.eigh(_symmetric(basis.T @ gram_times(vectors, idf, basis)))
    keep = np.argsort(value)[::-1][:rank]
    keep = keep[value[keep] > 1e-9 * max(value.max(initial=0.0), 1e-300)]
    basis = basis @ turn[:, keep]
    largest = np.abs(basis).argmax(axis=0)
    return DenseModel(idf, basis * np.where(basis[largest, np.arange(basis.shape[1])] < 0, -1.0, 1.0))


def _symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def embed_dense(vectors: DataFrame, model: DenseModel, out: str = "embedding") -> DataFrame:
    """Add the learned vector (array of float, or null) to rows with ``buckets`` and ``tfs``."""
    names = vectors.columns

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                v = times(*weighted_rows(part, model.idf), part.num_rows, model.basis)
                norm = np.sqrt((v * v).sum(axis=1))
                none = norm < 1e-9
                v = (v / np.where(none, 1.0, norm)[:, None]).astype(np.float32)
                size = np.where(none, 0, v.shape[1])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, size)), pa.int32(), mask=np.append(none, False)), pa.array(v[~none].ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*names, out])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in vectors.dtypes), f"`{out}` array<float>"])
    return vectors.mapInArrow(run, schema)
