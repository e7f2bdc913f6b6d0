"""Approximate nearest neighbours: bands of sign projections, exact distances.

A band is a few random hyperplanes; the signs of a vector on them are its cell. Two
vectors at an angle a share a cell of r planes with probability (1 - a / pi)^r. The
planes per band grow with the index, so that a cell holds about ``CELL`` entries whatever
its size. A vector travels once per band: cells are as large as one group takes, as each
plane less saves about a third of the bands at the same recall, for some 1.3 times the
distances. The number of bands comes from the data: the nearest neighbours of a bounded
sample are searched exactly, and bands are added until the expected share of these that
meet in some band reaches the recall asked for (neighbours in the whole index are nearer,
so this errs to the safe side).

Queries and entries meet on one key, (band, cell), in cogroups that keep a running top-k;
a cell with very many entries or queries is split, its entries into several parts and its
queries into several blocks. What leaves a group is k rows per query with exact
distances; they are merged per pair and ranked. A query that found fewer than k entries
is searched exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.operators.blocks import dense_kernel
from srcindex.session import stage

#: Entries of a cell that the planes per band aim at; most entries and queries of one group, on average.
CELL, PART_ROWS, BLOCK_ROWS = 8_192, 16_384, 16_384
#: Rows of the sample that the bands are chosen on, and of its queries; most bands.
SAMPLE, SAMPLE_QUERIES, MOST_BANDS = 4_000, 200, 32


def planes(dim: int, bits: int, band: int, seed: int) -> np.ndarray:
    """The hyperplanes of a band; the same on every machine."""
    return np.random.default_rng([seed, dim, band]).standard_normal((dim, bits))


def cells(x: np.ndarray, bits: int, band: int, seed: int) -> np.ndarray:
    return ((x @ planes(x.shape[1], bits, band, seed)) > 0) @ (1 << np.arange(bits))


def choose(sample: np.ndarray, n_index: int, k: int, recall: float) -> tuple[int, int]:
    """Planes per band and number of bands for an index of ``n_index`` entries."""
    bits = int(max(1, min(40, round(np.log2(max(n_index, 1) / CELL)))))
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    asked = sample[:SAMPLE_QUERIES]
    d = (asked * asked).sum(axis=1)[:, None] + (sample * sample).sum(axis=1) - 2 * asked @ sample.T
    near = np.argsort(d, axis=1)[:, :k + 1]  # with the row itself, as an index mostly holds its queries
    cosine = np.clip(np.take_along_axis(unit[:SAMPLE_QUERIES] @ unit.T, near, axis=1), -1, 1)
    miss = 1 - (1 - np.arccos(cosine) / np.pi) ** bits
    for bands in range(1, MOST_BANDS):
        if 1 - (miss[:, 1:] ** bands).mean() >= recall:
            return bits, bands
    return bits, MOST_BANDS


def _placed(table: DataFrame, id_col: str, vec: str, bits: int, bands: int, seed: int) -> DataFrame:
    """Each row once per band, with its cell."""
    def run(batches):
        for part in batches:
            if not part.num_rows:
                continue
            x = part.column(vec).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            for band in range(bands):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, band, np.int32)), pa.array(cells(x, bits, band, seed), pa.int64())],
                                                 names=[id_col, vec, "_band", "_cell"])
    kinds = dict(table.dtypes)
    return table.select(id_col, vec).mapInArrow(run, f"{id_col} {kinds[id_col]}, {vec} {kinds[vec]}, _band int, _cell long")


def lsh_neighbours(queries: DataFrame, index: DataFrame, k: int, recall: float, seed: int, query_id: str, qvec: str, entry_id: str, vec: str,
                   part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, entry_id, distance): up to k rows of every group, merged per pair. Vectors are of one length, without nulls."""
    n_index = index.count()
    kinds = dict(queries.dtypes) | dict(index.dtypes)
    schema, names = f"{query_id} {kinds[query_id]}, {entry_id} {kinds[entry_id]}, distance double", [query_id, entry_id, "distance"]
    few = index.select(vec).orderBy(F.xxhash64(vec)).limit(SAMPLE).toPandas()[vec]  # a bounded sample
    if not len(few):
        return queries.sparkSession.createDataFrame([], schema)
    bits, bands = choose(np.stack(few.to_numpy()).astype(np.float64), n_index, k, recall)
    q = _placed(queries, query_id, qvec, bits, bands, seed)
    x = _placed(index, entry_id, vec, bits, bands, seed)
    key = ["_band", "_cell"]
    share = lambda t, rows, name: t.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    split = stage(share(q, block_rows, "_blocks").join(share(x, part_rows, "_parts"), key), "lsh-cells")  # cells with both
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.monotonically_increasing_id()), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(split, key).withColumn("_block", deal(query_id, F.col("_blocks"))).withColumn("_part", every("_parts")).drop("_blocks", "_parts")
    right = x.join(split, key).withColumn("_part", deal(entry_id, F.col("_parts"))).withColumn("_block", every("_blocks")).drop("_blocks", "_parts")
    group = [*key, "_block", "_part"]
    found = (left.groupBy(*group).cogroup(right.groupBy(*group))
             .applyInArrow(dense_kernel(k, None, qvec, vec, names, 9), schema))
    return found.groupBy(query_id, entry_id).agg(F.min("distance").alias("distance"))


def measured_recall(exact: DataFrame, found: DataFrame, query_id: str = "query_id", entry_id: str = "entry_id") -> float:
    """Share of the exact neighbours that were found."""
    n = exact.count()
    return exact.join(found, [query_id, entry_id], "left_semi").count() / n if n else 1.0

