r"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Unit vectors are hashed by ``TABLES`` tables of ``WIDTH``-wide cells along
``PLANES`` Gaussian (2-stable) projections. A query visits, in every table, its own
cell and the cells around it in order of estimated success: the smaller the squared
distance to the borders that a perturbation crosses, the sooner. The cells of a
table are spread over parts of about ``PART`` vectors; a query goes to the parts that
hold its cells, where its candidates are ranked by exact cosine in double precision
and its best k leave. Tables meet in one small top-k per query.

Equal vectors are merged first (the k + 1 smallest ids of each can ever be among k
nearest), so a vector that a third of the rows share is one candidate; cells of very
many vectors are salted over several parts. A query that found fewer than k goes to
all parts of one table, so it gets all candidates if there are fewer than k.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows without an id; dimensions are searched apart; an
id with several rows counts once per different vector, and queries with the smallest;
equal scores go to the smaller id; other columns are not read; an empty table gives
no rows. Recall on vectors without any structure is measured in the README.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcindex.llm.common import query, table
from srcindex.session import stage

#: Tables, projections per table, cell width (in units of a projection's deviation), cells visited per table.
TABLES, PLANES, WIDTH, PROBES = 14, 8, 1.5, 450
#: Vectors of a part; most vectors of a cell before it is salted.
PART, HOT = 20_000, 20_000
_SHIFTS = np.array(list(itertools.product((0, -1, 1), repeat=PLANES)), np.int64)
_ODD = np.random.default_rng(5).integers(1 << 40, 1 << 62, 64) | 1


def projections(dim: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and offsets of table t for vectors of a dimension; the same on every machine."""
    rng = np.random.default_rng([2024, dim, t])
    return rng.standard_normal((dim, PLANES)), rng.random(PLANES)


def cell_keys(cells: np.ndarray) -> np.ndarray:
    """A number per cell (last axis: the cell's coordinates)."""
    return (cells * _ODD[:cells.shape[-1]]).sum(axis=-1)  # wraps modulo 2**64


def cells_of(x: np.ndarray, t: int) -> np.ndarray:
    a, b = projections(x.shape[1], t)
    return cell_keys(np.floor(x @ a / WIDTH + b).astype(np.int64))


def probes_of(x: np.ndarray, t: int, n: int = PROBES) -> np.ndarray:
    """The n cells of each row that most likely hold its neighbours, best first."""
    a, b = projections(x.shape[1], t)
    place = x @ a / WIDTH + b
    home = np.floor(place)
    low = place - home  # distance to the lower border; 1 - low to the upper
    out = np.empty((len(x), min(n, len(_SHIFTS))), np.int64)
    down, up = (_SHIFTS < 0).T.astype(float), (_SHIFTS > 0).T.astype(float)
    for i in range(0, len(x), 256):
        s = slice(i, i + 256)
        cost = low[s] ** 2 @ down + (1 - low[s]) ** 2 @ up
        first = np.argsort(cost, axis=1, kind="stable")[:, :n]
        out[s] = cell_keys(home[s, None].astype(np.int64) + _SHIFTS[first])
    return out


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return (rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where((F.size("embedding") > 0) & fine & F.exists(v, lambda x: x != 0))
            .select("vec_id", v.alias("v")))


def merged(rows: DataFrame, k: int) -> DataFrame:
    """v and the k + 1 smallest ids that have it."""
    first = Window.partitionBy("v").orderBy("vec_id")
    return (rows.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
            .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


def _by_dimension(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of each dimension in an Arrow list column."""
    rows = column.to_numpy(zero_copy_only=False)
    sizes = np.array([len(r) for r in rows])
    out = {}
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = np.stack([rows[i] for i in at]).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so squares neither overflow nor vanish
        out[int(d)] = at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return out


def hashed(vectors: DataFrame, tables: int) -> DataFrame:
    """ids, v once per table, with dim, t and the cell."""
    def run(batches):
        for batch in batches:
            for d, (at, x) in _by_dimension(batch.column("v")).items():
                rows = batch.take(pa.array(at))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([rows.column("ids"), rows.column("v"), pa.array([d] * len(at), pa.int32()), pa.array([t] * len(at), pa.int32()),
                                                      pa.array(cells_of(x, t), pa.int64())], names=["ids", "v", "dim", "t", "cell"])
    return vectors.mapInArrow(run, "ids array<long>, v array<double>, dim int, t int, cell long")


def probing(queries: DataFrame, tables: int, parts: int, salts: int, probes: int) -> DataFrame:
    """A row per query and part that holds some of its cells: qid, v, dim, t, part, salt, cells."""
    def run(batches):
        for batch in batches:
            for d, (at, x) in _by_dimension(batch.column("v")).items():
                rows = batch.take(pa.array(at))
                for t in range(tables):
                    cells = probes_of(x, t, probes)
                    part = _part_of(cells, parts)
                    for p in range(parts):
                        inside = part == p
                        has = np.flatnonzero(inside.any(axis=1))
                        if not len(has):
                            continue
                        sub = rows.take(pa.array(has))
                        lists = pa.array([cells[i][inside[i]] for i in has], pa.list_(pa.int64()))
                        for salt in range(salts):
                            n = len(has)
                            yield pa.RecordBatch.from_arrays(
                                [sub.column("vec_id"), sub.column("v"), lists] + [pa.array([c] * n, pa.int32()) for c in (d, t, p, salt)],
                                names=["vec_id", "v", "cells", "dim", "t", "part", "salt"])
    return queries.mapInArrow(run, "vec_id long, v array<double>, cells array<long>, dim int, t int, part int, salt int")


def _part_of(cells: np.ndarray, parts: int) -> np.ndarray:
    return ((cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of every row of x with q, in double precision; a row's value does not depend on the others."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _rank(k: int):
    def rank(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Best k of every query among the vectors of this part that lie in its cells."""
        qs, ids, scores = [], [], []
        if len(data) and len(asked):
            order = np.argsort(data["cell"].to_numpy(), kind="stable")
            cell = data["cell"].to_numpy()[order]
            x = np.stack(data["v"].to_numpy()[order])
            norm = np.sqrt((x * x).sum(axis=1))
            own = data["ids"].to_numpy()[order]
            for q, v, cells in zip(asked["vec_id"].to_numpy(), asked["v"].to_numpy(), asked["cells"].to_numpy()):
                if cells is None:
                    rows = np.arange(len(x))
                else:
                    cells = np.unique(cells)
                    lo, hi = np.searchsorted(cell, cells, "left"), np.searchsorted(cell, cells, "right")
                    n = hi - lo
                    if not n.sum():
                        continue
                    rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                s = (x[rows] * v).sum(axis=1) / (norm[rows] * np.sqrt((v * v).sum()))
                if len(rows) > k + 1:  # the query's own vector may be one of them; ties with the last stay in
                    edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    rows, s = rows[s >= edge], s[s >= edge]
                best = sorted((-c, i) for r, c in zip(rows, s) for i in own[r] if i != q)[:k]
                qs += [q] * len(best)
                ids += [i for _, i in best]
                scores += [-c for c, _ in best]
        return pd.DataFrame({"query_id": np.array(qs, np.int64), "vec_id": np.array(ids, np.int64), "score": np.array(scores, np.float64)})
    return rank


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query (vec_id, embedding) among ``rows``."""
    vectors = stage(merged(usable(rows), k), "ann-vectors")
    asked = stage(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    cells = hashed(vectors, tables)
    most = cells.groupBy("dim", "t", "cell").count().agg(F.max("count").alias("m"), F.sum("count").alias("n")).first()
    parts = max(1, -(-(most.n or 0) // (tables * PART)))
    salts = max(1, -(-(most.m or 0) // HOT))
    part = F.pandas_udf(lambda c: pd.Series(_part_of(c.to_numpy(), parts).astype(np.int32)), "int")
    data = cells.withColumn("part", part("cell")).withColumn("salt", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(salts)).cast("int"))
    keys = ["dim", "t", "part", "salt"]
    schema = "query_id long, vec_id long, score double"

    def search(asked_rows: DataFrame, within: DataFrame) -> DataFrame:
        return asked_rows.groupBy(*keys).cogroup(within.groupBy(*keys)).applyInPandas(lambda a, d: _rank(k)(d, a), schema)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = stage(top(search(probing(asked, tables, parts, salts, probes), data)), "ann-found")
    few = found.groupBy("query_id").count().where(F.col("count") < k)
    short = stage(asked.join(found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "ann-short")
    if not short.isEmpty():
        everywhere = (short.select("vec_id", "v", F.lit(None).cast("array<long>").alias("cells"), F.size("v").alias("dim"), F.lit(0).alias("t"),
                                   F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
                      .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
        exact = top(search(everywhere, data.where("t = 0")))
        found = found.join(few.select("query_id"), "query_id", "left_anti").unionByName(exact.select(*found.columns))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op8_ann")
def op8_ann(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"), k=5)
