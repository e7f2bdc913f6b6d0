"""Exact similarity join under a distance cut: prefix filtering over count vectors.

Two unit vectors within distance ``max_distance`` have a cosine of at least
t = 1 - max_distance / 2. Let every vector's buckets be ordered from rare to common (one
order for all). Of a pair's common buckets take the rarest: all others come after it, so
the cosine is at most the product of the two norms *from that bucket on*. A bucket from
which on a vector's norm is below t can therefore never be a pair's rarest common one,
and only the buckets before, its prefix, are posted. Postings meet on the bucket. A pair
goes on only

* if the product of the two weights there, plus that of the norms after, reaches t, and
* if each vector has as many buckets as the other one needs: the m largest weights of a
  vector bound its cosine with any vector of m buckets, so a short line is no candidate
  of a long text whose weight is spread.

A pair's matches are then added up: with the norms after its last match they bound its
cosine once more. What is left is verified by ids on the whole vectors. No pair within the cut is lost, and
common buckets, which would make the long lists, are mostly in no prefix at all.

A bucket in very many entries is split: its entries are dealt to several salts and the
queries repeated for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.session import stage

#: Entries of a bucket that one salt holds, on average.
SPLIT = 100_000
#: Relative slack of the norm bounds against rounding; verification is exact.
SLACK = 1e-9


def bucket_counts(index: DataFrame, dim: int) -> np.ndarray:
    """In how many entries each bucket is: at most ``dim`` rows."""
    counts = index.select(F.explode("buckets").alias("b")).groupBy("b").count().toPandas()
    out = np.zeros(dim, np.int64)
    out[counts["b"].to_numpy()] = counts["count"].to_numpy()
    return out


def prefixes(vectors: DataFrame, id_col: str, counts: np.ndarray, t: float, repeat: bool, split: int = SPLIT) -> DataFrame:
    """A row per prefix bucket: (bucket, salt, id, weight there, norm after it, buckets of the vector, buckets that a
    partner needs); weights are those of the unit vector."""
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    salts = counts // split + 1

    def run(batches):
        for part in batches:
            lists, tfs = part.column("buckets"), part.column("tfs")
            size = np.diff(lists.offsets.to_numpy())
            start = np.cumsum(size) - size
            b, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.float64)
            row = np.repeat(np.arange(part.num_rows), size)
            norm2 = part.column("norm2").to_numpy().astype(np.float64)
            so_far = lambda x: np.cumsum(x) - np.append(0.0, np.cumsum(x))[start][row]  # noqa: E731  within a row; exact: integers
            falling = (tf * tf)[np.lexsort((-tf, row))]
            enough = so_far(falling) >= t * t * norm2[row] * (1 - SLACK)
            need = size - np.bincount(row, enough, part.num_rows).astype(np.int64) + 1
            order = np.lexsort((rank[b], row))
            b, square = b[order], tf[order] ** 2
            upto = so_far(square)
            rest = norm2[row] - upto + square  # from this bucket on
            keep = np.flatnonzero(rest >= t * t * norm2[row] * (1 - SLACK))
            b, row = b[keep], row[keep]
            weight = np.sqrt(square[keep] / norm2[row])
            after = np.sqrt(np.maximum(norm2[row] - upto[keep], 0.0) / norm2[row])
            if repeat:
                times = salts[b]
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                b, row, weight, after = (np.repeat(x, times) for x in (b, row, weight, after))
            else:
                salt = row % salts[b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), pa.array(salt, pa.int32()), part.column(id_col).take(pa.array(row)), pa.array(weight), pa.array(after),
                 pa.array(size[row], pa.int32()), pa.array(need[row], pa.int32())], names=["bucket", "salt", id_col, "weight", "after", "size", "need"])

    kind = dict(vectors.dtypes)[id_col]
    return vectors.select(id_col, "buckets", "tfs", "norm2").mapInArrow(
        run, f"bucket int, salt int, {id_col} {kind}, weight double, after double, size int, need int")


def candidates(queries: DataFrame, index: DataFrame, max_distance: float, query_id: str, entry_id: str, dim: int, split: int = SPLIT) -> DataFrame:
    """Different (query, entry) pairs that pass the bounds: a superset of the pairs within the cut. Vectors are not empty."""
    t = 1.0 - max_distance / 2.0
    if t <= 0:
        raise ValueError("a cut of 2 or more excludes nothing: use a search without one")
    counts = bucket_counts(index, dim)
    q = prefixes(queries, query_id, counts, t, True, split).alias("q")
    x = prefixes(index, entry_id, counts, t, False, split).alias("x")
    bound = F.col("q.weight") * F.col("x.weight") + F.col("q.after") * F.col("x.after")
    return (q.join(x, (F.col("q.bucket") == F.col("x.bucket")) & (F.col("q.salt") == F.col("x.salt"))
                   & (F.col("q.size") >= F.col("x.need")) & (F.col("x.size") >= F.col("q.need")) & (bound >= t * (1 - SLACK)))
            .groupBy(F.col(f"q.{query_id}").alias(query_id), F.col(f"x.{entry_id}").alias(entry_id))
            .agg(F.sum(F.col("q.weight") * F.col("x.weight")).alias("seen"), (F.min("q.after") * F.min("x.after")).alias("open"))
            .where(F.col("seen") + F.col("open") >= t * (1 - SLACK)).select(query_id, entry_id))


def common_count(buckets_a: str, tfs_a: str, buckets_b: str, tfs_b: str):
    """Dot product of two sparse count vectors."""
    found = F.map_from_arrays(buckets_a, tfs_a)
    return F.aggregate(F.arrays_zip(F.col(buckets_b).alias("b"), F.col(tfs_b).alias("n")), F.lit(0).cast("long"),
                       lambda acc, p: acc + p["n"].cast("long") * F.coalesce(F.element_at(found, p["b"]), F.lit(0)).cast("long"))


def pairs_within(queries: DataFrame, index: DataFrame, max_distance: float, query_id: str = "query_id", entry_id: str = "entry_id",
                 dim: int = 1024, split: int = SPLIT) -> DataFrame:
    """Every (query, entry) with a common token and a distance of at most ``max_distance``: (query_id, entry_id, distance).

    Both sides are staged, as counts, prefixes and verification read them.
    """
    from srcindex.operators.knn import unit_l2_distance

    # filtered after staging: pushed further down, the filter would hold the whole tokenizer
    q = stage(queries.select(query_id, "buckets", "tfs", "norm2"), "cut-queries").where("norm2 > 0")
    x = stage(index.select(entry_id, "buckets", "tfs", "norm2"), "cut-index").where("norm2 > 0")
    found = candidates(q, x, max_distance, query_id, entry_id, dim, split)
    whole = (found.join(q.select(query_id, F.col("buckets").alias("qb"), F.col("tfs").alias("qt"), F.col("norm2").alias("qn")), query_id)
             .join(x, entry_id))
    return (whole.select(query_id, entry_id, unit_l2_distance(common_count("qb", "qt", "buckets", "tfs"), F.col("qn"), F.col("norm2")).alias("distance"))
            .where(F.col("distance") <= F.lit(float(max_distance))))
