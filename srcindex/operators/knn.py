"""Batch nearest-neighbour joins (Q-1 .. Q-4).

Both sides are Spark tables throughout; nothing of them passes through the driver.

* By default every entry is scored: query blocks meet index parts in cogroups of
  bounded size that keep a running top-k (:mod:`srcindex.operators.blocks`).
* ``method="cut"`` finds the pairs within a distance cut by an exact prefix-filtered
  similarity join (:mod:`srcindex.operators.threshold`), which scores few of them.
* :func:`lsh_knn` is approximate: sign-projection bands chosen from the data, exact distances.
* ``method="join"`` is the plain relational form: postings joined on ``(bucket, salt)``,
  which splits a hot bucket (a very common token) over several tasks, and a partial sum
  of ``q.tf * d.tf``.

Top-k uses ``row_number() <= k`` over ``(distance, entry_id)``; Spark plans it
as a ``WindowGroupLimit`` so every task keeps only k rows per query before the
shuffle by query id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcindex.functions.embed import DEFAULT_DIM, idf_weights, postings
from srcindex.operators.blocks import BLOCK_ROWS, PART_ROWS, block_join, dense_kernel, sparse_kernel
from srcindex.operators.lsh import lsh_neighbours
from srcindex.operators.threshold import pairs_within

# Fixed values from the reference's retrieval defaults.
DEFAULT_K = 5
DEFAULT_MAX_DISTANCE = 0.55

DEFAULT_SALT = 16


def unit_l2_distance(dot: Column, n1: Column, n2: Column) -> Column:
    """Squared L2 distance of the unit vectors of two integer count vectors."""
    return F.lit(2.0) - (F.lit(2.0) * dot) / F.sqrt(n1.cast("double") * n2.cast("double"))


def top_k(pairs: DataFrame, k: int, query_id: str = "query_id", entry_id: str = "entry_id",
          order: str = "distance") -> DataFrame:
    """Keep the k best rows per query, ranked by (order, entry_id) from 1."""
    w = Window.partitionBy(query_id).orderBy(F.col(order).asc(), F.col(entry_id).asc())
    return (pairs.withColumn("rank", F.row_number().over(w))
                 .where(F.col("rank") <= k))


def sparse_candidates(queries: DataFrame, index: DataFrame, query_id: str = "query_id",
                      entry_id: str = "entry_id", salt: int = DEFAULT_SALT) -> DataFrame:
    """Every (query, entry) pair sharing a bucket with its distance.

    ``queries`` / ``index`` carry ``buckets``, ``tfs``, ``norm2`` columns
    (see :func:`srcindex.functions.embed.embed`). Each index posting gets one salt,
    each query posting is repeated for every salt.
    """
    qp = (postings(queries.select(query_id, "buckets", "tfs", F.col("norm2").alias("qnorm2")), query_id, keep=("qnorm2",))
          .withColumnRenamed("tf", "qtf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))))
    ip = (postings(index.select(entry_id, "buckets", "tfs", "norm2"), entry_id, keep=("norm2",))
          .withColumn("salt", F.pmod(F.xxhash64(entry_id), F.lit(salt)).cast("int")))
    dots = (ip.join(qp, ["bucket", "salt"]).groupBy(query_id, "qnorm2", entry_id, "norm2")
              .agg(F.sum(F.col("qtf").cast("long") * F.col("tf").cast("long")).alias("dot")))
    return dots.select(query_id, entry_id,
                       unit_l2_distance(F.col("dot"), F.col("qnorm2"), F.col("norm2")).alias("distance"))


def _empty(queries: DataFrame, index: DataFrame, query_id: str, entry_id: str) -> tuple[str, list[str]]:
    """Schema of a search's rows; ids keep their type, numbers or strings."""
    return f"{query_id} {dict(queries.dtypes)[query_id]}, {entry_id} {dict(index.dtypes)[entry_id]}, distance double", [query_id, entry_id, "distance"]


def sparse_knn(queries: DataFrame, index: DataFrame, k: int = DEFAULT_K,
               max_distance: float | None = None, query_id: str = "query_id",
               entry_id: str = "entry_id", method: str = "blocks", fill: bool = True,
               weighting: str = "count", dim: int = DEFAULT_DIM, block_rows: int = BLOCK_ROWS,
               part_rows: int = PART_ROWS) -> DataFrame:
    """k nearest index entries per query: (query_id, rank, entry_id, distance).

    ``method`` is "blocks" (all entries scored, with or without a cut), "cut" (similarity
    join under ``max_distance``: for short texts and tight cuts, where few pairs share a
    rare bucket) or "join" (postings). All give the same rows. ``max_distance`` (the reference's cut
    keeps ``distance <= 0.55``) is applied before the top-k; with the same order key that
    equals cutting after it.

    With ``fill`` every query gets k rows whenever the index has k entries: those without
    a common token (or without any) follow all hits at distance 2, smallest ids first.
    ``weighting="tfidf"`` scales every bucket by ``ln(N / df)`` over the index (a table of
    at most ``dim`` rows), so tokens common to all entries stop dominating; ranks are then
    on nine places.
    """
    import numpy as np

    from srcindex.session import ship_package
    ship_package(queries.sparkSession)
    if weighting not in ("count", "tfidf"):
        raise ValueError(f"weighting must be 'count' or 'tfidf', not {weighting!r}")
    if method == "cut":
        if max_distance is None or weighting != "count":
            raise ValueError("method 'cut' needs max_distance and counts")
        found = pairs_within(queries, index, max_distance, query_id, entry_id, dim)
    elif method == "join":
        found = sparse_candidates(queries, index, query_id, entry_id)
        if max_distance is not None:
            found = found.where(F.col("distance") <= F.lit(float(max_distance)))
    elif method == "blocks":
        idf = None
        if weighting == "tfidf":
            idf = np.zeros(dim)
            w = idf_weights(index.select(F.col(entry_id).alias("entry_id"), "buckets", "tfs")).toPandas()  # at most dim rows
            idf[w["bucket"].to_numpy()] = w["idf"].to_numpy()
        schema, names = _empty(queries, index, query_id, entry_id)
        found = block_join(queries.select(query_id, "buckets", "tfs", "norm2"), index.select(entry_id, "buckets", "tfs", "norm2"),
                           sparse_kernel(k, max_distance, dim, fill, idf, names), schema, query_id, entry_id, block_rows, part_rows)
    else:
        raise ValueError(f"method must be 'blocks', 'cut' or 'join', not {method!r}")
    if weighting == "tfidf":   # float weights: rank on 9 places, then id
        out = top_k(found.withColumn("_rd", F.round("distance", 9)), k, query_id, entry_id, order="_rd")
    else:
        out = top_k(found, k, query_id, entry_id)
    return out.select(query_id, "rank", entry_id, "distance")


def dense_knn(queries: DataFrame, index: DataFrame, k: int = DEFAULT_K, max_distance: float | None = None,
              query_id: str = "query_id", qvec: str = "qvec", entry_id: str = "entry_id", vec: str = "embedding",
              block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS, rank_digits: int = 9) -> DataFrame:
    """Exact k nearest by squared L2: (query_id, rank, entry_id, distance).

    Query blocks meet index parts; a group computes float64 distances in slices of bounded
    size and keeps k candidates per query; Spark ranks them on
    ``(round(distance, rank_digits), entry_id)``. Ids are numbers or strings.
    """
    from srcindex.session import ship_package
    ship_package(queries.sparkSession)
    schema, names = _empty(queries, index, query_id, entry_id)
    found = block_join(queries.select(query_id, qvec), index.select(entry_id, vec),
                       dense_kernel(k, max_distance, qvec, vec, names, rank_digits), schema, query_id, entry_id, block_rows, part_rows)
    out = top_k(found.withColumn("_rd", F.round("distance", rank_digits)), k, query_id, entry_id, order="_rd")
    return out.select(query_id, "rank", entry_id, "distance")


def nest_results(neighbours: DataFrame, query_id: str = "query_id", entry_id: str = "entry_id") -> DataFrame:
    """Q-3: one row per query with its neighbours as a rank-ordered array of structs."""
    return neighbours.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", entry_id, "distance"))).alias("results"))


def lsh_knn(queries: DataFrame, index: DataFrame, k: int = DEFAULT_K, recall: float = 0.95, seed: int = 7,
            query_id: str = "query_id", qvec: str = "qvec", entry_id: str = "entry_id", vec: str = "embedding", **sizes) -> DataFrame:
    """Approximate form of :func:`dense_knn`: sign-projection bands chosen for ``recall``, distances and ranks
    exact among what they find (:mod:`srcindex.operators.lsh`). Every query gets k rows if the index has k: those
    with fewer are searched exactly."""
    from srcindex.session import ship_package, stage

    ship_package(queries.sparkSession)
    found = stage(lsh_neighbours(queries, index, k, recall, seed, query_id, qvec, entry_id, vec, **sizes), "lsh-found")
    ranked = top_k(found.withColumn("_rd", F.round("distance", 9)), k, query_id, entry_id, order="_rd").select(query_id, "rank", entry_id, "distance")
    enough = found.groupBy(query_id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    rest = stage(queries.join(enough, query_id, "left_anti").select(query_id, qvec), "lsh-rest")
    return (ranked.join(rest.select(query_id), query_id, "left_anti")
            .unionByName(dense_knn(rest, index, k, None, query_id, qvec, entry_id, vec)))
