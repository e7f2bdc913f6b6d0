"""Exact nearest neighbours as a join of query blocks with index parts.

Both sides stay Spark tables. A query row belongs to one block (about ``block_rows``
queries) and is repeated for every part; an index row belongs to one part (about
``part_rows`` entries) and is repeated for every block, so each (block, part) meets once,
in a cogroup of bounded size, whatever the number of queries. A group reads its part in
order of ids and keeps a running list of the k best per query; a later entry enters only
with a strictly smaller distance, so ties stay with the smaller id. Only these lists leave
the group, and Spark ranks them with one top-k per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of a block, entries of a part (both on average), entries that are scored at once. A group is in
#: memory whole, with its arrays several times: a part is no more than what is scored at once. Both sides are
#: repeated for the other's groups, so the two sizes are near each other.
BLOCK_ROWS, PART_ROWS, CHUNK_ROWS = 8_192, 16_384, 16_384
#: Most partitions that the groups are dealt to.
MOST_PARTITIONS = 50_000


def block_join(queries: DataFrame, index: DataFrame, kernel, schema: str, query_id: str, entry_id: str,
               block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``kernel(queries, entries)`` (Arrow tables) of every pair of a query block and an index part."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-queries.count() // block_rows))
    parts = max(1, -(-index.count() // part_rows), -(-2 * cores // blocks))
    deal = lambda n, c: F.pmod(F.xxhash64(c, F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_block", deal(blocks, query_id)).withColumn("_part", every(parts))
    right = index.withColumn("_part", deal(parts, entry_id)).withColumn("_block", every(blocks))
    n = min(blocks * parts, MOST_PARTITIONS)
    pair = ("_block", "_part")
    return (left.repartition(n, *pair).groupBy(*pair).cogroup(right.repartition(n, *pair).groupBy(*pair))
            .applyInArrow(kernel, schema))


class Nearest:
    """The k nearest of every query so far, from entries offered in order of their ids."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.rank, self.dist = [np.empty(0)] * n_queries, [np.empty(0)] * n_queries
        self.at = [np.empty(0, np.int64)] * n_queries

    def offer(self, query: int, rank: np.ndarray, dist: np.ndarray, at: np.ndarray) -> None:
        """Entries ``at`` with their distances; ``rank`` is what they are ordered by."""
        k = self.k
        if len(self.rank[query]) == k:
            better = rank < self.rank[query][-1]
            rank, dist, at = rank[better], dist[better], at[better]
        if not len(rank):
            return
        if len(rank) > k:
            near = rank <= np.partition(rank, k - 1)[k - 1]
            rank, dist, at = rank[near], dist[near], at[near]
        rank = np.concatenate([self.rank[query], rank])
        order = np.argsort(rank, kind="stable")[:k]  # held entries come first and have smaller ids
        self.rank[query] = rank[order]
        self.dist[query] = np.concatenate([self.dist[query], dist])[order]
        self.at[query] = np.concatenate([self.at[query], at])[order]

    def table(self, qids: pa.Array, ids: pa.Array, names: list[str]) -> pa.Table:
        query = np.repeat(np.arange(len(self.at)), [len(x) for x in self.at])
        at, dist = (np.concatenate([np.empty(0, kind), *x]) for kind, x in ((np.int64, self.at), (np.float64, self.dist)))
        return pa.table([qids.take(pa.array(query)), ids.take(pa.array(at)), pa.array(dist, pa.float64())], names=names)


def _in_id_order(entries: pa.Table, entry_id: str) -> tuple[pa.Table, pa.Array]:
    entries = entries.take(pc.sort_indices(entries.column(entry_id))).combine_chunks()
    ids = entries.column(entry_id)
    return entries, ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the lists' lengths."""
    lists = table.column(name).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # no chunk at all
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


class CountVectors:
    """Sparse count vectors of a table, with or without a weight for every bucket."""

    def __init__(self, table: pa.Table, idf: np.ndarray | None):
        self.bucket, size = _flat(table, "buckets")
        self.weight = _flat(table, "tfs")[0].astype(np.float64)
        self.row = np.repeat(np.arange(len(size)), size)
        if idf is None:
            self.norm2 = table.column("norm2").to_numpy().astype(np.float64)
        else:
            self.weight = self.weight * idf[self.bucket]
            self.norm2 = np.bincount(self.row, self.weight * self.weight, len(size))
        self.starts = np.cumsum(np.append(0, size))

    def postings(self, lo: int, hi: int, dim: int):
        """Rows (from 0) and weights of the entries lo to hi, by bucket, and where each bucket begins."""
        a, b = self.starts[lo], self.starts[hi]
        order = np.argsort(self.bucket[a:b], kind="stable")
        return self.row[a:b][order] - lo, self.weight[a:b][order], np.searchsorted(self.bucket[a:b][order], np.arange(dim + 1))


def sparse_kernel(k: int, max_distance: float | None, dim: int, fill: bool, idf: np.ndarray | None, names: list[str]):
    """Cogroup body for count vectors: each query adds up the posting lists of its buckets.

    The sums are exact integers (as doubles) for counts, and the distance is the SQL
    formula in the same operations. With ``fill``, entries without a common token count at
    distance 2; they follow all others, whose distance is smaller.
    """
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        entries, ids = _in_id_order(entries, names[1])
        q, x = CountVectors(queries, idf), CountVectors(entries, idf)
        best, apart = Nearest(queries.num_rows, k), Nearest(queries.num_rows, k)
        for lo in range(0, entries.num_rows, CHUNK_ROWS):
            hi = min(lo + CHUNK_ROWS, entries.num_rows)
            rows, weights, begin = x.postings(lo, hi, dim)
            norm2 = x.norm2[lo:hi]
            for i in range(queries.num_rows):
                own = slice(q.starts[i], q.starts[i + 1])
                lists = [(slice(begin[b], begin[b + 1]), w) for b, w in zip(q.bucket[own].tolist(), q.weight[own].tolist()) if begin[b] < begin[b + 1]]
                dot = np.bincount(np.concatenate([rows[s] for s, _ in lists]), np.concatenate([weights[s] * w for s, w in lists]), hi - lo) if lists else np.zeros(hi - lo)
                hit = np.flatnonzero(dot > 0)
                if fill and len(apart.at[i]) < k:
                    none = np.flatnonzero(dot <= 0)[:k]
                    apart.offer(i, np.full(len(none), 2.0), np.full(len(none), 2.0), none + lo)
                if not len(hit):
                    continue
                dist = 2.0 - (2.0 * dot[hit]) / np.sqrt(norm2[hit] * q.norm2[i])
                if max_distance is not None:
                    near = dist <= max_distance
                    hit, dist = hit[near], dist[near]
                best.offer(i, dist if idf is None else np.round(dist, 9), dist, hit + lo)
        if fill and (max_distance is None or max_distance >= 2.0):
            for i in range(queries.num_rows):
                need = k - len(best.at[i])
                best.at[i] = np.concatenate([best.at[i], apart.at[i][:need]])
                best.dist[i] = np.concatenate([best.dist[i], apart.dist[i][:need]])
        return best.table(_plain(queries, names[0]), ids, names)
    return run


def _plain(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _not_beyond(d: np.ndarray, k: int, slack: float, width: int = 64) -> np.ndarray:
    """Where the values of each row are that may be among its k smallest, ties within ``slack`` included (and null values).

    The k-th smallest of the least values of more than k groups of columns is no less than the row's k-th smallest.
    """
    groups = d.shape[1] // width
    if groups <= k:
        return np.ones(d.shape, bool)
    least = d[:, :groups * width].reshape(len(d), width, groups).min(axis=1)
    return ~(d > np.partition(least, k - 1, axis=1)[:, k - 1:k] + slack)


def dense_kernel(k: int, max_distance: float | None, qvec: str, vec: str, names: list[str], rank_digits: int, slice_rows: int = 64):
    """Cogroup body for dense vectors: squared L2 by matrix products of bounded slices."""
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        entries, ids = _in_id_order(entries, names[1])
        best = Nearest(queries.num_rows, k)
        if queries.num_rows and entries.num_rows:
            q = _flat(queries, qvec)[0].astype(np.float64).reshape(queries.num_rows, -1)
            x = _flat(entries, vec)[0].astype(np.float64).reshape(entries.num_rows, -1)
            qn, xn = (q * q).sum(axis=1), (x * x).sum(axis=1)
            for lo in range(0, entries.num_rows, CHUNK_ROWS):
                part = x[lo:lo + CHUNK_ROWS]
                at = np.arange(lo, lo + len(part))
                for a in range(0, len(q), slice_rows):
                    d = qn[a:a + slice_rows, None] + xn[None, lo:lo + len(part)] - 2.0 * (q[a:a + slice_rows] @ part.T)
                    np.maximum(d, 0.0, out=d)
                    keep = _not_beyond(d, k, 2.0 * 10.0 ** -rank_digits)
                    if max_distance is not None:
                        keep &= d <= max_distance
                    for i, (row, near) in enumerate(zip(d, keep), a):
                        row, near = row[near], at[near]
                        best.offer(i, np.round(row, rank_digits), row, near)
        return best.table(_plain(queries, names[0]), ids, names)
    return run
