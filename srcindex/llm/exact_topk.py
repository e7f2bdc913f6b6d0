r"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A component x of a vector becomes the integer floor(256 x); a component's place is a
term, and a vector a sparse row of (term, weight). The data side is cut into parts of
about ``PART`` rows, the queries into blocks of about ``BLOCK``; every part meets every
block once, in a cogroup. There the part's posting lists (term -> rows, weights) are
built once, and the block's terms are taken one at a time: the weights of the queries
that have the term, times its posting list, are scattered into a dense array of scores,
a row per query. A partition selection keeps each query's best ``k`` of the part, ties
by id; the parts' lists merge in one small top-k per query, of which every task sends
its own k only.

Nothing is pruned or left out, so the result is exact. The sums run in 64-bit integers,
in 32-bit ones where the largest weights prove that they suffice, and in Python's own
integers where a score might leave 64 bits.

Defined results: vectors that are null or hold a null or non-finite component take no
part, nor do rows without an id; a vector's missing components are 0, so an empty vector
has score 0 with all; every row is a candidate, so a repeated one comes again; of query
rows with one id the smallest vector counts, and no row with the query's id is its
candidate; a score beyond 64 bits counts as the end of their range. Other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcindex.llm.common import query, table
from srcindex.session import stage

#: Rows of a part and queries of a block, on average; the scores of SLICE queries are held at once.
PART, BLOCK, SLICE = 16_384, 1_024, 128
LONG = np.iinfo(np.int64)


def quantise(flat: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite doubles: 64-bit integers, or Python's where one does not fit."""
    whole = np.floor(256.0 * flat)
    if not len(whole) or np.abs(whole).max() < 2.0 ** 62:
        return whole.astype(np.int64)
    return np.array([int(x) * 256 if abs(x) > 2.0 ** 60 else int(np.floor(256.0 * x)) for x in flat.tolist()], object)


class Rows:
    """Sparse integer rows: ``row``, ``term`` and ``weight`` of every component that is not 0."""

    def __init__(self, vectors: pd.Series):
        size = np.fromiter(map(len, vectors), np.int64, len(vectors))
        flat = quantise(np.concatenate([np.empty(0), *map(np.asarray, vectors)]).astype(np.float64))
        row = np.repeat(np.arange(len(size)), size)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(term, kind="stable")
        order = order[flat[order] != 0]
        self.n, self.row, self.term, self.weight = len(size), row[order], term[order], flat[order]
        self.terms, at = np.unique(self.term, return_index=True)
        self.at = np.append(at, len(self.term))
        self.place = {int(t): i for i, t in enumerate(self.terms)}
        self.most = max((abs(int(w)) for w in (self.weight.min(), self.weight.max())), default=0) if len(self.weight) else 0
        self.longest = int(size.max(initial=0))

    def postings(self, i: int):
        """Rows and weights of the i-th term; all rows as a slice."""
        lo, hi = self.at[i], self.at[i + 1]
        return (slice(None) if hi - lo == self.n else self.row[lo:hi]), self.weight[lo:hi]

    def with_type(self, kind) -> None:
        self.weight = self.weight.astype(kind)


def accumulate(queries: Rows, first: int, last: int, data: Rows, kind) -> np.ndarray:
    """Scores of the queries ``first`` to ``last`` with all rows, a term at a time."""
    scores = np.zeros((last - first, data.n), kind)
    for i, term in enumerate(queries.terms.tolist()):
        if (j := data.place.get(term)) is None:
            continue
        who, weight = queries.postings(i)
        if isinstance(who, slice):
            who, weight = slice(None), weight[first:last]
        else:
            lo, hi = np.searchsorted(who, (first, last))
            who, weight = who[lo:hi] - first, weight[lo:hi]
        rows, posted = data.postings(j)
        if not len(weight):
            continue
        step = np.multiply.outer(weight, posted)
        if isinstance(who, slice):
            scores[:, rows] += step
        elif isinstance(rows, slice):
            scores[who] += step
        else:
            scores[np.ix_(who, rows)] += step
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one query: places of its k highest scores, ties to smaller ids; rows with its own id left out."""
    open_ = np.flatnonzero(ids != own)
    s = scores[open_]
    if len(s) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > edge)
        level = np.flatnonzero(s == edge)
        need = k - len(above)
        if len(level) > need:  # the smallest ids among equals, without sorting them all
            level = level[np.argpartition(ids[open_[level]], need - 1)[:need]]
        s, open_ = s[np.concatenate([above, level])], open_[np.concatenate([above, level])]
    return open_, s


def top_of_part(k: int):
    """Cogroup body: a block of queries and a part of the data -> (query_id, vec_id, score)."""
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(queries) and len(data):
            q, d = Rows(queries["vector"]), Rows(data["vector"])
            bound = max(q.most, d.most, q.most * d.most * min(q.longest, d.longest))
            kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
            q.with_type(kind)
            d.with_type(kind)
            ids, own = data["id"].to_numpy(), queries["id"].to_numpy()
            for lo in range(0, q.n, SLICE):
                hi = min(q.n, lo + SLICE)
                scores = accumulate(q, lo, hi, d, kind)
                if kind is object:
                    scores = np.clip(scores, int(LONG.min), int(LONG.max)).astype(np.int64)
                for i in range(lo, hi):
                    at, s = best_of(scores[i - lo], ids, own[i], k)
                    found.append((np.full(len(at), own[i]), ids[at], s.astype(np.int64)))
        parts = [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)] or [np.empty(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts)))
    return run


def exact_top_k(data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
                part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def usable(df):
        v = F.col(vector).cast("array<double>")
        return (df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))
                .where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite)))

    asked = stage(usable(queries).groupBy("id").agg(F.min("vector").alias("vector")), "topk-queries")
    rows = usable(data)
    n_rows, n_asked = data.count(), asked.count()
    cores = data.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_asked // block))
    parts = max(-(-n_rows // part), -(-cores // blocks), 1)
    # whatever the ids, parts and blocks are even: rows are dealt by id and vector, so repeated ids spread, too
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    left = asked.withColumn("block", deal(blocks, "id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("part", deal(parts, "id", "vector", F.monotonically_increasing_id())).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    n = parts * blocks
    found = (left.repartition(n, "block", "part").groupBy("block", "part").cogroup(right.repartition(n, "block", "part").groupBy("block", "part"))
             .applyInPandas(top_of_part(k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


SQL = """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, generate_subscripts(embedding, 1) AS term, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS w FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
      FROM t q JOIN t c ON q.term = c.term AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@query("op13_exact_topk", SQL)
def op13_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
