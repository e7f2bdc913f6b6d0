"""Nearest-neighbour joins against brute force on small fixtures."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from srcindex.functions.embed import embed
from srcindex.functions.where import where_to_column
from srcindex.operators import knn

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def brute_sparse(queries, docs, k, cut=None):
    import hashlib
    def vec(t):
        import re
        v = {}
        for tok in re.findall(r"[^\W]+", t.lower()):
            b = int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % 1024
            v[b] = v.get(b, 0) + 1
        return v
    out = {}
    for qid, qt in queries:
        qv = vec(qt)
        res = []
        for did, dt in docs:
            dv = vec(dt)
            dot = sum(c * dv.get(b, 0) for b, c in qv.items())
            if dot == 0:
                continue
            n1, n2 = sum(c * c for c in qv.values()), sum(c * c for c in dv.values())
            d = 2.0 - (2.0 * dot) / math.sqrt(float(n1) * float(n2))
            if cut is None or d <= cut:
                res.append((d, did))
        out[qid] = [did for _, did in sorted(res)[:k]]
    return out


def test_sparse_knn_matches_brute_force(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 8)))) for i in range(60)]
    qs = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 5)))) for i in range(8)]
    idx = embed(spark.createDataFrame(docs, "entry_id long, txt string"), "txt")
    q = embed(spark.createDataFrame(qs, "query_id long, code string"), "code")
    for method, cut, kw in [("join", None, {}), ("join", 0.9, {}), ("blocks", None, {"block_rows": 3, "part_rows": 7}), ("blocks", 0.9, {}), ("cut", 0.9, {})]:
        got = knn.sparse_knn(q, idx, k=3, max_distance=cut, method=method, fill=False, **kw).collect()
        by_q = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            by_q.setdefault(r.query_id, []).append(r.entry_id)
        exp = {k: v for k, v in brute_sparse(qs, docs, 3, cut).items() if v}
        assert by_q == exp


def test_dense_knn_matches_numpy_and_partitions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x[i]], i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x32 = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    for parts, block, part in [(1, 1000, 1000), (7, 1000, 11), (3, 25, 40)]:
        idx = df.select(F.col("vec_id").alias("entry_id"), "embedding").repartition(parts)
        got = knn.dense_knn(q, idx, k=4, block_rows=block, part_rows=part).collect()
        by_q = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            by_q.setdefault(r.query_id, []).append(r.entry_id)
        d = ((x32[:, None, :] - x32[None, :, :]) ** 2).sum(-1)
        for qi in range(120):
            exp = sorted(range(120), key=lambda j: (round(d[qi, j], 9), j))[:4]
            assert by_q[qi] == exp


def vectors(spark, rows):
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "vec_id long, embedding array<float>")
    return df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), df.select(F.col("vec_id").alias("entry_id"), "embedding")


def check_lsh(q, idx, k=5, least=0.9, **kw):
    exact = {(r.query_id, r.entry_id): round(r.distance, 9) for r in knn.dense_knn(q, idx, k=k).collect()}
    rows = knn.lsh_knn(q, idx, k=k, **kw).collect()
    found = {(r.query_id, r.entry_id): round(r.distance, 9) for r in rows}
    assert len(found) == len(rows) == len(exact)  # k rows for every query
    assert all(exact[p] == d for p, d in found.items() if p in exact)
    by_q = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by_q.setdefault(r.query_id, []).append((round(r.distance, 9), r.entry_id))
    assert all(v == sorted(v) for v in by_q.values())
    recall = len(found.keys() & exact.keys()) / len(exact)
    assert recall >= least
    return recall


def test_lsh_recall_with_and_without_clusters(spark):
    """Vectors without any structure are the worst case; clustered ones need few bands."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    check_lsh(*vectors(spark, enumerate(x)))
    c = x[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 24)) * 0.03
    check_lsh(*vectors(spark, enumerate(c)))


def test_lsh_bands_follow_the_data():
    """More planes for a larger index, fewer bands for nearer neighbours, all of them for a recall of 1."""
    from srcindex.operators.lsh import MOST_BANDS, choose
    rng = np.random.default_rng(3)
    loose = rng.normal(size=(1000, 16))
    tight = loose[rng.integers(0, 20, 1000)] + rng.normal(size=(1000, 16)) * 0.02
    assert choose(loose, 10 ** 9, 5, 0.9)[0] > choose(loose, 10 ** 5, 5, 0.9)[0] > choose(loose, 10 ** 3, 5, 0.9)[0]
    assert choose(tight, 10 ** 6, 5, 0.9)[1] < choose(loose, 10 ** 6, 5, 0.9)[1] <= MOST_BANDS
    assert choose(loose, 10 ** 6, 5, 1.1)[1] == MOST_BANDS


def test_lsh_sends_a_vector_few_times():
    """Vectors without structure, at any size of the index: the bands (copies of each vector) stay few, the sample's recall is no less."""
    from srcindex.operators.lsh import choose
    loose = np.random.default_rng(8).normal(size=(4000, 64))
    assert [choose(loose, n, 5, 0.95)[1] <= most for n, most in ((10_000, 4), (50_000, 16), (10 ** 6, 32), (10 ** 8, 32))] == [True] * 4


def test_selection_before_the_running_top_k():
    """What the kernel offers holds the k smallest of a row with their ties on nine places; null values never hide others."""
    from srcindex.operators.blocks import _not_beyond
    rng = np.random.default_rng(6)
    for width in (1, 4, 64):
        for k in (1, 3, 8):
            d = np.round(rng.random((20, 301)), 2) + rng.integers(-4, 5, (20, 301)) * 1e-10
            d[3, ::7] = np.nan
            d[4] = np.nan
            keep = _not_beyond(d, k, 2e-9, width)
            for row, kept in zip(d, keep):
                rank = np.round(row, 9)
                assert kept[np.argsort(rank, kind="stable")[:k]].all()
            assert keep[:3].sum() < 3 * 301 or width == 64
    assert np.array_equal(_not_beyond(np.arange(512.0)[None], 2, 0.0)[0], np.arange(512) <= 1)


def test_lsh_splits_hot_cells_and_fills(spark):
    """A third of all rows share one vector: groups stay small, and lonely queries are searched exactly."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12))
    x[:300] = x[0]
    q, idx = vectors(spark, enumerate(x))
    found = {(r.query_id, r.rank): (r.entry_id, r.distance) for r in knn.lsh_knn(q, idx, k=5, part_rows=40, block_rows=30).collect()}
    assert all(found[i, r] == (r - 1, 0.0) for i in range(0, 300, 37) for r in range(1, 6))
    check_lsh(q, idx, k=4, least=0.9, part_rows=40, block_rows=30)
    far = np.zeros((9, 12))
    far[np.arange(9), np.arange(9)] = 1
    check_lsh(*vectors(spark, enumerate(np.concatenate([far, -far]))), k=7, least=0.5, recall=0.1)
    assert knn.lsh_knn(q, idx.where("false")).count() == 0 and knn.lsh_knn(q.where("false"), idx).count() == 0


def test_where_dict(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "b", 5), (3, "c", 7)], "id int, t string, n int")
    def ids(w):
        return sorted(r.id for r in df.where(where_to_column(w)).collect())
    assert ids({"t": "a"}) == [1]
    assert ids({"n": {"$gte": 5}}) == [2, 3]
    assert ids({"$or": [{"t": "a"}, {"n": {"$gt": 6}}]}) == [1, 3]
    assert ids({"$and": [{"t": {"$in": ["a", "b"]}}, {"n": {"$ne": 3}}]}) == [2]
    assert ids({"t": {"$nin": ["a"]}, "n": {"$lt": 7}}) == [2]


def test_dense_embedder_hook_feeds_dense_knn(spark):
    from srcindex.functions.embed import dense_embedder

    def toy_model(texts):
        out = np.zeros((len(texts), 4))
        for i, t in enumerate(texts):
            out[i, len(t) % 4] = 1.0
        return out

    emb = dense_embedder(toy_model, 4)
    df = spark.createDataFrame([(i, "x" * i) for i in range(12)], "vec_id long, text string")
    vec = df.select("vec_id", emb("text").alias("embedding"))
    q = vec.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    idx = vec.select(F.col("vec_id").alias("entry_id"), "embedding")
    got = knn.dense_knn(q, idx, k=3).where("query_id = 1").orderBy("rank").collect()
    assert [r.entry_id for r in got] == [1, 5, 9] and all(r.distance == 0.0 for r in got)


def test_tfidf_downweights_common_tokens(spark):
    docs = [(0, "alpha alpha beta"), (1, "alpha gamma"), (2, "alpha delta"), (3, "alpha beta")]
    idx = embed(spark.createDataFrame(docs, "entry_id long, txt string"), "txt")
    q = embed(spark.createDataFrame([(0, "alpha beta")], "query_id long, code string"), "code")
    plain = [r.entry_id for r in knn.sparse_knn(q, idx, k=4).orderBy("rank").collect()]
    tfidf = knn.sparse_knn(q, idx, k=4, weighting="tfidf").orderBy("rank").collect()
    assert [(r.entry_id, r.distance) for r in tfidf[2:]] == [(1, 2.0), (2, 2.0)]  # no common token of any weight
    tfidf = tfidf[:2]
    assert plain[0] == 3
    # alpha is in every entry: idf 0, so only beta-bearing entries remain hits;
    # both reduce to the beta direction (distance 0) and the id breaks the tie
    assert [(r.entry_id, r.distance) for r in tfidf] == [(0, 0.0), (3, 0.0)]


def test_methods_agree_across_partitions(spark):
    rnd = random.Random(11)
    vocab = WORDS + ["x%d" % i for i in range(40)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12)))) for i in range(300)]
    qs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 6)))) for i in range(25)]
    q = embed(spark.createDataFrame(qs, "query_id long, code string"), "code")
    results = []
    for parts in (1, 5):
        idx = embed(spark.createDataFrame(docs, "entry_id long, txt string").repartition(parts), "txt")
        for method in ("blocks", "cut", "join"):
            rows = knn.sparse_knn(q, idx, k=4, max_distance=1.2, method=method).collect()
            results.append(sorted((r.query_id, r.rank, r.entry_id, r.distance) for r in rows))
    assert all(r == results[0] for r in results[1:]) and results[0]


def test_many_blocks_fill_and_string_ids(spark):
    """Tiny blocks and parts, chunks of three entries, ties: equal to one whole sort; k rows for every query."""
    import srcindex.operators.blocks as B
    rnd = random.Random(3)
    docs = [(f"e{i:03d}", " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 1, 1, 2, 3])))) for i in range(90)] + [("", "alpha"), ("zz", None)]
    qs = [(f"q{i}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 2)))) for i in range(20)] + [("none", "unknown words only")]
    idx = embed(spark.createDataFrame(docs, "entry_id string, txt string"), "txt")
    q = embed(spark.createDataFrame(qs, "query_id string, code string"), "code")
    hits = brute_sparse(qs, [(d, t or "") for d, t in docs], 1000)
    dots = {(qid, did) for qid, found in hits.items() for did in found}
    for block, part in [(2, 5), (100, 1000)]:
        got = knn.sparse_knn(q, idx, k=7, block_rows=block, part_rows=part).collect()
        by_q = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            by_q.setdefault(r.query_id, []).append((r.entry_id, r.distance))
        for qid, _ in qs:
            rest = sorted(d for d, _ in docs if (qid, d) not in dots)
            assert [e for e, _ in by_q[qid]] == (hits[qid] + rest)[:7]
            assert all((d == 2.0) == ((qid, e) not in dots) for e, d in by_q[qid])
    assert B.CHUNK_ROWS > 3


def test_running_top_k_over_chunks():
    """Entries offered in order of ids, in chunks: the k smallest, ties to the earlier."""
    from srcindex.operators.blocks import Nearest
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, k = rng.integers(1, 60), rng.integers(1, 8)
        d = rng.integers(0, 6, n).astype(float)
        best = Nearest(1, int(k))
        cuts = np.sort(rng.integers(0, n + 1, 3))
        for lo, hi in zip([0, *cuts], [*cuts, n]):
            best.offer(0, d[lo:hi], d[lo:hi], np.arange(lo, hi))
        assert best.at[0].tolist() == np.argsort(d, kind="stable")[:k].tolist()


def test_search_plans_hold_no_collected_queries(spark):
    """Neither file brings queries to the driver."""
    import inspect

    import srcindex.operators.blocks as B
    import srcindex.operators.lsh as L
    import srcindex.operators.threshold as T
    for module in (knn, B, L, T):
        assert not any(word in inspect.getsource(module) for word in ("toArrow", "collect()", "broadcast("))


def test_empty_sides(spark):
    q = embed(spark.createDataFrame([(1, "alpha")], "query_id long, code string"), "code")
    idx = embed(spark.createDataFrame([(1, "alpha")], "entry_id long, txt string"), "txt")
    for kw in ({}, {"max_distance": 0.55}, {"max_distance": 0.55, "method": "cut"}, {"method": "join"}):
        assert knn.sparse_knn(q.where("false"), idx, **kw).count() == 0
        assert knn.sparse_knn(q, idx.where("false"), **kw).count() == 0
        assert [tuple(r) for r in knn.sparse_knn(q, idx, **kw).collect()] == [(1, 1, 1, 0.0)]


def test_groups_are_small_by_default(spark):
    """What a Python worker holds at once does not grow with the index: of 400,000 entries none meets 20,000 others."""
    import pyarrow as pa

    from srcindex.operators.blocks import block_join
    queries = spark.range(10).withColumnRenamed("id", "query_id")
    index = spark.range(400_000).withColumnRenamed("id", "entry_id")
    kernel = lambda q, e: pa.table({"q": pa.array([q.num_rows], pa.int64()), "e": pa.array([e.num_rows], pa.int64())})
    met = [(r.q, r.e) for r in block_join(queries, index, kernel, "q long, e long", "query_id", "entry_id").collect()]
    assert sum(e for _, e in met) == 400_000 and {q for q, _ in met} == {10}
    assert max(e for _, e in met) < 20_000
