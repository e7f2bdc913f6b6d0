"""The learned embedding against NumPy's singular value decomposition."""

import random

import numpy as np
import pytest

from srcindex.functions import dense as D
from srcindex.functions.embed import embed
from srcindex.operators import knn
from srcindex.session import stage

TOPICS = [[f"t{t}w{i}" for i in range(12)] for t in range(6)]


def corpus(spark, n=500, parts=4):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices(TOPICS[i % 6], k=rnd.randint(2, 9)) + ["common"])) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, "common")]
    return rows, stage(embed(spark.createDataFrame(rows, "entry_id long, txt string").repartition(parts), "txt").select("entry_id", "buckets", "tfs"), "dense-test")


def matrix(vectors, idf):
    x = np.zeros((0, len(idf)))
    ids = []
    for r in sorted(vectors.collect(), key=lambda r: r.entry_id):
        v = np.zeros(len(idf))
        v[r.buckets] = np.array(r.tfs) * idf[r.buckets]
        n = np.linalg.norm(v)
        x = np.vstack([x, v / n if n else v])
        ids.append(r.entry_id)
    return ids, x


def test_singular_vectors_equal_numpy(spark):
    _, v = corpus(spark)
    model = D.learn(v, rank=6, products=12)  # the error falls with every product
    _, x = matrix(v, model.idf)
    right = np.linalg.svd(x, full_matrices=False)[2][:6].T
    assert np.allclose(model.basis.T @ model.basis, np.eye(6), atol=1e-9)
    assert np.abs(model.basis @ model.basis.T - right @ right.T).max() < 1e-4


@pytest.mark.parametrize("parts", [1, 7])
def test_vectors_and_search(spark, parts):
    """Rows by hand from the model; lines of a query's own topic come first; no vector without a telling token."""
    rows, v = corpus(spark, parts=parts)
    model = D.learn(v, rank=8)
    got = {r.entry_id: r.embedding for r in D.embed_dense(v, model).collect()}
    ids, x = matrix(v, model.idf)
    for i, w in zip(ids, x @ model.basis):
        n = np.linalg.norm(w)
        if n < 1e-9:
            assert got[i] is None and i >= 500
        else:
            assert np.allclose(got[i], w / n, atol=1e-6)
    index = D.embed_dense(v, model).where("embedding IS NOT NULL").select("entry_id", "embedding")
    asked = embed(spark.createDataFrame([(t, " ".join(TOPICS[t][:3])) for t in range(6)], "query_id long, code string"), "code").select("query_id", "buckets", "tfs")
    hits = knn.dense_knn(D.embed_dense(asked, model, "qvec"), index, k=5).collect()
    assert len(hits) == 30 and all(r.entry_id % 6 == r.query_id for r in hits)


def test_empty_corpus_and_rerun(spark):
    _, v = corpus(spark)
    assert D.learn(v.where("false"), rank=4).basis.shape[1] == 0
    a, b = D.learn(v, rank=5), D.learn(v.repartition(3), rank=5)
    assert np.allclose(a.basis, b.basis, atol=1e-6)
