"""The prefix-filtered similarity join against all pairs."""

import random

import pytest

from srcindex.functions.embed import embed
from srcindex.operators import threshold as T
from tests.test_knn import brute_sparse


def corpus(spark, seed=1, n=400):
    """Few very common words (hot buckets), many rare ones, near copies of queries, blanks."""
    rnd = random.Random(seed)
    common, rare = ["the", "of", "and"], [f"r{i}" for i in range(300)]
    line = lambda: " ".join(rnd.choice(common) if rnd.random() < 0.5 else rnd.choice(rare) for _ in range(rnd.randint(1, 14)))
    qs = [(i, line()) for i in range(25)] + [(25, ""), (26, "the"), (27, "the the the of")]
    docs = [(i, line()) for i in range(n)] + [(n, ""), (n + 1, "the"), (n + 2, "of the of the")]
    for i in range(60):
        w = rnd.choice(qs)[1].split()
        if w:
            w[rnd.randrange(len(w))] = rnd.choice(rare)
            rnd.shuffle(w)
        docs.append((1000 + i, " ".join(w)))
    q = embed(spark.createDataFrame(qs, "query_id long, code string"), "code")
    x = embed(spark.createDataFrame(docs, "entry_id long, txt string").repartition(3), "txt")
    return qs, docs, q, x


@pytest.mark.parametrize("cut", [0.0, 0.2, 0.55, 1.0, 1.5, 1.99])
def test_no_pair_is_lost(spark, cut):
    qs, docs, q, x = corpus(spark)
    want = {(i, d) for i, found in brute_sparse(qs, docs, 10 ** 6, cut).items() for d in found}
    got = T.pairs_within(q, x, cut, split=40)  # hot buckets over many salts
    rows = [(r.query_id, r.entry_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_candidates_are_few(spark):
    """Less than twice the pairs within the cut, a sixth of those that share a token."""
    qs, docs, q, x = corpus(spark, n=3000)
    found = T.candidates(q, x, 0.55, "query_id", "entry_id", 1024).count()
    sharing = sum(map(len, brute_sparse(qs, docs, 10 ** 6).values()))
    within = sum(map(len, brute_sparse(qs, docs, 10 ** 6, 0.55).values()))
    assert within <= found < min(2 * within, sharing / 5)


def test_cut_of_two_is_refused(spark):
    _, _, q, x = corpus(spark, n=10)
    with pytest.raises(ValueError):
        T.candidates(q, x, 2.0, "query_id", "entry_id", 1024)
