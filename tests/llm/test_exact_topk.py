import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcindex.llm import exact_topk
from srcindex.llm.common import table

LONG = np.iinfo(np.int64)


def brute(rows, k=5, every=50):
    """Python integers throughout."""
    ok = [(i, list(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in ok]
    asked = {}
    for i, v in sorted(ok):
        if i % every == 0:
            asked.setdefault(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v])
    out = set()
    for q, v in asked.items():
        best = sorted((-min(max(sum(a * b for a, b in zip(v, w)), int(LONG.min)), int(LONG.max)), i) for i, w in whole if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, part string")


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set((r[0], r[1]) for r in rows)) == len(rows)
    return set(rows)


def asked(d, every=50):
    return d.where(F.col("vec_id") % every == 0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, f"/root/testdata/{sf}", "embeddings").collect()]
    got = exact_topk.op13_exact_topk(spark, f"/root/testdata/{sf}")
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["rank"] == "int"
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in rows}
    ids = np.array(sorted(x))
    mat = np.stack([x[i] for i in ids])
    want = set()
    for q in ids[ids % 50 == 0]:
        s = mat @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        want |= {(int(q), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)}
    assert found(got) == want


@pytest.mark.parametrize("part,block", [(16_384, 1_024), (3, 2)])
def test_odd_rows(spark, part, block):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [-1.0, 0.3, 5.0]), (None, [1.0, 1.0]), (50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 3.0]), (0, [1.0, 0.0]), (100, None), (150, [-1.0, 0.0]),
            (200, []), (250, [nan]), (2, [0.0, 1.0]), (300, [0.001]), (300, [-0.001])]
    d = frame(spark, [(i, v) if i != 2 else (2, v) for i, v in rows])
    want = brute(rows, k=4)
    assert found(exact_topk.exact_top_k(d, asked(d), 4, part=part, block=block)) == want


def test_ties_go_to_smaller_ids_and_repeated_rows_come_again(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [1.0, 2.0]) for i in rng.permutation(300)] + [(7, [1.0, 2.0])] * 3 + [(i, [-1.0, 0.5]) for i in range(300, 340)]
    d = frame(spark, rows)
    assert found(exact_topk.exact_top_k(d, asked(d), 5, part=16)) == brute(rows)


def test_sparse_rows_and_wide_vectors(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(150):
        v = rng.standard_normal(rng.integers(0, 200)) * (rng.random() < 0.9)
        v[rng.random(len(v)) < 0.8] = 0.0
        rows.append((i, v.tolist()))
    d = frame(spark, rows)
    assert found(exact_topk.exact_top_k(d, asked(d, 10), 5, part=40, block=4)) == brute(rows, every=10)


def test_sums_of_any_size_are_exact(spark):
    """Beyond 32 bits, beyond doubles' 53, beyond 64 and up to the largest double."""
    rng = np.random.default_rng(7)
    for scale in (1e4, 1e7, 3e8, 1e12, 1e30, 1e307):
        rows = [(i, (rng.standard_normal(5) * scale / 4).tolist()) for i in range(60)] + [(60, [0.0] * 5)]
        d = frame(spark, rows)
        assert found(exact_topk.exact_top_k(d, asked(d, 10), 3)) == brute(rows, k=3, every=10)


def test_empty_tables_and_few_candidates(spark):
    d = frame(spark, [(0, [1.0]), (1, [2.0])])
    assert found(exact_topk.exact_top_k(d, asked(d))) == {(0, 1, 1, 131072)}
    assert exact_topk.exact_top_k(d.where("false"), d.where("false")).count() == 0
    assert exact_topk.exact_top_k(d, d.where("false")).count() == 0
    assert exact_topk.exact_top_k(d.where("false"), d).count() == 0
