import math

import numpy as np
import pytest

from srcindex.llm import ann
from srcindex.llm.common import table


def brute(rows, k=5, every=50):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if q % every == 0:
            c = sorted((-float((x * v).sum() / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum()))), i) for i, x in rows if i != q and len(x) == len(v))
            out[q] = [(i, -s) for s, i in c[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(have, want):
    return sum(len({i for i, _ in have[q]} & {i for i, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, f"/root/testdata/{sf}", "embeddings").collect()]
    want, have = brute(rows), found(ann.op8_ann(spark, f"/root/testdata/{sf}"))
    assert have.keys() == want.keys() and all(len(v) == 5 for v in have.values())
    exact = {(q, i): s for q, w in brute(rows, k=10 ** 6).items() for i, s in w}
    assert all(abs(s - exact[q, i]) < 1e-14 for q, v in have.items() for i, s in v)
    assert recall(have, want) >= 0.93


def test_small_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (None, [1.0, 1.0]), (50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 3.0]), (0, [1.0, 0.0]), (100, None), (150, [-1.0, 0.0])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    have = found(ann.nearest(d, d.where("vec_id % 50 = 0")))
    want = brute([r for k, r in enumerate(rows) if k != 12])
    assert {q: [i for i, _ in v] for q, v in have.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert have[0][0] == (1, 1.0)


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "HOT", 3)
    monkeypatch.setattr(ann, "PART", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 60)] + [(i, rng.standard_normal(3).tolist()) for i in range(60, 200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    have = found(ann.nearest(d, d.where("vec_id % 50 = 0")))
    assert [i for i, _ in have[0]] == [1, 2, 3, 4, 5] and [i for i, _ in have[50]] == [0, 1, 2, 3, 4]
    assert recall(have, brute(rows)) >= 0.9


def test_empty_table(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(d, d).collect() == []


def test_probes_come_in_order_of_estimated_success():
    x = np.random.default_rng(2).standard_normal((50, 16))
    a, b = ann.projections(16, 0)
    place = x @ a / ann.WIDTH + b
    home = np.floor(place)
    assert (ann.probes_of(x, 0)[:, 0] == ann.cells_of(x, 0)).all()
    for i in range(50):
        cost = {int(ann.cell_keys(home[i].astype(np.int64) + s)): sum((place[i, j] - home[i, j] - (1 if s[j] > 0 else 0)) ** 2 for j in range(ann.PLANES) if s[j]) for s in ann._SHIFTS}
        seen = [cost[int(c)] for c in ann.probes_of(x, 0)[i]]
        assert seen == sorted(seen) and max(seen) <= sorted(cost.values())[ann.PROBES] + 1e-12
