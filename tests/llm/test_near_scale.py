"""Near dedup's plans: what a round costs, and equal results whichever way its pairs meet."""

import numpy as np
import pyarrow as pa
import pytest

from srcindex.llm import components, near_dedup
from tests.llm.test_near_dedup import brute, got, made

LIST = "value long, cid long, n long, w long, comp long"


@pytest.mark.parametrize("few,group", [(0, 0), (0, 1 << 30), (1 << 30, 0), (1 << 30, 1 << 30)])
def test_rounds_and_groups_equal_all_pairs(spark, monkeypatch, few, group):
    """The full sets' lists in rounds or at once, pairs in blocks or in one group."""
    for name, value in (("SHORT", 4), ("BLOCK", 2000), ("FEW", few), ("GROUP", group)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = made(11)
    assert got(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_few_edges_are_one_task(spark, monkeypatch):
    """A chain in odd order, a star around its largest node and a loop; the joins label them alike."""
    order = np.random.default_rng(3).permutation(60).tolist()
    edges = spark.createDataFrame([*zip(order, order[1:]), *((999, 100 + i) for i in range(20)), (2000, 2000)], "a long, b long")
    few = sorted(map(tuple, components.connected_components(edges).collect()))
    assert few == sorted([(i, 0) for i in range(60)] + [(100 + i, 100) for i in range(20)] + [(999, 100), (2000, 2000)])
    monkeypatch.setattr(components, "FEW", -1)
    assert sorted(map(tuple, components.connected_components(edges).collect())) == few
    empty = list(components._labels(iter([])))
    assert sum(b.num_rows for b in empty) == 0


def test_equal_lists_are_one(spark):
    """40 lists of the same three classes and one of others: two lists are left, each with its length."""
    rows = [(v, c, 50, 9, c) for v in range(40) for c in (1, 2, 3)] + [(70, c, 50, 9, c) for c in (2, 3)] + [(80, c, 50, 9, 5) for c in (5, 6)]
    out = near_dedup._open_lists(spark.createDataFrame(rows, LIST))
    assert sorted((r.value, r.cid, r.m) for r in out.collect()) == [(0, 1, 3), (0, 2, 3), (0, 3, 3), (70, 2, 2), (70, 3, 2)]


def test_partners_come_once_without_comparing_all(spark):
    """A class in lists that overlap meets each of their classes once; array_distinct would compare every two structs."""
    rows = [(v, c, 50 if c != 4 else 10, 9, c) for v, of in enumerate([(1, 2, 3), (1, 3, 4), (1, 2, 5), (2, 5)]) for c in of]
    lists = spark.createDataFrame(rows, LIST)
    out = near_dedup._partners(lists, lists, 0.85)
    assert "array_distinct" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.cid: [p.cid for p in r.partners] for r in out.collect()} == {1: [2, 3, 5], 2: [1, 3, 5], 3: [1, 2], 5: [1, 2]}


def test_long_partner_arrays_make_parts(spark, monkeypatch):
    """Small classes with many partners each: their arrays count, so no task gets them all."""
    monkeypatch.setattr(near_dedup, "GROUP", 0)
    pairs = spark.createDataFrame([(c, 1, c, [(p, 1, p) for p in range(200)]) for c in range(1000, 1040)], near_dedup.PAIRS)
    held = spark.createDataFrame([(c, [c]) for c in (*range(200), *range(1000, 1040))], "cid long, v array<long>")
    others = spark.createDataFrame([(p, 1) for p in range(200)], "cid long, n long")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table({"rows": pa.array([left.num_rows], pa.int64())})

    met = near_dedup.meet(pairs, others, held, count, "rows long", 16000)
    sizes = [r["rows"] for r in met.collect()]
    assert sum(sizes) == 40 and max(sizes) < 25
