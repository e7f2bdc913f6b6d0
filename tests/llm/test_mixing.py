"""Targets, flow and selection of the mixing operator."""

import itertools
import random
import re

from pyspark.sql import functions as F

from srcindex.llm import mixing
from srcindex.llm.common import table, text_of


def test_targets_stop_at_twice_the_size():
    t = mixing.targets_of([("b", 100), ("a", 10), (None, 1000)])
    assert t["a"] == 20 and t["b"] == 200 and abs(sum(t.values()) - 1.5 * 1110) < 1e-9
    assert mixing.targets_of([("a", 0)]) == {"a": 0.0} and mixing.targets_of([]) == {}
    assert mixing.targets_of([("a", 100), ("b", 100), ("c", 100), ("d", 100)])["d"] == 200


def test_flow_is_the_cheapest_that_fills_the_quotas():
    rng = random.Random(3)
    for _ in range(40):
        supply = {("a",): rng.randint(0, 3), ("a", "b"): rng.randint(0, 3), ("b",): rng.randint(0, 3)}
        quota = {"a": rng.randint(0, 5), "b": rng.randint(0, 5)}
        flow = mixing.min_cost_flow(supply, quota)
        total = lambda used: sum(used.values())
        cost = lambda used: sum(used[p] + 2 * max(0, used[p] - supply[p]) for p in used)
        best = (0, 0)
        for a, ab_a, ab_b, b in itertools.product(range(7), repeat=4):
            used = {("a",): a, ("a", "b"): ab_a + ab_b, ("b",): b}
            if a + ab_a <= quota["a"] and b + ab_b <= quota["b"] and all(used[p] <= 2 * supply[p] for p in used):
                best = max(best, (total(used), -cost(used)))
        used = {p: sum(f for (q, _), f in flow.items() if q == p) for p in supply}
        assert (total(used), -cost(used)) == best
        for s in quota:
            assert sum(f for (_, t), f in flow.items() if t == s) <= quota[s]


def run(spark, rows, **kw):
    d = spark.createDataFrame([(i, t, s, 9.0) for i, t, s in rows], "doc_id long, text string, source string, target double")
    return mixing.mix(d, F.array("source"), mixing.words_in(text_of()), **kw).collect()


def test_taken_comes_near_the_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["s1", "s1", "s2", "S3", None])) for i in range(1500)]
    rows += [(2000, None, "s1"), (2001, "", "s2"), (2002, "one\x0btwo\xa0x", None), (2002, "one\x0btwo\xa0x", None)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    want = mixing.targets_of([(s, sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, x in rows if x == s)) for s in ("s1", "s2", "S3", None)])
    for s, t in want.items():
        mine = [r for r in got if r.members[0] == s]
        assert {r.target for r in mine} == {t} and abs(sum(r.taken for r in mine) - t) <= 0.01 * t + 3
    assert all(r.taken <= 2 * r.size and r.taken == r.size * r.copies for r in got)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, run(spark, random.Random(2).sample(rows, len(rows)))))


def test_a_long_document_at_the_edge_leaves_no_gap(spark):
    rows = [(i, "w " * 50, "a") for i in range(400)] + [(1000 + i, "w " * n, "a") for i, n in enumerate((9, 7, 3, 2, 1))]
    for seed in range(4):  # the long document holds much of the words and comes at another place of the order each time
        got = run(spark, rows + [(2000, "w " * 15_000, "a")], share=0.5, seed=seed)
        # nothing untaken is shorter than the gap, so it ends within half of the usual document
        assert abs(sum(r.taken for r in got) - got[0].target) <= 25, (seed, sum(r.taken for r in got), got[0].target)


def test_overlapping_sources_and_empty_table(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)] + [(500, "w", []), (501, "w", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    got = mixing.mix(d, F.col("of"), mixing.words_in(text_of())).collect()
    assert len(got) == 102 and all(r.taken <= 2 * r.size for r in got)
    assert run(spark, []) == []


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = mixing.op2_mixing(spark, sf).collect()
    source = {r.doc_id: r.source for r in table(spark, sf, "documents").collect()}
    for s in set(source.values()):
        mine = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.05 * mine[0].target and mine[0].source_size == sum(r.size for r in mine)
