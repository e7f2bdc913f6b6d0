r"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents are summed by membership
pattern (the sorted set of their sources); the flow runs on patterns and sources
only, whose number does not grow with the documents: pattern -> source arcs carry
words, each source drains its quota, and a pattern's words leave in layers, the
first copy at cost 1, the second at cost 3, the third at 5: convex repetition
costs. Back on Spark, a pattern's flow becomes whole copies of every document plus
a seeded selection for the rest: a hash orders the documents, a histogram of the
hash finds where the quota ends, and only the documents of that one bin are ranked.
What the first document that does not fit leaves open is filled the same way from the
remaining documents that are no longer than the gap, until none is.

Defined results: a null text has size 0 and takes nothing; null is a source of its
own, last in order; a null or empty membership is the pattern of that null source;
repeated rows are separate documents; ties in the hash go by doc_id, then size;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcindex.llm.common import query, table, text_of
from srcindex.session import stage

#: Weights of the sources in code-point order, repeating; share of all words that is asked for; most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Bins of the seeded order.
BINS = 4096


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets_of(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """Target words of each source, given its size.

    ``share`` of all words goes out by weight; a target stops at ``most`` times its
    source's size and the excess is shared among the others by weight, again and
    again, until none is above.
    """
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    size = dict(sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    free, left, out = list(order), share * sum(size.values()), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = float(most * size[s])
        left -= sum(most * size[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(supply: dict[tuple, int], quota: dict, most: int = MOST) -> dict[tuple[tuple, object], int]:
    """Words that each (pattern, source) carries: as near the quotas as the words allow, at the least repetition cost.

    Successive shortest paths on source node -> pattern (one arc per copy, costs
    1, 3, 5, ...) -> member source -> sink. The graph has a node per pattern and source.
    """
    patterns, sources = sorted(supply, key=repr), sorted(quota, key=repr)
    number = {("p", p): k + 1 for k, p in enumerate(patterns)} | {("s", s): len(patterns) + 1 + k for k, s in enumerate(sources)}
    sink = len(number) + 1
    arcs: list[list[int]] = []  # to, capacity, cost; an arc's reverse is its number ^ 1
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    for p in patterns:
        for copy in range(most):
            arc(0, number["p", p], supply[p], 2 * copy + 1)
    carried = {(p, s): arc(number["p", p], number["s", s], most * supply[p], 0) for p in patterns for s in p if s in quota}
    for s in sources:
        arc(number["s", s], sink, quota[s], 0)
    height = [0] * (sink + 1)
    while True:
        far, via = [float("inf")] * (sink + 1), [-1] * (sink + 1)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, capacity, cost = arcs[e]
                if capacity > 0 and d + cost + height[a] - height[b] < far[b]:
                    far[b], via[b] = d + cost + height[a] - height[b], e
                    heapq.heappush(heap, (far[b], b))
        if far[sink] == float("inf"):
            return {k: arcs[e ^ 1][1] for k, e in carried.items() if arcs[e ^ 1][1]}
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far)]
        path, a = [], sink
        while a:
            path.append(via[a])
            a = arcs[via[a] ^ 1][0]
        push = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= push
            arcs[e ^ 1][1] += push


def _select(d: DataFrame, rest: dict[str, int], seed: int) -> DataFrame:
    """``d`` plus ``extra`` (0/1): documents of each pattern in seeded order up to its ``rest`` of words.

    A round takes of the untaken documents no longer than the gap the bins before the
    last one that the gap reaches, and inside that bin the ranked documents up to the
    first that does not fit. That one is longer than the gap it leaves, so each round
    has fewer documents, and the rounds end when none is short enough. What is then
    missing is filled with the one untaken document whose size comes nearest to the gap,
    if that brings the sum nearer. The driver holds a few numbers a pattern and round.
    """
    spark = d.sparkSession
    pick = F.xxhash64("doc_id", "size", F.lit(seed))
    d = d.withColumn("bin", F.pmod(pick, F.lit(BINS))).withColumn("tie", F.xxhash64(F.lit(seed + 1), "doc_id", "size"))
    gap, ended = {p: n for p, n in rest.items() if n > 0}, {}
    rules: dict[str, list[tuple[int, int, int]]] = {p: [] for p in gap}  # by round: least and most size, and the bin before which all such are taken
    fits = spark.createDataFrame([], "row_no long")
    by_rule = F.exists("rules", lambda r: F.col("size").between(r["least"], r["most"]) & (F.col("bin") < r["edge"]))

    def untaken(rows: DataFrame, most: Column) -> DataFrame:
        """``rows`` of patterns with a gap that are not taken and hold up to ``most`` words."""
        now = spark.createDataFrame([(p, gap[p], rules[p]) for p in gap], "pattern string, gap long, rules array<struct<least: int, most: long, edge: int>>")
        return (rows.join(F.broadcast(now), "pattern").where((F.col("size") >= least) & (F.col("size") <= most) & ~by_rule)
                .join(fits, "row_no", "left_anti"))

    least = 0  # documents of size 0 go with the first round
    ranked = Window.partitionBy("pattern").orderBy("tie", "doc_id", "row_no")
    order = Window.partitionBy("pattern").orderBy("bin")
    while gap:
        left = untaken(d, F.col("gap"))
        per_bin = left.groupBy("pattern", "bin").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))  # at most BINS rows a pattern
        reach = (per_bin.withColumn("upto", F.sum("words").over(order)).groupBy("pattern")
                 .agg(F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("e"),
                      F.max("upto").alias("all")).collect())  # a row per pattern
        edges = [(r.pattern, r.e.bin, r.e.before) for r in reach if r.e]
        inside = []
        if edges:
            found = (left.join(F.broadcast(spark.createDataFrame(edges, "pattern string, edge long, before long")), "pattern").where("bin = edge")
                     .withColumn("upto", F.sum("size").over(ranked) + F.col("before")).where("upto <= gap").select("row_no", "pattern", "upto"))
            found = stage(found, "mix-inside")
            inside = found.groupBy("pattern").agg(F.max("upto").alias("upto")).collect()  # a row per pattern
            fits = fits.unionByName(found.select("row_no"))
        sums = {r.pattern: r.e.before if r.e else r.all for r in reach} | {r.pattern: r.upto for r in inside}
        for r in reach:
            rules[r.pattern].append((least, gap[r.pattern], r.e.bin if r.e else BINS))
        missing = {p: n - sums.get(p, 0) for p, n in gap.items()}
        ended |= {p: n for p, n in missing.items() if not n or not sums.get(p)}  # full, or no document is short enough
        gap, least = {p: n for p, n in missing.items() if p not in ended}, 1
    gap = {p: n for p, n in ended.items() if n}
    if gap:
        last = (untaken(d, 2 * F.col("gap") - 1).groupBy("pattern")
                .agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "tie", "row_no")).alias("m")))
        fits = fits.unionByName(stage(last.select(F.col("m.row_no").alias("row_no")), "mix-last"))
    told = spark.createDataFrame(list(rules.items()), "pattern string, rules array<struct<least: int, most: long, edge: int>>")
    return (d.join(F.broadcast(told), "pattern", "left").join(fits.withColumn("fits", F.lit(1)), "row_no", "left")
            .withColumn("extra", (F.coalesce(by_rule, F.lit(False)) | F.col("fits").isNotNull()).cast("int")))


def mix(docs: DataFrame, members: Column, size: Column, weights=WEIGHTS, share: float = SHARE, most: int = MOST,
        seed: int = 17, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, pattern, size, copies and taken (= size * copies) of every row, plus targets per source.

    ``members``: array of the document's sources. Returns also ``targets``: a map of
    source (null as the empty key's twin is written "\\0null") to (size, target).
    """
    spark = docs.sparkSession
    raw = F.when(F.coalesce(F.size(members), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(members)))
    d = stage(docs.select(*keep, raw.alias("members"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
                          F.monotonically_increasing_id().alias("row_no"))
              .withColumn("pattern", F.to_json(F.struct("members"), {"ignoreNullFields": "false"})), "mix-sizes")
    sums = d.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).collect()  # a row per pattern
    supply = {tuple(r.members): r.size for r in sums}
    name = {tuple(r.members): r.pattern for r in sums}
    by_source: dict = {}
    for p, n in supply.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + n
    targets = targets_of(list(by_source.items()), weights, share, most)
    flow = min_cost_flow(supply, {s: round(t) for s, t in targets.items()}, most)
    plan = {p: sum(f for (q, _), f in flow.items() if q == p) for p in supply}
    whole = spark.createDataFrame([(name[p], plan[p] // n if n else 0) for p, n in supply.items()], "pattern string, whole long")
    rest = {name[p]: plan[p] % n for p, n in supply.items() if n}
    chosen = (_select(d, rest, seed).select(*keep, "members", "pattern", "size", "extra", "row_no")
              .join(F.broadcast(whole), "pattern"))
    goals = spark.createDataFrame([(s, by_source[s], float(targets[s])) for s in by_source], "source string, source_size long, target double")
    copies = F.col("whole") + F.col("extra")
    return (chosen.select(*keep, "members", "size", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"),
                          F.element_at("members", 1).alias("first_source"))
            .join(F.broadcast(goals), F.col("first_source").eqNullSafe(F.col("source")), "left").drop("source", "first_source"))


@query("op2_mixing")
def op2_mixing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return (mix(d, F.array("source"), words_in(text_of()))
            .select("doc_id", "size", "source_size", "target", "taken", "copies"))
