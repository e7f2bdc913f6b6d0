r"""Near-duplicate classes from bottom-k sketches of one hash function.

* Texts with equal shingle sets form a class; classes are compared, copies never.
* A sketch holds the smallest shingle hashes of a set of n: ``spare(n)`` more than the
  n - ceil(J n) that a partner of similarity J may lack. The first spare(n) common
  values of two such sets are in both sketches, so sketches share at least as many.
* Therefore partners share a value among the first size - spare + 1 of each sketch in
  any common order. Values in order of rising frequency give inverted lists that are
  short, except where classes really look alike; no pair of the similarity is without
  a common list.
* Inside a list not all pairs are made. First the most central class of each list
  (its values are the most frequent ones) is compared with the others; what it links
  is one component already. Short lists that still hold several components are paired
  across them. Classes of long ones are listed again by their full sets: there a pair
  must share one of the rarest 15 % or so of its shingles, and a class with too many
  shingles of its own drops out of the list for good. What is left goes through rounds
  of 1, 16, 64, ... pivots per list, across components only, until each list is one
  component or every pair was looked at; when all the pairs that are left are few, they
  are looked at in one round.
* A pair is never a row: a class carries its partners as an array and meets them by
  blocks, twice. First the sketches meet, as the upper halves of their values: partners
  whose sketches differ in more values than the whole sets may are left. Full sets are made, and travel, only for classes that
  still have partners: a task takes these in order of the union-sketch estimate, confirms
  on the full sets, skips components that it has joined already and returns a spanning
  forest of its links.

Defined results: a null or empty text, or one without words, has no shingles and
is a component of its own; repeated rows fall into one class and have the same
component; component ids are smallest doc_ids, null only where all are null (those
rows all stay); texts are used whole; only doc_id and text are read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcindex.llm.common import query, table, text_of, text_slices
from srcindex.llm.components import connected_components
from srcindex.llm.shingles import shingle_sets
from srcindex.llm.sieve import sieve
from srcindex.session import stage

#: Shingles of a block's sets together (8 bytes each), and smallest values of a set that the estimate looks at.
BLOCK, K = 1 << 20, 64
#: A partner in a class's array weighs as much as so many shingles; so many are one group, without blocks.
PARTNER, GROUP = 16, 4 << 20
#: So many pairs (one in several lists counts again) end the rounds over the full sets' lists at once.
FEW = 1 << 22
#: Longest list whose members are paired at once; pivots per list in the rounds over the full sets' lists, then fourfold.
SHORT, PIVOTS = 24, (1, 16, 64)
#: What pairs look like: a class and those that it is compared with.
PAIRS = "cid long, n long, comp long, partners array<struct<cid:long,n:long,comp:long>>"
#: The same after the sketches met, with those of the partners that the task has not named before.
LIKELY = f"{PAIRS}, fresh array<struct<cid:long,n:long,comp:long>>"
#: 1 / SPARE of a set's size is in its sketch beyond what partners may lack.
SPARE = 16


def spare(n):
    """How many common values of a set of ``n`` are sure to be in both sketches (an array or a number)."""
    return 1 + n // SPARE


def sketch_size(n, similarity: float):
    """All values but those that partners must share, and ``spare(n)`` of these."""
    return np.minimum(n, n - np.ceil(n * similarity - 1e-9).astype(np.int64) + spare(n))


def sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, text_key (a hash of the text), n (set size), digest of the set (16 bytes, null if empty), sketch of every row."""
    def run(batches):
        for part in text_slices(batches, "text", max_bytes=1 << 19):
            s, at = shingle_sets(part.column("text").to_pylist(), width)
            n = np.diff(at)
            digest = [hashlib.blake2b(s[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:])]
            head = sketch_size(n, similarity)
            ends = np.concatenate([[0], np.cumsum(head)])
            take = np.repeat(at[:-1] - ends[:-1], head) + np.arange(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s[take], pa.int64()))], names=["doc_id", "text_key", "n", "digest", "sketch"])

    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", "text", F.xxhash64(text_of()).alias("text_key"))
            .mapInArrow(run, f"doc_id {kind}, text_key long, n long, digest binary, sketch array<long>"))


def _rarest(values: DataFrame, sizes: DataFrame, head: str) -> DataFrame:
    """(value, cid, n, w, c) for the rarest ``head`` of the values that each class of ``values`` (cid, value) shares with others.

    ``sizes`` (cid, n, s) is joined last; ``head`` may use these and ``c``, how many shared values a class has. Rows go
    to their value once and the shared ones back to their class once, and are ranked there by Spark's sort.
    """
    by, rank = Window.partitionBy("cid"), Window.partitionBy("cid").orderBy("df", "value")
    shared = values.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("value"))).where("df > 1")
    ranked = shared.select("cid", "value", F.row_number().over(rank).alias("at"), F.count(F.lit(1)).over(by).alias("c"), F.sum("df").over(by).alias("w"))
    return ranked.join(sizes, "cid").where(F.col("at") <= F.expr(head)).select("value", "cid", "n", "w", "c")


def inverted_lists(classes: DataFrame, similarity: float) -> DataFrame:
    """(value, cid, n, w): the rarest values of each sketch, as many as a partner must share one of; w: how central the class is."""
    sizes = classes.select("cid", "n", F.size("sketch").alias("s"))
    # a partner has similarity * n shingles at least; values that only this set holds come first in the order and lead to nobody
    needed = f"floor(ceil(n * {similarity!r}D - 1e-9D) / {SPARE}) + 1"
    return _rarest(classes.select("cid", F.explode("sketch").alias("value")), sizes, f"s - least(s, {needed}) + 1 - (s - c)").drop("c")


def exact_lists(sets: DataFrame, similarity: float) -> DataFrame:
    """The same over full sets (cid, shingles): no pair of the similarity is without a common list.

    Of sizes a and b, partners have similarity / (1 + similarity) * (a + b) shingles in
    common at least, so a class with fewer shared ones than its list's smallest size asks
    for leaves the list.
    """
    sizes = sets.select("cid", F.size("shingles").cast("long").alias("n"))
    rows = _rarest(sets.select("cid", F.explode("shingles").alias("value")), sizes, f"floor(n * {1 - similarity!r}D + 1e-9D) + 1 - (n - c)")
    partner = F.greatest(F.min("n").over(Window.partitionBy("value")) * 1.0, F.col("n") * similarity)
    needed = similarity / (1 + similarity) * (F.col("n") + partner) - 1e-6
    return rows.withColumn("needed", needed).where(F.col("c") >= F.col("needed")).select("value", "cid", "n", "w")


def _open_lists(postings: DataFrame) -> DataFrame:
    """Postings of the lists that hold more than one component, with the lists' lengths m; of lists of the same classes (by 128 bits and m) one.

    Classes with a passage in common share as many lists as it has listed values.
    """
    by = Window.partitionBy("value")
    open_ = postings.select("value", "cid", "n", "w", "comp", F.min("comp").over(by).alias("lo"), F.max("comp").over(by).alias("hi"), F.count(F.lit(1)).over(by).alias("m"),
                            *(F.bit_xor(F.xxhash64(F.lit(seed), "cid")).over(by).alias(f"all_{seed}") for seed in (0, 1))).where("lo < hi")
    return open_.groupBy("all_0", "all_1", "m", "cid", "n", "w", "comp").agg(F.min("value").alias("value")).select("value", "cid", "n", "w", "comp", "m")


def _with_pivots(postings: DataFrame, pivots: int) -> DataFrame:
    """Postings with ``pivot``: whether the class is the most central one of its list, or of one of the list's ``pivots`` shares."""
    share = F.pmod(F.xxhash64("cid"), F.lit(pivots)) if pivots > 1 else F.lit(0)
    rank = Window.partitionBy("value", "share").orderBy(F.desc("w"), F.desc("cid"))
    return postings.withColumn("share", share).withColumn("pivot", F.row_number().over(rank) == 1).drop("share")


def _partners(postings: DataFrame, some: DataFrame, similarity: float) -> DataFrame:
    """(cid, n, comp, partners): of the classes ``some`` of its lists those of other components and fitting size, each once."""
    # sorted, so that equal lists come once, and a class's partners side by side: array_distinct compares all pairs of structs
    by_list = some.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("cid", "n", "comp"))).alias("some"))
    met = postings.join(by_list, "value").groupBy("cid", "n", "comp").agg(F.sort_array(F.flatten(F.collect_set("some"))).alias("some"))

    def fits(p, i):
        again = (i > 0) & (p["cid"] == F.get("some", i - 1)["cid"])
        return ~F.coalesce(again, F.lit(False)) & (p["comp"] != F.col("comp")) & (F.least(p["n"], F.col("n")) >= similarity * F.greatest(p["n"], F.col("n")) - 1e-9)

    return met.select("cid", "n", "comp", F.filter("some", fits).alias("partners")).where(F.size("partners") > 0)


def _short_pairs(postings: DataFrame, similarity: float) -> DataFrame:
    """All pairs across components in lists of at most SHORT members, each on the side of the larger id."""
    both = _partners(postings, postings, similarity)
    return both.withColumn("partners", F.filter("partners", lambda p: p["cid"] < F.col("cid"))).where(F.size("partners") > 0)


def meet(pairs: DataFrame, others: DataFrame, held: DataFrame, task, schema: str, block: int) -> DataFrame:
    """``task`` on the classes of ``pairs`` (cid, n, comp, partners) and their partners, both with what ``held`` (cid, v) has of them.

    ``others`` (cid, n) holds all classes that may be partners; None: all meet in one group.
    Partners lie in hashed blocks of some ``block`` shingles. A class goes to the blocks of
    its partners; a block with more classes than fit is dealt to parts, which get all of
    the block. So sets travel once per block, however many pairs meet there. Long arrays of
    partners count as shingles do, so a part is bounded by both.
    """
    if others is None:
        # both are bounded by GROUP, and ``held`` need not move to them
        left = held.join(F.broadcast(pairs), "cid").select(F.lit(0).alias("block"), "cid", "n", "comp", "partners", "v")
        right = held.join(F.broadcast(_all_partners(pairs).select("cid")), "cid").select(F.lit(0).alias("at_block"), F.col("cid").alias("other"), F.col("v").alias("other_v"))
        return left.groupBy("block").cogroup(right.groupBy("at_block")).applyInArrow(task, schema)
    wanted = stage(others.select("cid", "n").distinct(), "nd-others")
    blocks = 1 + int((wanted.agg(F.sum("n")).first()[0] or 0) // block)

    def block_of(cid):
        return F.pmod(F.xxhash64(cid), F.lit(blocks))

    here = F.filter("partners", lambda p: block_of(p["cid"]) == F.col("block"))
    sent = (pairs.withColumn("block", F.explode(F.array_distinct(F.transform("partners", lambda p: block_of(p["cid"])))))
            .withColumn("partners", here))
    parts = stage(sent.groupBy("block").agg((F.lit(1) + F.floor(F.sum(F.col("n") + PARTNER * F.size("partners")) / block)).alias("parts")), "nd-parts")
    # written before they meet the sets: with their size known, small ones are sent to the sets and not these to them
    asked = stage(sent.join(parts, "block").withColumn("part", F.pmod(F.xxhash64(F.col("cid"), F.lit(1)), F.col("parts")))
                  .select("block", "part", "cid", "n", "comp", "partners"), "nd-asked")
    placed = stage(wanted.select("cid", block_of(F.col("cid")).alias("block")).join(parts, "block")
                   .select(F.col("block").alias("at_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("at_part"), "cid"),
                   "nd-placed")
    # both joins read ``held`` by cid in the same way, so that one shuffle of it serves them
    left = asked.join(held, "cid").select("block", "part", "cid", "n", "comp", "partners", "v")
    right = placed.join(held, "cid").select("at_block", "at_part", F.col("cid").alias("other"), F.col("v").alias("other_v"))
    return left.groupBy("block", "part").cogroup(right.groupBy("at_block", "at_part")).applyInArrow(task, schema)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _differ(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, float]:
    """In the part of the order that both sketches (of ``k`` values at most) reach: values in one set only, and the similarity estimated from the union's sketch."""
    end = min(a[min(k, len(a)) - 1], b[min(k, len(b)) - 1])
    a, b = a[:np.searchsorted(a, end, "right")], b[:np.searchsorted(b, end, "right")]
    both = _common(a, b)
    return len(a) + len(b) - 2 * both, both / (len(a) + len(b) - both)


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many values are in one set only, by the halves that both sketches reach.

    The last half itself is left out: the set whose sketch ends there may hold more values of that half.
    """
    end = min(a[-1], b[-1])
    a, b = a[:np.searchsorted(a, end)], b[:np.searchsorted(b, end)]
    return len(a) + len(b) - 2 * _common(a, b)


def _lists(column) -> list[np.ndarray]:
    """A column of arrays as NumPy arrays."""
    column = column.combine_chunks()
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in chunks:
        at, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        out.extend(values[i:j] for i, j in zip(at[:-1], at[1:]))
    return out


def _may_be(differ: int, total: int, similarity: float) -> bool:
    """Whether sets of ``total`` values together can reach the similarity with so many in one of them only."""
    return differ <= total - 2 * similarity / (1 + similarity) * total + 1e-6


def _structs(column) -> tuple[pa.StructArray, np.ndarray]:
    """The rows of a column of arrays of structs one after the other, and where each array begins."""
    column = column.combine_chunks()
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    sizes = [np.diff(c.offsets.to_numpy()) for c in chunks]
    rows = [c.flatten() for c in chunks]
    return (pa.concat_arrays(rows) if rows else pa.array([], column.type.value_type)), np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64)


def _places(right: pa.Table, cids: np.ndarray) -> np.ndarray:
    """In which row of ``right`` each of the classes is."""
    other = right.column("other").to_numpy()
    order = np.argsort(other)
    return order[np.searchsorted(other, cids, sorter=order)]


def _likely(similarity: float):
    """The classes with those of their partners that the sketches leave."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = _lists(right.column("other_v"))
        partners, begin = _structs(left.column("partners"))
        cid, size = (partners.field(name).to_numpy() for name in ("cid", "n"))
        at, named = _places(right, cid), np.zeros(right.num_rows, bool)
        keep, stay, ends, fresh, fresh_ends = [], [], [0], [], [0]
        for i, (n, mine) in enumerate(zip(left.column("n").to_numpy(), _lists(left.column("v")))):
            left_over = [j for j in range(begin[i], begin[i + 1])
                         if _may_be(_apart(mine, held[at[j]]), n + size[j], similarity)]
            if left_over:
                keep.append(i)
                stay += left_over
                ends.append(len(stay))
                for j in left_over:
                    if not named[at[j]]:
                        named[at[j]] = True
                        fresh.append(j)
                fresh_ends.append(len(fresh))
        out = left.select(["cid", "n", "comp"]).take(pa.array(keep, pa.int64()))
        for name, chosen, at in (("partners", stay, ends), ("fresh", fresh, fresh_ends)):
            out = out.append_column(name, pa.ListArray.from_arrays(pa.array(at, pa.int32()), partners.take(pa.array(chosen, pa.int64()))))
        return out
    return run


def _forest(similarity: float):
    """The links (a, b) that the full sets confirm, as a forest."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, top = _lists(right.column("other_v")), {}
        partners, begin = _structs(left.column("partners"))
        others, other_comps, sizes = (partners.field(name).to_numpy() for name in ("cid", "comp", "n"))
        at = _places(right, others)

        def root(x):
            while (y := top.get(x, x)) != x:
                top[x] = x = top.get(y, y)
            return x

        links = []
        for i, (cid, comp, mine) in enumerate(zip(left.column("cid").to_pylist(), left.column("comp").to_pylist(), _lists(left.column("v")))):
            order = []
            for j in range(begin[i], begin[i + 1]):
                if root(int(other_comps[j])) != root(comp):
                    differ, alike = _differ(mine, sets[at[j]], K)
                    if _may_be(differ, len(mine) + sizes[j], similarity):
                        order.append((alike, j))
            for _, j in sorted(order, reverse=True):
                b, b_comp = sets[at[j]], int(other_comps[j])
                if root(b_comp) != root(comp):
                    both = _common(mine, b)
                    if both >= similarity * (len(mine) + len(b) - both) - 1e-9:
                        top[root(b_comp)] = root(comp)
                        links.append((cid, int(others[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})
    return run


def halves(sketch):
    """The upper halves of a sketch's values, in the same order; equal values have equal ones."""
    return F.transform(sketch, lambda v: F.shiftright(v, 32).cast("int"))


def _named(likely: DataFrame) -> DataFrame:
    """(cid, n) of the partners that are left; as a task names one once, no row for every pair."""
    return likely.select(F.explode("fresh").alias("p")).select("p.cid", "p.n")


def _weight(pairs: DataFrame) -> int:
    """Shingles of the classes and of their partners, and their arrays' weight; 0: no pairs. It is exact up to GROUP; beyond, partners may count again."""
    of_partners = F.aggregate("partners", F.lit(0).cast("long"), lambda s, p: s + p["n"])
    own, named = (x or 0 for x in pairs.agg(F.sum(F.col("n") + PARTNER * F.size("partners")), F.sum(of_partners)).first())
    if own > GROUP or own + named <= GROUP:
        return own + named
    return own + _all_partners(pairs).agg(F.sum("n")).first()[0]


def _all_partners(pairs: DataFrame) -> DataFrame:
    """(cid, n) of all partners; only for pairs of a GROUP, as each is a row on the way."""
    return pairs.select(F.explode("partners").alias("p")).select("p.cid", "p.n").distinct()


class Links:
    """Confirmed links so far, as components of classes; sketches and full sets of the classes that may have links."""

    def __init__(self, docs: DataFrame, classes: DataFrame, postings: DataFrame, width: int, similarity: float):
        self.docs, self.classes, self.width, self.similarity = docs, classes, width, similarity
        self.comps = self.sets = None
        listed = stage(postings.select("cid").distinct(), "nd-listed")
        self.sketches = stage(sieve(classes.select("cid", halves("sketch").alias("v")), listed, "cid").join(listed, "cid"), "nd-held")

    def need(self, cids: DataFrame) -> None:
        """Full sets of these classes (cid) are at hand from now on; those not made yet are made from the texts."""
        new = cids.distinct()
        if self.sets is not None:
            new = new.join(self.sets.select("cid"), "cid", "left_anti")
        new = stage(new, "nd-new")
        if new.isEmpty():
            return
        # written first, so that the planner knows whether the texts need to move
        wanted = stage(self.classes.select("cid", "digest", "rep").join(new, "cid").select("cid", F.col("digest").alias("d"), F.col("rep").alias("doc_id")), "nd-wanted")
        source = (sieve(self.docs.select("doc_id", "text"), wanted, "doc_id")
                  .join(wanted.withColumnRenamed("doc_id", "r"), F.col("doc_id").eqNullSafe(F.col("r"))).select("cid", "text", "d"))
        made = stage(_sets_of(source, self.width), "nd-sets")
        if not made.groupBy("cid").count().where("count > 1").isEmpty():  # doc_ids that several rows have
            made = stage(made.dropDuplicates(["cid"]), "nd-sets")
        self.sets = made if self.sets is None else self.sets.union(made)

    def likely(self, pairs: DataFrame, others: DataFrame, made: bool = False) -> DataFrame:
        """``pairs`` without the partners that the sketches reject; few of them stay as they are if their full sets are ``made``."""
        pairs = stage(pairs, "nd-pairs")
        weight = _weight(pairs)
        if not weight or made and weight <= GROUP:
            return pairs.withColumn("fresh", F.col("partners"))
        return stage(meet(pairs, None if weight <= GROUP else others, self.sketches, _likely(self.similarity), LIKELY, BLOCK * 8), "nd-likely")

    def confirm(self, likely: DataFrame, made: bool = False) -> None:
        """Confirm classes with their partners on full sets and merge the components that are linked; ``made``: the sets are at hand."""
        weight = _weight(likely)
        if not weight:
            return
        partners = _named(likely)
        if not made:
            self.need(likely.select("cid").union(partners.select("cid")))
        held = self.sets.withColumnRenamed("shingles", "v")
        links = stage(meet(likely, None if weight <= GROUP else partners, held, _forest(self.similarity), "a long, b long", BLOCK), "nd-links")
        if links.isEmpty():
            return
        edges = links if self.comps is None else self.relabel(self.relabel(links.withColumn("comp", F.col("a"))).withColumn("a", F.col("comp")).withColumn("comp", F.col("b"))) \
            .select("a", F.col("comp").alias("b")).where("a <> b")
        merged = connected_components(edges).select(F.col("node").alias("cid"), "comp")
        if self.comps is None:
            self.comps = merged
            return
        into = merged.select(F.col("cid").alias("comp"), F.col("comp").alias("into"))
        moved = self.comps.join(into, "comp", "left").select("cid", F.coalesce("into", "comp").alias("comp"))
        self.comps = stage(moved.union(merged.join(self.comps.select("cid"), "cid", "left_anti")), "nd-comps")

    def relabel(self, frame: DataFrame) -> DataFrame:
        """``frame`` with its ``comp`` (a class or an older component) replaced by the component now."""
        if self.comps is None:
            return frame
        now = self.comps.select(F.col("cid").alias("comp"), F.col("comp").alias("now"))
        return frame.join(now, "comp", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now").select(*frame.columns)


def _components(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_key, n, digest), and the classes (digest, rep, comp)."""
    rows = stage(sketches(docs, width, similarity), "nd-sketches")
    classes = stage(rows.where("digest IS NOT NULL").groupBy("digest")
                    .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
                    .withColumn("cid", F.monotonically_increasing_id()), "nd-classes")
    postings = stage(_with_pivots(_open_lists(inverted_lists(classes, similarity).withColumn("comp", F.col("cid"))), 1), "nd-lists")
    links = None if postings.isEmpty() else Links(docs, classes, postings, width, similarity)
    if links:
        links.confirm(links.likely(_partners(postings, postings.where("pivot"), similarity), postings.where("pivot")))
        postings = stage(_open_lists(links.relabel(postings.where("NOT pivot"))), "nd-open")
        short = postings.where(F.col("m") <= SHORT)
        long = stage(postings.where(F.col("m") > SHORT).select("cid").distinct(), "nd-long")
        likely = links.likely(_short_pairs(short, similarity), short)
        links.need(long.union(likely.select("cid")).union(_named(likely).select("cid")))  # one pass over the texts for both
        links.confirm(likely, made=True)
        if not long.isEmpty():
            postings = exact_lists(links.sets.join(long, "cid"), similarity).withColumn("comp", F.col("cid"))
            step = 0
            while True:
                pivots = PIVOTS[step] if step < len(PIVOTS) else PIVOTS[-1] * 4 ** (step - len(PIVOTS) + 1)
                postings = stage(_with_pivots(_open_lists(links.relabel(postings)), pivots), "nd-open")
                met = postings.agg(F.sum("m")).first()[0] or 0
                if met <= FEW:
                    if met:
                        links.confirm(links.likely(_short_pairs(postings, similarity), postings, made=True), made=True)
                    break
                links.confirm(links.likely(_partners(postings, postings.where("pivot"), similarity), postings.where("pivot"), made=True), made=True)
                postings = postings.where("NOT pivot")
                step += 1
    comps = links.comps if links else None
    member = classes.select("digest", "cid", "rep")
    member = member.withColumn("comp", F.col("cid")) if comps is None else \
        member.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    return rows.drop("sketch"), stage(member.select("digest", "rep", "comp"), "nd-member")


def near_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id linked), kept, one row per input row."""
    rows, member = _components(docs, width, similarity)
    smallest = member.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_digest = member.join(smallest, "comp").select("digest", "component_id")
    return (rows.select("doc_id", "n", "digest").join(by_digest, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null last), of repeated ids the smallest text hash.

    Rows are told apart by doc_id and text, so repeated and null ids do no harm; texts without shingles all stay.
    """
    rows, member = _components(docs, width, similarity)
    placed = rows.join(member.select("digest", "comp"), "digest")
    first = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))).alias("w"))
    gone = (placed.join(first, "comp").where(~(F.col("doc_id").eqNullSafe(F.col("w.b")) & (F.col("text_key") == F.col("w.c"))))
            .select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    keyed = docs.withColumn("near_key", F.xxhash64(text_of()))
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("near_key") == F.col("gone_key")), "left_anti")
    again = placed.groupBy("doc_id", "text_key").count().where("count > 1")
    if not again.isEmpty():  # one id and text on several rows: one stays; rows without shingles are no copies here
        empty = rows.where("digest IS NULL").select(F.col("text_key").alias("gone_key")).distinct()
        several = left.join(empty, F.col("near_key") == F.col("gone_key"), "left_anti").dropDuplicates(["doc_id", "near_key"])
        left = several.unionByName(left.join(empty, F.col("near_key") == F.col("gone_key"), "left_semi"))
    return left.select(*docs.columns)


def _sets_of(source: DataFrame, width: int) -> DataFrame:
    """Full sets of the class representatives, one for every row that has the id and the set; rows that share a doc_id with one but not its set are left out."""
    def run(batches):
        for part in text_slices(batches, "text", max_bytes=1 << 19):
            s, at = shingle_sets(part.column("text").to_pylist(), width)
            wanted = part.column("d").to_pylist()
            right = [hashlib.blake2b(s[a:b].tobytes(), digest_size=16).digest() == bytes(w) for a, b, w in zip(at[:-1], at[1:], wanted)]
            sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s, pa.int64()))
            out = pa.RecordBatch.from_arrays([part.column("cid"), sets], names=["cid", "shingles"])
            yield out.filter(pa.array(right))
    return source.mapInArrow(run, "cid long, shingles array<long>")


@query("op5_near_dedup")
def op5_near_dedup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"), width=3, similarity=0.85)
