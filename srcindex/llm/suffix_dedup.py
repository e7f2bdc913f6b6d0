r"""Removal of byte strings that repeat across a corpus, by a hash-compared suffix sort.

Every string of ``WIDTH`` bytes is represented by the lowest-hashed gram of ``GRAM``
bytes in it (its anchor), so equal strings have equal anchors in the same place and
only about 2 / (WIDTH - GRAM + 2) of all positions travel. Anchors whose gram occurs
once settle their strings. For the others the surroundings of the anchor decide:

* equal surroundings (two independent 64-bit hashes) are repeats as a whole;
* different surroundings of one gram are suffix-sorted: the bytes to the right of the
  anchor, and those to its left read backwards, by a mergesort whose comparisons find
  common extensions by binary search over prefix polynomial hashes. Neighbours'
  common lengths are verified byte by byte; a group with a hash collision is sorted
  by its bytes. A string that reaches d bytes to the left repeats if another
  surrounding shares its interval of the left order at depth d and its interval of the
  right order at depth WIDTH - d.
* a gram with more than ``GROUP`` different surroundings is split: its strings are
  hashed and counted by Spark instead, so no task holds an unbounded group.

Spans go back to the documents, where covered bytes are cut.

Defined results: a null text is empty; texts shorter than ``WIDTH`` bytes lose
nothing; repeated rows repeat each other's strings and so lose them; null or repeated
doc_ids are told apart by a hash of their text; only doc_id and text are read; an
empty table gives no rows. The kept bytes may cut a character in two: they are binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.llm.common import query, table, text_of, text_slices
from srcindex.llm.shingles import POWERS, mixed
from srcindex.session import stage

#: Length of a repeat; length of an anchor's gram; different surroundings of a gram that one task sorts.
WIDTH, GRAM, GROUP = 200, 40, 20_000
#: Bytes of a text that are hashed at a time.
PART = 1 << 20

_RNG = np.random.default_rng(77)
#: Two independent random numbers per byte (case matters here).
BYTE, BYTE2 = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def sums_of(data: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums modulo 2**64: out[j] - out[i] belongs to data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * POWERS.upto(len(data))[0], out=out[1:])
    return out


def slide(x: np.ndarray, w: int, best, rest) -> np.ndarray:
    """best over x[i:i+w] for i in 0..len(x)-w, from running values in blocks of w."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, rest, x.dtype)]).reshape(-1, w)
    upto = best.accumulate(padded, axis=1).ravel()
    back = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n - w + 1], upto[w - 1:n])


def parts_of(raw: bytes, width: int):
    """(offset, bytes, first window, end of windows) of a text in parts with enough around them."""
    n = len(raw)
    for a in range(0, max(n - width + 1, 0), PART):
        b = min(a + PART, n - width + 1)
        lo, hi = max(0, a - 2 * width), min(n, b + 2 * width)
        yield lo, raw[lo:hi], a - lo, b - lo


def anchors(raws: list[bytes], width: int = WIDTH, gram: int = GRAM):
    """Arrays (text number, position, gram hash, surroundings hash, bytes to the left, to the right)."""
    reach = width - gram  # windows start at most so many bytes before their anchor
    found = []
    held: list[tuple] = []

    def flush():
        if not held:
            return
        data = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
        begin = np.cumsum([0, *(len(p[2]) for p in held)])
        valid = np.zeros(len(data), bool)
        for p, at in zip(held, begin):
            valid[at + p[3]:at + p[4]] = True
        s1, s2 = sums_of(data, BYTE), sums_of(data, BYTE2)
        down = POWERS.upto(len(data))[1]
        h = mixed((s1[gram:] - s1[:-gram]) * down[:len(data) - gram + 1])
        low = slide(h, reach + 1, np.minimum, np.uint64(2 ** 64 - 1))  # by window
        low = np.where(valid[:len(low)], low, np.uint64(0))
        padded = np.concatenate([np.zeros(reach, np.uint64), low, np.zeros(len(h) - len(low), np.uint64)])
        pos = np.flatnonzero(slide(padded, reach + 1, np.maximum, np.uint64(0)) == h)
        part = np.searchsorted(begin, pos, "right") - 1
        text = np.array([p[0] for p in held])[part]
        n = np.array([len(raws[p[0]]) for p in held])[part]
        place = pos - begin[part] + np.array([p[1] for p in held])[part]  # in its text
        left, right = np.minimum(place, reach), np.minimum(n - place, width)
        a, b = pos - left, pos + right
        ctx = mixed((s2[b] - s2[a]) * down[a] + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64))
        found.append((text, place, h[pos].view(np.int64), ctx.view(np.int64), left, right))
        held.clear()

    size = 0
    for k, raw in enumerate(raws):
        for lo, data, a, b in parts_of(raw, width):
            if size + len(data) > 2 * PART:
                flush()
                size = 0
            held.append((k, lo, data, a, b))
            size += len(data)
    flush()
    if not found:
        return [np.zeros(0, np.int64)] * 6
    out = [np.concatenate(x) for x in zip(*found)]
    # a long text's parts may find an anchor near their seam twice
    new = np.ones(len(out[0]), bool)
    new[1:] = (out[0][1:] != out[0][:-1]) | (out[1][1:] > np.maximum.accumulate(out[0] * (1 << 40) + out[1])[:-1] - out[0][1:] * (1 << 40))
    return [x[new] for x in out]


# --- the suffix sort -----------------------------------------------------------------

def common_lengths(sums: np.ndarray, i: np.ndarray, j: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Longest common extension of the bytes from i and from j, at most ``top``: binary search over hashes."""
    down = POWERS.upto(len(sums))[1]
    lo, hi = np.zeros(len(i), np.int64), top.astype(np.int64)
    di, dj = down[i], down[j]
    si, sj = sums[i], sums[j]
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = (sums[i + mid] - si) * di == (sums[j + mid] - sj) * dj
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)
    return lo


def before(data, sums, start, size, a, b, ties: bool) -> np.ndarray:
    """Whether suffix a sorts before suffix b (or, with ``ties``, equals it)."""
    top = np.minimum(size[a], size[b])
    same = common_lengths(sums, start[a], start[b], top)
    inside = same < top
    x = np.where(inside, data[np.where(inside, start[a] + same, 0)].astype(np.int64), size[a])
    y = np.where(inside, data[np.where(inside, start[b] + same, 0)].astype(np.int64), size[b])
    return (x <= y) if ties else (x < y)


def suffix_order(data: np.ndarray, sums: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Suffixes (start, size) sorted within their groups (ascending, contiguous): bottom-up mergesort.

    In each round neighbouring runs of a group merge: every element finds its place in
    the other run by binary search, all elements at once.
    """
    n = len(start)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    begin = np.repeat(first, np.diff(np.append(first, n)))
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    order, at = np.arange(n), np.arange(n)
    run = 1
    while run < (np.diff(np.append(first, n)).max() if n else 0):
        number = (at - begin) // run
        right = (number & 1) == 1
        own = begin + number * run
        other = np.where(right, own - run, own + run)
        stop = np.minimum(other + run, end)
        moves = np.flatnonzero(right | (other < end))  # a run without a partner stays
        lo, hi = other[moves], stop[moves].copy()
        lo = lo.copy()
        mine, is_right = order[moves], right[moves]
        while (live := lo < hi).any():
            w = np.flatnonzero(live)
            mid = (lo[w] + hi[w]) >> 1
            theirs = order[mid]
            r = is_right[w]
            goes = np.empty(len(w), bool)  # the other run's element comes first
            if r.any():
                goes[r] = before(data, sums, start, size, theirs[r], mine[w][r], True)
            if (~r).any():
                goes[~r] = before(data, sums, start, size, theirs[~r], mine[w][~r], False)
            lo[w] = np.where(goes, mid + 1, lo[w])
            hi[w] = np.where(goes, hi[w], mid)
        target = at.copy()
        base = np.minimum(own, other)[moves]
        target[moves] = base + (at[moves] - own[moves]) + (lo - other[moves])
        if (np.bincount(target, minlength=n) != 1).any():
            return np.arange(n)  # a hash has lied and two elements claim one place; verification sees to it
        order = order[np.argsort(target)]
        run *= 2
    return order


def verified_order(data, start, size, group) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order and the common length of each suffix with the one before it in its group (-1 for the first).

    Common lengths are compared byte by byte; if a hash has lied, the group is sorted by its bytes.
    """
    sums = sums_of(data, BYTE)
    order = suffix_order(data, sums, start, size, group)
    for attempt in range(2):
        a, b = order[:-1], order[1:]
        together = group[a] == group[b]
        top = np.where(together, np.minimum(size[a], size[b]), 0)
        same = np.full(len(a), -1, np.int64)
        wrong = np.zeros(len(a), bool)
        wide = int(top.max()) if len(top) else 0
        steps = np.arange(wide)
        for lo in range(0, len(a), 4096):
            s = slice(lo, lo + 4096)
            inside = steps[None, :] < top[s, None]
            x = data[np.where(inside, start[a[s], None] + steps, 0)]
            y = data[np.where(inside, start[b[s], None] + steps, 0)]
            differ = (x != y) & inside
            m = np.where(differ.any(1), differ.argmax(1) if wide else 0, top[s])
            same[s] = np.where(together[s], m, -1)
            ends = m >= top[s]
            at = np.minimum(m, max(wide - 1, 0))[:, None]
            less = np.take_along_axis(x, at, 1)[:, 0] < np.take_along_axis(y, at, 1)[:, 0] if wide else ends
            wrong[s] = together[s] & ~np.where(ends, size[a[s]] <= size[b[s]], less)
        if not wrong.any() or attempt:
            break
        order = np.array(sorted(range(len(start)), key=lambda i: (group[i], data[start[i]:start[i] + size[i]].tobytes())), np.int64)
    return order, np.concatenate([[-1], same])


def repeated_reach(surroundings: list[bytes], left: np.ndarray, copies: np.ndarray, group: np.ndarray,
                   width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each surrounding the largest and smallest d for which its string from d bytes left of the anchor repeats (-1: none)."""
    size = np.array([len(s) for s in surroundings], np.int64)
    n = len(size)
    text = np.frombuffer(b"".join(surroundings), np.uint8)
    begin = np.cumsum(size) - size
    right = size - left
    r_order, r_same = verified_order(text, begin + left, right, group)
    back = text[::-1]
    l_order, l_same = verified_order(np.ascontiguousarray(back), len(text) - (begin + left), left, group)
    most, least = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    r_id, l_id = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(width - gram + 1):
        here = (left >= d) & (right >= width - d)
        if not here.any():
            continue
        r_id[r_order] = np.cumsum(r_same < width - d)  # a new interval where the common length is shorter; groups begin with -1
        l_id[l_order] = np.cumsum(l_same < d)
        key = r_id[here] * (n + 1) + l_id[here]
        _, place, seen = np.unique(key, return_inverse=True, return_counts=True)
        again = np.zeros(n, bool)
        again[here] = seen[place] > 1
        again |= here & (copies > 1)
        most[again] = d
        least[again & (least < 0)] = d
    return most, least


# --- the Spark side ---------------------------------------------------------------------

def identified(docs: DataFrame) -> DataFrame:
    """key, doc_id, text: the doc_id is the key where it is unique, else it comes with a hash of the text."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    key = F.col("doc_id") if odd.isEmpty() else F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(text_of()))
    return docs.select(key.alias("key"), "doc_id", text_of().alias("text"))


def _raws(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def anchor_rows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches):
        for part in text_slices(batches, "text", max_bytes=PART):
            text, place, h, ctx, left, right = anchors(_raws(part.column("text")), width, gram)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(text)), pa.array(place, pa.int64()), pa.array(h, pa.int64()), pa.array(ctx, pa.int64()),
                 pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))], names=["key", "pos", "gram", "ctx", "l", "r"])
    return docs.select("key", "text").mapInArrow(run, f"key {dict(docs.dtypes)['key']}, pos long, gram long, ctx long, l short, r short")


def packed(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_bytes and the compressed text: a third of the bytes go through the shuffle."""
    def run(batches):
        zip_ = pa.Codec("zstd", compression_level=1)
        for part in text_slices(batches, "text"):
            raws = _raws(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()),
                 pa.array([zip_.compress(r, asbytes=True) if r else b"" for r in raws], pa.binary())], names=["key", "doc_id", "n_bytes", "z"])
    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, f"key {kinds['key']}, doc_id {kinds['doc_id']}, n_bytes long, z binary")


def _unzip(z: bytes, n: int) -> bytes:
    return pa.decompress(z, decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def surroundings_of(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """gram, ctx, n, l and the bytes around the anchor, read once from one text that has them."""
    wanted = reps.groupBy("key").agg(F.collect_list(F.struct("gram", "ctx", "n", "m", "pos", "l", "r")).alias("w"))

    def run(batches):
        for part in text_slices(batches, "z", max_bytes=1 << 20, max_rows=500):
            out = []
            for z, n, w in zip(part.column("z").to_pylist(), part.column("n_bytes").to_pylist(), part.column("w").to_pylist()):
                raw = _unzip(z, n)
                out += [(x["gram"], x["ctx"], x["n"], x["m"], x["l"], raw[x["pos"] - x["l"]:x["pos"] + x["r"]]) for x in w]
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["gram", "ctx", "n", "m", "l", "around"])

    return (texts.select("key", "n_bytes", "z").dropDuplicates(["key"]) if dict(texts.dtypes)["key"] == "string" else texts.select("key", "n_bytes", "z")) \
        .join(wanted, "key").mapInArrow(run, "gram long, ctx long, n long, m long, l long, around binary")


def sorted_reach(around: DataFrame, width: int, gram: int) -> DataFrame:
    """(gram, ctx, most, least) from suffix sorts: a task reads its grams in order, whole groups at a time."""
    def run(batches):
        held: list[tuple] = []

        def solve(rows):
            g = np.array([x[0] for x in rows], np.int64)
            most, least = repeated_reach([x[4] for x in rows], np.array([x[3] for x in rows], np.int64), np.array([x[2] for x in rows], np.int64), g, width, gram)
            hit = np.flatnonzero(most >= 0)
            return pa.RecordBatch.from_arrays([pa.array(g[hit]), pa.array([rows[i][1] for i in hit], pa.int64()), pa.array(most[hit], pa.int64()),
                                               pa.array(least[hit], pa.int64())], names=["gram", "ctx", "most", "least"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("gram", "ctx", "n", "l", "around")))
            if len(held) >= GROUP:
                cut = len(held)  # the last group may go on
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield solve(held[:cut])
                    held = held[cut:]
        if held:
            yield solve(held)

    return (around.select("gram", "ctx", "n", "l", "around").repartition("gram").sortWithinPartitions("gram")
            .mapInArrow(run, "gram long, ctx long, most long, least long"))


def counted_reach(around: DataFrame, width: int, gram: int) -> DataFrame:
    """The same for grams with very many surroundings: their strings are counted by two hashes."""
    def run(batches):
        for part in text_slices(batches, "around", max_bytes=1 << 18):
            raws, left = part.column("around").to_pylist(), np.array(part.column("l").to_pylist(), np.int64)
            data = np.frombuffer(b"".join(raws), np.uint8)
            size = np.array([len(r) for r in raws], np.int64)
            begin = np.cumsum(size) - size
            s1, s2 = sums_of(data, BYTE), sums_of(data, BYTE2)
            down = POWERS.upto(len(data) + 1)[1]
            i = np.repeat(np.arange(len(raws)), left + 1)
            d = np.arange(len(i)) - np.repeat(np.cumsum(left + 1) - left - 1, left + 1)
            fits = size[i] - left[i] >= width - d
            i, d = i[fits], d[fits]
            a = begin[i] + left[i] - d
            pick = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(pick) for c in ("gram", "ctx", "n")] + [pa.array(d), pa.array(mixed((s1[a + width] - s1[a]) * down[a]).view(np.int64)),
                 pa.array(mixed((s2[a + width] - s2[a]) * down[a]).view(np.int64))], names=["gram", "ctx", "n", "d", "h1", "h2"])

    strings = around.mapInArrow(run, "gram long, ctx long, n long, d long, h1 long, h2 long")
    # one string may stand around several anchors: it is counted by its place at each
    again = strings.groupBy("gram", "d", "h1", "h2").agg(F.sum("n").alias("seen")).where("seen > 1")
    return (strings.join(again, ["gram", "d", "h1", "h2"]).groupBy("gram", "ctx")
            .agg(F.max("d").alias("most"), F.min("d").alias("least")))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(key, spans): per document the byte ranges [lo, hi) that repeated strings cover, unmerged. ``docs``: key, doc_id, text."""
    found = stage(anchor_rows(docs, width, gram), "sd-anchors").repartition("gram")
    kinds = found.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"))
    grams = (kinds.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")).where("total > 1"))
    shared = stage(found.join(grams, "gram"), "sd-shared")  # the same shuffle serves counts and join
    whole = shared.where("m = 1").select("key", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r")).alias("hi"))
    mixed_ = shared.where("m > 1")
    reps = (mixed_.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos", "l", "r", "m")).alias("x"))
            .select("gram", "ctx", "n", "x.*"))
    around = stage(surroundings_of(reps, packed(docs)), "sd-around")
    reach = sorted_reach(around.where(F.col("m") <= group), width, gram)
    if not around.where(F.col("m") > group).isEmpty():
        reach = reach.union(counted_reach(around.where(F.col("m") > group), width, gram))
    part = (mixed_.join(stage(reach, "sd-reach"), ["gram", "ctx"])
            .select("key", (F.col("pos") - F.col("most")).alias("lo"), (F.col("pos") + width - F.col("least")).alias("hi")))
    return whole.union(part).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cut(raw: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    kept, runs, done = [], 0, 0
    last = -1
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if lo > last:
            kept.append(raw[done:lo])
            runs += 1
        if hi > last:
            last = done = hi
    kept.append(raw[done:])
    return b"".join(kept), runs


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row."""
    d = identified(docs)
    spans = repeated_spans(d, width, gram, group)

    def run(batches):
        for part in text_slices(batches, "z", max_bytes=1 << 20, max_rows=1000):
            n = part.column("n_bytes").to_pylist()
            done = [cut(_unzip(z, k), s) for z, k, s in zip(part.column("z").to_pylist(), n, part.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_bytes"), pa.array([k - len(x) for k, (x, _) in zip(n, done)], pa.int64()),
                 pa.array([r for _, r in done], pa.int64()), pa.array([x for x, _ in done], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return (packed(d).join(spans, "key", "left").select("doc_id", "n_bytes", "z", "spans")
            .mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    return (suffix_dedup(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
