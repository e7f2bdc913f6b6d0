r"""Personal data: fixed rules plus a semi-Markov conditional random field.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers. The
field looks at islands: neighbouring words that hold a digit or an at sign. An
island is cut into atoms (letters, digits, single marks); a segment is a stretch of
up to ``ATOMS`` atoms. Whole-segment features (digit count, grouping, Luhn sum,
octets, shape of the domain, separators, neighbours) score each segment for each
type, and dynamic programming over bounded segments finds the best boundaries and
types of the whole island together.

Weights are learned here: conditional likelihood by forward-backward on a bounded,
seeded sample of islands (``SAMPLE``), with the rules' matches as labels, half of
the islands rewritten in ways that the rules don't know (no plus sign, dots for
spaces) while the labels stay. So the field also finds data that the rules miss;
what overlaps no rule match is added.

Defined results: a null text counts as empty and has no spans; whole texts are
scanned; repeated rows are scanned and counted each; without any rule match in the
corpus nothing is learned and nothing added; of equal scores the shorter and earlier
type wins; an island of which rows differ in their matches is learned with the smallest
ones; texts of any length take three numbers per atom; only doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.llm.common import query, table, text_slices
from srcindex.llm.spans import SPAN, count_kind, rule_spans, written

KINDS = ("email", "ip", "card", "phone")
#: Islands that are learned from, at most; atoms of a segment, at most; atoms of an island that is learned from.
SAMPLE, ATOMS, LONG = 500, 24, 80

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit that no digit stands before begins every ip and card match: elsewhere the run has failed or is used up
IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?<![0-9]{2})(?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HIT, SPACE = re.compile(r"[0-9@]"), re.compile(r"\s")
ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)


# --- rules -------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets(s: str) -> bool:
    """Whether all parts between dots are at most 255, whatever their number of digits."""
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Found from the at signs, so that long words without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def rule_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, place in KINDS) of the rules' matches; failing ones are passed over whole."""
    out = [(a, b, 0) for a, b in emails(text)]
    if not HIT.search(text):
        return out
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if octets(m.group())]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(text)
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


# --- islands, segments, features -------------------------------------------------

def islands(text: str) -> list[tuple[int, int]]:
    """Maximal stretches of words with a digit or an at sign, one space apart."""
    out: list[tuple[int, int]] = []
    done = 0
    while m := HIT.search(text, done):
        a = m.start()
        while a > done and not text[a - 1].isspace():
            a -= 1
        end = SPACE.search(text, m.start())
        b = end.start() if end else len(text)
        if out and a == out[-1][1] + 1 and text[a - 1] == " ":
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        done = b
    return out


def segments(atoms: list[str]) -> list[list[tuple[int, int]]]:
    """By last atom: (first atom, digits) of the segments that could be personal data."""
    out: list[list[tuple[int, int]]] = [[] for _ in atoms]
    for i, first in enumerate(atoms):
        if not (first[0].isalnum() or first in "+("):
            continue
        n_digits = n_at = n_dots = n_letters = 0
        for j in range(i, min(len(atoms), i + ATOMS)):
            s = atoms[j]
            if "0" <= s[0] <= "9":
                n_digits += len(s)
            elif s == "@":
                n_at += 1
            elif s == ".":
                n_dots += 1
            elif s[0].isalnum():
                n_letters += 1
            elif s.isspace() and s != " " or n_at > 1:
                break
            if s[0].isalnum() and (n_at == 1 or n_at == 0 and n_letters == 0 and (n_digits >= 7 or n_digits >= 4 and n_dots == 3)):
                out[j].append((i, n_digits))
    return out


def features(s: str, n_digits: int, before: str, after: str) -> list[tuple[int, str]]:
    """(type, feature) pairs of a segment, for every type that it could have."""
    out: list[tuple[int, str]] = []
    if "@" in s:
        name, _, host = s.partition("@")
        parts = host.split(".")
        shape = ["dots" if len(parts) > 1 and all(parts) else "no-dots", "tld" if parts[-1].isalpha() and 2 <= len(parts[-1]) <= 6 else "odd-tld",
                 "clean" if name and all(c in LOCAL for c in name) and all(c.isalnum() or c in ".-" for c in host) else "marks",
                 "grows-left" if before in LOCAL and before else "edge-left", "grows-right" if after.isalnum() or after == "-" else "edge-right"]
        return [(0, f) for f in (*shape, "one")]
    marks = {c for c in s if not "0" <= c <= "9"}
    edge = ["more-left" if before.isdigit() or before == "." else "edge-left", "more-right" if after.isdigit() else "edge-right"]
    groups = re.findall(r"[0-9]+", s)
    if s.count(".") == 3 and marks == {"."}:
        out += [(1, f) for f in ("octets" if len(groups) == 4 and octets(s) else "no-octets", "short" if max(map(len, groups)) <= 3 else "long", *edge)]
    if n_digits >= 12 and not marks & {"+", "(", ")"}:
        out += [(2, f) for f in ("luhn" if luhn("".join(groups)) else "no-luhn", "length" if 13 <= n_digits <= 19 else "odd-length",
                                 "fours" if len(groups) == 1 or all(len(g) == 4 for g in groups[:-1]) else "uneven",
                                 "one-mark" if len(marks) <= 1 else "mixed", *edge)]
    if n_digits >= 7:
        out += [(3, f) for f in ("plus" if s[0] == "+" else "no-plus", "length" if 8 <= n_digits <= 15 else "odd-length",
                                 "grouped" if len(groups) >= 3 else "solid", "brackets" if s.count("(") == s.count(")") == 1 else "open" if marks & {"(", ")"} else "plain",
                                 "usual" if marks <= set("+() .-") else "odd-marks", "grows-left" if before and before in "+(" else "own-left", *edge)]
        if s.count(".") == 3 and marks == {"."}:
            out.append((3, "like-ip"))
    return out


def lattice(text: str, before: str = "", after: str = "") -> tuple[list[int], list[list[tuple[int, int, tuple]]]]:
    """Atom starts, and by last atom the (first atom, type, features) of all typed segments of an island."""
    atoms = [m.group() for m in ATOM.finditer(text)]
    at = [0]
    for s in atoms:
        at.append(at[-1] + len(s))
    arcs: list[list[tuple[int, int, tuple]]] = []
    for j, ends in enumerate(segments(atoms)):
        here = []
        for i, n_digits in ends:
            s = text[at[i]:at[j + 1]]
            by_type: dict[int, list] = {}
            for y, f in features(s, n_digits, text[at[i] - 1] if i else before, text[at[j + 1]] if at[j + 1] < len(text) else after):
                by_type.setdefault(y, []).append((y, f))
            here += [(i, y, tuple(fs)) for y, fs in by_type.items()]
        arcs.append(here)
    return at, arcs


def scorer(weights: dict):
    """(type, score) of every type that a segment could have; short segments' answers are kept, a bounded number of them."""
    def score(s: str, n_digits: int, before: str, after: str) -> list[tuple[int, float]]:
        total: dict[int, float] = {}
        for y, f in features(s, n_digits, before, after):
            total[y] = total.get(y, 0.0) + weights.get((y, f), 0.0)
        return list(total.items())

    kept = lru_cache(1 << 14)(score)
    return lambda s, *rest: (kept if len(s) <= 64 else score)(s, *rest)


def best_segments(score, text: str, before: str = "", after: str = "") -> list[tuple[int, int, int]]:
    """Viterbi over bounded segments: (start, stop, type) of the best labelling; an unlabelled atom scores 0.

    Atoms are read one by one. Held are the segments open at the last ATOMS atoms, as many
    scores, and for the way back three numbers per atom; never the lattice.
    """
    at, length, kind = array("q", [0]), array("b"), array("b")
    best = deque([0.0], ATOMS + 1)  # of the last atoms' ends
    is_open: deque[list] = deque()  # by first atom: [its place, its start, digits, at signs, dots, letters]
    for j, m in enumerate(ATOM.finditer(text)):
        s, end = m.group(), m.end()
        digit, other = "0" <= s[0] <= "9", s[0].isalnum()
        if is_open and is_open[0][0] <= j - ATOMS:
            is_open.popleft()
        if other or s in "+(":
            is_open.append([j, m.start(), 0, 0, 0, 0])
        if s.isspace() and s != " ":
            is_open.clear()
        top, size, what = best[-1], 0, 0
        for seg in is_open:
            seg[2] += len(s) * digit
            seg[3] += s == "@"
            seg[4] += s == "."
            seg[5] += other and not digit
            _, a, n_digits, n_at, n_dots, n_letters = seg
            if other and (n_at == 1 or n_at == 0 and n_letters == 0 and (n_digits >= 7 or n_digits >= 4 and n_dots == 3)):
                n = j - seg[0] + 1
                for y, v in score(text[a:end], n_digits, text[a - 1] if a else before, text[end] if end < len(text) else after):
                    if best[-n] + v > top + 1e-12:
                        top, size, what = best[-n] + v, n, y
        best.append(top)
        at.append(end)
        length.append(size)
        kind.append(what)
    out, j = [], len(length)
    while j:
        if n := length[j - 1]:
            out.append((at[j - n], at[j], kind[j - 1]))
        j -= n or 1
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -700 + a else a


def gradient(weights: dict, at: list[int], arcs, gold: list[tuple[int, int, int]]) -> dict:
    """Gradient of the conditional log-likelihood of the gold segments (start, stop, type)."""
    n = len(arcs)
    scored = [[(i, y, fs, sum(weights.get(f, 0.0) for f in fs)) for i, y, fs in here] for here in arcs]
    forth = [0.0] * (n + 1)
    for j in range(n):
        total = forth[j]
        for i, _, _, v in scored[j]:
            total = _log_add(total, forth[i] + v)
        forth[j + 1] = total
    back = [-math.inf] * n + [0.0]
    for j in range(n - 1, -1, -1):
        back[j] = _log_add(back[j + 1], back[j]) if back[j] > -math.inf else back[j + 1]
        for i, _, _, v in scored[j]:
            back[i] = _log_add(back[i], v + back[j + 1]) if back[i] > -math.inf else v + back[j + 1]
    grad: dict = {}
    wanted = set(gold)
    for j in range(n):
        for i, y, fs, v in scored[j]:
            change = ((at[i], at[j + 1], y) in wanted) - math.exp(min(0.0, forth[i] + v + back[j + 1] - forth[n]))
            if abs(change) > 1e-9:
                for f in fs:
                    grad[f] = grad.get(f, 0.0) + change
    return grad


def rewritten(text: str, gold: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The island with its phone numbers' plus signs gone and its card numbers' spaces turned to dots; labels follow."""
    out, spans, done = "", [], 0
    for a, b, y in gold:
        out += text[done:a]
        s = text[a:b]
        s = s.lstrip("+") if y == 3 else s.replace(" ", ".") if y == 2 else s
        spans.append((len(out), len(out) + len(s), y))
        out, done = out + s, b
    return out + text[done:], spans


def fit(sample: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 6) -> dict:
    """Weights by stochastic gradient with per-feature steps; seeded, so the same sample gives the same weights."""
    rows = []
    for text, gold in sample:
        rows.append((*lattice(text), gold))
        rows.append((*lattice((new := rewritten(text, gold))[0]), new[1]))
    rng, weights, seen = random.Random(11), {}, {}
    for _ in range(rounds):
        rng.shuffle(rows)
        for at, arcs, gold in rows:
            for f, g in gradient(weights, at, arcs, gold).items():
                g -= 0.002 * weights.get(f, 0.0)
                seen[f] = seen.get(f, 1e-8) + g * g
                weights[f] = weights.get(f, 0.0) + 0.5 * g / math.sqrt(seen[f])
    return weights


# --- the Spark side ---------------------------------------------------------------

def labelled_islands(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(key, island, gold) of at most ``sample`` islands with rule matches, the smallest by a hash of their text."""
    def run(batches):
        held: dict = {}
        for part in text_slices(batches, "text"):
            for text in part.column("text").to_pylist():
                found = rule_matches(text) if text else []
                if not found:
                    continue
                where = iter(sorted(found))
                nxt = next(where, None)
                for a, b in islands(text):
                    gold, last = [], a
                    while nxt and nxt[0] < b:
                        if nxt[0] >= last and nxt[1] <= b:
                            gold.append([nxt[0] - a, nxt[1] - a, nxt[2]])
                            last = nxt[1]
                        nxt = next(where, None)
                    if gold and b - a <= 4 * LONG:
                        held[text[a:b]] = min(gold, held.get(text[a:b], gold))
            if len(held) > 20 * sample:
                held = dict(sorted(held.items(), key=lambda x: (zlib.crc32(x[0].encode()), x[0]))[:sample])
        held = dict(sorted(held.items(), key=lambda x: (zlib.crc32(x[0].encode()), x[0]))[:sample])
        yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(t.encode()) for t in held], pa.int64()), pa.array(list(held), pa.string()),
                                          pa.array(list(held.values()), pa.list_(pa.list_(pa.int32())))], names=["key", "island", "gold"])

    return (docs.select("text").mapInArrow(run, "key long, island string, gold array<array<int>>")
            .groupBy("key", "island").agg(F.min("gold").alias("gold")).orderBy("key", "island").limit(sample))


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict:
    rows = labelled_islands(docs, sample).collect()  # at most `sample` short strings
    kept = [(r.island, [tuple(g) for g in r.gold]) for r in sorted(rows, key=lambda r: (r.key, r.island))]
    return fit([x for x in kept if sum(1 for _ in ATOM.finditer(x[0])) <= LONG])


def find_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and all spans (rules' and the field's) of every row."""
    weights = learn(docs, sample)

    def one(text: str, score) -> list[dict]:
        rules = rule_matches(text)
        out = [{"start": a, "stop": b, "place": k, "kind": KINDS[k], "base": True} for a, b, k in rules]
        starts, reach, top = [], [], 0
        for a, b, _ in sorted(rules):
            top = max(top, b)
            starts.append(a)
            reach.append(top)  # the furthest end of a match that starts here or before
        for a, b in islands(text) if weights else ():
            for s, e, y in best_segments(score, text[a:b], text[a - 1:a], text[b:b + 1]):
                before = bisect_left(starts, a + e)
                if not before or reach[before - 1] <= a + s:
                    out.append({"start": a + s, "stop": a + e, "place": y, "kind": KINDS[y], "base": False})
        return out

    kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches):
        score = scorer(weights)
        for part in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([one(t, score) if t else [] for t in part.column("text").to_pylist()], kinds)],
                                             names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans {SPAN}")


@query("op3_pii")
def op3_pii(spark, sf_dir):
    spans, by = F.col("spans"), ("place", "start")
    return (find_pii(table(spark, sf_dir, "documents"))
            .select("doc_id", *(count_kind(spans, k).alias(f"n_{k}") for k in KINDS),
                    F.sha2(written(rule_spans(spans), by), 256).alias("base_sha256"), written(spans, by).alias("spans")))
