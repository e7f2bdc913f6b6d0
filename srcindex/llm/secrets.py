r"""Secret scan: fixed rules plus a battery of randomness tests with false-discovery control.

Rules find assignments, access keys and long hex runs. Beyond them, every maximal
run of token characters of ``LEAST`` characters or more outside rule matches is
tested; a run that no alphabet holds whole (it has ``/`` or ``+`` and ``-`` or ``_``)
is cut at ``/``, and where that is not enough at ``+``, into pieces that are, and so
is a path that is found not random as a whole.

A run's encoding is inferred from its characters, and three tests ask if it could be
drawn evenly from that alphabet: chi-squared uniformity of the symbols,
Wald-Wolfowitz runs of low and high symbols, and lag-one serial correlation of
symbol values. Fisher's method combines them; a run that they reject is not random.
For the others the null is "this is text": a Markov chain of characters over letters,
case and digits, whose prior is prose and whose counts are the corpus's own text-like
runs. The ratio of a run's probabilities as text and as even draws is a p-value under
that null (Markov's inequality; times the number of alphabets, as one was chosen).

A weighted Benjamini-Hochberg step over all runs of the corpus, with weights by
length class (short runs carry little evidence and get little of the error rate),
sets the p-value that a run must reach. It works on counts per length class and
p-value bin, so what reaches the driver does not grow with the corpus.

Defined results: a null text counts as empty and has no spans; texts are scanned
whole; repeated rows are scanned and counted each; ties do not arise (bins are
taken whole); only doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.llm.common import query, table, text_slices
from srcindex.llm.spans import SPAN, count_kind, rule_spans, written
from srcindex.session import stage

#: The rules' kinds as listed, then the inferred encodings.
RULES = ("assign", "access", "hex")
#: Alphabets in order of inference, by their characters.
ALPHABETS = (
    ("hex16", "0123456789abcdef"),
    ("hex16u", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Share of each letter a-z in prose, in percent.
PROSE = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Shortest run that is tested; combined p-value of the battery below which a run is not random; false-discovery rate.
LEAST, NOT_RANDOM, RATE = 20, 0.001, 0.01
#: The null's prior: its weight in transitions, share of transitions that stay in a class of characters, share of letters that are even.
PRIOR, STAY, EVEN = 50.0, 0.85, 0.2
#: Transitions that one run adds to the null at most.
MOST_OF_ONE = 64
#: Length classes (upper ends) and their weights in the false-discovery step; p-value bins per power of ten.
CLASSES, CLASS_WEIGHTS, BINS = (24, 32, 48, 64, 1 << 30), (0.25, 0.5, 1.0, 1.5, 1.5), 20

ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
_SETS = [(name, frozenset(chars), {c: i for i, c in enumerate(chars)}) for name, chars in ALPHABETS]


def _class(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c and "-"


def text_model(counts: dict[str, float]) -> dict[str, float]:
    """log10 of the probability that text goes from one character to the next, by the two characters (the first one alone: at the start).

    ``counts``: transitions seen in text. A character's own counts are backed by those
    between classes of characters times the letter's share, and these by the prior.
    """
    chars = [*ALPHABETS[5][1], "-", "_"]
    moves, share, seen = Counter(), Counter(), Counter()
    for x in ("", "a", "A", "0", "-"):
        for y in ("a", "A", "0", "-"):
            moves[x, y] = PRIOR * (0.25 if not x else STAY if x == y else (1 - STAY) / 3)
    for i, p in enumerate(PROSE):
        share[chr(97 + i)] = PRIOR * ((1 - EVEN) * p / sum(PROSE) + EVEN / 26)
    share.update({c: PRIOR / 10 for c in "0123456789"} | {c: PRIOR / 4 for c in "+/-_"})
    for pair, n in counts.items():
        moves[_class(pair[:-1]), _class(pair[-1])] += n
        share[pair[-1].lower()] += n
        seen[pair[:-1]] += n
    out, of, by = Counter(), Counter(), Counter()
    for (x, _), n in moves.items():
        out[x] += n
    for c, n in share.items():
        of[_class(c)] += n
    for x in ("", *chars):
        for c in chars:
            back = moves[_class(x), _class(c)] / out[_class(x)] * share[c.lower()] / of[_class(c.lower())]
            by[x + c] = math.log10((counts.get(x + c, 0) + PRIOR * back) / (seen[x] + PRIOR))
    return dict(by)


PRIOR_MODEL = text_model({})


def log_ratio(run: str, k: int, model: dict[str, float]) -> float:
    """log10 of the run's probability as text over that of even draws from k symbols."""
    return model[run[0]] + sum(model[a + b] for a, b in zip(run, run[1:])) + len(run) * math.log10(k)


def rule_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, place in RULES) of the rules' matches; a match that fails its length is passed over whole."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def _upper(z: float) -> float:
    """P(Z > z) of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(run: str) -> tuple[str, list[int]] | None:
    """The first alphabet that holds all characters, and the characters' places in it."""
    used = set(run)
    for name, chars, place in _SETS:
        if used <= chars:
            return name, [place[c] for c in run]
    return None


def battery(values: list[int], k: int) -> float:
    """p-value of "drawn evenly from k symbols"."""
    n = len(values)
    chi2 = k / n * sum(c * c for c in Counter(values).values()) - n
    p_even = _upper((chi2 - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)))
    high = [v >= k / 2 for v in values]
    n1 = sum(high)
    n0 = n - n1
    if n1 and n0:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * n1 * n0 / n
        var = (mean - 1) * (mean - 2) / max(n - 1, 1)
        p_runs = 2 * _upper(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - min(n, 1000))
    mid = sum(values) / n
    spread = sum((v - mid) ** 2 for v in values)
    r = sum((a - mid) * (b - mid) for a, b in zip(values, values[1:])) / spread if spread else 1.0
    p_serial = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    x = -sum(math.log(max(p, 1e-300)) for p in (p_even, min(p_runs, 1.0), min(p_serial, 1.0)))
    return math.exp(-x) * (1 + x + x * x / 2)  # Fisher's method, six degrees of freedom


def _cut(text: str, a: int, b: int, at: str) -> list[tuple[int, int]]:
    """(start, stop) of the parts of text[a:b] between the characters ``at``."""
    out = []
    for part in text[a:b].split(at):
        out.append((a, a + len(part)))
        a += len(part) + 1
    return out


def pieces(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, stop) of what is tested: runs outside rule matches; one without an alphabet is cut at ``/``, and what still has none at ``+``."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        for s, e in sorted((s, e) for s, e, _ in taken if s < b and a < e):
            out.append((a, s))
            a = max(a, e)
        out.append((a, b))
    for at in "/+":
        out = [p for a, b in out for p in ([(a, b)] if b - a < LEAST or infer(text[a:b]) else _cut(text, a, b, at))]
    return [(a, b) for a, b in out if b - a >= LEAST]


def tested_runs(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, bool]]:
    """(start, stop, place, passes the battery, is text-like by the prior) of the runs outside rule matches."""
    out, todo = [], pieces(text, taken)
    for a, b in todo:
        if (run := text[a:b]).isdigit():
            continue
        found = infer(run)
        place = next(i for i, (name, _) in enumerate(ALPHABETS) if name == found[0])
        k = len(ALPHABETS[place][1])
        random = battery(found[1], k) >= NOT_RANDOM
        if not random and "/" in run and (parts := [p for p in _cut(text, a, b, "/") if p[1] - p[0] >= LEAST]):
            todo += parts  # a path that is not random as a whole can hold a token
            continue
        mixed = any(c.isdigit() for c in run) or not (run.islower() or run.isupper() or run[1:].islower())
        out.append((a, b, place, mixed and random, log_ratio(run, k, PRIOR_MODEL) >= 0))
    return out


def transitions(run: str) -> dict[str, int]:
    """A run's transitions in thousandths, of ``MOST_OF_ONE`` at most."""
    held = min(len(run), MOST_OF_ONE)
    return {pair: 1000 * held * n // len(run) for pair, n in Counter([run[0], *(a + b for a, b in zip(run, run[1:]))]).items()}


def p_value(run: str, place: int, model: dict[str, float]) -> float:
    """p-value of "this is text" for a run that passes the battery."""
    return 10 ** min(0.0, log_ratio(run, len(ALPHABETS[place][1]), model) + math.log10(len(ALPHABETS)))


_THREE = [("start", pa.int32()), ("stop", pa.int32()), ("place", pa.int32())]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, rules (start, stop, place), runs (start, stop, place, random, like, run) of every row; run is null where neither holds."""
    def run(batches):
        for part in text_slices(batches, "text"):
            rules, runs = [], []
            for text in part.column("text").to_pylist():
                found = rule_matches(text) if text else []
                rules.append([{"start": a, "stop": b, "place": k} for a, b, k in found])
                runs.append([{"start": a, "stop": b, "place": k, "random": r, "like": t, "run": text[a:b] if r or t else None}
                             for a, b, k, r, t in (tested_runs(text, found) if text else [])])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rules, pa.list_(pa.struct(_THREE))),
                 pa.array(runs, pa.list_(pa.struct([*_THREE, ("random", pa.bool_()), ("like", pa.bool_()), ("run", pa.string())])))],
                names=["doc_id", "rules", "runs"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"""doc_id {kind}, rules array<struct<start: int, stop: int, place: int>>,
        runs array<struct<start: int, stop: int, place: int, random: boolean, like: boolean, run: string>>""")


def seen_transitions(found: DataFrame) -> dict[str, float]:
    """Transitions of all text-like runs: a row per pair of characters, whatever the corpus."""
    def count(batches):
        total = Counter()
        for part in batches:
            for run in part.column("run").to_pylist():
                total.update(transitions(run))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["pair", "n"])

    rows = (found.select(F.explode("runs").alias("r")).where("r.like").select("r.run").mapInArrow(count, "pair string, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")).collect())
    return {r["pair"]: r["n"] / 1000 for r in rows}


def rated(found: DataFrame, model: dict[str, float]) -> DataFrame:
    """``scan``'s rows with the length class and the bin of the p-value of every run (p = 1 where the battery rejects it)."""
    def rate(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                runs = []
                for row in part.column("runs").to_pylist():
                    ps = [p_value(r["run"], r["place"], model) if r["random"] else 1.0 for r in row]
                    runs.append([{"start": r["start"], "stop": r["stop"], "place": r["place"],
                                  "size": next(i for i, top in enumerate(CLASSES) if r["stop"] - r["start"] <= top),
                                  "bin": min(20 * BINS, int(-BINS * math.log10(max(p, 1e-30))))} for r, p in zip(row, ps)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("rules"), pa.array(runs, pa.list_(pa.struct([*_THREE, ("size", pa.int32()), ("bin", pa.int32())])))],
                    names=["doc_id", "rules", "runs"])

    kinds = dict(found.dtypes)
    return found.mapInArrow(rate, f"""doc_id {kinds["doc_id"]}, rules {kinds["rules"]},
        runs array<struct<start: int, stop: int, place: int, size: int, bin: int>>""")


def least_bins(counts: dict[tuple[int, int], int], rate: float = RATE) -> dict[int, int]:
    """Weighted Benjamini-Hochberg on binned p-values: the lowest bin that counts as a discovery, by length class.

    ``counts``: runs by (length class, bin). A run's p-value is divided by its class's
    weight, the weights having mean 1 over all runs.
    """
    total = sum(counts.values())
    if not total:
        return {}
    mean = sum(n * CLASS_WEIGHTS[c] for (c, _), n in counts.items()) / total
    weighted = sorted((10 ** (-b / BINS) / (CLASS_WEIGHTS[c] / mean), c, b, n) for (c, b), n in counts.items())
    limit, seen = 0.0, 0
    for p, _, _, n in weighted:
        seen += n
        if p <= rate * seen / total:
            limit = p
    return {c: min(b for p, c2, b, _ in weighted if c2 == c and p <= limit) for c in {c for p, c, _, _ in weighted if p <= limit}}


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id and all spans (rules' and the battery's) of every row."""
    found = stage(scan(docs), "secrets")
    found = stage(rated(found, text_model(seen_transitions(found))), "secrets-rated")
    counts = found.select(F.explode("runs").alias("r")).groupBy("r.size", "r.bin").count().collect()  # at most classes x bins
    least = least_bins({(r["size"], r["bin"]): r["count"] for r in counts}, rate)
    name = F.array(*map(F.lit, RULES))
    code = F.array(*(F.lit(a) for a, _ in ALPHABETS))
    rules = F.transform("rules", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["place"].alias("place"),
                                                    F.element_at(name, s["place"] + 1).alias("kind"), F.lit(True).alias("base")))
    floor = lambda s: F.coalesce(*(F.when(s["size"] == c, F.lit(b)) for c, b in least.items()), F.lit(1 << 20))
    runs = F.transform(F.filter("runs", lambda s: s["bin"] >= floor(s)), lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), (s["place"] + len(RULES)).alias("place"),
        F.element_at(code, s["place"] + 1).alias("kind"), F.lit(False).alias("base")))
    return found.select("doc_id", F.concat(rules.cast(SPAN), runs.cast(SPAN)).alias("spans"))


@query("op1_secrets")
def op1_secrets(spark, sf_dir):
    spans = F.col("spans")
    by = ("start", "place")
    return (find_secrets(table(spark, sf_dir, "documents"))
            .select("doc_id", *(count_kind(spans, k).alias(f"n_{k}") for k in RULES),
                    F.sha2(written(rule_spans(spans), by), 256).alias("base_sha256"), written(spans, by).alias("spans")))
