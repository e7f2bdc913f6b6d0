r"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, quote, other).
Four small transducers are composed: negation, reported speech, target, and the
insult/threat scorer that reads what the others have marked. Run over a clause,
the composed machine gives each matched insult or threat a strength: more when it
is aimed at somebody, less when it is negated or only reported. A document's
features are the strengths summed per lexicon entry, over the whole text; a ridge
logistic regression weighs them.

The lexicon is a short list of fixed entries plus words and word beginnings that
mark toxic texts in a bounded, seeded sample of labelled training rows (``SAMPLE``
rows); the regression is fitted on the same rows. Rows with crc32(doc_id) mod 5 = 0
are never learned from. Scores read the text only.

Defined results: a null text counts as empty, and an empty text gets the score of
no match; a null doc_id is not held out; of several labels of a document the
largest counts, null labels are none; without labels of both kinds the fixed
entries score with fixed weights; repeated rows score alike; an empty table gives
none; only doc_id and text are read, besides the columns that ``keep`` names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.llm.common import query, table, text_slices
from srcindex.session import stage

#: Labelled training rows that are learned from, at most; entries that the lexicon learns, at most.
SAMPLE, ENTRIES = 10_000, 300
#: A learned entry stands in so many toxic rows of the sample at least, with this likelihood-ratio statistic.
LEAST_ROWS, LEAST_G2 = 8, 25.0
#: The grammar's closed word classes and seed entries.
TARGETS = "you your yours yourself he him his she her they them their this that these those people everyone he's she's you're they're".split()
NEGATIONS = "not no never none nobody neither nor without isn't aren't wasn't weren't don't doesn't didn't cannot can't won't nicht kein keine pas jamais no nunca".split()
REPORTS = "said says say saying told tells wrote writes claimed claims called quoted reported reports according alleged allegedly".split()
INSULTS = "idiot moron stupid trash worthless pathetic scum loser clown disgusting".split()
THREATS = "kill hurt destroy punch stab burn strangle".split()
#: Strength of a match: plain, aimed at a target, reported, negated; they multiply.
AIMED, REPORTED, NEGATED = 1.5, 0.5, 0.25

CLAUSE_END = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]")


# --- transducers -----------------------------------------------------------------

class Transducer:
    """A deterministic weighted transducer: ``step(state, symbol) -> (state, symbol, weight)``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: the other machine reads what this one writes; weights multiply."""
        memo: dict = {}

        def step(state, symbol):
            if (hit := memo.get((state, symbol))) is None:
                a, mid, w = self.step(state[0], symbol)
                b, out, v = other.step(state[1], mid)
                hit = memo[state, symbol] = ((a, b), out, w * v)
            return hit

        return Transducer((self.start, other.start), step)


def _marker(opens: str, reach: int, weight: float) -> Transducer:
    """Weighs the matches (I, H) among the ``reach`` symbols after one of ``opens``."""
    def step(left, symbol):
        if symbol in opens:
            return reach, symbol, 1.0
        return max(0, left - 1), symbol, weight if left and symbol in "IH" else 1.0
    return Transducer(0, step)


def _aimed(reach: int = 6) -> Transducer:
    """A target before the match aims it; a match is remembered so that a target after it can."""
    def step(left, symbol):
        if symbol == "T":
            return reach, symbol, 1.0
        return max(0, left - 1), symbol, AIMED if left and symbol in "IH" else 1.0
    return Transducer(0, step)


GRAMMAR = _marker("N", 3, NEGATED).then(_marker("RQ", 12, REPORTED)).then(_aimed())
_CLASS = {w: c for c, ws in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws} | dict.fromkeys("\"“”„«»", "Q")


class Lexicon:
    """Entries as a keyword automaton: ``word`` matches the word itself, ``stem*`` any word that it begins."""

    def __init__(self, entries: list[str], threats: set[str] = frozenset(THREATS)):
        self.entries, self.threats = entries, threats
        self.find = ahocorasick.Automaton()
        for k, e in enumerate(entries):
            key = " " + e.rstrip("*")
            both = self.find.get(key, ())
            self.find.add_word(key, (*both, k))
        if entries:
            self.find.make_automaton()
        self.exact = {e: k for k, e in enumerate(entries) if not e.endswith("*")}
        self.stems = {e[:-1]: k for k, e in enumerate(entries) if e.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)

    def entry(self, word: str) -> int | None:
        """The entry that a lower-case word matches: the word itself, else its longest listed beginning."""
        if (k := self.exact.get(word)) is not None:
            return k
        return next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), None)

    def strengths(self, text: str) -> dict[int, float]:
        """Strength per entry over the whole text; only clauses that can hold a match are read word by word."""
        if not self.entries:
            return {}
        low = text.lower()
        spaced = _NOT_LETTER.sub(" ", " " + low)  # same positions, shifted by one
        out: dict[int, float] = defaultdict(float)
        done = 0
        for end, _ in self.find.iter(spaced):
            if end - 1 < done:
                continue
            begin = max((m.end() for m in CLAUSE_END.finditer(low, done, end - 1)), default=done)
            stop = CLAUSE_END.search(low, end - 1)
            done = stop.end() if stop else len(low)
            self.clause(low[begin:stop.start() if stop else len(low)], out)
        return out

    def clause(self, clause: str, out: dict[int, float]) -> None:
        state = GRAMMAR.start
        words = WORD.findall(clause)
        marks = [self.entry(w) for w in words]
        aims = [_CLASS.get(w) == "T" for w in words]
        for i, (w, k) in enumerate(zip(words, marks)):
            symbol = _CLASS.get(w, "O") if k is None else "H" if self.entries[k] in self.threats else "I"
            state, _, weight = GRAMMAR.step(state, symbol)
            if k is not None:
                out[k] += weight * (AIMED if weight == 1.0 and any(aims[i + 1:i + 4]) else 1.0)


_NOT_LETTER = re.compile(r"[\W\d_]")


# --- learning -----------------------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``sample`` labelled rows that are not held out, the smallest by a seeded hash."""
    few = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
           .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def candidate_terms(rows: DataFrame) -> DataFrame:
    """(term, toxic rows, clean rows): words, and word beginnings of 4 to 8 letters as ``stem*``."""
    def count(batches):
        held: dict[str, list[int]] = {}
        for part in text_slices(batches, "text"):
            for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                terms = set(WORD.findall((text or "").lower()))
                terms |= {w[:n] + "*" for w in terms for n in range(4, min(9, len(w) + 1))}
                for t in terms:
                    held.setdefault(t, [0, 0])[y > 0] += 1
            if len(held) > 200_000:
                yield _counts(held)
                held.clear()
        yield _counts(held)

    return (rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _counts(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"term": pa.array(list(held), pa.string()), "toxic": pa.array([v[1] for v in held.values()], pa.int64()),
                                       "clean": pa.array([v[0] for v in held.values()], pa.int64())})


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The fixed entries and the learned ones: the highest likelihood ratios, one of each chain of beginnings."""
    share = n_toxic / (n_toxic + n_clean)
    a, b, n = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    part = lambda seen, rate: F.when(seen > 0, seen * F.log(seen / (n * rate))).otherwise(0.0)
    best = (candidate_terms(rows).where((a >= LEAST_ROWS) & (a > n * share))
            .withColumn("g2", F.round(2 * (part(a, share) + part(b, 1 - share)), 6)).where(F.col("g2") >= LEAST_G2)
            .orderBy(F.col("g2").desc(), F.length("term").desc(), "term").limit(20 * ENTRIES).collect())
    entries = [*INSULTS, *THREATS]
    learned: list[str] = []
    for r in best:
        bare = r.term.rstrip("*")
        if len(learned) < ENTRIES and r.term not in entries and not any(bare.startswith(e.rstrip("*")) or e.rstrip("*").startswith(bare) for e in [*learned, *INSULTS]):
            learned.append(r.term)
    return entries + learned


def vector(strengths: dict[int, float], n_words: int, size: int) -> list[tuple[int, float]]:
    """Features of a text: log strength per entry, of all, per hundred words, and the constant."""
    total = sum(strengths.values())
    return [*((k, float(np.log1p(v))) for k, v in strengths.items()),
            (size, float(np.log1p(total))), (size + 1, min(10.0, 100 * total / max(n_words, 20))), (size + 2, 1.0)]


def fit(rows: list[list[tuple[int, float]]], y: np.ndarray, width: int, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last feature (constant) is not shrunk."""
    x = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        for k, v in row:
            x[i, k] = v
    shrink = np.full(width, ridge)
    shrink[-1] = 1e-6
    w = np.zeros(width)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (shrink * w * w).sum()

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, gain, now = w + step, now - then, then
        if gain < 1e-7 * max(1.0, now):
            break
    return w


class Model:
    """A lexicon and its weights; small enough to travel with each task."""

    def __init__(self, entries: list[str], weights: list[float]):
        self.entries, self.weights = entries, weights

    def scorer(self):
        lexicon, weights, size = Lexicon(self.entries), self.weights, len(self.entries)

        def score(text: str | None) -> float:
            text = text or ""
            z = sum(weights[k] * v for k, v in vector(lexicon.strengths(text), len(text.split()), size))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return score


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn lexicon and weights from a bounded sample of the labelled rows that are not held out."""
    rows = stage(training_rows(docs, labels, sample), "toxic-sample")
    seen = Counter({bool(r.toxic > 0): r["count"] for r in rows.groupBy("toxic").count().collect()})
    if not seen[True] or not seen[False]:
        entries = [*INSULTS, *THREATS]
        return Model(entries, [1.0] * len(entries) + [1.0, 0.2, -2.0])
    entries = learn_lexicon(rows, seen[True], seen[False])
    size = len(entries)

    def features(batches):
        lexicon = Lexicon(entries)
        for part in text_slices(batches, "text"):
            got = [vector(lexicon.strengths(t or ""), len((t or "").split()), size) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([[k for k, _ in g] for g in got], pa.list_(pa.int32())),
                                              pa.array([[v for _, v in g] for g in got], pa.list_(pa.float64()))], names=["toxic", "k", "v"])

    got = rows.mapInArrow(features, "toxic int, k array<int>, v array<double>").collect()  # at most `sample` rows
    got.sort(key=lambda r: (r.toxic, r.k, r.v))  # sums don't depend on the order of tasks
    w = fit([list(zip(r.k, r.v)) for r in got], np.array([float(r.toxic > 0) for r in got]), size + 3)
    return Model(entries, [float(v) for v in w])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the toxicity score of every row's whole text."""
    def run(batches):
        one = model.scorer()
        for part in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([one(t) for t in part.column("text").to_pylist()], pa.float64())],
                                             names=[*keep, "toxicity_score"])

    kinds = dict(docs.dtypes)
    wanted = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*wanted).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "toxicity_score double"]))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"),
                         (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
