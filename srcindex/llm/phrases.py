r"""Phrase collocations by Toivonen's method: a sample proposes, full passes decide.

Every ``SAMPLE``-th document (by a hash of its text) is mined alone with a lowered
threshold; what it finds is proposed. A full pass then counts in all documents the
proposals together with their negative border, that is every word, and every longer
phrase whose two next shorter parts are proposed while it need not be. If a phrase of
the border turns out frequent, the proposals failed there: an expansion pass adds it and
counts every phrase that this makes countable and that was not counted before. As it
takes all that it counts for proposed, it counts the border of its own phrases, too, and
so the proposals are closed after it: every frequent phrase has been counted, whatever
the sample held (the counts of a phrase's parts are at least its own; all words are
known after the first pass; a phrase whose parts were all counted then is frequent only
if they are, and one with a part that was not is counted in the expansion).

These passes count by a phrase's 64-bit hash, which is short to shuffle and can only
count too much where hashes meet. A last pass counts the phrases themselves, but only
those whose hash was frequent, so all counts that come out are exact.

Proposals travel as one bit filter of fixed size (``FILTER_BITS``). It knows every
proposal; the others that it lets through are counted without need and change nothing.
A task cuts its texts into words and counts phrases with array operations over slices of
bounded size, so what reaches Spark's map-side sum is a row per different phrase of a
slice, and a very common word is no hot key.

Defined results: a null text is empty, a null lang is ``und``; texts are read whole;
rows count as they come, repeated ones too, and ids are not read; other columns are not
read; an empty table gives no rows. Equal scores and counts go by the phrase's bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcindex.llm.common import query, table, text_slices
from srcindex.session import stage

#: What ends a piece and what parts its words.
BREAKS, PARTS = ".,;:!?\n\x0b\x0c\r", " \t"
#: One document in SAMPLE proposes; a phrase is proposed from MIN_COUNT / SAMPLE occurrences on there, but from two.
SAMPLE = 8
#: Bits of the filter (8 MB) and how many of them stand for a phrase.
FILTER_BITS, HASHES = 1 << 26, 3
#: Bytes of text counted at once; bytes of text for which a bucket of hashes is made; entries that a bucket holds before it sums them up.
SLICE, BUCKET, JOINED = 1 << 20, 4 << 20, 1_000_000

_KIND = np.zeros(256, np.uint8)  # 0: part of a word
_KIND[[ord(c) for c in PARTS]], _KIND[[ord(c) for c in BREAKS]] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- words and phrases of a slice --------------------------------------------------

def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts in order, the text of each, and whether the next one follows in the same piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kind = _KIND[raw]
    inside = kind == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = np.unique(ends)
    border = border[(border > 0) & (border < len(raw))]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.cumsum(np.append(0, sizes))), pa.py_buffer(_LOWER[raw[inside]]))
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(raw) else np.empty(0, np.int32)
    text = np.searchsorted(ends, starts, side="right") - 1
    follows = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return words, text, follows


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hashes(strings) -> np.ndarray:
    return pd.util.hash_array(np.asarray(strings, object), categorize=False)


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase (or of a lang) with one more word."""
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


class Filter:
    """A set of phrase hashes in a fixed number of bits; it may take others for members."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(h: np.ndarray, n_bits: int) -> np.ndarray:
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * step) % np.uint64(n_bits) for k in range(HASHES)]).astype(np.int64)

    def __contains__(self, h):
        raise TypeError("use has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h, len(self.bits) * 64)
        return ((self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0).astype(bool)


def count_slice(texts: pa.Array, langs: pa.Array, max_words: int, new: Filter | None, old: Filter | None, exact: bool):
    """Yields what one slice counts, by levels (numbers of words): (level, hashes, n), or with ``exact``
    (level, langs, phrases, n) and as level 0 each lang's number of words.

    ``new`` None: everything counts (the sample). Else the phrases whose parts ``new`` has,
    but for those that a pass with ``old`` has counted; words in the first pass only
    (``old`` None). With ``exact`` only phrases that ``new`` itself has count.
    """
    words, text, follows = cut_words(texts)
    if not len(words):
        return
    words = words.dictionary_encode()
    known, word = words.dictionary, words.indices.to_numpy().astype(np.int64)
    lang_codes = pc.fill_null(langs, "und").dictionary_encode()
    names = lang_codes.dictionary
    lang = lang_codes.indices.to_numpy().astype(np.int64)[text]
    word_hash, lang_hash = hashes(known.to_numpy(zero_copy_only=False)), hashes(names.to_numpy(zero_copy_only=False))
    if exact:
        yield 0, names, pa.array([""] * len(names), pa.large_string()), np.bincount(lang, minlength=len(names))

    code, pairs = pd.factorize(lang * len(known) + word)
    del lang, word, text
    own_lang, own_word = pairs // len(known), pairs % len(known)
    spelled = [own_word]  # of every phrase its words
    h = longer(lang_hash[own_lang], word_hash[own_word])
    in_new = np.ones(len(h), bool) if new is None else new.has(h)
    in_old = np.zeros(len(h), bool) if old is None else old.has(h)
    langs_of, part = own_lang, code
    done = np.full(len(h), old is not None)
    base, at = len(pairs), code  # `at`: number of the phrase that begins at a word, -1 for none
    for level in range(1, max_words + 1):
        if level > 1:
            n = len(code) - level + 1
            if n <= 0:
                return
            where = np.flatnonzero(follows[level - 2:] & (at[:n] >= 0) & (at[1:n + 1] >= 0))  # each shorter phrase lies in one piece
            where = where[in_new[at[where]] & in_new[at[where + 1]]]
            part, uniq = pd.factorize(at[where] * base + code[where + level - 1])
            if not len(uniq):
                return
            head, end = uniq // base, uniq % base
            one = np.empty(len(uniq), np.int64)
            one[part] = where  # a place of each phrase
            done = in_old[head] & in_old[at[one + 1]]
            langs_of = own_lang[end]
            spelled = [w[head] for w in spelled] + [own_word[end]]
            h = longer(h[head], word_hash[own_word[end]])
            in_new = np.ones(len(h), bool) if new is None else new.has(h)
            in_old = done & (False if old is None else old.has(h))
            if old is not None:
                in_new |= ~done  # what an expansion counts it takes for proposed
        count = np.bincount(part, minlength=len(h))
        if exact:
            show = np.flatnonzero(in_new)
            phrase = known.take(pa.array(spelled[0][show]))
            for w in spelled[1:]:
                phrase = pc.binary_join_element_wise(phrase, known.take(pa.array(w[show])), pa.scalar(" ", known.type))
            yield level, names.take(pa.array(langs_of[show])), phrase, count[show]
        else:
            show = np.flatnonzero(~done)
            yield level, h[show], count[show]
        if level > 1:
            at = np.full(len(at), -1, np.int64)
            at[where] = part


# --- passes ---------------------------------------------------------------------------

def _shared(bits):
    return None if bits is None else Filter(bits.value)


def add_up(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order, and the sum of each."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def hash_counts(docs: DataFrame, max_words: int, least: int, buckets: int, new=None, old=None) -> DataFrame:
    """(words, h, n) with n >= ``least``, summed over all documents; filters are broadcast variables.

    A slice's hashes and counts are dealt to ``buckets`` by their hash and travel packed,
    one row for each bucket; a bucket is summed as its rows stream in.
    """
    def run(batches):
        for part in text_slices(batches, "text", SLICE, 1 << 20):
            for level, h, n in count_slice(part.column("text"), part.column("lang"), max_words, _shared(new), _shared(old), False):
                bucket = ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
                bucket, h, n = bucket[order], h[order], n[order].astype(np.int64)
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
                ends = pa.py_buffer((np.append(first, len(h)) * 8).astype(np.int64))
                packed = lambda x: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, ends, pa.py_buffer(x)]).cast(pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), level, np.int8)), pa.array(bucket[first].astype(np.int32)), packed(h), packed(n)],
                                                 names=["words", "bucket", "h", "n"])

    def flat(column):
        """The packed numbers of all rows."""
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].view(np.int64)

    def join(batches):
        held: dict[int, list] = {}  # of each level the sums so far, and what came since
        fresh, kept = 0, 0

        def settle():
            for level, (hs, ns) in held.items():
                h, n = add_up(np.concatenate(hs), np.concatenate(ns))
                held[level] = [[h], [n]]

        for part in batches:
            level_of = np.repeat(part.column("words").to_numpy(), pc.binary_length(part.column("h")).to_numpy() // 8)
            h, n = (flat(part.column(c)) for c in ("h", "n"))
            for level in np.unique(level_of).tolist():
                hs, ns = held.setdefault(level, [[], []])
                hs.append(h[level_of == level].view(np.uint64))
                ns.append(n[level_of == level])
            fresh += len(h)
            if fresh > max(JOINED, kept):
                settle()
                fresh, kept = 0, sum(len(ns[0]) for _, ns in held.values())
        settle()
        for level, ((h,), (n,)) in held.items():
            h, n = h[n >= least], n[n >= least]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), level, np.int8)), pa.array(h.view(np.int64)), pa.array(n)], names=["words", "h", "n"])

    return (docs.select("text", "lang").mapInArrow(run, "words byte, bucket int, h binary, n binary")
            .repartition(buckets, "bucket").mapInArrow(join, "words byte, h long, n long"))


def exact_counts(docs: DataFrame, max_words: int, new) -> DataFrame:
    """(words, lang, phrase, n) of the phrases that the filter has, and of level 0."""
    def run(batches):
        for part in text_slices(batches, "text", 4 * SLICE, 1 << 20):
            for level, lang, phrase, n in count_slice(part.column("text"), part.column("lang"), max_words, _shared(new), None, True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), level, np.int32)), lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(n, pa.int64())],
                                                 names=["words", "lang", "phrase", "n"])

    return (docs.select("text", "lang").mapInArrow(run, "words int, lang string, phrase string, n long")
            .groupBy("words", "lang", "phrase").agg(F.sum("n").alias("n")))


def filter_bits(found: DataFrame, n_bits: int, known=None) -> np.ndarray:
    """Bits of the hashes ``h`` that the broadcast filter ``known`` does not have; zeros where there are none.

    Spark joins the bits by 64-bit words, at most n_bits / 64 rows, which come to the driver.
    """
    def run(batches):
        for part in batches:
            h = part.column("h").to_numpy().view(np.uint64)
            if known is not None:
                h = h[~Filter(known.value).has(h)]
            at = np.unique(Filter.places(h, n_bits))
            slot, first = np.unique(at >> 6, return_index=True)
            if len(slot):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    joined = found.select("h").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.uint64)
    out[joined.column("slot").to_numpy()] = joined.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, sample: int = SAMPLE, n_bits: int = FILTER_BITS) -> tuple[DataFrame, int]:
    """(words, lang, phrase, n) of all phrases of 1 to ``max_words`` words with n >= ``min_count``, with one
    row of 0 words for each lang (n: all its words); and the number of passes until closed."""
    sc = docs.sparkSession.sparkContext
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    lowered = max(2, min_count // sample)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, size // BUCKET)
    bits = filter_bits(hash_counts(some, max_words - 1, lowered, buckets), n_bits)
    first = sc.broadcast(bits)
    now = stage(hash_counts(docs, max_words, min_count, buckets, first), "phrases")
    frequent = filter_bits(now, n_bits)
    failed = filter_bits(now.where(F.col("words") < max_words), n_bits, first)
    if failed.any():
        frequent |= filter_bits(hash_counts(docs, max_words, min_count, buckets, sc.broadcast(bits | failed), first), n_bits)
    counted = exact_counts(docs, max_words, sc.broadcast(frequent))
    return stage(counted.where((F.col("words") == 0) | (F.col("n") >= min_count)), "phrases"), 1 + bool(failed.any())


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, top: int = 2000, sample: int = SAMPLE, n_bits: int = FILTER_BITS) -> DataFrame:
    """Each lang's ``top`` phrases: (lang, rank, phrase, a, l, r, n, score).

    score: the lowest, over all cuts in two, of floor(10^6 a^2 / (l r)), in exact decimals.
    A phrase goes if a longer candidate that holds it has at least half its count.
    """
    found, _ = frequent_phrases(docs, min_count, max_words, sample, n_bits)
    parts = found.where(F.col("words") > 0).select("lang", "phrase", "n")
    cand = found.where(F.col("words") > 1).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    span = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cut = (cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
           .select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("head"), span(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest")))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide('l')} * {wide('r')})")
    scored = (cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
              .select("lang", "phrase", "a", "low.score", "low.l", "low.r"))
    inner = (cand.where(F.size("w") > 2).withColumn("m", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
             .withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)))
             .groupBy("lang", span(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer")))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = found.where(F.col("words") == 0).select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 10),
cuts AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, m, w FROM c),
s AS (SELECT cuts.lang, cuts.phrase, a, k, x.n AS l, y.n AS r,
        CAST((CAST(a AS HUGEINT) * a * 1000000) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ')
                JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:cuts.m], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE m = 3) GROUP BY ALL),
r AS (SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, score
      FROM low LEFT JOIN d ON d.lang = low.lang AND d.phrase = low.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT r.lang, rank, r.phrase, a, l, r, t.n, score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000
"""


@query("op12_phrases", SQL)
def op12_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
