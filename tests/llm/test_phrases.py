import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from srcindex.llm import phrases
from srcindex.llm.common import table


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\t]+", p) for p in re.split(r"[.,;:!?\n-\r]", low)]


def brute(rows, min_count=10, max_words=3, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for w in pieces(text):
            for m in range(1, max_words + 1):
                f[lang or "und" if lang is None else lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, n in f.items():
        cand = {p: c for p, c in n.items() if len(p) > 1 and c >= min_count}
        total = sum(c for p, c in n.items() if len(p) == 1)
        inside = defaultdict(int)
        for p, c in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], c)
        ranked = []
        for p, a in cand.items():
            if 100 * inside[p] >= 50 * a and p in inside and inside[p]:
                continue
            s, k = min((10 ** 6 * a * a // (n[p[:k]] * n[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-s, -a, " ".join(p).encode(), n[p[:k]], n[p[k:]]))
        out |= {(lang, r + 1, t.decode(), -a, x, y, total, -s) for r, (s, a, t, x, y) in enumerate(sorted(ranked)[:top])}
    return out


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return {tuple(r) for r in df.collect()}


def random_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "SAT", "on", "a", "mat", "été", "É", "x\xa0y", "日本", "I", "i", "\x1cz"] + [f"w{i}" for i in range(60)]
    weights = [8] * 14 + [1] * 60
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b", " ; "]
    rows = []
    for _ in range(n):
        text = "".join(w + rng.choice(ends) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((text if rng.random() < 0.95 else None, rng.choice(["en", "en", "fr", None, "", "und"])))
    return rows + [(rows[3][0], "en")] * 15


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, 1, "x") for k, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, n long, phrase string").repartition(5)


@pytest.mark.parametrize("sample,n_bits", [(8, 1 << 26), (1, 1 << 26), (10 ** 9, 1 << 26), (3, 64), (10 ** 9, 1 << 12)])
def test_equals_brute_force_whatever_the_sample_and_the_filter(spark, sample, n_bits):
    """An empty sample, a whole one, a filter that lets nearly everything through."""
    rows = random_rows(1)
    assert found(phrases.collocations(frame(spark, rows), sample=sample, n_bits=n_bits)) == brute(rows)


@pytest.mark.parametrize("max_words,min_count,top", [(2, 3, 5), (4, 4, 50), (5, 12, 2000)])
def test_other_lengths_and_counts(spark, max_words, min_count, top):
    rows = random_rows(2)
    assert found(phrases.collocations(frame(spark, rows), min_count, max_words, top, sample=4)) == brute(rows, min_count, max_words, top)


def test_border_failures_cause_an_expansion_that_closes(spark):
    rows = [("alpha beta gamma delta", "en")] * 30
    d = frame(spark, rows)
    empty, passes = phrases.frequent_phrases(d, sample=10 ** 9)  # nothing proposed: words, then all that they make countable
    assert passes == 2 and {(r.phrase, r.n) for r in empty.collect() if r.words == 3} == {("alpha beta gamma", 30), ("beta gamma delta", 30)}
    _, passes = phrases.frequent_phrases(d, sample=1)  # all proposed: the border holds nothing frequent
    assert passes == 1


def test_every_phrase_is_counted_in_one_pass_only(spark):
    """Counts of the passes are disjoint, so their union has no phrase twice."""
    rows = random_rows(4)
    got, passes = phrases.frequent_phrases(frame(spark, rows), min_count=5, sample=40)
    assert passes > 1 and got.groupBy("lang", "words", "phrase").count().where("count > 1").count() == 0


def test_given_documents(spark):
    rows = [(r.text, r.lang) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    assert found(phrases.op12_phrases(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_nulls_empty_table_and_long_text(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert found(phrases.collocations(d)) == set()
    d = spark.createDataFrame([(None, None, None), (1, "", "en")], "doc_id long, text string, lang string")
    assert found(phrases.collocations(d)) == set()
    rows = [("one two three. " * 200_000, "en"), ("one two", None)]
    assert found(phrases.collocations(frame(spark, rows))) == brute(rows)


def test_products_beyond_64_bits_are_exact(spark, monkeypatch):
    """a = 3 * 10^9: 10^6 a^2 has 84 bits."""
    def given(docs, *_):
        return spark.createDataFrame([(0, "en", "", 10 ** 13), (1, "en", "u", 10 ** 12 + 7), (1, "en", "v", 3 * 10 ** 9 + 1), (2, "en", "u v", 3 * 10 ** 9)],
                                     "words int, lang string, phrase string, n long"), 1
    monkeypatch.setattr(phrases, "frequent_phrases", given)
    a, l, r = 3 * 10 ** 9, 10 ** 12 + 7, 3 * 10 ** 9 + 1
    assert found(phrases.collocations(spark.range(1))) == {("en", 1, "u v", a, l, r, 10 ** 13, 10 ** 6 * a * a // (l * r))}


def test_words_equal_the_plain_cut():
    rng = random.Random(9)
    texts = ["".join(rng.choices("aB é日\t .,\n\x0b\x0c\r!?;:Z\x1c", k=rng.randint(0, 40))) if rng.random() < 0.9 else None for _ in range(500)]
    words, text, follows = phrases.cut_words(pa.array(texts).slice(3))
    want = [(k, i == 0, w) for k, t in enumerate(texts[3:]) for p in pieces(t) for i, w in enumerate(p)]
    assert words.to_pylist() == [w for _, _, w in want] and text.tolist() == [k for k, _, _ in want]
    assert np.logical_not(follows).tolist() == [new for _, new, _ in want[1:]]
