import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from srcindex.llm import alignment
from srcindex.llm.common import table

PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
EDGE = ["", None, " ", "a", "hello world's don't  two  spaces \n\n x\t\ty ", "<|endoftext|> and <s> </s> <unk> <0x41>", "été naïve 日本語 🙂🙂 ‍",
        "x\x1c\x1d y\x85z\xa0 w v﻿", "\x00\x01", "1234 56½ ²", "▁ is no blank", "the same words again", "the same words again", "a" * 3000,
        " " * 3000 + "b", "ab " * 2000, "\r\n\r\n", "é" * 700, "1" * 900]


def token_bytes():
    """The contract's reading of both vocabularies, from the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    byte_of = {chr(b) if b in plain else chr(next(spare)): b for b in range(256)}
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    ta = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in a.get_vocab().items()}
    tb = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]}
    return a, b, ta, tb


def brute(texts):
    a, b, ta, tb = token_bytes()
    docs, links = [], []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(ta[i] for i in x) != raw or b"".join(tb[i] for i in y) != raw:
            docs.append(([], [], ""))
            links.append([])
            continue
        ea, eb = np.cumsum([len(ta[i]) for i in x]).tolist(), np.cumsum([len(tb[i]) for i in y]).tolist()
        cuts = sorted(set(ea) & set(eb))
        groups, own, i, j = [], [], 0, 0
        for c in cuts:
            i2, j2 = ea.index(c, i) + 1, eb.index(c, j) + 1
            groups.append(",".join(map(str, x[i:i2])) + "|" + ",".join(map(str, y[j:j2])))
            for p in range(i, i2):
                for q in range(j, j2):
                    if max(ea[p] - len(ta[x[p]]), eb[q] - len(tb[y[q]])) < min(ea[p], eb[q]):
                        own.append((x[p], y[q]))
            i, j = i2, j2
        docs.append((x, y, ";".join(groups)))
        links.append(own)
    n = Counter(p for own in links for p in own)
    most = {}
    for (_, q), c in n.items():
        most[q] = max(most.get(q, 0), c)
    return [(len(x), len(y), g.count(";") + bool(g), len(own), sum(n[p] == most[p[1]] for p in own), sum(n[p] for p in own),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for (x, y, g), own in zip(docs, links)]


def rows_of(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("share", [1, 300, 500_000])
def test_edges_equal_brute_force(spark, share):
    """At every border between broadcast and joined pairs; a column that clashes with a result name is not read."""
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(EDGE)], "doc_id long, text string, pairs string, n_a int")
    assert rows_of(alignment.alignments(d, *PATHS, share=share)) == brute(EDGE)


def test_given_documents_equal_brute_force(spark):
    texts = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = alignment.op11_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == brute([r.text for r in texts])


def test_empty_table_null_and_repeated_ids(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignments(d, *PATHS).count() == 0
    d = spark.createDataFrame([(None, "one two"), (None, "one two"), (4, "one two"), (4, None)], "doc_id long, text string")
    got = Counter(tuple(r)[1:] for r in alignment.alignments(d, *PATHS).collect())
    assert got == Counter(brute(["one two"] * 3 + [None]))


@pytest.mark.parametrize("lane", [1, 2, 7, 256])
def test_lockstep_equals_plain_merge(lane):
    """Random token borders of several documents, whatever the length of a lane."""
    rng = random.Random(lane)
    for _ in range(40):
        ends_a, ends_b, starts, at = [], [], [], 0
        for _doc in range(rng.randint(1, 5)):
            n = rng.randint(1, 30)
            starts.append(len(ends_a))
            for ends in (ends_a, ends_b):
                ends += sorted(at + c for c in rng.sample(range(1, n), rng.randint(0, n - 1))) + [at + n]
            at += n
        got = alignment.lockstep(np.array(ends_a), np.array(ends_b), np.array(starts), lane)
        begin = lambda e: [0, *e[:-1]]
        links = {(i, j) for i, (p, q) in enumerate(zip(begin(ends_a), ends_a)) for j, (r, s) in enumerate(zip(begin(ends_b), ends_b)) if max(p, r) < min(q, s)}
        cuts = {(ends_a.index(c), ends_b.index(c)) for c in set(ends_a) & set(ends_b)}
        assert sorted(zip(got[0].tolist(), got[1].tolist())) == sorted(links)
        assert sorted(zip(got[2].tolist(), got[3].tolist())) == sorted(cuts)


def test_long_text(spark):
    """Several lanes and, beyond ``FAST``, the other library; equal ids from both."""
    t = alignment.Tokenizers(*PATHS)
    text = "".join(random.Random(3).choices(["word ", "été ", "12", " ", "\n", "xx", "日", "aaaa"], k=90_000))
    assert len(text) > alignment.FAST and (t.fast.encode_to_numpy(" " + text) == t.encode_a(text)).all()
    d = spark.createDataFrame([(1, text), (2, "word")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.alignments(d, *PATHS).collect()}
    assert got[1].n_a == len(t.encode_a(text)) and got[1].n_links >= max(got[1].n_a, got[1].n_b) and got[2].n_groups == 1


def test_encoder_equals_the_library():
    """All kinds of letters: one text for every 97th code point."""
    t = alignment.Tokenizers(*PATHS)
    for c in range(1, 0x110000, 97):
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}  {chr(c)} x{chr(c)}\n{chr(c)}."
            assert t.encode_a(s).tolist() == t.slow.encode(" " + s, add_special_tokens=False).ids, hex(c)


def test_large_counts_stay_exact(spark):
    d = spark.createDataFrame([(k, "one two three") for k in range(500)], "doc_id long, text string").repartition(7)
    got = alignment.alignments(d, *PATHS, share=1).agg(F.countDistinct("count_sum").alias("k"), F.max("count_sum").alias("s"), F.max("n_links").alias("n")).first()
    assert got.k == 1 and got.s == got.n * 500
