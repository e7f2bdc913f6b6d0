import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcindex.llm import bpe
from srcindex.llm.common import table

EDGE = ["", None, " ", "a", "a" * 5000, "hello world's don't I'LL  two  spaces \n\n x\t\ty ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>",
        "<|endoftext", "été naïve 日本語 🙂🙂 ‍", "x\x1c\x1d y\x85z\xa0 w v﻿", "\x00\x01", "1234 56½ ²", "  ", "\n", "don't’s", " " * 3000 + "b",
        "ab" * 3000, "\r\n\r\n", "'s't're", "A" * 49 + " tail", "é" * 700]


def lib():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_vocabulary())


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def check(rows, texts):
    t = lib()
    for r in rows:
        want = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want, repr((texts[r.doc_id] or "")[:80])
        assert r.n_tokens == len(want)
        assert r.decoded == t.decode(want, skip_special_tokens=False)


def test_edges_equal_the_library(spark):
    texts = dict(enumerate(EDGE))
    d = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, ids string")
    check(bpe.bpe(d, bpe.default_vocabulary()).collect(), texts)


def test_random_unicode_equals_the_library(spark):
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0, 0x250), 0x300, 0x3b1, 0x416, 0x5d0, 0x661, 0x966, 0xe01, 0x200b, 0x2009, 0x3000, 0x4e2d, 0x1f600, 0x1f1e6]]
    texts = {k: "".join(rng.choices(pool, k=rng.randint(1, 80))) for k in range(400)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(bpe.bpe(d, bpe.default_vocabulary()).collect(), texts)


def test_documents_equal_the_library(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    check(bpe.bpe(d, bpe.default_vocabulary()).collect(), {r.doc_id: r.text for r in d.collect()})


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe(d, bpe.default_vocabulary()).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_transducer_holds_exactly_its_words(tmp_path, seed):
    rng = random.Random(seed)
    words = {bytes(rng.choices(b"abc\xff", k=rng.randint(1, 7))): [rng.randint(0, 50256) for _ in range(rng.randint(1, 4))] for _ in range(800)}
    (tmp_path / "w").write_bytes(bpe.compile_words(words))
    t = bpe.Transducer(str(tmp_path / "w"))
    for w, ids in words.items():
        assert np.frombuffer(t.get(w), "<u4").tolist() == ids
    for _ in range(2000):
        w = bytes(rng.choices(b"abcd\xff", k=rng.randint(1, 8)))
        assert (t.get(w) is None) == (w not in words)


def test_transducer_shares_suffixes(tmp_path):
    words = {p + s: [1] for p in (b"un", b"re", b"dis", b"mis", b"over") for s in (b"taking", b"making", b"using")}
    (tmp_path / "w").write_bytes(bpe.compile_words(words))
    assert len(bpe.Transducer(str(tmp_path / "w")).final) < 30  # a plain tree has over 70


def test_query_digests(spark):
    t = lib()
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in bpe.op6_bpe(spark, "/root/testdata/sf0.001").where(F.col("doc_id") < 20).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == digest(ids) and r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lockstep_merges_equal_single_ones(tmp_path):
    v = bpe.Vocabulary(bpe.default_vocabulary())
    rng = random.Random(9)
    words = [b"", b"a", *(bytes(rng.choices(b" aeinorst\xc3\xa9\xff", k=rng.randint(1, 60))) for _ in range(3000)), *(t for t in v.token_bytes if t)]
    for w, ids in zip(words, v.merge_all(words)):
        assert np.frombuffer(ids, "<u4").tolist() == v.merge(w)
    assert v.merge_all([]) == []


def test_ascii_texts_are_cut_alike():
    import regex
    rng, full, cut = random.Random(3), regex.compile(bpe.PIECES), bpe.piece_cutter()
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(128), 32, 10, 39, 115])) for _ in range(rng.randint(0, 40)))
        assert cut(text) == full.findall(text)


def test_full_word_cache(spark, monkeypatch, tmp_path):
    """Words come and go between the two generations of the cache, with equal ids."""
    monkeypatch.setattr(bpe, "CACHED", 3)
    (tmp_path / "w").write_bytes(bpe.compile_words({b" the": [262]}))
    codec, t = bpe.Codec(bpe.default_vocabulary(), str(tmp_path / "w")), lib()
    for text in ["one two three four the", "two " + "x" * 70 + " the five", "one six seven", "x" * 70, "two <|endoftext|> one", ""] * 3:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_waiting_workers_hold_no_words(spark):
    """After a run the workers that made it hold the vocabulary, but no cache of words."""
    import pyarrow as pa

    from srcindex.llm import bpe as B
    from srcindex.session import ship_package
    ship_package(spark)
    docs = spark.range(400, numPartitions=4).selectExpr("id AS doc_id", "concat('word', id, ' other', id * 7) AS text")
    assert B.bpe(docs, B.default_vocabulary()).where("n_tokens > 0").count() == 400

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"n": [sum(len(c.words) + len(c.words.older) for c in B._CODECS.values())], "codecs": [len(B._CODECS)]})

    rows = spark.range(64, numPartitions=16).mapInArrow(held, "n long, codecs long").collect()
    assert sum(r.codecs for r in rows) > 0 and sum(r.n for r in rows) == 0
