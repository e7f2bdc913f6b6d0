import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from srcindex.llm import suffix_dedup as sd
from srcindex.llm.common import table


def brute(texts, width):
    """(n_bytes, n_removed, n_spans, kept) of every text, by counting all strings."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if seen[r[i:i + width]] > 1:
                gone[i:i + width] = True
        gone[len(r):] = False
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    out = [None, "", "a" * 700, "ab" * 300, " ".join(["same line here"] * 60)]
    for _ in range(n):
        t = " ".join(rng.choice([word(), word(), word(), rng.choice(shared)]) for _ in range(rng.randint(1, 40)))
        if rng.random() < 0.2 and out[-1]:
            t = out[-1][:len(out[-1]) // 2] + "#" + out[-1][len(out[-1]) // 2 + 1:]
        out.append(t)
    return out + [out[-1], out[7]]


def got(spark, texts, **kw):
    d = spark.createDataFrame([(k, t, b"x") for k, t in enumerate(texts)], "doc_id long, text string, kept binary").repartition(3)
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(sd.suffix_dedup(d, **kw).collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("seed,group", [(1, sd.GROUP), (2, 3)])
def test_equals_brute_force(spark, seed, group):
    texts = made(seed)
    assert got(spark, texts, width=60, gram=16, group=group) == brute(texts, 60)


def test_documents_equal_brute_force(spark):
    rows = sorted(table(spark, "/root/testdata/sf0.001", "documents").collect(), key=lambda r: r.doc_id)
    want = brute([r.text for r in rows], 200)
    have = sorted(sd.op4_suffix_dedup(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in have] == [(a, b, c, hashlib.sha256(k).hexdigest()) for a, b, c, k in want]
    assert sum(w[1] for w in want) > 0


def test_null_and_repeated_ids(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=900))
    d = spark.createDataFrame([(None, t), (None, "short"), (3, t[100:500]), (3, "x" + t[300:620]), (4, "y" * 10)], "doc_id long, text string")
    have = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in sd.suffix_dedup(d).collect())
    assert have == sorted((n, g, s) for n, g, s, _ in brute([t, "short", t[100:500], "x" + t[300:620], "y" * 10], 200))


def test_empty_table(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order_is_the_byte_order(seed):
    rng = random.Random(seed)
    parts = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(300)]
    group = np.sort(np.array([rng.randint(0, 20) for _ in parts]))
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
    start = np.cumsum(size) - size
    order, same = sd.verified_order(data, start, size, group)
    raw = sd.suffix_order(data, sd.sums_of(data, sd.BYTE), start, size, group)
    want = sorted(range(300), key=lambda i: (group[i], parts[i]))
    assert [(group[i], parts[i]) for i in order] == [(group[i], parts[i]) for i in want] == [(group[i], parts[i]) for i in raw]
    for k in range(1, 300):
        a, b = parts[order[k - 1]], parts[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert same[k] == (n if group[order[k - 1]] == group[order[k]] else -1)


def test_collisions_are_verified(monkeypatch):
    """With a hash that says "equal" to everything the order still comes out right."""
    monkeypatch.setattr(sd, "sums_of", lambda data, numbers: np.zeros(len(data) + 1, np.uint64))
    parts = [b"bca", b"abc", b"abd", b"b"]
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    order, same = sd.verified_order(data, np.cumsum(size) - size, size, np.zeros(4, np.int64))
    assert [parts[i] for i in order] == sorted(parts) and same.tolist() == [-1, 2, 0, 1]


def test_long_texts_go_in_parts(monkeypatch):
    rng = random.Random(3)
    raw = bytes(rng.choices(b"abcdefgh", k=30_000))
    want = sd.anchors([raw])
    monkeypatch.setattr(sd, "PART", 1500)
    have = sd.anchors([raw])
    assert all((a == b).all() for a, b in zip(want, have))


def test_case_matters_and_inconsistent_hashes_are_survived(monkeypatch):
    """A hash that cannot tell cases apart contradicts the bytes; the verified order is right all the same."""
    rng = random.Random(8)
    parts = ["".join(rng.choices("aAbB", k=rng.randint(1, 9))).encode() for _ in range(200)]
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    folded = sd.BYTE.copy()
    folded[65:91] = folded[97:123]
    for numbers in (sd.BYTE, folded):
        monkeypatch.setattr(sd, "BYTE", numbers)
        order, _ = sd.verified_order(data, np.cumsum(size) - size, size, np.zeros(200, np.int64))
        assert [parts[i] for i in order] == sorted(parts)
