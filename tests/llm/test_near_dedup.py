"""Near-duplicate classes against all pairs."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from srcindex.llm import near_dedup
from srcindex.llm.common import table


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    """(shingles, smallest linked doc_id) of every row, from all pairs that share a shingle."""
    sets = [shingles(t, width) for _, t in rows]
    places, parent = defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in places[x]}:
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s:
            places[x].append(i)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), d), d)
    return sorted((d, len(sets[i]), best[root(i)]) for i, (d, _) in enumerate(rows))


def got(spark, rows, width, percent):
    d = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_classes(d, width, percent / 100).collect())


def made(seed):
    """A large group of copies with a varying number of changed words, chains, small sets and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    base = [word() for _ in range(160)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "one"), (1006, "a b c"), (1007, "a b c d")]
    for k in range(70):
        w = list(base)
        for i in rng.sample(range(len(w)), rng.choice([0, 1, 2, 3, 5, 9, 14])):
            w[i] = word()
        rows.append((k, " ".join(w)))
    chain = [word() for _ in range(60)]
    for k in range(100, 115):  # each like the one before only
        chain[k - 100] = word()
        rows.append((k, " ".join(chain)))
    rows += [(200 + k, " ".join(word() for _ in range(rng.randint(1, 300)))) for k in range(30)]
    return rows + [(300, rows[9][1]), (301, rows[9][1].upper())]


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 85), (2, 5, 80)])
def test_equals_all_pairs(spark, monkeypatch, seed, width, percent):
    monkeypatch.setattr(near_dedup, "SHORT", 6)  # the large group goes through the full sets' lists
    rows = made(seed)
    assert got(spark, rows, width, percent) == brute(rows, width, percent)


def test_documents_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    have = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.op5_near_dedup(spark, "/root/testdata/sf0.001").collect())
    assert have == brute(rows, 3, 85) and any(c != d for d, _, c in have)


def test_repeated_rows_and_empty_table(spark):
    assert got(spark, [(5, "a b c d e"), (5, "a b c d e"), (4, "A b c d e"), (6, "z")], 5, 80) == [(4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6)]
    assert got(spark, [], 5, 80) == []


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_partners_share_enough_of_their_sketches(similarity):
    """The worst pairs: as many values in common as the similarity asks for, the others smaller than all of these."""
    for n in [*range(1, 80), 333, 1000]:
        for m in {n, int(n / similarity), max(1, n - 1)}:
            both = next(i for i in range(min(n, m) + 1) if i >= similarity * (n + m - i) - 1e-9 or i == min(n, m))
            if both < similarity * (n + m - both) - 1e-9:
                continue
            a, b = int(near_dedup.sketch_size(np.array([n]), similarity)[0]), int(near_dedup.sketch_size(np.array([m]), similarity)[0])
            shared = min(a - (n - both), b - (m - both))  # common values in both sketches
            assert shared >= near_dedup.spare(math.ceil(max(n, m) * similarity - 1e-9)) or shared >= both


def test_sketches_travel_as_halves(spark):
    """Four bytes a value, in the same order; they never count more differences than the sets have, whatever halves fall together."""
    rng = np.random.default_rng(12)
    sets, rows = [], []
    for crowded in (1 << 62, 1 << 38, 1 << 34):  # of the last, 8 halves in all
        for i in range(60):
            pool = np.unique(rng.integers(-crowded, crowded, 90))
            sets.append([np.sort(rng.choice(pool, rng.integers(1, 80), replace=False)) for _ in "ab"])
            rows.append([s[:rng.integers(1, len(s) + 1)].tolist() for s in sets[-1]])
    held = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, a array<long>, b array<long>")
    half = held.select("i", near_dedup.halves("a").alias("a"), near_dedup.halves("b").alias("b"))
    assert dict(half.dtypes) == {"i": "bigint", "a": "array<int>", "b": "array<int>"}
    for r in half.collect():
        a, b = (np.array(x, np.int32) for x in (r.a, r.b))
        assert a.tolist() == (np.array(rows[r.i][0]) >> 32).tolist() and (np.diff(a) >= 0).all()
        assert near_dedup._apart(a, b) <= len(np.setxor1d(*sets[r.i]))
    assert near_dedup._apart(np.arange(0, 40, 2, np.int32), np.arange(0, 90, 3, np.int32)) == 19 + 13 - 2 * 7


def test_small_blocks_and_a_large_list_without_links(spark, monkeypatch):
    """A passage that all documents share lists them together, though few are alike; blocks and parts of a few sets."""
    monkeypatch.setattr(near_dedup, "BLOCK", 600)
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join(passage + [word() for _ in range(rng.randint(5, 40))])) for k in range(90)]
    assert got(spark, rows, 3, 85) == brute(rows, 3, 85)
    rows = made(7)
    assert got(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_regular_words_have_hashes_of_their_own():
    """Words over two letters whose polynomial hashes modulo 2**64 meet: the Thue-Morse word and its complement."""
    from srcindex.llm.shingles import shingle_sets
    for n in (8, 64, 1024, 4096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        sets, at = shingle_sets([word, other, f"x {word} y z", f"x {other} y z", word.upper()], 3)
        one, two, three, four, five = (set(sets[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))
        assert not one & two and len(three & four) == 0 and one == five


def test_a_task_names_its_partners_once():
    """40 classes that are all partners of the same 3: 120 pairs, but 3 rows name the sets that are needed."""
    sketch = list(range(50))
    three = [{"cid": c, "n": 50, "comp": c} for c in (1, 2, 3)]
    kind = pa.list_(pa.struct([("cid", pa.int64()), ("n", pa.int64()), ("comp", pa.int64())]))
    ids = list(range(10, 50))
    left = pa.table({"cid": ids, "n": [50] * 40, "comp": ids, "partners": pa.array([three] * 40, kind), "v": pa.array([sketch] * 40, pa.list_(pa.int64()))})
    right = pa.table({"other": [1, 2, 3], "other_v": pa.array([sketch] * 3, pa.list_(pa.int64()))})
    out = near_dedup._likely(0.85)(left, right)
    assert out.column("partners").to_pylist() == [three] * 40
    assert [p["cid"] for row in out.column("fresh").to_pylist() for p in row] == [1, 2, 3]


def test_repeated_ids_with_one_set_in_other_texts(spark):
    """Rows of one doc_id whose different texts have the same set: the set is made once."""
    rows = [(1, "a b c d e f g h i j"), (1, "A b  c d e f g h i j"), (2, "a b c d e f g h i j k"), (3, "x y z")]
    assert got(spark, rows, 3, 85) == [(1, 8, 1), (1, 8, 1), (2, 9, 1), (3, 1, 3)]
