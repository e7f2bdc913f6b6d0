"""Exact and line deduplication against plain Python, with odd rows."""

import hashlib
from collections import Counter, defaultdict

from srcindex.llm import exact_dedup, line_dedup

BLANKS = " \t\n\x0b\x0c\r"
DOCS = [(1, "a b"), (2, "ab"), (3, "a  b\n"), (4, None), (5, ""), (6, " \t"), (7, "é b"), (8, "x" * 50_000), (9, "x" * 50_000 + " "), (10, "\xa0ab"),
        (11, "ab"), (11, "ab"), (None, "ab    "), (12, "q"), (12, "r")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, 5, True) for i, t in rows], "doc_id long, text string, group_size int, kept boolean")


def test_exact_groups(spark, monkeypatch):
    bare = lambda t: "".join(c for c in t or "" if c not in BLANKS)
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    rows = exact_dedup.exact_dedup(docs(spark)).collect()
    assert len(rows) == len(DOCS)
    by = defaultdict(list)
    for r in rows:
        by[bytes(r.digest)].append(r)
    for text, members in groups.items():
        got = by[hashlib.sha256(text.encode()).digest()]
        best = min(members)
        assert len(got) == len(members) and {r.group_size for r in got} == {len(members)} and {r.keep_id for r in got} == {best[3]}
        assert sum(r.kept for r in got) == 1 and [r.doc_id for r in got if r.kept] == [best[3]]


def test_frequent_digests_give_the_same_as_the_shuffle(spark, monkeypatch):
    rows = [(i, f"text {i % 7 if i % 3 else i}") for i in range(400)]
    key = lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept)
    split = sorted(map(key, exact_dedup.exact_dedup(docs(spark, rows)).collect()))
    assert exact_dedup.frequent_digests(exact_dedup.digests(docs(spark, rows))).count() >= 7
    monkeypatch.setattr(exact_dedup, "frequent_digests", lambda d: d.sparkSession.createDataFrame(
        [], "digest binary, group_size long, w struct<a: int, b: boolean, c: long, d: long>"))
    assert sorted(map(key, exact_dedup.exact_dedup(docs(spark, rows)).collect())) == split


def test_drop_copies_keeps_one_row_of_each_text(spark):
    left = exact_dedup.drop_copies(docs(spark))
    assert left.columns == ["doc_id", "text", "group_size", "kept"]
    assert sorted((str(r.doc_id), r.text[:3]) for r in left.where("text IS NOT NULL").collect()) == sorted(
        [("None", "ab "), ("6", " \t"), ("7", "é b"), ("9", "xxx"), ("10", "\xa0ab"), ("12", "q"), ("12", "r")])


def lines_by_hand(rows, least, first=False):
    """(n_lines, n_dropped, kept) per row; a document is its id and text."""
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(BLANKS))
    where = defaultdict(set)
    for i, t in set(rows):
        for s in (t or "").split("\n"):
            if key(s):
                where[key(s)].add((i, t))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(where[key(s)]) < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    rows = [(k, f"  Shared Line \nown {k}\n\nshared line\r\nÄ\nä{k}\n") for k in range(6)] + [
        (20, None), (21, ""), (22, "\n\n"), (23, "shared LINE"), (23, "shared LINE"), (None, "shared line\nx"), (24, "\n".join(f"l{i}\nshared line" for i in range(500))),
        (25, "x\n" * 3)]
    for least in (1, 2, 7, 9, 99):
        got = sorted(map(tuple, line_dedup.line_dedup(docs(spark, rows), min_docs=least).collect()), key=repr)
        assert got == sorted(lines_by_hand(rows, least), key=repr), least


def test_first_lines_can_stay(spark):
    rows = [(1, "a\nb\na"), (2, "A\nc"), (3, "b\na")]
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(docs(spark, rows), min_docs=2, keep_first=True).collect()}
    assert got == {1: "a\nb", 2: "c", 3: ""}


def test_empty_tables(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == line_dedup.line_dedup(docs(spark, [])).count() == 0
    assert Counter(r.kept for r in exact_dedup.exact_dedup(docs(spark, [(1, None)])).collect()) == {True: 1}
