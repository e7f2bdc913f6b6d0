"""Spark string helpers agree with Python's str.strip and textwrap.dedent."""

import random
import textwrap

from pyspark.sql import functions as F

from srcindex.functions.text import is_blank, line_slice, pystrip, truncate_chars, with_dedent

TRICKY = ["", " ", "\t x \n", " a ", "\x1c\x1fb\x1e", " c ", "　d　 ",
          "﻿e", "\x85f\x85", "g​", "  \n\r\n h i \x0b\x0c"]


def test_pystrip_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(TRICKY)], "i int, s string")
    out = {r.i: (r.t, r.b) for r in df.select("i", pystrip("s").alias("t"), is_blank("s").alias("b")).collect()}
    for i, s in enumerate(TRICKY):
        assert out[i] == (s.strip(), not s.strip()), repr(s)


def _texts(n=300, seed=3):
    rnd = random.Random(seed)
    alphabet = [" ", "  ", "\t", "x", "y = 1", "", "    ", "\t\t", " \t"]
    out = []
    for _ in range(n):
        lines = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(1, 6))]
        out.append("\n".join(lines))
    return out


def test_dedent_matches_textwrap(spark):
    texts = _texts() + ["    a\n      b\n    c", "\ta\n\t\tb", "  a\n\tb", "    x\n\n    y\n  \n", "a\n  b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in with_dedent(df, "t", "d").collect()}
    for i, t in enumerate(texts):
        assert got[i] == textwrap.dedent(t), repr(t)


def test_line_slice_and_truncate(spark):
    code = "l1\nl2\nl3\nl4"
    df = spark.createDataFrame([(code, 2, 3), (code, 4, 9), (code, 6, 8), ("x" * 1001, 1, 1)],
                               "c string, s int, e int")
    rows = df.select(line_slice("c", "s", "e").alias("x"), truncate_chars("c", 1000).alias("t")).collect()
    lines = code.split("\n")
    assert rows[0].x == "\n".join(lines[1:3])
    assert rows[1].x == "\n".join(lines[3:9])
    assert rows[2].x == ""
    assert rows[3].t == "x" * 1000 + "..."


def test_dedent_of_odd_lines(spark):
    """Only a line feed ends a line; tabs, mixed margins and signs of regular expressions are plain text."""
    import textwrap

    from srcindex.functions.text import with_dedent
    texts = ["", "\n", "  \n", "  a\r  b\n  c", "\ta\n\t\tb\n \t", "  a\x85 b\n   $1\\n", "    x\n\ty", "  a\n\n\t \n    b\n", "   a\n  b", "\x1c a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: r.d for r in with_dedent(df, "t", "d").collect()}
    assert got.pop(99) is None and got == {i: textwrap.dedent(t) for i, t in enumerate(texts)}
