"""Modules are read on their own: null and repeated paths don't mix."""

from srcindex.operators import chunks as CH
from srcindex.operators.prepare import prepare_entries

ONE = '''import json as j


class A(Base):
    """Doc."""
    def m(self, a):
        if a:
            f(j.dumps(a))
'''
TWO = "def k(x, y=2):\n    g(x)\n"
THREE = "def k():\n    return 1\n"


def test_null_and_repeated_paths(spark):
    src = spark.createDataFrame([(None, ONE), (None, TWO), ("same.py", TWO), ("same.py", THREE), (None, None), (None, "def (")],
                                "filepath string, code string")
    facts = CH.parse_sources(src)
    ch = CH.chunk_table(facts).collect()
    tagged = [r for r in ch if r.class_name == "A"]
    assert [(r.filepath, r.name, r.calls_functions, r.complexity_score, [p.name for p in r.parameters], r.imports_used) for r in tagged] == \
        [(None, "m", ["f", "j.dumps"], 2, ["self", "a"], ["json"])]
    assert sorted((r.filepath or "", r.name, tuple(r.calls_functions), len(r.parameters)) for r in ch if r.name == "k") == \
        [("", "k", ("g",), 2), ("same.py", "k", (), 0), ("same.py", "k", ("g",), 2)]
    assert [r.methods for r in ch if r.type == "ClassDef"] == [["m"]]
    assert [(r.filepath, r.reason) for r in CH.source_errors(facts).collect()] == [(None, "syntax")]
    assert prepare_entries(CH.chunk_table(facts), with_vectors=False).count() == len(ch)


def test_other_columns_come_along(spark):
    src = spark.createDataFrame([(7, "a.py", TWO, "x")], "repo long, filepath string, code string, kindly string")
    (row,) = CH.parse_sources(src).collect()
    assert (row.repo, row.filepath, row.kindly, row.name, row.calls) == (7, "a.py", "x", "k", ["g"])


def test_long_error_texts_are_whole():
    from srcindex.operators.pyfacts import source_facts
    (row,) = source_facts("x = (\n" + "a" * 500 + " b\n")
    assert row[0] == "error"
