"""Chunk table rules on hand-written modules (expected values worked out by hand)."""

import pytest

from srcindex.operators import chunks as CH
from srcindex.operators.prepare import keep_first, prepare_entries

MOD_LOW = '''import json as js


class Svc(ABC):
    """Service."""
    def __init__(self):
        self.x = 1
    def run(self):
        return super().run(js.dumps(self.x))
    def __repr__(self):
        return "S"
    class Inner:
        def deep(self):
            pass


class Migration(Base):
    def forward(self):
        pass
'''

MOD_TOP = '''class First:
    def a(self):
        return 1
'''


@pytest.fixture(scope="module")
def tables(spark):
    src = spark.createDataFrame([("pkg/low.py", MOD_LOW), ("pkg/top.py", MOD_TOP)], "filepath string, code string")
    facts = CH.parse_sources(src).cache()
    return facts


def rows(df):
    return {(r.filepath, r.name, r.class_name): r for r in df.collect()}


def test_tagged_and_untagged_rows(tables):
    ch = rows(CH.chunk_table(tables))
    low = {k[1:]: v for k, v in ch.items() if k[0] == "pkg/low.py"}
    # untagged: dunders and Migration dropped; tagged: all direct methods incl. dunders
    assert ("__init__", None) not in low and ("__repr__", None) not in low
    assert ("__init__", "Svc") in low and ("__repr__", "Svc") in low
    assert ("Migration", None) not in low and ("forward", "Migration") not in low
    assert ("forward", None) in low
    # nested class gets its own tagged method; Inner itself is untagged
    assert ("deep", "Inner") in low and ("Inner", None) in low
    run_t, run_u = low[("run", "Svc")], low[("run", None)]
    assert run_t.overrides_method is True and run_u.overrides_method is False
    assert run_t.code.startswith("def run(self):\n    return") and run_u.code.startswith("def run(self):\n        return")
    assert run_t.imports_used == ["json"] and run_t.calls_functions == ["js.dumps", "super", "super().run"]
    assert run_t.class_docstring == "Service." and low[("Svc", None)].is_abstract is True
    assert low[("Svc", None)].methods == ["__init__", "run", "__repr__"]
    assert run_t.seq < low[("Svc", None)].seq + 1000 < run_u.seq


def test_method_slice_class_option(tables):
    ch = rows(CH.chunk_table(tables, method_slice="class"))
    # class on line 1: class text and file lines coincide
    assert ch[("pkg/top.py", "a", "First")].code == "def a(self):\n    return 1"
    # lower class: file line numbers index the class text -> shifted or empty slices
    low = {k[1:]: v for k, v in ch.items() if k[0] == "pkg/low.py"}
    # Svc starts on line 4; run (lines 8-9) reads class-text lines 8-9
    svc_lines = MOD_LOW.split("\n")[3:15]
    expect = "\n".join(svc_lines[7:9])
    import textwrap
    assert low[("run", "Svc")].code == textwrap.dedent(expect).strip()
    assert ("forward", "Migration") not in low


def test_keep_first_prefers_tagged(tables):
    e = keep_first(prepare_entries(CH.chunk_table(tables), with_vectors=False))
    by_id = {r.chunk_id: r for r in e.collect()}
    assert by_id["pkg/low.py:8:run"].class_name == "Svc"
    assert by_id["pkg/low.py:8:run"].document.startswith("# Class docstring: Service.\n# Class: Svc\n")


def test_chunk_ids_at_limit(spark):
    from pyspark.sql import functions as F
    from srcindex.operators.prepare import chunk_id
    import hashlib
    p100 = "p" * (100 - len(":1:n"))
    p101 = p100 + "q"
    df = spark.createDataFrame([(p100, 1, "n"), (p101, 1, "n"), (None, None, "é𝄞")],
                               "filepath string, start_line int, name string")
    got = [r.i for r in df.select(chunk_id().alias("i")).collect()]
    assert got[0] == f"{p100}:1:n"
    assert got[1] == "n:" + hashlib.md5(f"{p101}:1:n".encode()).hexdigest()[:8]
    assert got[2] == "None:None:é𝄞"


def test_same_result_alone_or_in_corpus(spark, tables):
    alone = spark.createDataFrame([("pkg/top.py", MOD_TOP)], "filepath string, code string")
    a = {(r.seq, r.code) for r in CH.chunk_table(CH.parse_sources(alone)).collect()}
    b = {(r.seq, r.code) for r in CH.chunk_table(tables).where("filepath = 'pkg/top.py'").collect()}
    assert a == b


def test_imports_used_prefix_rules(spark):
    code = ("import os\nimport os.path as op\nimport json as j\nfrom json import dumps as j\n"
            "def f():\n    osx.run()\n    op.join()\n    j()\n    x.os\n")
    src = spark.createDataFrame([("m.py", code)], "filepath string, code string")
    facts = CH.parse_sources(src)
    imports = {r.alias: r.full_name for r in CH.file_imports(facts).collect()}
    assert imports == {"os": "os", "op": "os.path", "j": "json.dumps"}   # from-import wins for `j`
    (row,) = CH.chunk_table(facts).where("name = 'f'").collect()
    # no word boundary: `osx.run` starts with alias `os`; `x.os` matches nothing
    assert row.imports_used == ["json.dumps", "os", "os.path"]


def test_chunk_table_writes_nothing(spark, tables):
    """The dedented text comes with the parse; the chunk table is a projection."""
    import glob

    from srcindex.session import checkpoint_root, local_dir
    staged = lambda: sorted(glob.glob(local_dir(checkpoint_root(spark)) + "/srcindex/*"))
    before = staged()
    assert CH.chunk_table(tables).count() > CH.chunk_table(tables, method_slice="class").count() > 0
    assert staged() == before and "src_dedented" in tables.columns
