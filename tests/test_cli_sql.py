"""The spark-submit entry point and the SQL registration."""

import os

import srcindex
from srcindex.__main__ import main


def test_sql_lateral_udtf_and_datasource(spark, tmp_path):
    srcindex.register(spark)
    spark.createDataFrame([("m.py", "def f():\n    return g(1)\n")], "filepath string, code string") \
        .createOrReplaceTempView("srcs")
    rows = spark.sql("SELECT s.filepath, f.kind, f.name FROM srcs s, LATERAL py_facts(s.code) f "
                     "WHERE f.kind IN ('def', 'call')").collect()
    assert sorted((r.kind, r.name) for r in rows) == [("call", "g"), ("def", "f")]
    os.makedirs(tmp_path / "src")
    (tmp_path / "src" / "_x.py").write_text("x = 1\n")
    assert spark.read.format("pysource").load(str(tmp_path / "src")).count() == 1


def test_cli_index_then_review(spark, tmp_path, capsys):
    src = tmp_path / "repo"
    os.makedirs(src / "pkg")
    (src / "pkg" / "a.py").write_text("def add(a, b):\n    return a + b\n\nclass K:\n    def m(self):\n        return add(1, 2)\n")
    (src / "bad.py").write_bytes(b"\xff\xfe")
    main(["index", str(src), str(tmp_path / "idx")])
    out = capsys.readouterr().out.strip().splitlines()[-1]
    # add, K, and m once (its tagged and untagged chunks share an id)
    assert '"undecodable": 1' in out and '"entries": 3' in out
    spark.createDataFrame([(1, "def add(a, b):\n    return a + b"), (2, "   ")], "request_id long, code string") \
        .write.parquet(str(tmp_path / "req"))
    main(["review", str(tmp_path / "req"), str(tmp_path / "idx"), str(tmp_path / "out")])
    prompts = spark.read.parquet(str(tmp_path / "out" / "prompts")).collect()
    assert sorted((r.request_id, r.kind) for r in prompts) == [(1, "duplication"), (1, "style")]
    dup = [r.prompt for r in prompts if r.kind == "duplication"][0]
    assert "[Code 1]\n```\ndef add(a, b):\n    return a + b\n```" in dup
    assert spark.read.parquet(str(tmp_path / "out" / "rejects")).count() == 1
