"""pysource scan and decoding rules."""

import os

from srcindex.operators import chunks as CH
from srcindex.sources.pysource import decode_sources, read_sources


def write(root, rel, data: bytes):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(data)


def test_scan_includes_hidden_and_underscore(spark, tmp_path):
    root = str(tmp_path)
    write(root, "a.py", b"x = 1\n")
    write(root, "__init__.py", b"")
    write(root, "_p/x.py", b"def f(): pass\n")
    write(root, ".hid/y.py", b"def g(): pass\n")
    write(root, ".dot.py", b"z = 2\n")
    write(root, "notes.PY", b"no")
    write(root, "data.txt", b"no")
    got = sorted(r.relpath for r in read_sources(spark, root, partitionBytes=8).collect())
    assert got == [".dot.py", ".hid/y.py", "__init__.py", "_p/x.py", "a.py"]


def test_decode_and_rejects(spark, tmp_path):
    root = str(tmp_path)
    write(root, "crlf.py", b"def f():\r\n    return 1\r\n")
    write(root, "bad.py", b"\xffdef f(): pass\n")
    write(root, "bom.py", "﻿def f(): pass\n".encode())
    write(root, "nul.py", b"def f(): pass\x00\n")
    good, bad = decode_sources(read_sources(spark, root))
    assert [(r.relpath, r.reason) for r in bad.collect()] == [("bad.py", "encoding")]
    codes = {r.relpath: r.code for r in good.collect()}
    assert codes["crlf.py"] == "def f():\n    return 1\n"
    errs = {r.filepath.rsplit("/", 1)[-1]: r.reason
            for r in CH.source_errors(CH.parse_sources(good.select("filepath", "code"))).collect()}
    assert errs == {"bom.py": "syntax", "nul.py": "syntax"}


def test_ids_of_any_size(spark, tmp_path):
    """Hashed ids beyond 32 bits, at the end of 64, and below zero."""
    from srcindex.sources import tables as T
    big = [(1 << 40) + 1, (1 << 63) - 1, -(1 << 63), 7]
    spark.createDataFrame([(i, "one\n\ntwo") for i in big], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = T.corpus_lines(spark, str(tmp_path)).collect()
    assert {(r.entry_id, r.txt) for r in rows} == {(f"{i}:{n}", t) for i in big for n, t in ((1, "one"), (3, "two"))}
    spark.createDataFrame([(i, t, r, "x") for i in big for t, r in ((0, "user"), (1, "assistant"))], "conv_id long, turn int, role string, text string") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.request_id for r in T.turn_requests(spark, str(tmp_path)).collect()} == {f"{i}:0{c}" for i in big for c in T.CASES}


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace as Some

    import pytest

    from srcindex.session import checkpoint_root

    def on(master):
        return Some(conf=Some(get=lambda *_: None, set=lambda *_: None),
                    sparkContext=Some(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))

    assert checkpoint_root(on("local[2]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoint_root(on(master))
