"""Streaming insert equals the batch insert, for several file splits and replays."""

import uuid

import pytest
from pyspark.sql import functions as F

from srcindex.operators import chunks as CH
from srcindex.operators.prepare import prepare_entries
from srcindex.sources.index_store import IndexStore
from srcindex.streaming.index_stream import stream_insert

MODS = [(f"m{i}.py", f"class C{i}:\n    def f(self):\n        return {i}\n\ndef g{i}():\n    pass\n") for i in range(10)]


@pytest.fixture(scope="module")
def chunks(spark):
    src = spark.createDataFrame(MODS, "filepath string, code string")
    return CH.chunk_table(CH.parse_sources(src)).cache()


@pytest.mark.parametrize("n_files", [1, 2, 5])
def test_stream_equals_batch(spark, chunks, tmp_path, n_files):
    base = str(tmp_path / uuid.uuid4().hex[:6])
    k = F.regexp_extract("filepath", r"m(\d+)", 1).cast("int")
    for i in range(n_files):
        chunks.where(F.pmod(k, F.lit(n_files)) == i).repartition(1, "filepath").write.parquet(f"{base}/drop/g={i}")
    store = IndexStore(spark, f"{base}/idx")
    stream_insert(spark, f"{base}/drop", chunks.schema, store, f"{base}/ckpt", max_files=1).awaitTermination()
    batch = IndexStore(spark, f"{base}/batch")
    batch.insert(prepare_entries(chunks))
    got = sorted((r.chunk_id, r.document) for r in store.read().collect())
    assert got == sorted((r.chunk_id, r.document) for r in batch.read().collect())
    # running again from the same checkpoint processes nothing new
    stream_insert(spark, f"{base}/drop", chunks.schema, store, f"{base}/ckpt", max_files=1).awaitTermination()
    assert sorted((r.chunk_id, r.document) for r in store.read().collect()) == got


def test_stream_upsert_later_batches_win(spark, chunks, tmp_path):
    from srcindex.streaming.index_stream import stream_upsert
    base = str(tmp_path / "ups")
    store = IndexStore(spark, f"{base}/idx")
    store.insert(prepare_entries(chunks))
    changed = spark.createDataFrame([(p, c.replace("pass", "return 0")) for p, c in MODS[:3]],
                                    "filepath string, code string")
    upd = CH.chunk_table(CH.parse_sources(changed))
    upd.repartition(1, "filepath").write.parquet(f"{base}/drop/g=0")
    stream_upsert(spark, f"{base}/drop", upd.schema, store, f"{base}/ckpt", max_files=1).awaitTermination()
    docs = {r.chunk_id: r.document for r in store.read().collect()}
    assert docs["m0.py:5:g0"] == "def g0():\n    return 0"
    assert docs["m5.py:5:g5"] == "def g5():\n    pass"
    assert len(docs) == store.count()


def test_stream_upsert_query_starts_from_the_whole_index():
    """Neither the SQL nor the job leaves modules out of the index that the changes meet."""
    from srcindex.plans.oracle import SQL
    assert "% 7 <> 0)" not in SQL["stream_index_upsert"] and "entries WHERE k % 7" not in SQL["stream_index_upsert"]
    assert "FROM entries_first WHERE chunk_id NOT IN" in SQL["stream_index_upsert"]
