"""The pipeline's stages on a small corpus, each against what it promises."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from srcindex.llm import mixing, toxicity
from srcindex.llm.common import table, text_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_order_and_columns(stages, spark):
    assert [s[0] for s in stages] == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == table(spark, SF, "documents").columns


def test_rows_of_every_stage(stages, spark):
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    (_, docs, clean), (_, _, single), (_, _, apart), (_, _, mixed), (_, _, coded) = stages
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, SF, "labels"))).collect()
    assert ids(clean) == {r.doc_id for r in scores if r.toxicity_score < 0.5}
    bare = clean.select("doc_id", F.translate(text_of(), " \t\n\x0b\x0c\r", "").alias("b"))
    assert single.count() == bare.select("b").distinct().count()
    assert ids(apart) <= ids(single) and 0 < apart.count() <= single.count()
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    plan = mixing.mix(apart, F.array("source"), mixing.words_in(text_of())).collect()
    assert counts == {r.doc_id: r.copies for r in plan if r.copies}
    assert coded.count() == mixed.count() and coded.where("n_tokens * 4 <> length(ids)").count() == 0


def test_odd_rows_go_through(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "some clean words here", "en", "a", 21), (3, "some clean words here", "en", "a", 21), (None, "others", None, "b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert {r.doc_id for r in docs.collect()} >= {3, None}


def test_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, f in corpus_pipeline.STAGES[:4]:
        assert f(spark, docs, SF).count() == 0


LONG = "one quiet line of plain words about rivers and hills and the slow boats that go down to the sea every day of the long summer "


def test_near_copies_go_with_repeated_and_null_ids(spark):
    """Three texts of one component under one id and under none, another text under the same id, two without shingles."""
    rows = [(7, LONG * 3 + "first"), (7, LONG * 3 + "second"), (None, LONG * 3 + "third"), (7, "quite another text of several words here"), (None, "so is this one with its several words"),
            (8, ""), (8, None), (5, LONG * 3 + "fourth"), (5, LONG * 3 + "fourth")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == sorted((str(i), t or "") for i, t in [
        (5, LONG * 3 + "fourth"), (7, "quite another text of several words here"), (None, "so is this one with its several words"), (8, ""), (8, None)])


def test_clashing_columns_pass_through_every_stage(spark):
    """Names that operators use inside, and every row keeps its own values."""
    extra = ["text_key", "copies", "toxicity_score", "copy", "kept", "digest", "near_key", "k_doc_id", "p_id", "extra_0", "row_no", "comp"]
    docs = table(spark, SF, "documents").limit(60)
    for i, c in enumerate(extra):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    for _, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{i}-{r.doc_id}" for r in rows for i, c in enumerate(extra))
    assert corpus_pipeline.encode(spark, docs, SF).count() == 60


def test_batches_for_workers_are_bounded(spark):
    """40 texts of 500 KB, far fewer than a batch's 10,000 rows, come in several batches; a session's own bound stays."""
    import pyarrow as pa

    from srcindex.session import ARROW_BYTES, ship_package
    ship_package(spark)
    docs = spark.range(40, numPartitions=1).select(F.repeat(F.lit("word "), 100_000).alias("text"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    sizes = [r.n for r in docs.mapInArrow(size, "n long").collect()]
    assert len(sizes) > 3 and max(sizes) < 8_000_000 and sum(sizes) > 20_000_000 - 1
    spark.conf.set(ARROW_BYTES[0], "1m")
    try:
        ship_package(spark)
        assert spark.conf.get(ARROW_BYTES[0]) == "1m"
    finally:
        spark.conf.set(*ARROW_BYTES)
