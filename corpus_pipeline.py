"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokenizing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works
on all that the stage before kept and returns a DataFrame. All but the last return
the columns of ``documents``; between stages the rows are written as Parquet and
read again, so a lost executor costs the running stage's tasks only.

Defined results: rows with null text count as empty texts and go through every
stage; an empty table gives no rows; extra columns of the input pass through, whatever
their names; ids may be repeated or null.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcindex.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from srcindex.llm.common import table, text_of
from srcindex.session import scratch_path, ship_package


#: The columns of ``documents``; others are an input's own.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """An input's own columns carry neutral names inside a stage, so none can clash with a stage's own."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = [c if c in DOCUMENT else f"extra_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*inside), sf_dir)
        return out.toDF(*docs.columns) if out.columns == inside else out
    return run


@apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels that are not held out."""
    ship_package(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns))
    return scored.where("toxicity_score < 0.5").select(*docs.columns)


@apart
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one document stays."""
    return exact_dedup.drop_copies(docs)


@apart
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles one row stays, that of the smallest doc_id."""
    ship_package(spark)
    return near_dedup.drop_near(docs, width=5, similarity=0.8)


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a document comes as often as the mix takes it."""
    keyed = docs.withColumn("text_key", F.xxhash64(text_of()))
    plan = mixing.mix(keyed, F.array("source"), mixing.words_in(text_of()), keep=("doc_id", "text_key"))
    plan = plan.where("copies > 0").groupBy("doc_id", "text_key").agg(F.max("copies").alias("copies"))
    p = plan.withColumnsRenamed({"doc_id": "p_id", "text_key": "p_key"})
    taken = keyed.join(p, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


@apart
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed, 32 bits little-endian), their number, and digests of ids and decoded text."""
    ship_package(spark)
    coded = bpe.bpe(docs, bpe.default_vocabulary(), keep=("doc_id", "source"))
    return coded.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("mixing", mix_sources), ("bpe", encode)]

#: SQL cannot express the learned, the sketched and the tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
