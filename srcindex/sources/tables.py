"""Readers for the given Parquet tables and the input tables derived from them.

Every derived table is a lazy DataFrame over the given tables, so Catalyst
prunes columns and pushes filters down to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcindex.functions.text import is_blank
from srcindex.session import spread


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_lines(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """``documents`` split into lines: one index entry per non-blank line.

    ``only`` (doc_id, maybe repeated) limits the documents before they are split.

    (entry_id string ``doc_id:line``, doc_id long, line_no int, txt string)
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = spread(docs if only is None else docs.join(only, "doc_id"), "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "txt"))
    return (lines.where(~is_blank("txt"))
                 .select(F.concat_ws(":", F.col("doc_id"), F.col("pos") + 1).alias("entry_id"),
                         "doc_id", (F.col("pos") + 1).cast("int").alias("line_no"), "txt"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets to search for: (query_id long, code string)."""
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("code"))


def review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review requests: every text of ``benchmark`` whole, and beside every tenth a blank snippet under a negative id."""
    b = read_table(spark, sf_dir, "benchmark")
    whole = b.select(F.col("item_id").alias("request_id"), F.col("text").alias("code"))
    blank = b.where(F.col("item_id") % 10 == 0).select((-F.col("item_id") - 1).alias("request_id"), F.lit("  \n\t ").alias("code"))
    return whole.unionByName(blank)


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id long, embedding array<float>, label int)"""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


#: What becomes of a turn's request: everything answered, no duplication found, an unreadable summary.
CASES = ("", ":alone", ":damaged")


def turn_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns answered by the next (assistant) turn: request and style response.

    (request_id string ``conv_id:turn`` and the case, case, turn, code, answer): every turn
    comes once in each case. The pairing is an equi-join on (conv_id, turn + 1), not a
    window, so one very long conversation does not land in a single task.
    """
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("code"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    t = u.join(a, ["conv_id", "turn"]).withColumn("case", F.explode(F.array(*map(F.lit, CASES))))
    return t.select(F.concat(F.concat_ws(":", "conv_id", "turn"), "case").alias("request_id"), "case", "turn", "code", "answer")


def response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model response bodies (request_id, kind, body) standing in for model calls, derived from the answers.

    Style for every request, duplication unless the case is "alone", summary for whole
    ones; the summary of a damaged one is, by turns, cut JSON, a number or an array for
    the text, text after the object, or an object without the field.
    """
    t = turn_requests(spark, sf_dir)
    body = lambda text: F.to_json(F.struct(text.alias("response")))
    summary = body(F.concat(F.lit("summary: "), "answer"))
    damage = F.array(F.substring(summary, 1, (F.length(summary) / 2).cast("int")), F.lit('{"response":5}'), F.concat(F.lit("["), summary, F.lit("]")),
                     F.concat(summary, F.lit(" x")), F.lit("{}"))
    row = lambda kind, b: F.struct(F.lit(kind).alias("kind"), b.alias("body"))
    rows = F.array(row("style", body(F.col("answer"))),
                   row("duplication", F.when(F.col("case") != ":alone", body(F.concat(F.lit("duplication: "), "answer")))),
                   row("summary", F.when(F.col("case") == "", summary).when(F.col("case") == ":damaged", F.element_at(damage, (F.pmod("turn", F.lit(5)) + 1).cast("int")))))
    return t.select("request_id", F.explode(rows).alias("r")).select("request_id", "r.kind", "r.body").where("body IS NOT NULL")


def long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, filepath, start_line, name): paths long enough to need the hashed id."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", F.repeat(F.col("url"), 2).alias("filepath"),
                    F.col("page_id").cast("int").alias("start_line"), F.lit("page").alias("name"))
