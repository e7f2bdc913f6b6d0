"""Exact deduplication with a heavy-hitter split (DataFrame operations only).

A Misra-Gries style frequent-items sketch over the digests proposes a bounded
number of candidates. Their exact counts and winners are computed with map-side
aggregation, and the winners (at most ``HEAVY`` rows) are broadcast, so copies of
frequent texts are resolved in the scan of the digests and are never shuffled.
All other digests go through an ordinary shuffle; the sketch bounds how large
one of their groups can be.

Defined results: a null text counts as empty; empty texts are equal to each
other and to texts of white space only; of rows that tie in length the smallest
doc_id stays (null last), of fully repeated rows exactly one; other columns
are not read, so clashing names do no harm; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcindex.llm.common import BLANKS, query, table, text_of
from srcindex.session import stage

#: Candidates taken from the sketch, and the counters that it keeps: bounds of the broadcast and of the sketch.
HEAVY, COUNTERS = 1000, 10_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text, SHA-256 of the text without white space, a hash of the text as it is, a row number."""
    bare = F.translate(text_of(), BLANKS, "")
    return docs.select("doc_id", F.char_length(text_of()).alias("n_points"), F.unhex(F.sha2(bare, 256)).alias("digest"),
                       F.xxhash64(text_of()).alias("text_key"), F.monotonically_increasing_id().alias("row_no"))


def _winner():
    """The row that stays: most code points, then smallest doc_id (null last), then row number."""
    return F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"),
                          F.col("doc_id").alias("c"), F.col("row_no").alias("d")))


def frequent_digests(d: DataFrame) -> DataFrame:
    """At most HEAVY digests that the sketch holds for frequent, with exact size and winner."""
    sketch = d.agg(F.expr(f"approx_top_k(hex(digest), {HEAVY}, {COUNTERS})").alias("top"))
    few = sketch.select(F.explode("top").alias("t")).where("t.count > 2").select(F.unhex("t.item").alias("digest"))
    return (d.join(F.broadcast(few), "digest").groupBy("digest")
            .agg(F.count(F.lit(1)).alias("group_size"), _winner().alias("w")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (binary), text_key."""
    d = stage(digests(docs), "digests")
    heavy = stage(frequent_digests(d), "frequent")
    big = (d.join(F.broadcast(heavy), "digest")
           .select("doc_id", F.col("w.c").alias("keep_id"), "group_size",
                   (F.col("row_no") == F.col("w.d")).alias("kept"), "digest", "text_key"))
    group = Window.partitionBy("digest")
    first = group.orderBy(F.col("n_points").desc(), F.col("doc_id").asc_nulls_last(), "row_no")
    rest = (d.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
            .select("doc_id", F.first("doc_id").over(first).alias("keep_id"),
                    F.count(F.lit(1)).over(group).alias("group_size"),
                    (F.row_number().over(first) == 1).alias("kept"), "digest", "text_key"))
    return big.unionByName(rest)


def keep_rows(docs: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (nulls equal) are in ``kept``; the text goes through one shuffle."""
    k = kept.select(*(F.col(c).alias(f"k_{c}") for c in keys)).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in keys]
    return docs.join(k, on, "left_semi")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact deduplication drops; all columns stay."""
    found = stage(exact_dedup(docs), "exact")
    keyed = docs.withColumn("text_key", F.xxhash64(text_of()))
    left = keep_rows(keyed, found.where("kept"), "doc_id", "text_key")
    repeated = found.groupBy("doc_id", "text_key").count().where("count > 1")
    if not repeated.isEmpty():  # the same doc_id and text twice: the pair can't tell the rows apart
        left = left.dropDuplicates(["doc_id", "text_key"])
    return left.select(*docs.columns)


@query("op10_exact_dedup", sql=r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS h FROM documents),
r AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r""")
def op10_exact_dedup(spark, sf_dir):
    return (exact_dedup(table(spark, sf_dir, "documents"))
            .select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
                    F.lower(F.hex("digest")).alias("text_sha256")))
