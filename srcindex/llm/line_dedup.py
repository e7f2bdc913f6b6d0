r"""Line deduplication (DataFrame operations only).

Line keys are hashed; the hashes are range-partitioned together with the
document, so a very common line spans as many partitions as it needs, and sorted
by document and position. Each partition streams its occurrences into one row
per (hash, document) and one count per hash; only those counts and the winners
meet in a second, small shuffle. The answer per document is a keep bitmap in
64-bit words that leaves out words with nothing dropped; the text itself never
travels with the lines.

Defined results: a null or empty text is one empty line; keys shorter than
``min_points`` are never dropped; a document is identified by doc_id and text,
so repeated rows count as one document and get the same bitmap; null doc_ids are
documents like others; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.llm.common import BLANKS, query, table, text_of
from srcindex.session import stage


def _identity():
    return [F.col("doc_id"), F.xxhash64(text_of()).alias("text_key")]


def line_keys(docs: DataFrame, min_points: int = 1) -> DataFrame:
    """One row per line whose key is long enough: doc_id, text_key, pos, h (16 bytes)."""
    lines = docs.select(*_identity(), F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)
    return (lines.select("doc_id", "text_key", "pos", key.alias("key"))
            .where(F.char_length("key") >= min_points)
            .select("doc_id", "text_key", "pos", F.unhex(F.md5("key")).alias("h")))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_points: int = 1, keep_first: bool = False) -> DataFrame:
    """Per document that loses a line: doc_id, text_key, words (array of (word, keep bits)), n_dropped.

    A key found in at least ``min_docs`` documents loses all its lines; with
    ``keep_first`` its first line, by doc_id and position, stays.
    """
    rows = stage(line_keys(docs, min_points), "line-keys")  # hashes and places only; read by the range sampling and twice more
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (rows.repartitionByRange(parts, "h", "doc_id", "text_key")
              .sortWithinPartitions("h", "doc_id", "text_key", "pos"))
    found = (ranged.groupBy("h", "doc_id", "text_key")
             .agg(F.collect_set("pos").alias("places"), F.min("pos").alias("first_pos")))
    common = stage(found.groupBy("h")  # as a table of its own the join below can split a hot hash
                   .agg(F.count(F.lit(1)).alias("n_docs"),
                        F.min(F.struct("doc_id", "text_key", "first_pos")).alias("first"))
                   .where(F.col("n_docs") >= min_docs), "line-common")
    lost = found.join(common, "h").select("doc_id", "text_key", "places", "first")
    places = F.col("places")
    if keep_first:
        here = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))
        places = F.when(here, F.filter("places", lambda p: p != F.col("first.first_pos"))).otherwise(places)
    bits = (lost.repartition("doc_id", "text_key").select("doc_id", "text_key", F.explode(places).alias("pos"))
            .groupBy("doc_id", "text_key", F.expr("pos div 64").alias("word"))
            .agg(F.expr("~bit_or(shiftleft(1L, cast(pos % 64 AS int)))").alias("bits"), F.count(F.lit(1)).alias("n")))
    return (bits.groupBy("doc_id", "text_key")
            .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
                 F.sum("n").alias("n_dropped"), F.max("word").alias("last_word")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row of ``docs``."""
    d = docs.select(*_identity(), text_of().alias("text"))
    b = bitmaps.withColumnRenamed("doc_id", "b_id").withColumnRenamed("text_key", "b_key")
    joined = d.join(b, d.doc_id.eqNullSafe(b.b_id) & (d.text_key == b.b_key), "left")
    kept = F.expr("""
        concat_ws('\n', filter(split(text, '\n', -1),
            (x, i) -> i div 64 > last_word
                   OR (shiftright(dense[cast(i div 64 AS int)], cast(i % 64 AS int)) & 1L) = 1L))""")
    dense = F.expr("transform(sequence(0L, last_word), w -> coalesce(words[w], -1L))")
    return (joined.withColumn("dense", F.when(F.col("last_word").isNotNull(), dense))
            .select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
                    F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("last_word").isNull(), F.col("text")).otherwise(kept).alias("kept_text")))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_points: int = 1, keep_first: bool = False) -> DataFrame:
    """Drop common lines: doc_id, n_lines, n_dropped, kept_text."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_points, keep_first))


@query("op9_line_dedup", sql=r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op9_line_dedup(spark, sf_dir):
    return (line_dedup(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")))
