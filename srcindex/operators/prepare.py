"""Index preparation (2.C): document text, flat metadata, ids, keep-first.

All of it is per-row projection except ``keep_first``, which ranks the
chunks of one id (a shuffle by ``chunk_id``; ids are unique up to the
method/function duplicate pairs, so no key can be hot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcindex.functions.embed import DEFAULT_DIM, embed
from srcindex.functions.text import is_blank

# Fixed values of the id scheme.
ID_MAX_CHARS = 100
ID_HASH_HEX = 8

# Metadata keys that hold lists.
LIST_FIELDS = ("decorators", "calls_functions", "accesses_attributes", "imports_used",
               "raises_exceptions", "base_classes", "methods")

# Metadata keys in the order the reference's dict holds them (code,
# docstring and class_docstring removed).
METADATA_KEYS = (
    "type", "name", "start_line", "end_line", "class_name", "method_name", "is_async", "is_function",
    "is_static", "is_classmethod", "is_property", "filepath", "filename",
    "decorators", "parameters", "return_annotation", "calls_functions", "accesses_attributes",
    "imports_used", "raises_exceptions", "overrides_method", "complexity_score",
    "base_classes", "methods", "is_abstract",
)

# Every metadata key is a typed top-level column of the index too, so a filter on any
# of them is pushed to Parquet: lists and parameters as the comma-joined text they
# have in the metadata, the others as they are.
FILTER_COLUMNS = METADATA_KEYS


def _present(c: Column) -> Column:
    """Python truthiness of an optional string: null and '' are absent."""
    return c.isNotNull() & (c != "")


def document_text(c=F.col) -> Column:
    """Class docstring line, class line, quoted docstring, code; absent parts left out."""
    cd, cn, doc, code = c("class_docstring"), c("class_name"), c("docstring"), c("code")
    return F.concat_ws(
        "\n",
        F.when(_present(cd), F.concat(F.lit("# Class docstring: "), cd)),
        F.when(_present(cn), F.concat(F.lit("# Class: "), cn)),
        F.when(_present(doc), F.concat(F.lit("'''"), doc, F.lit("'''"))),
        code,
    )


def metadata_value(k: str) -> Column:
    """A metadata key's flat value under its name: lists joined by commas, '' as null."""
    c = F.col(k)
    if k in LIST_FIELDS:
        return F.nullif(F.array_join(c, ","), F.lit("")).alias(k)
    if k == "parameters":
        return F.nullif(F.array_join(F.transform(c, lambda p: F.concat(
            F.coalesce(p["name"], F.lit("None")), F.lit(":"), F.coalesce(p["type"], F.lit("None")))), ","), F.lit("")).alias(k)
    if k in ("type", "name", "class_name", "method_name", "filepath", "filename", "return_annotation"):
        return F.nullif(c, F.lit("")).alias(k)
    return c


def metadata_json() -> Column:
    """Metadata of the flat columns as JSON; nulls left out."""
    return F.to_json(F.struct(*METADATA_KEYS))


def chunk_id() -> Column:
    """``path:line:name``; above 100 characters ``name:`` + 8 hex digits of its MD5."""
    name = F.coalesce(F.col("name"), F.lit("None"))
    base = F.concat(F.coalesce(F.col("filepath"), F.lit("None")), F.lit(":"),
                    F.coalesce(F.col("start_line").cast("string"), F.lit("None")), F.lit(":"), name)
    return F.when(F.length(base) > ID_MAX_CHARS,
                  F.concat(name, F.lit(":"), F.substring(F.md5(base), 1, ID_HASH_HEX))).otherwise(base)


def prepare_entries(chunks: DataFrame, dim: int = DEFAULT_DIM, with_vectors: bool = True) -> DataFrame:
    """Chunk rows -> index entries (chunk_id, document, metadata, filter columns, seq, vector)."""
    kept = chunks.where(~is_blank("code"))
    flat = kept.select(chunk_id().alias("chunk_id"), document_text().alias("document"), *map(metadata_value, FILTER_COLUMNS), "seq")
    # a second projection: were the JSON built from the same expressions in the first, the
    # optimizer's constraints would hold it once for every subset of the columns
    out = flat.select("chunk_id", "document", metadata_json().alias("metadata"), *FILTER_COLUMNS, "seq")
    return embed(out, "document", dim) if with_vectors else out


def keep_first(entries: DataFrame, *within: str) -> DataFrame:
    """First occurrence per ``chunk_id`` by (filepath, seq); ``within``: columns that follow from the id and deal the rows already."""
    w = Window.partitionBy(*within, "chunk_id").orderBy(F.col("filepath").asc_nulls_first(), F.col("seq").asc())
    return entries.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
