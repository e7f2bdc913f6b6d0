"""Definition chunking and analysis (2.B).

``parse_sources`` reads each module once, in Arrow batches, and emits one row per
definition with nested arrays, its class context and the imports it uses; nothing
has to be regrouped or joined afterwards. ``definitions`` and ``chunk_table`` are
projections over those rows: the untagged chunks and the class-tagged method
chunks are unioned into one chunk table.
"""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcindex.functions.text import pystrip, with_dedent
from srcindex.operators.pyfacts import ROW_SCHEMA, arrow_schema, parsed_rows
from srcindex.session import ship_package

# Definitions the reference leaves out of the untagged walk.
SKIPPED_CLASS = "Migration"
SKIPPED_NAMES = ("__init__", "__str__", "__repr__", "__call__")

FUNCTION_TYPES = ("FunctionDef", "AsyncFunctionDef")
SEQ_SHIFT = 32  # seq = emitting definition << 32 | position after it

CHUNK_COLUMNS = [
    "filepath", "filename", "seq", "type", "name", "code", "start_line", "end_line", "docstring",
    "class_name", "class_docstring", "method_name", "is_async", "is_function", "is_static",
    "is_classmethod", "is_property", "decorators", "parameters", "return_annotation",
    "calls_functions", "accesses_attributes", "imports_used", "raises_exceptions",
    "overrides_method", "complexity_score", "base_classes", "methods", "is_abstract",
]


def parse_sources(sources: DataFrame) -> DataFrame:
    """(code, other columns) -> one row per definition, import name or unreadable module.

    Every module is read on its own, so modules need no key: paths may be null or
    occur more than once. The other columns come with every row; a null text has none.
    ``src_dedented`` is the dedented text of a method of a class.
    """
    ship_package(sources.sparkSession)
    kept = [c for c in sources.columns if c != "code"]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in sources.dtypes if c != "code"), ROW_SCHEMA])

    def run(batches):
        shape = arrow_schema()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, source = [], []
                gc.disable()  # trees have no cycles; looking for some takes a third of the time
                try:
                    for i, code in enumerate(part.column("code").to_pylist()):
                        found = parsed_rows(code) if code is not None else []
                        rows += found
                        source += [i] * len(found)
                    parsed = [pa.array([r.get(f.name) for r in rows], f.type) for f in shape]
                finally:
                    gc.enable()
                at = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in kept), *parsed], names=[*kept, *shape.names])

    parsed = sources.select(*kept, "code").mapInArrow(run, schema)
    # dedented here, so that it is staged with the parse and filters on ``code`` meet a stored column
    method = parsed.withColumn("_method", F.when(F.col("parent_id").isNotNull(), F.col("src")))
    return with_dedent(method, "_method", "src_dedented").drop("_method")


def source_errors(facts: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (filepath) and reason of the modules that cannot be read."""
    return facts.where(F.col("kind") == "error").select(*(columns or ("filepath",)), F.col("value").alias("reason"))


def file_imports(facts: DataFrame) -> DataFrame:
    """(filepath, alias, full_name): a from-import beats a plain import, then the last one."""
    return facts.where(F.col("kind") == "import").select("filepath", F.col("name").alias("alias"), F.col("value").alias("full_name"))


def definitions(facts: DataFrame) -> DataFrame:
    """Every definition with all analysis columns (before chunk selection); a projection."""
    is_fn = F.col("type").isin(*FUNCTION_TYPES)
    is_cls = F.col("type") == "ClassDef"
    return facts.where(F.col("kind") == "def").select(
        "filepath", "def_id", "parent_id", "type", "name", "start_line", "end_line", "docstring", "src",
        F.when(is_fn, F.col("name")).alias("method_name"),
        (F.col("type") == "AsyncFunctionDef").alias("is_async"),
        is_fn.alias("is_function"),
        "is_static", "is_classmethod", "is_property",
        F.when(is_fn, F.col("decorators")).alias("decorators"),
        "parameters",
        F.col("returns").alias("return_annotation"),
        F.col("calls").alias("calls_functions"),
        F.col("attrs").alias("accesses_attributes"),
        "imports_used",
        F.col("raises").alias("raises_exceptions"),
        (F.lit(1) + F.col("branches")).alias("complexity_score"),
        F.col("bases").alias("base_classes"),
        "methods",
        F.when(is_cls, F.exists("bases", lambda b: F.contains(b, F.lit("ABC"))
                                | F.contains(F.lower(b), F.lit("abstract")))).alias("is_abstract"),
        "class_name", "class_docstring", "class_has_bases", "src_in_class", "src_dedented",
    )


def _skipped() -> Column:
    return (((F.col("type") == "ClassDef") & (F.col("name") == SKIPPED_CLASS))
            | F.col("name").isin(*SKIPPED_NAMES))


def chunk_table(facts: DataFrame, method_slice: str = "file") -> DataFrame:
    """The chunk rows of the reference's walk, in the fixed chunk schema.

    ``method_slice="file"`` cuts class-tagged methods from the file text;
    ``"class"`` reproduces slicing the class text with file line numbers.
    """
    if method_slice not in ("file", "class"):
        raise ValueError(f"method_slice must be 'file' or 'class', not {method_slice!r}")
    full = definitions(facts)
    fp = F.when(F.col("filepath") != "", F.col("filepath"))
    filename = F.when(fp.isNotNull(), F.element_at(F.split(fp, "/"), -1))
    filename = F.when(filename != "", filename)

    untagged = (full.where(~_skipped())
                .withColumn("code", pystrip("src"))
                .withColumn("seq", F.shiftleft(F.col("def_id").cast("long"), SEQ_SHIFT))
                .withColumn("class_name", F.lit(None).cast("string"))
                .withColumn("class_docstring", F.lit(None).cast("string"))
                .withColumn("overrides_method", F.when(F.col("is_function"), F.lit(False))))

    # a method stands in its class unless the walk leaves the class out
    tagged = full.where(F.col("parent_id").isNotNull() & ~F.col("class_name").isin(SKIPPED_CLASS, *SKIPPED_NAMES))
    if method_slice == "file":
        tagged = tagged.withColumn("code", pystrip("src_dedented"))
    else:
        # dedent removes only spaces and tabs: a slice is blank iff its dedented form is
        tagged = tagged.where(F.length(pystrip("src_in_class")) > 0)
        tagged = with_dedent(tagged, "src_in_class", "_dedented")
        tagged = tagged.withColumn("code", pystrip("_dedented")).drop("_dedented")
    tagged = (tagged
              .withColumn("seq", F.shiftleft(F.col("parent_id").cast("long"), SEQ_SHIFT) + F.col("def_id") + 1)
              .withColumn("overrides_method", F.col("class_has_bases") & F.exists(
                  "calls_functions", lambda c: F.contains(c, F.lit("super()")))))

    cols = [c for c in CHUNK_COLUMNS if c not in ("filepath", "filename")]
    return (untagged.select(fp.alias("filepath"), filename.alias("filename"), *cols)
            .unionByName(tagged.select(fp.alias("filepath"), filename.alias("filename"), *cols)))
