"""What the corpus operators share: the query registry, table access and Arrow text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcindex.session import ship_package

#: ASCII white space as the contracts name it: space, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as a query, with its DuckDB SQL where there is one."""
    def deco(fn):
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__ = run.__qualname__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text"):
    """The text with null counted as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20,
                max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``max_bytes`` of ``column``.

    A single longer text stays whole in a slice of its own, so a task's memory
    is bounded by the longest text and not by Spark's rows per batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
