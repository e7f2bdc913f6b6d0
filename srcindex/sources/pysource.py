"""``pysource``: a Python Data Source scanning a directory tree for ``.py`` files.

Spark's file index skips names starting with ``_`` or ``.`` (``__init__.py``,
``_private/``), which a source corpus needs, so the listing is done here:
the driver walks the tree (names and sizes only, no symlinked directories,
case-sensitive ``.py`` suffix), sorts it, and packs files into partitions of
about ``partitionBytes``; executors read the bytes. Decoding happens in Spark
(:func:`decode_sources`), so invalid files become reject rows, not failures.

Options: ``path`` (required, a mounted directory), ``partitionBytes``
(default 64 MiB), ``suffix`` (default ``.py``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "filepath string, relpath string, size long, content binary"


class _Files(InputPartition):
    def __init__(self, files):
        self.files = files


class PySourceReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.target = int(options.get("partitionBytes", 64 << 20))
        self.suffix = options.get("suffix", ".py")

    def _listing(self):
        out = []
        for root, _dirs, files in os.walk(self.root):
            for name in files:
                if name.endswith(self.suffix):
                    full = os.path.join(root, name)
                    try:
                        size = os.path.getsize(full)
                    except OSError:
                        size = 0
                    out.append((full, size))
        out.sort()
        return out

    def partitions(self):
        parts, cur, cur_bytes = [], [], 0
        for full, size in self._listing():
            if cur and cur_bytes + size > self.target:
                parts.append(_Files(cur))
                cur, cur_bytes = [], 0
            cur.append(full)
            cur_bytes += size
        if cur:
            parts.append(_Files(cur))
        return parts or [_Files([])]

    def read(self, partition):
        for full in partition.files:
            with open(full, "rb") as fh:
                data = fh.read()
            yield (full, os.path.relpath(full, self.root), len(data), data)


class PySource(DataSource):
    @classmethod
    def name(cls):
        return "pysource"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PySourceReader(self.options)


def read_sources(spark: SparkSession, path: str, **options) -> DataFrame:
    """(filepath, relpath, size, content) for every ``.py`` file under ``path``."""
    from srcindex.session import ship_package
    ship_package(spark)
    spark.dataSource.register(PySource)
    reader = spark.read.format("pysource").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def decode_sources(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strict UTF-8 text with ``\\r\\n`` / ``\\r`` folded to ``\\n``, and rejects.

    Returns (sources(filepath, relpath, code), rejects(filepath, relpath, reason)).
    """
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    good = raw.where(valid).select("filepath", "relpath", F.regexp_replace(text, "\r\n?", "\n").alias("code"))
    bad = raw.where(~valid).select("filepath", "relpath", F.lit("encoding").alias("reason"))
    return good, bad
