"""Input fixtures derived from the given tables by Spark expressions.

``rendered_modules``: one Python module per ``part`` row (layout in
FIXTURES.md), so chunking results have closed forms in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcindex.session import spread
from srcindex.sources.tables import read_table

IF_BLOCK = "        if by > 1 and self.size:\n            by = root(by)\n"
SUPER_LINE = "        super().scale(by)\n"


def module_text(k, s, p_name, p_type, p_brand):
    m = F.pmod(s, F.lit(4))
    even = F.pmod(s, F.lit(2)) == 0
    cls = F.when(F.pmod(k, F.lit(7)) == 0, F.lit("Migration")).otherwise(F.concat(F.lit("Part"), k.cast("string")))
    bases = F.when(F.pmod(k, F.lit(5)) == 0, F.lit("AbstractBase, pkg.Mixin")).otherwise(
        F.concat(F.lit("Base"), F.pmod(s, F.lit(3)).cast("string")))
    return F.concat(
        F.lit("import os.path as osp\nfrom math import sqrt as root\n\n"),
        F.lit("class "), cls, F.lit("("), bases, F.lit("):\n"),
        F.lit('    """'), p_name, F.lit(' part."""\n'),
        F.lit("    def __init__(self, size="), s.cast("string"), F.lit("):\n"),
        F.lit("        self.size = size\n"),
        F.lit("    @property\n"),
        F.lit("    def label(self) -> str:\n"),
        F.lit('        """Label of '), p_name, F.lit('."""\n'),
        F.lit('        return osp.join("'), p_type, F.lit('", self.size)\n'),
        F.lit('    def scale(self, by: float = 1.5, *rest, **opts) -> "Part":\n'),
        F.repeat(F.lit(IF_BLOCK), m),
        F.when(even, F.lit(SUPER_LINE)).otherwise(F.lit("")),
        F.lit('        raise ValueError("'), p_brand, F.lit('")\n'),
        F.lit("\n"),
        F.lit("async def load_"), k.cast("string"), F.lit("(path, retries: int = 3):\n"),
        F.lit("    return await fetch(path)\n"),
    )


def rendered_modules(spark: SparkSession, sf_dir: str, brand_override: str | None = None) -> DataFrame:
    """(filepath string, code string, p_partkey long) one module per part."""
    p = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"),
               "p_partkey")
    brand = F.lit(brand_override) if brand_override is not None else F.col("p_brand")
    return p.select(
        F.concat(F.lit("corpus/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("filepath"),
        module_text(F.col("p_partkey"), F.col("p_size"), F.col("p_name"), F.col("p_type"), brand).alias("code"),
        "p_partkey")


def rendered_file_layout(k):
    """(relative path, damage) of the on-disk fixture for part key ``k``."""
    rel = F.when(F.pmod(k, F.lit(17)) == 0, F.concat(F.lit("_private/part_"), k.cast("string"), F.lit(".py"))) \
        .when(F.pmod(k, F.lit(19)) == 0, F.concat(F.lit("part_"), k.cast("string"), F.lit("/__init__.py"))) \
        .otherwise(F.concat(F.lit("part_"), k.cast("string"), F.lit(".py")))
    damage = F.when(F.pmod(k, F.lit(11)) == 0, F.lit("encoding")) \
        .when(F.pmod(k, F.lit(13)) == 0, F.lit("syntax"))
    return rel, damage


def write_rendered_files(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Write ``rendered_modules`` as files under the mounted directory ``root``.

    Every 11th module gets a leading 0xFF byte, every 13th a leading
    ``def (``; some live under ``_private/`` or are named ``__init__.py``.
    Each task writes its own rows' files.
    """
    from srcindex.session import ship_package
    ship_package(spark)
    mods = rendered_modules(spark, sf_dir)
    rel, damage = rendered_file_layout(F.col("p_partkey"))
    rows = mods.select(rel.alias("rel"), damage.alias("damage"), "code")

    def write_part(it):
        import os as _os
        for r in it:
            path = _os.path.join(root, r["rel"])
            _os.makedirs(_os.path.dirname(path), exist_ok=True)
            data = r["code"].encode("utf-8")
            if r["damage"] == "encoding":
                data = b"\xff" + data
            elif r["damage"] == "syntax":
                data = b"def (" + data
            with open(path, "wb") as fh:
                fh.write(data)

    rows.foreachPartition(write_part)
