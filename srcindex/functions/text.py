"""Python string semantics expressed with Spark built-in functions.

Spark's ``trim`` removes spaces only, while Python's ``str.strip`` removes
every Unicode blank. ``pystrip`` reproduces the latter with one regular
expression whose class lists the characters Python treats as whitespace.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true.
# Written once as a Java/RE2 character class so the DuckDB oracle can use the
# same text.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = rf"^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+$"
# The same 29 characters as a plain set, for the linear-time ``btrim``.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace.

    ``btrim`` over the character set is linear and code-generated; a regular
    expression with a trailing ``\\s+$`` branch backtracks on every inner run
    of indentation.
    """
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def is_blank(c) -> Column:
    """True when a string is null or only whitespace (Python's ``not s.strip()``)."""
    c = _col(c)
    return c.isNull() | (F.length(pystrip(c)) == 0)


def truncate_chars(c, limit: int, suffix: str = "...") -> Column:
    """``s[:limit] + suffix`` when ``len(s) > limit``, else ``s`` (code points)."""
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(suffix))).otherwise(c)


def line_slice(text, start, end) -> Column:
    """``'\\n'.join(text.split('\\n')[start-1:end])`` for 1-based inclusive spans."""
    lines = F.split(_col(text), "\n", -1)
    n = F.size(lines)
    lo = F.greatest(_col(start), F.lit(1))
    hi = F.least(_col(end), n)
    return F.when(hi >= lo, F.array_join(F.slice(lines, lo, hi - lo + 1), "\n")).otherwise(F.lit(""))


def _common_prefix_len(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two short strings."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when(
            (acc == i - 1) & (i <= F.length(a)) & (i <= F.length(b))
            & (F.substring(a, i, 1) == F.substring(b, i, 1)), i
        ).otherwise(acc),
    )


def with_dedent(df, src: str, out: str):
    """Add column ``out`` = ``textwrap.dedent(src)``.

    Blank space/tab-only lines are emptied, then the longest common *exact*
    prefix of the leading spaces and tabs of every line holding another
    character is removed (tabs and spaces differ). Lines end at ``\\n`` only.
    Text and margin are materialised as columns in their own projections, so
    later expressions read them instead of evaluating them again.
    """
    df = df.withColumn("_dd_text", F.regexp_replace(src, r"(?md)^[ \t]+$", ""))
    df = df.withColumn("_dd_ind", F.regexp_extract_all("_dd_text", F.lit(r"(?md)^([ \t]*)[^ \t\n]"), 1))
    # the common prefix of a set of strings is that of its smallest and largest
    df = df.withColumn("_dd_lo", F.array_min("_dd_ind")).withColumn("_dd_hi", F.array_max("_dd_ind"))
    lo, hi = F.col("_dd_lo"), F.col("_dd_hi")
    df = df.withColumn("_dd_margin", F.when(lo.isNull(), F.lit("")).when(F.startswith(hi, lo), lo).otherwise(
        F.substring(lo, 1, _common_prefix_len(lo, hi))))
    margin = F.col("_dd_margin")
    df = df.withColumn(out, F.when(F.length(margin) > 0, F.regexp_replace(
        F.col("_dd_text"), F.concat(F.lit("(?md)^"), margin), F.lit(""))).otherwise(F.col("_dd_text")))
    return df.drop("_dd_text", "_dd_ind", "_dd_lo", "_dd_hi", "_dd_margin")
