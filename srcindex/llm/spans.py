"""Span lists in their written form: ``kind:start:end`` joined by commas (DataFrame helpers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How scanners return spans: code points, end exclusive; ``place`` is the kind's place in its list, ``base`` marks rule matches.
SPAN = "array<struct<start: int, stop: int, place: int, kind: string, base: boolean>>"


def written(spans: Column, by: tuple[str, ...]) -> Column:
    """``kind:start:end`` of every span, ordered by the named fields, joined by commas."""
    rest = tuple(f for f in ("start", "place", "stop", "kind") if f not in by)
    keyed = F.transform(spans, lambda s: F.struct(*(s[f].alias(f) for f in (*by, *rest))))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def rule_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_kind(spans: Column, kind: str) -> Column:
    """Rule matches of one kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
