"""Corpus operators for training data: scans, deduplication, mixing, tokenizing, search.

Importing this package registers one query per operator (``QUERIES``) and the
DuckDB SQL of those that SQL can express (``SQL``). Nothing else in the library
imports it.
"""

from srcindex.llm import (  # noqa: F401
    alignment,
    ann,
    bpe,
    exact_dedup,
    exact_topk,
    line_dedup,
    mixing,
    near_dedup,
    phrases,
    pii,
    secrets,
    suffix_dedup,
    toxicity,
)
from srcindex.llm.common import QUERIES, SQL  # noqa: F401
