"""Registered queries against their DuckDB oracle at sf0.001 (set SRCINDEX_ORACLE=all for every query)."""

import os

import pytest

from tests.conftest import SF0001

FAST = ["knn_sparse", "knn_threshold", "prompt_style", "review_rejects", "job_review_prompts",
        "model_requests", "review_assemble", "knn_dense", "long_chunk_id", "fn_calls", "file_imports",
        "knn_fill", "knn_tfidf", "chunk_methods_class_slice", "index_stats"]


def _names():
    import __spark_entry__ as E
    sql = E.oracle_sql()
    if os.environ.get("SRCINDEX_ORACLE") == "all":
        return sorted(sql)
    return FAST


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    from tools.check_oracle import compare, duck
    res = compare(spark, duck(SF0001), name, E.queries()[name], E.oracle_sql()[name], SF0001)
    assert res["ok"], res


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["request_id", "kind", "prompt"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
