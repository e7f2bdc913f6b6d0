"""The entry lists the library's queries whatever happens to the corpus operators."""

import importlib.util
import subprocess
import sys

import pytest

from tests.conftest import ROOT

BLOCKED = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None
import __spark_entry__ as E
print(len(E.queries()), len(E.oracle_sql()), any(q.startswith("op") for q in E.queries()))
"""


@pytest.mark.parametrize("blocked", [["srcindex.llm"], ["ahocorasick"], ["corpus_pipeline"], []])
def test_missing_modules_take_only_their_own_queries(blocked):
    there = importlib.util.find_spec("srcindex.llm") is not None and importlib.util.find_spec("srcindex.llm").origin is not None
    from srcindex.plans.catalog import QUERIES
    from srcindex.plans.oracle import SQL
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    n, sql, has_ops = out.split()
    assert int(n) >= len(QUERIES) and int(sql) >= len(set(SQL) & set(QUERIES))
    assert (has_ops == "True") == (there and not {"srcindex.llm", "ahocorasick"} & set(blocked))
