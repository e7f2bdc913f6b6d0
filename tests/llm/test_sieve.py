"""The filter before a join."""

from srcindex.llm.sieve import sieve


def test_a_sieve_needs_no_python_worker(spark):
    """Every key passes, null too; of other rows hardly any, and the JVM looks the bits up."""
    keys = spark.createDataFrame([(i,) for i in (*range(0, 4000, 7), None)], "k long")
    rows = spark.createDataFrame([(i, f"t{i}") for i in (*range(4000), None)], "k long, t string")
    out = sieve(rows, keys, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInArrow" not in plan
    kept = [r.k for r in out.collect()]
    assert out.columns == ["k", "t"] and {r.k for r in keys.collect()} <= set(kept) and len(kept) < 1000
    assert sieve(rows, keys.limit(0), "k").count() == 0
