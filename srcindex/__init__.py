"""srcindex: a Spark-native engine for source-code corpora.

Python sources are broken into definition chunks with relational metadata,
turned into an embedding index kept as Parquet, and queried with a
distributed nearest-neighbour join that feeds review-prompt tables.
"""

__version__ = "0.1.0"


def register(spark) -> None:
    """Make the engine's Python pieces callable from SQL.

    ``SELECT s.filepath, f.* FROM sources s, LATERAL py_facts(s.code) f`` and
    ``spark.read.format("pysource").load(path)``.
    """
    from srcindex.operators.pyfacts import PyFacts
    from srcindex.sources.pysource import PySource
    spark.udtf.register("py_facts", PyFacts)
    spark.dataSource.register(PySource)
