"""End-to-end jobs (2.F): corpus -> index (J-1), snippets -> review prompts (J-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.functions.embed import DEFAULT_DIM, embed
from srcindex.operators import chunks as CH
from srcindex.operators import knn, review
from srcindex.operators.prepare import prepare_entries
from srcindex.session import stage
from srcindex.sources.index_store import IndexStore


class IndexReport(dict):
    """``written`` and ``errors`` (modules that cannot be read); ``rejects`` is their table (filepath, reason)."""

    rejects: DataFrame


def index_corpus(sources: DataFrame, store: IndexStore, method_slice: str = "file",
                 dim: int = DEFAULT_DIM) -> IndexReport:
    """J-1: (filepath, code) -> index entries inserted into ``store``.

    The parse runs once (staged); an empty corpus writes nothing. Modules that cannot
    be read are reported, however many others were written: the report counts them and
    has their table, staged with the parse.
    """
    facts = stage(CH.parse_sources(sources), "facts")
    kinds = {r["kind"]: r["count"] for r in facts.groupBy("kind").count().collect()}  # three kinds
    report = IndexReport(written="def" in kinds, errors=kinds.get("error", 0))
    report.rejects = CH.source_errors(facts)
    if report["written"]:
        store.insert(prepare_entries(CH.chunk_table(facts, method_slice=method_slice), dim=dim))
    return report


def review_prompts(requests: DataFrame, index: DataFrame, documents: DataFrame,
                   k: int = knn.DEFAULT_K, max_distance: float = knn.DEFAULT_MAX_DISTANCE,
                   dim: int = DEFAULT_DIM) -> tuple[DataFrame, DataFrame]:
    """J-2: requests (request_id, code) -> (prompt table, rejects).

    ``index``: embedded entries keyed ``entry_id``; ``documents``: (entry_id,
    document) text joined back after the top-k.
    """
    valid, rejects = review.split_requests(requests)
    q = embed(valid.select(F.col("request_id").alias("query_id"), "code"), "code", dim)
    nb = knn.sparse_knn(q, index, k=k, max_distance=max_distance)
    nb = stage(nb.withColumnRenamed("query_id", "request_id"), "neighbours")
    similar = review.similar_snippets(nb, documents, max_distance)
    return review.prompt_table(valid, similar), rejects
