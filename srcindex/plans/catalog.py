"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcindex.functions import dense as DN
from srcindex.functions.embed import embed, postings
from srcindex.operators import knn, review
from srcindex.session import ship_package, stage
from srcindex.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__ = run.__qualname__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def _line_index(spark, sf_dir):
    return embed(T.corpus_lines(spark, sf_dir), "txt")


def _bench_queries(spark, sf_dir):
    return embed(T.benchmark_queries(spark, sf_dir), "code")


@query("embed_documents")
def embed_documents(spark, sf_dir):
    return postings(_line_index(spark, sf_dir), "entry_id", keep=())


@query("embed_queries")
def embed_queries(spark, sf_dir):
    return postings(_bench_queries(spark, sf_dir), "query_id", keep=())


@query("knn_sparse")
def knn_sparse(spark, sf_dir):
    return knn.sparse_knn(_bench_queries(spark, sf_dir), _line_index(spark, sf_dir), k=knn.DEFAULT_K)


@query("knn_fill")
def knn_fill(spark, sf_dir):
    """Snippets against page URLs, always k rows: entries sharing no token fill in at distance 2."""
    pages = T.read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("entry_id"), "url")
    return knn.sparse_knn(_bench_queries(spark, sf_dir), embed(pages, "url"), k=knn.DEFAULT_K, fill=True)


@query("knn_tfidf")
def knn_tfidf(spark, sf_dir):
    """Top-k with tf-idf weights over the line index; distances rounded to 6 places."""
    r = knn.sparse_knn(_bench_queries(spark, sf_dir), _line_index(spark, sf_dir), k=knn.DEFAULT_K,
                       weighting="tfidf")
    return r.select("query_id", "rank", "entry_id", F.round("distance", 6).alias("distance"))


@query("knn_threshold")
def knn_threshold(spark, sf_dir):
    return knn.sparse_knn(_bench_queries(spark, sf_dir), _line_index(spark, sf_dir), k=knn.DEFAULT_K,
                          max_distance=knn.DEFAULT_MAX_DISTANCE)


# --- review assembly (2.E) -----------------------------------------------------

def _review_stage1(spark, sf_dir):
    """Valid requests, rejects, similar-snippet text for the benchmark requests."""
    valid, rejects = review.split_requests(T.review_requests(spark, sf_dir))
    index = _line_index(spark, sf_dir)
    q = embed(valid.select(F.col("request_id").alias("query_id"), "code"), "code")
    nb = knn.sparse_knn(q, index, k=knn.DEFAULT_K, max_distance=knn.DEFAULT_MAX_DISTANCE)
    nb = stage(nb.withColumnRenamed("query_id", "request_id"), "neighbours")
    docs = T.corpus_lines(spark, sf_dir).select("entry_id", F.col("txt").alias("document"))
    similar = review.similar_snippets(nb, docs, knn.DEFAULT_MAX_DISTANCE)
    return valid, rejects, similar


@query("review_rejects")
def review_rejects(spark, sf_dir):
    return review.split_requests(T.review_requests(spark, sf_dir))[1]


@query("prompt_style")
def prompt_style(spark, sf_dir):
    valid, _ = review.split_requests(T.review_requests(spark, sf_dir))
    return review.style_prompts(valid)


@query("similar_snippets")
def similar_snippets(spark, sf_dir):
    return _review_stage1(spark, sf_dir)[2]


@query("prompt_duplication")
def prompt_duplication(spark, sf_dir):
    valid, _, similar = _review_stage1(spark, sf_dir)
    return review.duplication_prompts(valid, similar)


@query("job_review_prompts")
def job_review_prompts(spark, sf_dir):
    valid, _, similar = _review_stage1(spark, sf_dir)
    return review.prompt_table(valid, similar)


@query("model_requests")
def model_requests(spark, sf_dir):
    return review.model_payloads(job_review_prompts(spark, sf_dir))


def _parsed_responses(spark, sf_dir):
    return review.parse_responses(T.response_bodies(spark, sf_dir))


@query("model_responses")
def model_responses(spark, sf_dir):
    return _parsed_responses(spark, sf_dir)[0]


@query("response_rejects")
def response_rejects(spark, sf_dir):
    return _parsed_responses(spark, sf_dir)[1]


@query("prompt_summary")
def prompt_summary(spark, sf_dir):
    return review.summary_prompts(_parsed_responses(spark, sf_dir)[0])


@query("review_assemble")
def review_assemble(spark, sf_dir):
    good, bad = _parsed_responses(spark, sf_dir)
    requests = T.turn_requests(spark, sf_dir).select("request_id", "code")
    valid, _ = review.split_requests(requests)
    return review.assemble_reviews(valid, good, bad)


# --- chunking and analysis (2.B) --------------------------------------------------

from srcindex.operators import chunks as CH  # noqa: E402
from srcindex.sources.fixtures import rendered_modules  # noqa: E402


def _facts(spark, sf_dir):
    """Fact rows of the rendered corpus, staged once (the Python walk runs once)."""
    return stage(CH.parse_sources(rendered_modules(spark, sf_dir).select("filepath", "code")), "facts")


def _chunks(spark, sf_dir, method_slice="file"):
    return CH.chunk_table(_facts(spark, sf_dir), method_slice=method_slice)


def _txt(c: str):
    return F.array_join(F.col(c), ",").alias(c)


def _params_txt():
    return F.array_join(F.transform("parameters", lambda p: F.concat_ws(
        ":", p["name"], F.coalesce(p["type"], F.lit("")), F.coalesce(p["default"], F.lit("")), p["kind"])),
        ",").alias("parameters")


def _fn_query(name, col):
    def q(spark, sf_dir):
        c = _chunks(spark, sf_dir).where("is_function")
        return c.select("filepath", "seq", col() if callable(col) else _txt(col))
    QUERIES[name] = lambda spark, sf_dir: (ship_package(spark), q(spark, sf_dir))[1]


@query("chunk_definitions")
def chunk_definitions(spark, sf_dir):
    return _chunks(spark, sf_dir).select("filepath", "seq", "type", "name", "start_line", "end_line", "class_name")


@query("chunk_skiplist")
def chunk_skiplist(spark, sf_dir):
    d = CH.definitions(_facts(spark, sf_dir))
    return d.where(CH._skipped()).select("filepath", "type", "name", "start_line")


@query("chunk_code")
def chunk_code(spark, sf_dir):
    return _chunks(spark, sf_dir).where(F.col("class_name").isNull()).select("filepath", "seq", "code")


@query("chunk_dedent")
def chunk_dedent(spark, sf_dir):
    return _chunks(spark, sf_dir).where(F.col("class_name").isNotNull()).select("filepath", "seq", "code")


@query("chunk_methods")
def chunk_methods(spark, sf_dir):
    return (_chunks(spark, sf_dir).where(F.col("class_name").isNotNull())
            .select("filepath", "seq", "name", "class_name", "class_docstring", "start_line", "end_line"))


@query("chunk_metadata")
def chunk_metadata(spark, sf_dir):
    return _chunks(spark, sf_dir).select("filepath", "filename", "seq", "type", "name", "docstring",
                                         "method_name", "is_async", "is_function", "start_line", "end_line")


_fn_query("fn_calls", "calls_functions")
_fn_query("fn_attributes", "accesses_attributes")
_fn_query("fn_raises", "raises_exceptions")
_fn_query("fn_decorators", "decorators")
_fn_query("fn_imports_used", "imports_used")
_fn_query("fn_parameters", _params_txt)
_fn_query("fn_returns", lambda: F.col("return_annotation"))
_fn_query("fn_complexity", lambda: F.col("complexity_score"))
_fn_query("fn_overrides", lambda: F.col("overrides_method"))


@query("fn_flags")
def fn_flags(spark, sf_dir):
    return _chunks(spark, sf_dir).select("filepath", "seq", "is_static", "is_classmethod", "is_property")


@query("file_imports")
def file_imports(spark, sf_dir):
    return CH.file_imports(_facts(spark, sf_dir))


@query("cls_members")
def cls_members(spark, sf_dir):
    return (_chunks(spark, sf_dir).where(F.col("type") == "ClassDef")
            .select("filepath", "seq", _txt("base_classes"), _txt("methods")))


@query("cls_abstract")
def cls_abstract(spark, sf_dir):
    return _chunks(spark, sf_dir).where(F.col("type") == "ClassDef").select("filepath", "seq", "is_abstract")


# --- index preparation, store, stats (2.C, SNK, Q-5..Q-7, J-1) -----------------

from srcindex.operators import prepare as PR  # noqa: E402
from srcindex.session import scratch_path  # noqa: E402
from srcindex.sources.index_store import IndexStore  # noqa: E402


def _entries(spark, sf_dir, vectors=False):
    return PR.prepare_entries(_chunks(spark, sf_dir), with_vectors=vectors)


@query("index_nonblank")
def index_nonblank(spark, sf_dir):
    return _entries(spark, sf_dir).select("filepath", "seq", "chunk_id")


@query("index_document")
def index_document(spark, sf_dir):
    return _entries(spark, sf_dir).select("filepath", "seq", "document")


@query("index_metadata")
def index_metadata(spark, sf_dir):
    return _entries(spark, sf_dir).select("filepath", "seq", "metadata")


@query("index_chunk_id")
def index_chunk_id(spark, sf_dir):
    return _entries(spark, sf_dir).select("filepath", "seq", "chunk_id")


@query("long_chunk_id")
def long_chunk_id(spark, sf_dir):
    ids = T.long_ids(spark, sf_dir)
    return ids.select("page_id", PR.chunk_id().alias("chunk_id"))


@query("index_keep_first")
def index_keep_first(spark, sf_dir):
    return PR.keep_first(_entries(spark, sf_dir)).select("chunk_id", "filepath", "seq")


def _built_store(spark, sf_dir):
    store = IndexStore(spark, scratch_path(spark, "index"))
    store.insert(PR.prepare_entries(_chunks(spark, sf_dir), with_vectors=True))
    return store


def _started_store(spark, sf_dir):
    """A store without every seventh module, so later batches bring new ids beside known ones."""
    store = IndexStore(spark, scratch_path(spark, "index"))
    first = _chunks(spark, sf_dir).where(_part_key() % 7 != 0)
    store.insert(PR.prepare_entries(first, with_vectors=True))
    return store


def _with_blanks(spark, sf_dir):
    """The changed chunks, and each once more with blank code."""
    mods = rendered_modules(spark, sf_dir, brand_override="changed").where(F.col("p_partkey") % 10 == 0)
    ch = CH.chunk_table(stage(CH.parse_sources(mods.select("filepath", "code")), "facts"))
    blank = ch.withColumn("code", F.lit(" \n\t ")).withColumn("seq", F.col("seq") + 1_000_000)
    return PR.prepare_entries(ch.unionByName(blank), with_vectors=True)


@query("index_insert_new")
def index_insert_new(spark, sf_dir):
    """Changed chunks of k % 10 = 0 into a store without k % 7 = 0: known ids stay as stored, new ones come in, blanks do nothing."""
    store = _started_store(spark, sf_dir)
    store.insert(_with_blanks(spark, sf_dir))
    return store.read().select("chunk_id", "document")


@query("index_upsert")
def index_upsert(spark, sf_dir):
    """The same batch as an upsert: known ids are replaced."""
    store = _started_store(spark, sf_dir)
    store.upsert(_with_blanks(spark, sf_dir))
    return store.read().select("chunk_id", "document")


@query("index_reopen")
def index_reopen(spark, sf_dir):
    store = _built_store(spark, sf_dir)
    reopened = IndexStore(spark, store.path.rsplit("/", 1)[0], store.collection)
    return reopened.read().select("chunk_id", "filepath", "start_line", "name")


@query("index_stats")
def index_stats(spark, sf_dir):
    return _built_store(spark, sf_dir).stats()


@query("index_peek")
def index_peek(spark, sf_dir):
    return _built_store(spark, sf_dir).peek(5).select("chunk_id", "metadata")


def _store_requests(spark, sf_dir):
    """Every benchmark text as a search request with a string id."""
    b = T.read_table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("request_id"), F.col("text").alias("code"))


#: Metadata filter of ``store_query_where``: a flag, and two keys that many entries do not have.
STORE_WHERE = {"$and": [{"is_static": False}, {"class_name": {"$ne": "Part2"}}, {"decorators": {"$nin": ["property"]}}]}


@query("store_query")
def store_query(spark, sf_dir):
    """Search over the stored collection: k rows for every request, ties by chunk id."""
    return _built_store(spark, sf_dir).query(_store_requests(spark, sf_dir), k=knn.DEFAULT_K)


@query("store_query_where")
def store_query_where(spark, sf_dir):
    hits = _built_store(spark, sf_dir).query(_store_requests(spark, sf_dir), k=knn.DEFAULT_K, where=STORE_WHERE)
    return hits.select("request_id", "rank", "chunk_id", "distance")


@query("store_query_nested")
def store_query_nested(spark, sf_dir):
    hits = _built_store(spark, sf_dir).query_nested(_store_requests(spark, sf_dir), k=knn.DEFAULT_K)
    return hits.select("request_id", *(F.array_join(c, chr(10)).alias(c) for c in ("ids", "documents", "metadatas")),
                       F.array_join(F.transform("distances", lambda d: F.round(d * 1e6).cast("long").cast("string")), ",").alias("distances_e6"))


@query("job_index_rejects")
def job_index_rejects(spark, sf_dir):
    """J-1 over modules of which every 13th cannot be parsed: the reject rows it reports."""
    from srcindex.plans.jobs import index_corpus
    mods = rendered_modules(spark, sf_dir)
    broken = F.when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("def ("), "code")).otherwise(F.col("code"))
    store = IndexStore(spark, scratch_path(spark, "index"))
    return index_corpus(mods.select("filepath", broken.alias("code")), store).rejects


@query("job_index")
def job_index(spark, sf_dir):
    """J-1: corpus -> chunks -> entries -> insert into a new collection; read back."""
    from srcindex.plans.jobs import index_corpus
    store = IndexStore(spark, scratch_path(spark, "index"))
    index_corpus(rendered_modules(spark, sf_dir).select("filepath", "code"), store)
    return store.read().select("chunk_id", "document", "metadata")


# --- dense / filtered / nested / LSH search (Q-1..Q-4) ------------------------------

from srcindex.functions.where import where_to_column  # noqa: E402


def _dense(spark, sf_dir):
    v = T.dense_vectors(spark, sf_dir)
    return (v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")),
            v.select(F.col("vec_id").alias("entry_id"), "embedding", "label"))


@query("knn_dense")
def knn_dense(spark, sf_dir):
    q, idx = _dense(spark, sf_dir)
    r = knn.dense_knn(q, idx, k=knn.DEFAULT_K)
    return r.select("query_id", "rank", "entry_id", F.round("distance", 6).alias("distance"))


@query("knn_dense_filtered")
def knn_dense_filtered(spark, sf_dir):
    q, idx = _dense(spark, sf_dir)
    idx = idx.where(where_to_column({"label": {"$in": [1, 3, 5]}}))
    r = knn.dense_knn(q, idx, k=knn.DEFAULT_K, max_distance=1.5)
    return r.select("query_id", "rank", "entry_id", F.round("distance", 6).alias("distance"))


@query("knn_filtered")
def knn_filtered(spark, sf_dir):
    good = T.read_table(spark, sf_dir, "labels").where(where_to_column({"quality": 1})).select("doc_id")
    idx = embed(T.corpus_lines(spark, sf_dir, only=good), "txt")
    return knn.sparse_knn(_bench_queries(spark, sf_dir), idx, k=knn.DEFAULT_K)


@query("knn_nested")
def knn_nested(spark, sf_dir):
    nested = knn.nest_results(knn_sparse(spark, sf_dir))
    return nested.select(
        "query_id",
        F.array_join(F.transform("results", lambda r: r["entry_id"].cast("string")), ",").alias("entry_ids"),
        F.array_join(F.transform("results", lambda r: F.round(r["distance"] * 1e6).cast("long").cast("string")),
                     ",").alias("distances_e6"))


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    q, idx = _dense(spark, sf_dir)
    return knn.lsh_knn(q, idx.select("entry_id", "embedding"), k=knn.DEFAULT_K)


def _learned(spark, sf_dir):
    """Count vectors of the corpus lines, staged, and the dense model learned from them."""
    lines = stage(_line_index(spark, sf_dir).select("entry_id", "buckets", "tfs"), "lines")
    return lines, DN.learn(lines)


@query("embed_dense")
def embed_dense(spark, sf_dir):
    """Learned vectors of all corpus lines, to four places."""
    lines, model = _learned(spark, sf_dir)
    return DN.embed_dense(lines, model).select("entry_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query("knn_embedded")
def knn_embedded(spark, sf_dir):
    """The nearest corpus lines of every benchmark text by learned vectors."""
    lines, model = _learned(spark, sf_dir)
    asked = stage(_bench_queries(spark, sf_dir).select("query_id", "buckets", "tfs"), "asked")
    q = DN.embed_dense(asked, model, "qvec").where("qvec IS NOT NULL")
    r = knn.dense_knn(q, stage(DN.embed_dense(lines, model).where("embedding IS NOT NULL"), "line-vectors"), k=knn.DEFAULT_K)
    return r.select("query_id", "rank", "entry_id", F.round("distance", 5).alias("distance"))


# --- file sources (2.A) --------------------------------------------------------

from srcindex.session import local_dir  # noqa: E402
from srcindex.sources import pysource as PS  # noqa: E402
from srcindex.sources.fixtures import write_rendered_files  # noqa: E402


def _files(spark, sf_dir):
    root = local_dir(scratch_path(spark, "files"))
    write_rendered_files(spark, sf_dir, root)
    return PS.read_sources(spark, root, partitionBytes=1 << 20)


@query("scan_sources")
def scan_sources(spark, sf_dir):
    raw = _files(spark, sf_dir)
    return raw.select("relpath", F.col("size").alias("n_bytes"), F.md5("content").alias("content_md5"))


@query("source_rejects")
def source_rejects(spark, sf_dir):
    good, bad = PS.decode_sources(_files(spark, sf_dir))
    errs = CH.source_errors(CH.parse_sources(good.select("relpath", "code")), "relpath")
    return bad.select("relpath", "reason").unionByName(errs)


# --- streaming index maintenance (J-3, J-4) ------------------------------------------

from srcindex.streaming import index_stream as ST  # noqa: E402


def _part_key():
    return F.regexp_extract("filepath", r"part_(\d+)", 1).cast("long")


@query("stream_index_insert")
def stream_index_insert(spark, sf_dir):
    """Chunks arrive in five groups (pmod(k, 5)); the last repeats k % 10 = 0."""
    base = scratch_path(spark, "stream-insert")
    ch = _chunks(spark, sf_dir)
    k = _part_key()
    for i in range(5):
        grp = ch.where(F.pmod(k, F.lit(5)) == i)
        if i == 4:
            grp = grp.unionByName(ch.where(k % 10 == 0))
        # a module's chunks share one file, hence one micro-batch
        grp.repartition("filepath").write.mode("overwrite").parquet(f"{base}/drop/group={i}")
    store = IndexStore(spark, f"{base}/index")
    q = ST.stream_insert(spark, f"{base}/drop", ch.schema, store, f"{base}/checkpoint", max_files=4)
    q.awaitTermination()
    return store.read().select("chunk_id", "document")


@query("stream_index_upsert")
def stream_index_upsert(spark, sf_dir):
    """The whole index, then changed chunks of k % 10 = 0 streamed in two groups."""
    base = scratch_path(spark, "stream-upsert")
    store = _built_store(spark, sf_dir)
    mods = rendered_modules(spark, sf_dir, brand_override="changed").where(F.col("p_partkey") % 10 == 0)
    ch = CH.chunk_table(stage(CH.parse_sources(mods.select("filepath", "code")), "facts"))
    k = _part_key()
    for i in range(2):
        # a module's chunks share one file, hence one micro-batch
        ch.where(F.pmod(k / 10, F.lit(2)) == i).repartition("filepath").write.mode("overwrite").parquet(
            f"{base}/drop/group={i}")
    q = ST.stream_upsert(spark, f"{base}/drop", ch.schema, store, f"{base}/checkpoint", max_files=1)
    q.awaitTermination()
    return store.read().select("chunk_id", "document")


@query("chunk_methods_class_slice")
def chunk_methods_class_slice(spark, sf_dir):
    """Class-tagged methods sliced as the reference does (class text, file line numbers)."""
    c = _chunks(spark, sf_dir, method_slice="class")
    return c.where(F.col("class_name").isNotNull()).select("filepath", "seq", "name", "code")
