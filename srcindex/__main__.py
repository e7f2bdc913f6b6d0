"""spark-submit entry point for the two end-to-end jobs.

  python -m srcindex index  <source_dir> <index_root> [--collection NAME]
  python -m srcindex review <requests.parquet> <index_root> <out_dir> [--collection NAME]

``index`` scans ``.py`` files (pysource), rejects undecodable ones, and inserts
new chunks into the collection. ``review`` embeds a Parquet table of
(request_id, code), searches the collection and writes the stage-1 prompt table
and the rejects as Parquet.
"""

from __future__ import annotations

import argparse
import json


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="srcindex")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("index")
    a.add_argument("source_dir")
    a.add_argument("index_root")
    a.add_argument("--collection", default="code_repository")
    b = sub.add_parser("review")
    b.add_argument("requests")
    b.add_argument("index_root")
    b.add_argument("out_dir")
    b.add_argument("--collection", default="code_repository")
    args = ap.parse_args(argv)

    from pyspark.sql import functions as F

    from srcindex.plans.jobs import index_corpus, review_prompts
    from srcindex.session import get_session, stage
    from srcindex.sources.index_store import IndexStore
    from srcindex.sources.pysource import decode_sources, read_sources

    spark = get_session()
    store = IndexStore(spark, args.index_root, args.collection)
    if args.cmd == "index":
        raw = stage(read_sources(spark, args.source_dir), "sources")  # the tree is read once
        sources, undecodable = decode_sources(raw)
        result = index_corpus(sources.select("filepath", "code"), store)
        rejects = f"{store.path}-rejects"
        (undecodable.select("filepath", "reason").unionByName(result.rejects)
         .write.mode("overwrite").parquet(rejects))
        result["undecodable"] = undecodable.count()
        result["rejects"] = rejects
        result["entries"] = store.count()
        print(json.dumps(result))
        return
    index = store.read()
    if index is None:
        raise SystemExit(f"collection {args.collection!r} under {args.index_root} is empty")
    entries = index.select(F.col("chunk_id").alias("entry_id"), "document", "buckets", "tfs", "norm2")
    prompts, rejects = review_prompts(spark.read.parquet(args.requests).select("request_id", "code"),
                                      entries, entries.select("entry_id", "document"))
    prompts.write.mode("overwrite").parquet(f"{args.out_dir}/prompts")
    rejects.write.mode("overwrite").parquet(f"{args.out_dir}/rejects")


if __name__ == "__main__":
    main()
