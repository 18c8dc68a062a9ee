"""Command-line entry for the batch jobs (``spark-submit -m webloom ...`` or
``python -m webloom ...``). The session comes from the launcher's configuration;
nothing here sets cluster options.

  rank     link pages (JSON lines) -> ranked table + rank slices
  produce  text / metadata archives -> cleaned page files + ingest manifest
  paths    crawl-index files -> archive path list for a url pattern
  stores   link pages + text pages -> serving stores (postings, stats, ranked, links)
  search   one request against the stores -> result table, analysis rows, graph
  cluster  saved analysis files -> k-means labels, centroids, scatter table
  ingest   newly landed page files -> appended parquet + ingest log (exactly once)
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webloom.constants import DEFAULT_ROUNDS, URL_DESCRIPTOR


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webloom")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("rank")
    r.add_argument("--links", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--rounds", type=int, default=DEFAULT_ROUNDS)
    pr = sub.add_parser("produce")
    pr.add_argument("--text", required=True)
    pr.add_argument("--meta", required=True)
    pr.add_argument("--out", required=True)
    pr.add_argument("--paths")
    pr.add_argument("--descriptor", default=URL_DESCRIPTOR)
    pa = sub.add_parser("paths")
    pa.add_argument("--index", required=True)
    pa.add_argument("--pattern")
    pa.add_argument("--out", required=True)
    st = sub.add_parser("stores")
    st.add_argument("--links", required=True)
    st.add_argument("--text", required=True)
    st.add_argument("--out", required=True)
    st.add_argument("--rounds", type=int, default=DEFAULT_ROUNDS)
    st.add_argument("--buckets", type=int, default=64)
    se = sub.add_parser("search")
    se.add_argument("--stores", required=True)
    se.add_argument("--q", required=True)
    se.add_argument("--density", default="Max (1000 nodes)")
    se.add_argument("--out", required=True)
    se.add_argument("--buckets", type=int, default=64)
    cl = sub.add_parser("cluster")
    cl.add_argument("--analysis", required=True)
    cl.add_argument("--out", required=True)
    cl.add_argument("--tag", default="analysis_data")
    ig = sub.add_parser("ingest")
    ig.add_argument("--links", help="directory where link-page files land")
    ig.add_argument("--text", help="directory where text-page files land")
    ig.add_argument("--out", required=True)
    ig.add_argument("--checkpoint", help="stream checkpoints (default: spark.checkpoint.dir)")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"webloom-{args.cmd}").getOrCreate()
    if args.cmd == "rank":
        from webloom.plans import ranking
        ranking.run(spark, args.links, args.out, args.rounds)
    elif args.cmd == "produce":
        from webloom.plans import production
        from webloom.sources import readers
        paths = readers.read_paths(spark, args.paths) if args.paths else None
        manifest = production.run(spark, args.text, args.meta, args.out, paths, args.descriptor)
        manifest.write.mode("overwrite").json(f"{args.out}/manifest")
    elif args.cmd == "paths":
        from webloom.plans import production
        from webloom.sources import readers, sinks
        sinks.write_paths(production.archive_paths(readers.read_index(spark, args.index),
                                                   args.pattern), args.out)
    elif args.cmd == "stores":
        from webloom.plans import ranking, serving
        from webloom.sources import readers
        r = ranking.rank_link_pages(readers.read_links(spark, args.links), args.rounds)
        docs = readers.read_text(spark, args.text).filter("valid").select(
            "url", F.col("plaintext").alias("text"))
        serving.build_stores(r.graph, r.ranked, docs, args.out, args.buckets)
    elif args.cmd == "search":
        from webloom.operators.results import node_budget
        from webloom.plans import serving
        from webloom.sources import sinks
        res = serving.served_request(spark, args.stores, args.q, node_budget(args.density),
                                     buckets=args.buckets)
        res.table.write.mode("overwrite").json(f"{args.out}/table")
        sinks.write_analysis(res.analysis(), f"{args.out}/analysis")
        sinks.write_graph(res.document(), f"{args.out}/graph")
    elif args.cmd == "cluster":
        from webloom.plans import clustering
        clustering.run(spark, args.analysis, args.out, args.tag)
    elif args.cmd == "ingest":
        from webloom.streaming import ingest
        ck = args.checkpoint
        queries = []
        if args.links:
            queries.append(ingest.ingest_link_pages(
                spark, args.links, f"{args.out}/links", ck and f"{ck}/links"))
            queries.append(ingest.ingest_log(
                ingest.link_page_stream(spark, args.links), f"{args.out}/log_links",
                checkpoint_location=ck and f"{ck}/log_links"))
        if args.text:
            queries.append(ingest.ingest_text_pages(
                spark, args.text, f"{args.out}/text", ck and f"{ck}/text"))
        for q in queries:
            q.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
