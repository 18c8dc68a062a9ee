"""Serving path: answer a search request from prebuilt key-bucketed stores.

The batch side writes four stores once (``build_stores``): postings by term
(each posting carries its document's length), one row of corpus statistics,
the ranked table by url and the link table by url. A request then touches
only bounded key sets — the query's terms, at most ``max_lookups`` hit urls,
at most ``budget // 10`` seed urls — so it reads a few bucket directories
instead of scanning corpus-sized tables. The terms are the request's own words;
hit and seed urls stay relations that prune the bucket directories at run time.
Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.constants import (BM25_B, BM25_K1, LINKS_PER_SEED, MAX_LOOKUPS, RANK_CUTOFF,
                               TABLE_ROWS)
from webloom.operators import results as R
from webloom.operators import search as S
from webloom.operators.graph import LinkGraph, written_table
from webloom.plans.search_request import SearchResult
from webloom.sources.keyed import read_keyed, read_matching, write_keyed


def build_stores(graph: LinkGraph, ranked: DataFrame, docs: DataFrame, out_dir: str,
                 buckets: int = 64) -> None:
    """Write the four serving stores below ``out_dir``."""
    lengths = S.text_lengths(docs)
    write_keyed(S.build_index(docs, with_length=True), f"{out_dir}/postings", "term", buckets)
    (lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
     .write.mode("overwrite").parquet(f"{out_dir}/stats"))
    write_keyed(ranked, f"{out_dir}/ranked", "url", buckets)
    write_keyed(graph.links, f"{out_dir}/links", "url", buckets)


def served_scores(spark: SparkSession, store: str, q: str, k1: float = BM25_K1,
                  b: float = BM25_B, buckets: int = 64) -> DataFrame:
    """BM25 ``(url, score)`` from the term-keyed postings and the stats row."""
    terms = S.query_terms(q)
    p = read_keyed(spark, f"{store}/postings", "term", terms, buckets)
    stats = spark.read.parquet(f"{store}/stats").select(F.struct("n", "avgdl").alias("s")).scalar()  # one row
    n_docs, avgdl = stats["n"], stats["avgdl"]
    df_t = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    part = F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / norm
    return (p.join(F.broadcast(df_t.select("term", idf.alias("idf"))), "term")
            .groupBy("url").agg(F.sum(part).alias("score")))


def served_request(spark: SparkSession, store: str, q: str, budget: int = 1000,
                   cutoff: float = RANK_CUTOFF, max_lookups: int = MAX_LOOKUPS,
                   table_rows: int = TABLE_ROWS, buckets: int = 64,
                   per_seed: int = LINKS_PER_SEED) -> SearchResult:
    """Same outputs as ``search_request``, reading only the request's keys.

    Every written set is bounded by the request: <= max_lookups urls and found
    rows, <= budget // 10 seeds, and the seeds' distinct links.
    """
    hits = served_scores(spark, store, q, buckets=buckets)
    first = R.first_hits(hits, max_lookups).select("url")
    ranked = read_matching(spark, f"{store}/ranked", "url", first, buckets)
    found = written_table(R.above_rank(ranked, cutoff), "found")

    def links_of(seeds: DataFrame) -> DataFrame:
        return read_matching(spark, f"{store}/links", "url", seeds.select("url"), buckets)

    return SearchResult(hits, found, links_of, budget, table_rows, per_seed)
