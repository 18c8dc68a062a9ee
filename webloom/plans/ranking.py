"""Batch ranking job: link pages -> PageRank -> ranked table and rank slices.

``read_links -> one capture per url -> long links -> edges -> rounds -> ranked``,
one lazily built plan; actions happen only at the writes and at the reliable
checkpoints inside the PageRank loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.constants import DEFAULT_ROUNDS
from webloom.operators import graph as G
from webloom.sources import readers, sinks


@dataclass
class Ranking:
    """Ranking outputs. Links stay in long form (``graph.links``) in the store:
    no page's list is ever gathered into one row."""
    graph: G.LinkGraph
    ranks: DataFrame    # (url, rank) including un-crawled targets
    ranked: DataFrame   # (url, rank, total_links) crawled pages only


def rank_link_pages(link_pages: DataFrame, rounds: int = DEFAULT_ROUNDS,
                    source_col: str | None = "source_file") -> Ranking:
    """Rank array-form link pages ``(url, links[, source_file])``.

    Several captures of one url are reduced to one first (largest list, then
    smallest source file), so repeated captures do not repeat initial ranks.
    """
    good = link_pages.filter("valid") if "valid" in link_pages.columns else link_pages
    if source_col and source_col in good.columns:
        pages = G.one_capture_per_url(good, source_col)
    else:  # captures of equal length: the least link list, whatever the input order
        pages = G.one_capture_per_url(good.select("url", "links", F.col("links").alias("_src")), "_src")
    graph = G.link_pages_graph(pages.select("url", "links"))
    ranks, edges = G.pagerank_with_edges(graph, rounds)
    return Ranking(graph=graph, ranks=ranks, ranked=G.ranked_pages(graph, ranks, edges))


def run(spark: SparkSession, links_path: str, out_dir: str, rounds: int = DEFAULT_ROUNDS) -> None:
    """Read link pages, rank them, merge the ranked store and write the rank slices,
    the rank lines, and the links of the ranked pages."""
    pages = readers.read_links(spark, links_path)
    r = rank_link_pages(pages, rounds)
    store = sinks.store_upsert(f"{out_dir}/ranked", r.ranked)
    sinks.write_rank_slices(r.ranked, f"{out_dir}/slices")
    sinks.export_text(r.ranked, f"{out_dir}/ranks_text")
    sinks.export_links(r.graph.links.join(store.select("url"), "url", "left_semi"), f"{out_dir}/links")
    readers.rejected(pages).write.mode("overwrite").json(f"{out_dir}/rejected")
