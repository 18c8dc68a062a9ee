"""Link-graph operators: adjacency, edge weights, PageRank, ranked pages.

Representation. A crawled page's links are kept in *long form*
``links(url, pos, link)`` — one row per link, ``pos`` any orderable value that
gives the order of appearance on the page. An array column per page (the
JSON-lines input format) is converted once with ``posexplode``; from then on no
operator needs a page's whole list in one row, so a page holding a large share
of all links never becomes one huge row, task or group.

PageRank semantics (kept on purpose): every crawled page starts at 1.0; each
round a page sends ``rank / out_degree`` along every link (repeats count), a
page's new rank is ``0.15 + 0.85 * received``; it is not normalised, dangling
mass is dropped, pages without in-links vanish after a round, and un-crawled
targets get a rank too.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.constants import (CHECKPOINT_EVERY, DAMPING, DEFAULT_ROUNDS, HOT_MAX_KEYS,
                               HOT_MIN_ROWS, INITIAL_RANK, TELEPORT)
from webloom.functions.numeric import report_round
from webloom.operators.skew import hot_keys, split_by_keys
from webloom.session import ensure_checkpoint_dir

#: Rows that a task sums by key, about, and the most tasks they are dealt over.
ROWS_PER_TASK = 1 << 19
MAX_TASKS = 10_000


@dataclass(frozen=True)
class LinkGraph:
    """Crawled pages ``(url, ...)`` (one row per url) and their links in long form."""
    pages: DataFrame
    links: DataFrame  # (url, pos, link)


@dataclass(frozen=True)
class Edges:
    """Weighted edges ``(src, dst, w)`` with ``w = multiplicity / out_degree``,
    split by whether ``src`` is a hot source (``hot_src`` is bounded).
    ``hot`` is None once it is known that no source is hot."""
    cold: DataFrame
    hot: DataFrame | None
    hot_src: DataFrame | None  # (src)
    degree: DataFrame | None = None  # (src, out_degree): links per page, repeats counted


# ---------------------------------------------------------------- adjacency

def explode_links(link_pages: DataFrame, url: str = "url", links: str = "links") -> DataFrame:
    """Array-form pages ``(url, links)`` -> long form ``(url, pos, link)``.

    Pages with an empty or missing list produce no rows (they still count as
    crawled pages through the page table).
    """
    return link_pages.select(F.col(url).alias("url"),
                             F.posexplode(links).alias("pos", "link"))


def one_capture_per_url(link_pages: DataFrame, source_col: str = "source_file") -> DataFrame:
    """Keep one capture per url: the largest link list, then the smallest source file.

    ``min_by`` is a partial aggregate, so a url captured very often is combined
    map-side instead of being gathered into one task.
    """
    order = F.struct(-F.size(F.coalesce("links", F.array())), F.col(source_col))
    others = [c for c in link_pages.columns if c != "url"]
    picked = link_pages.groupBy("url").agg(
        F.min_by(F.struct(*others), order).alias("_pick"))
    return picked.select("url", *[F.col(f"_pick.{c}").alias(c) for c in others])


def link_pages_graph(link_pages: DataFrame) -> LinkGraph:
    """LinkGraph from array-form pages ``(url, links)`` with one row per url."""
    pages = link_pages.select("url")
    return LinkGraph(pages=pages, links=explode_links(link_pages))


def out_degree(links: DataFrame) -> DataFrame:
    """``(url, out_degree, n_targets)``: links with repeats, and distinct targets.

    Two partial aggregations; a page with a huge list is combined map-side.
    """
    pairs = links.groupBy("url", "link").agg(F.count(F.lit(1)).alias("mult"))
    return pairs.groupBy("url").agg(F.sum("mult").alias("out_degree"),
                                    F.count(F.lit(1)).alias("n_targets"))


def sum_tasks(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int | None:
    """Tasks over which to deal rows that are summed by key, by their number; None for
    rows that one task can sum. It is a multiple of the shuffle partitions, so that
    rows of one task stay in one partition or bucket of the same key."""
    tasks = -(-rows.count() // rows_per_task)
    if tasks <= 1:
        return None
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n * -(-min(tasks, MAX_TASKS) // n)


def deal(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``rows`` by the hash of their keys in ``tasks`` partitions; as they are for None."""
    return rows.repartition(tasks, *keys) if tasks else rows


def build_edges(links: DataFrame, hot_max_keys: int = HOT_MAX_KEYS,
                hot_min_rows: int = HOT_MIN_ROWS, stored: bool = False,
                rows_per_task: int = ROWS_PER_TASK) -> Edges:
    """Pre-aggregate the long link table once into weighted, skew-split edges.

    ``(src, dst)`` pairs are counted (partial aggregate), then each pair is
    divided by its source's out-degree. Cold sources join their degree by
    shuffle; hot sources (bounded count) get their degree by broadcast.
    ``stored``: write the pairs and the degrees, which several steps read, once.
    Almost every pair is its own, so sums of a split are as large as its rows: stored
    links are counted first, and many are dealt unsummed over as many tasks as they
    need, by pair and later by source.
    """
    tasks = sum_tasks(links, rows_per_task) if stored else None
    ends = deal(links.select(F.col("url").alias("src"), F.col("link").alias("dst")), tasks, "src", "dst")
    pairs = ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("mult"))
    degree = pairs.groupBy("src").agg(F.sum("mult").alias("out_degree"),
                                      F.count(F.lit(1)).alias("n_targets"))
    if stored:
        pairs = written_table(pairs, "pairs")
        degree = written_table(pairs.groupBy("src").agg(F.sum("mult").alias("out_degree"), F.count(F.lit(1)).alias("n_targets")), "degree")
    hot = hot_keys(degree, "src", "n_targets", hot_max_keys, hot_min_rows)
    if stored and hot.isEmpty():  # known from the written degrees: no hot branch at all
        w = (F.col("mult") / F.col("out_degree")).alias("w")
        degree = degree.select("src", "out_degree")
        return Edges(cold=deal(pairs, tasks, "src").join(degree, "src").select("src", "dst", w), hot=None, hot_src=None, degree=degree)
    pairs_hot, pairs_cold = split_by_keys(pairs, "src", hot, "src")
    degree_hot, _ = split_by_keys(degree, "src", hot, "src")
    w = (F.col("mult") / F.col("out_degree")).alias("w")
    cold = deal(pairs_cold, tasks, "src").join(degree.select("src", "out_degree"), "src").select("src", "dst", w)
    hot_e = (pairs_hot.join(F.broadcast(degree_hot.select("src", "out_degree")), "src")
             .select("src", "dst", w))
    return Edges(cold=cold, hot=hot_e, hot_src=hot, degree=degree.select("src", "out_degree"))


def contributions(edges: Edges, ranks: DataFrame) -> DataFrame:
    """One round's contributions ``(dst, contrib)`` from ranks ``(src, rank)``.

    Cold sources join by shuffle; the ranks of hot sources (fewer than
    HOT_MAX_KEYS rows by construction) are broadcast to their edges.
    """
    via = edges.cold.join(ranks, "src")
    if edges.hot is not None:
        hot_ranks, _ = split_by_keys(ranks, "src", edges.hot_src, "src")
        via = via.unionByName(edges.hot.join(F.broadcast(hot_ranks), "src"))
    return via.select("dst", (F.col("rank") * F.col("w")).alias("contrib"))


def bucketed_table(df: DataFrame, key: str, buckets: int, prefix: str) -> DataFrame:
    """Write ``df`` once as a table bucketed and sorted by ``key`` below the
    shared checkpoint directory and return it (lineage cut, co-partitioned)."""
    spark = df.sparkSession
    name = f"webloom_{prefix}_{uuid.uuid4().hex[:12]}"
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", name)
    (df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return spark.table(name)


def written_table(df: DataFrame, prefix: str) -> DataFrame:
    """Write ``df`` once as parquet below the shared checkpoint directory and
    read it back: lineage is cut and, unlike a checkpointed RDD, the scan has
    file-size statistics for the optimizer."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tables",
                        f"webloom_{prefix}_{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def damp(received: Column, damping: float = DAMPING, teleport: float = TELEPORT) -> Column:
    """New rank from received contributions."""
    return F.lit(teleport) + F.lit(damping) * received


def pagerank(graph: LinkGraph, rounds: int = DEFAULT_ROUNDS, damping: float = DAMPING,
             teleport: float = TELEPORT, checkpoint_every: int = CHECKPOINT_EVERY,
             edges: Edges | None = None, until: float | None = None) -> DataFrame:
    """Unnormalised PageRank after ``rounds`` rounds: ``(url, rank)``."""
    return pagerank_with_edges(graph, rounds, damping, teleport, checkpoint_every, edges, until)[0]


def pagerank_with_edges(graph: LinkGraph, rounds: int = DEFAULT_ROUNDS,
                        damping: float = DAMPING, teleport: float = TELEPORT,
                        checkpoint_every: int = CHECKPOINT_EVERY,
                        edges: Edges | None = None, until: float | None = None) -> tuple[DataFrame, Edges]:
    """PageRank ``(url, rank)`` and the edges it ran on (written ones when the
    run spans checkpoints), so later steps can reuse their degree table.

    Each round is one join and one partial+final aggregate by target, which is its
    only shuffle: the edges lie in buckets of their source, and the aggregate deals
    the new ranks by the same hash into as many partitions, so neither side of the
    next join moves. Lineage is cut every ``checkpoint_every`` rounds by writing
    the ranks, in those same buckets; a lost executor recomputes at most that many
    rounds. With ``until`` the rounds end early, at such a cut, once no rank has
    changed by more than that in the last round.
    """
    if rounds < 0:
        raise ValueError("rounds must be >= 0")
    given = edges is not None
    edges = edges or build_edges(graph.links, stored=rounds > 0)
    spark = graph.links.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rounds > 1:
        # Write the edges once, so no round rebuilds them.
        hot_src = written_table(edges.hot_src, "hot_src") if edges.hot_src is not None else None
        degree = written_table(edges.degree, "degree") if given and edges.degree is not None else edges.degree
        cold = bucketed_table(edges.cold, "src", n, "edges")
        if hot_src is None or hot_src.isEmpty():  # known after one pass: drop the hot branch
            edges = Edges(cold=cold, hot=None, hot_src=None, degree=degree)
        else:
            edges = Edges(cold=cold, hot=written_table(edges.hot, "hot_edges"), hot_src=hot_src, degree=degree)
    ranks = graph.pages.select(F.col("url").alias("src"),
                               F.lit(INITIAL_RANK).cast("double").alias("rank"))
    for i in range(rounds):
        before = ranks
        received = (contributions(edges, ranks).groupBy("dst")
                    .agg(F.sum("contrib").alias("received")))
        ranks = received.select(F.col("dst").alias("src"),
                                damp(F.col("received"), damping, teleport).alias("rank"))
        if checkpoint_every and (i + 1) % checkpoint_every == 0 and i + 1 < rounds:
            ranks = bucketed_table(ranks, "src", n, "ranks")
            if until is not None and moved(before, ranks).filter(F.col("moved") > until).isEmpty():
                break
    return ranks.withColumnRenamed("src", "url"), edges


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """By how much each rank ``(src, rank)`` has changed: ``(src, moved)``; a page that
    has a rank on one side only moved by all of it."""
    both = before.select("src", F.col("rank").alias("was")).join(after, "src", "full")
    return both.select("src", F.abs(F.coalesce("was", F.lit(0.0)) - F.coalesce("rank", F.lit(0.0))).alias("moved"))


def ranked_pages(graph: LinkGraph, ranks: DataFrame, edges: Edges | None = None) -> DataFrame:
    """Ranks of crawled pages with their link counts: ``(url, rank, total_links)``.

    A left join of ranks with the pages followed by a not-null filter is an
    inner join; un-crawled targets (ranked, no page) and pages that lost
    their rank drop out. ``total_links`` counts repeats (the list length).
    Passing the ``edges`` the ranks came from reuses their out-degree table
    instead of aggregating the link table again.
    """
    if edges is not None and edges.degree is not None:
        degree = edges.degree.select(F.col("src").alias("url"),
                                     F.col("out_degree").alias("total_links"))
    else:
        degree = graph.links.groupBy("url").agg(F.count(F.lit(1)).alias("total_links"))
    pages = (graph.pages.select("url").join(degree, "url", "left")
             .select("url", F.coalesce("total_links", F.lit(0)).cast("long").alias("total_links")))
    return ranks.join(pages, "url").select("url", "rank", "total_links")


def top_ranks(ranks: DataFrame, n: int, decimals: int = 6) -> DataFrame:
    """The ``n`` highest ranks (ties by url) — a TakeOrderedAndProject, no full sort."""
    r = report_round("rank", decimals)
    return (ranks.select("url", r.alias("rank"))
            .orderBy(F.desc("rank"), F.asc("url")).limit(n))


def slice_keys(ranked: DataFrame) -> DataFrame:
    """Distinct link counts of the ranked table (the rank-slice partition keys)."""
    return ranked.select("total_links").distinct()


def rank_slice(ranked: DataFrame, n_links: int) -> DataFrame:
    """One link-count slice in rank order (ties by url)."""
    return (ranked.filter(F.col("total_links") == n_links)
            .orderBy(F.desc("rank"), F.asc("url")))
