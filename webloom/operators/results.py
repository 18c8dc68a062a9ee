"""Search results: rank lookup, cutoff, result table, seeds and the seed graph.

Sizes are bounded by the request, not by the corpus: at most ``max_lookups``
hits are looked up (so the hit side of the lookup join is broadcast), at most
``budget // 10`` seeds, at most 10 neighbours per seed. The only inputs that
grow with the corpus — the ranked table and the link table — are never
shuffled whole for a request: both are reached through a broadcast of the
bounded side. Per-seed neighbour selection uses a literal-bounded
``row_number`` filter, which Spark plans as a partial WindowGroupLimit before
the exchange, so a seed with an enormous link list ships at most 10 rows per
map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.numeric import report_round
from webloom.operators.topk import top_k_per_group
from webloom.constants import (COLOUR_GROUPS, COLOUR_ZERO_SUBSTITUTE, DENSITY_PRESETS,
                               LINKS_PER_SEED, MAX_LOOKUPS, NEIGHBOUR_EDGE_VALUE, RANK_CUTOFF,
                               RANK_DECIMALS, SEED_EDGE_VALUE, SEED_GROUP, SEEDS_DIVISOR,
                               TABLE_ROWS)

# ------------------------------------------------------------ small columns


def node_budget(density: str) -> int:
    """Density preset label -> node budget."""
    try:
        return DENSITY_PRESETS[density]
    except KeyError:
        raise ValueError(f"unknown density {density!r}; one of {list(DENSITY_PRESETS)}")


def seed_count(budget: int) -> int:
    return budget // SEEDS_DIVISOR


def colour_group(seed_idx: Column) -> Column:
    """Neighbour colour: seed index mod 20, with 0 shown as 19."""
    g = F.pmod(seed_idx, F.lit(COLOUR_GROUPS))
    return F.when(g == 0, F.lit(COLOUR_ZERO_SUBSTITUTE)).otherwise(g).cast("int")


def rounded_rank(rank: str | Column = "rank") -> Column:
    """Rank at the reported precision; float noise is snapped first (3 more places)."""
    return report_round(rank, RANK_DECIMALS)


# ------------------------------------------------------------ lookup


def first_hits(hits: DataFrame, n: int = MAX_LOOKUPS, order: str = "score") -> DataFrame:
    """The first ``n`` hits in relevance order (ties by url), before any lookup."""
    return hits.orderBy(F.desc(order), F.asc("url")).limit(n)


def lookup_pages(hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hits joined with the ranked table: ``(url, rank, total_links)``.

    ``hits`` is bounded (``first_hits``), which the optimizer knows from its limit: a
    limit of the usual size is broadcast, so the ranked table is only scanned; a
    far larger one is shuffled.
    """
    return ranked.join(hits.select("url"), "url")


def above_rank(found: DataFrame, cutoff: float = RANK_CUTOFF) -> DataFrame:
    """Strict cutoff on the rounded rank; rank reported rounded."""
    return (found.withColumn("rank", rounded_rank())
            .filter(F.col("rank") > F.lit(cutoff)))


def best_pages(found: DataFrame, n: int = TABLE_ROWS) -> DataFrame:
    """Top ``n`` by rank (ties by url): a TakeOrderedAndProject, no full sort."""
    return found.orderBy(F.desc("rank"), F.asc("url")).limit(n)


def pick_seeds(found: DataFrame, n_seeds: int, by: Sequence[str] = ()) -> DataFrame:
    """Seeds ``(*by, seed_idx, url, rank, total_links)``: best ``n_seeds`` (per
    ``by`` group, e.g. per query of a batch), numbered 0…

    Without ``by`` the window runs over the ``n_seeds`` rows left after the
    limit only; with ``by`` an exact two-phase per-group top-k comes first.
    """
    order = [F.desc("rank"), F.asc("url")]
    top = top_k_per_group(found, list(by), order, n_seeds) if by else best_pages(found, n_seeds)
    w = Window.partitionBy(*by).orderBy(*order)
    return top.select(*by, (F.row_number().over(w) - 1).cast("long").alias("seed_idx"), "url",
                      "rank", "total_links")


# ------------------------------------------------------------ seed graph


def _small(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Broadcast a request-bounded side; in a batch (``by``) its size grows with
    the number of queries, so the runtime size check (AQE) decides instead."""
    return df if by else F.broadcast(df)


def seed_links(links: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct links of each seed with their first position:
    ``(*by, seed_idx, link, first_pos)``.

    The seeds are bounded and broadcast; the link table is only scanned. The
    ``(seed_idx, link)`` aggregate is partial+final, so a seed with a huge
    list is combined map-side.
    """
    s = _small(seeds.select(*by, "url", "seed_idx"), by)
    return (links.join(s, "url").groupBy(*by, "seed_idx", "link")
            .agg(F.min("pos").alias("first_pos")))


def seed_edges(dlinks: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges between seeds ``(*by, source, target, value)``: every distinct link
    of a seed that is itself a seed, self-links included, not capped."""
    targets = _small(seeds.select(*by, F.col("url").alias("link"),
                                  F.col("seed_idx").alias("target")), by)
    return dlinks.join(targets, [*by, "link"]).select(
        *by, F.col("seed_idx").cast("long").alias("source"), F.col("target").cast("long"),
        F.lit(SEED_EDGE_VALUE).alias("value"))


def neighbours(dlinks: DataFrame, s_edges: DataFrame, seeds: DataFrame,
               per_seed: int = LINKS_PER_SEED, by: Sequence[str] = ()) -> DataFrame:
    """Neighbour nodes ``(*by, node_id, seed_idx, link)``.

    Seed ``s`` with ``e`` seed edges takes its first ``per_seed - e`` distinct
    links (first appearance; the same url may appear under several seeds and
    seed urls are not excluded). Nodes are numbered after the seeds, seed by
    seed, in link order.
    """
    n_edges = s_edges.groupBy(*by, F.col("source").alias("seed_idx")).agg(
        F.count(F.lit(1)).alias("n_edges"))
    w = Window.partitionBy(*by, "seed_idx").orderBy(F.asc("first_pos"), F.asc("link"))
    top = (dlinks.withColumn("pos_in_seed", F.row_number().over(w))
           .filter(F.col("pos_in_seed") <= per_seed))          # literal: partial top-k
    keep = (top.join(_small(n_edges, by), [*by, "seed_idx"], "left")
            .filter(F.col("pos_in_seed") <= F.lit(per_seed) - F.coalesce("n_edges", F.lit(0))))
    # Node numbering: per-seed counts (<= n_seeds rows per group) -> running offsets.
    counts = keep.groupBy(*by, "seed_idx").agg(F.count(F.lit(1)).alias("c"))
    wo = Window.partitionBy(*by).orderBy("seed_idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(wo), F.lit(0))
    if by:
        n_seeds = seeds.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        offsets = counts.join(n_seeds, list(by)).select(
            *by, "seed_idx", (F.col("_n") + before).alias("offset"))
    else:
        n_seeds = seeds.agg(F.count(F.lit(1))).scalar()
        offsets = counts.select("seed_idx", (n_seeds + before).alias("offset"))
    return (keep.join(_small(offsets, by), [*by, "seed_idx"])
            .select(*by, (F.col("offset") + F.col("pos_in_seed") - 1).cast("long")
                    .alias("node_id"), "seed_idx", "link"))


def graph_nodes(seeds: DataFrame, nbrs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Node table ``(*by, node_id, name, group, rank, total_links)``; neighbours
    carry NULL rank and link count."""
    s = seeds.select(*by, F.col("seed_idx").cast("long").alias("node_id"),
                     F.col("url").alias("name"), F.lit(SEED_GROUP).cast("int").alias("group"),
                     F.col("rank").cast("double").alias("rank"),
                     F.col("total_links").cast("long").alias("total_links"))
    n = nbrs.select(*by, "node_id", F.col("link").alias("name"),
                    colour_group(F.col("seed_idx")).alias("group"),
                    F.lit(None).cast("double").alias("rank"),
                    F.lit(None).cast("long").alias("total_links"))
    return s.unionByName(n)


def graph_edges(s_edges: DataFrame, nbrs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edge table ``(*by, source, target, value)``: seed edges, then neighbour -> seed."""
    n = nbrs.select(*by, F.col("node_id").alias("source"), F.col("seed_idx").cast("long")
                    .alias("target"), F.lit(NEIGHBOUR_EDGE_VALUE).alias("value"))
    return s_edges.unionByName(n)


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(nodes, links)`` of arrays ordered by node id / (seed, kind, ...).

    Bounded: at most ``budget`` + seeds nodes and as many edges per request.
    An empty seed list gives empty arrays.
    """
    node_arr = nodes.agg(F.array_sort(F.collect_list(F.struct(
        "node_id", "name", "group", "rank", "total_links"))).alias("n"))
    edge_key = F.when(F.col("value") == SEED_EDGE_VALUE, F.col("source")).otherwise(F.col("target"))
    edge_arr = edges.agg(F.array_sort(F.collect_list(F.struct(
        edge_key.alias("seed"), F.col("value").alias("kind"), "source", "target",
        "value"))).alias("e"))
    return node_arr.select(
        F.transform("n", lambda x: F.struct(x["name"].alias("name"), x["group"].alias("group"),
                                            x["rank"].alias("rank"),
                                            x["total_links"].alias("total_links"))).alias("nodes"),
        edge_arr.scalar().alias("_e")).select(
        "nodes", F.transform("_e", lambda x: F.struct(
            x["source"].alias("source"), x["target"].alias("target"),
            x["value"].alias("value"))).alias("links"))


def text_with_ranks(text_pages: DataFrame, ranked: DataFrame) -> DataFrame:
    """Text pages joined with their ranks on url (both one row per url)."""
    return text_pages.join(ranked, "url")
