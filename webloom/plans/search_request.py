"""One search request, end to end, as lazily built DataFrames.

``hits (relevance order) -> first max_lookups -> rank lookup -> strict cutoff``
then, from the pages above the cutoff: the saved analysis rows, the result
table, the seeds, and the seed/neighbour graph (node and edge tables and the
assembled document).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.constants import LINKS_PER_SEED, MAX_LOOKUPS, RANK_CUTOFF, TABLE_ROWS
from webloom.operators import results as R
from webloom.operators import search as S
from webloom.operators.graph import written_table


@dataclass
class SearchResult:
    """Outputs of a request. What only the graph needs is made when first asked for;
    the seeds' distinct links, which three of its tables read, are written once."""

    hits: DataFrame        # (url, score), every matching document
    found: DataFrame       # (url, rank, total_links), looked up and above the cutoff
    links_of: Callable[[DataFrame], DataFrame]  # links (url, pos, link) of the seeds given
    budget: int = 1000
    table_rows: int = TABLE_ROWS
    per_seed: int = LINKS_PER_SEED
    materialize: bool = True

    @cached_property
    def table(self) -> DataFrame:
        """Best ``table_rows`` of found."""
        return R.best_pages(self.found, self.table_rows)

    @cached_property
    def seeds(self) -> DataFrame:
        """(seed_idx, url, rank, total_links)"""
        return R.pick_seeds(self.found, R.seed_count(self.budget))

    @cached_property
    def seed_links(self) -> DataFrame:
        """(seed_idx, link, first_pos): as many rows as the seeds have distinct links."""
        links = R.seed_links(self.links_of(self.seeds), self.seeds)
        return written_table(links, "seed_links") if self.materialize else links

    @cached_property
    def seed_edges(self) -> DataFrame:
        """(source, target, value)"""
        return R.seed_edges(self.seed_links, self.seeds)

    @cached_property
    def neighbours(self) -> DataFrame:
        """(node_id, seed_idx, link)"""
        return R.neighbours(self.seed_links, self.seed_edges, self.seeds, self.per_seed)

    @cached_property
    def nodes(self) -> DataFrame:
        """(node_id, name, group, rank, total_links)"""
        return R.graph_nodes(self.seeds, self.neighbours)

    @cached_property
    def edges(self) -> DataFrame:
        """(source, target, value)"""
        return R.graph_edges(self.seed_edges, self.neighbours)

    def document(self) -> DataFrame:
        return R.graph_document(self.nodes, self.edges)

    def analysis(self) -> DataFrame:
        """Saved analysis rows: every page above the cutoff, without links."""
        return self.found.select("url", "rank", "total_links")


def search_request(index: DataFrame | None, ranked: DataFrame, links: DataFrame, q: str,
                   budget: int = 1000, cutoff: float = RANK_CUTOFF,
                   max_lookups: int = MAX_LOOKUPS, table_rows: int = TABLE_ROWS,
                   lengths: DataFrame | None = None, materialize: bool = True,
                   hits: DataFrame | None = None) -> SearchResult:
    """Run the request for query ``q`` with a node ``budget`` (seeds = budget // 10).

    ``hits`` ``(url, score)``, where given, stand for the scores from ``index``.
    ``found`` has at most ``max_lookups`` rows and feeds every output, so it is
    written once (``materialize``) instead of being recomputed by each consumer.
    Its files carry its size, so the optimizer never mistakes it for a large
    table; nothing of it passes through the driver.
    """
    if hits is None:
        hits = S.score(index, q, lengths=lengths)
    first = R.first_hits(hits, max_lookups)
    found = R.above_rank(R.lookup_pages(first, ranked), cutoff)
    if materialize:
        found = written_table(found, "found")
    return SearchResult(hits, found, lambda seeds: links, budget, table_rows, materialize=materialize)


def table_links(table: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the result-table pages in long form ``(url, pos, link)``.

    Kept long rather than gathered into one array per page, so a page with a
    huge list is never collected into a single row or task.
    """
    return links.join(F.broadcast(table.select("url")), "url")
