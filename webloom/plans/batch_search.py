"""Many search requests at once: every per-request limit becomes a per-query top-k.

Equivalent to running ``search_request`` once per query, but one set of Spark
jobs for the whole batch: query terms are joined to the postings, BM25 is
computed per ``(query_id, url)``, and the per-query limits use a two-phase
top-k (first inside ``(query_id, hash bucket)``, then per query) so a query
with an enormous hit list is spread over many tasks before it is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.constants import BM25_B, BM25_K1, MAX_LOOKUPS, RANK_CUTOFF, TABLE_ROWS
from webloom.operators import results as R
from webloom.operators import search as S
from webloom.operators.search import SALTS
from webloom.operators.topk import top_k_per_group
from webloom.operators.graph import written_table


#: Pairs of a query and a posting of one of its terms that a task meets, about, and
#: the most tasks they are dealt over.
PAIRS_PER_TASK = 1 << 18
MAX_TASKS = 10_000


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, q)`` -> distinct ``(query_id, term)``."""
    return (queries.select("query_id", F.explode(F.array_distinct(S.tokens(F.col("q"))))
                           .alias("term")).distinct())


def batch_scores(index: DataFrame, queries: DataFrame, k1: float = BM25_K1,
                 b: float = BM25_B, lengths: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """BM25 ``(query_id, url, score)`` for every query of the batch (OR semantics).

    Terms meet postings by ``(term, salt)``, where the salt is a hash of the url and
    the terms, few beside the postings, are repeated for every salt: a word that is
    in every document is joined in ``salts`` places, not in one.

    A posting becomes a row for every query that asks its term, so the bytes read say
    nothing of a task's work: the pairs are counted first, and dealt over as many
    tasks as they need, both where they are made and where they are summed. The index
    is read twice, so it should be stored.
    """
    lengths = lengths if lengths is not None else S.doc_lengths(index)
    # One scalar subquery for both corpus statistics (one pass over lengths).
    stats = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                 F.avg("dl").alias("avgdl")).alias("s")).scalar()
    n_docs, avgdl = stats["n"], stats["avgdl"]
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    qt = query_terms(queries)
    terms = qt.select("term").distinct().select("term", every_salt)
    salted = index.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int"))
    p = salted.join(terms, ["term", "salt"], "left_semi")
    df_t = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    part = F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / norm
    counted = written_table(qt.join(df_t, "term"), "terms")
    pairs = counted.agg(F.sum("df")).first()[0] or 0
    tasks = min(MAX_TASKS, max(1, -(-pairs // PAIRS_PER_TASK)))
    asked = counted.select("query_id", "term", idf.alias("idf"), every_salt).repartition(tasks, "term", "salt")
    scored = p.repartition(tasks, "term", "salt").join(asked, ["term", "salt"])
    if "dl" not in p.columns:
        scored = scored.join(lengths, "url")
    parts = scored.select("query_id", "url", part.alias("part")).repartition(tasks, "query_id", "url")
    return parts.groupBy("query_id", "url").agg(F.sum("part").alias("score"))


def batch_search(index: DataFrame, ranked: DataFrame, queries: DataFrame,
                 cutoff: float = RANK_CUTOFF, max_lookups: int = MAX_LOOKUPS,
                 lengths: DataFrame | None = None) -> DataFrame:
    """Per query: first ``max_lookups`` hits by relevance, looked up, above the
    cutoff: ``(query_id, url, rank, total_links)``."""
    hits = batch_scores(index, queries, lengths=lengths)
    first = top_k_per_group(hits, "query_id", [F.desc("score"), F.asc("url")], max_lookups)
    found = first.select("query_id", "url").join(ranked, "url")
    return R.above_rank(found, cutoff).select("query_id", "url", "rank", "total_links")


def batch_tables(found: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """Result table per query: best ``rows`` by rank (ties by url)."""
    return top_k_per_group(found, "query_id", [F.desc("rank"), F.asc("url")], rows)


def batch_graph(found: DataFrame, links: DataFrame, budget: int = 1000,
                materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Seed/neighbour graph of every query of a batch: ``(nodes, edges)``, each
    keyed by ``query_id`` and numbered per query exactly like a single request.

    The seeds (at most budget // 10 per query) feed every output, so they are
    written once as a table in the shared checkpoint directory.
    """
    by = ("query_id",)
    seeds = R.pick_seeds(found, R.seed_count(budget), by)
    if materialize:
        seeds = written_table(seeds, "seeds")
    dlinks = R.seed_links(links, seeds, by)
    s_edges = R.seed_edges(dlinks, seeds, by)
    nbrs = R.neighbours(dlinks, s_edges, seeds, by=by)
    return R.graph_nodes(seeds, nbrs, by), R.graph_edges(s_edges, nbrs, by)
