"""A stored text index in blocks: ranked search that skips blocks, and phrases.

Documents are dealt to *cells* of at most about ``CELL_DOCS`` of like length:
by their length, four steps to a doubling, and by a hash of the url. A block is
one term's postings in one cell, ``(url, dl, tf, at)`` with all positions. So a
common term is as many rows as there are cells, never one key, and the blocks
of several terms in a cell hold the same documents.

A block's header (documents, greatest ``tf``, least ``dl``) bounds the BM25 part
that the term can give to any of its documents, whatever the parameters, and
the sum over a query's terms bounds a cell. Ranked search scores the cells of
the highest bounds first, until they hold k documents for sure; the k-th best
score found there tells which other cells can still matter, and only those are
read. Both steps take a whole batch of queries, each with a threshold of its
own. A phrase is found from the positions, without any text.

The empty term stands for the documents themselves: its headers hold their
number and length, from which come the corpus statistics.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.constants import BM25_B, BM25_K1
from webloom.functions.numeric import report_round
from webloom.operators import search as S
from webloom.operators.graph import written_table
from webloom.sources.keyed import BUCKET, with_bucket

CELL_DOCS = 4096
#: Bytes of text of which a task makes the blocks, and pairs of a query and a posting
#: that a task scores, about; the most tasks of either kind.
TASK_BYTES = 16 << 20
TASK_PAIRS = 1 << 20
MAX_TASKS = 10_000
#: Scores are compared at six places, so a bound must fall short by more than this.
SLACK = 1e-6


def cell_of(dl: Column, url: Column, split: int) -> Column:
    """Cell of a document of ``dl`` tokens; ``split`` cells share a length."""
    return (F.floor(F.log2(dl.cast("double")) * 4) * split + F.pmod(F.xxhash64(url), F.lit(split))).cast("long")


def _cell_blocks(cell: pa.Table) -> pa.Table:
    """The blocks of one cell from its rows ``(cell, url, dl, words)``."""
    cell = cell.combine_chunks()
    cell = cell.take(pc.sort_indices(cell, [("url", "ascending"), ("dl", "ascending")], null_placement="at_start")).combine_chunks()
    url, dl = cell["url"].combine_chunks(), cell["dl"].to_numpy()
    same = url.dictionary_encode(null_encoding="encode").indices.to_numpy()
    # Rows of one url and length are one document.
    fresh = np.append(True, (same[1:] != same[:-1]) | (dl[1:] != dl[:-1]))
    doc, rows = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    # The empty term comes first, so that a token's position counts from 1.
    lists = pc.split_pattern(pc.binary_join_element_wise("", cell["words"].combine_chunks(), " "), " ")
    begin = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    size = np.diff(begin)
    code, of = coded.indices.to_numpy().astype(np.int64), np.repeat(doc, size)
    at = (np.arange(len(code)) - np.repeat(begin[:-1] - begin[0], size)).astype(np.int32)
    key = code * len(rows) + of
    order = np.argsort(key, kind="stable") if len(rows) == len(doc) else np.lexsort((at, key))
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    code, of, tf = key[head] // len(rows), key[head] % len(rows), np.diff(np.append(head, len(key)))
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    positions = pa.ListArray.from_arrays(pa.array(np.append(head, len(key)), pa.int32()), pa.array(at[order]))
    docs = pa.StructArray.from_arrays([url.take(pa.array(rows[of])), pa.array(dl[rows[of]]), pa.array(tf), positions], ["url", "dl", "tf", "at"])
    n = np.diff(np.append(first, len(code)))
    return pa.table({
        "term": coded.dictionary.take(pa.array(code[first])), "cell": pa.array(np.full(len(first), cell["cell"][0].as_py())), "n": pa.array(n),
        "max_tf": pa.array(np.maximum.reduceat(tf, first)), "min_dl": pa.array(np.minimum.reduceat(dl[rows[of]], first)),
        "sum_dl": pa.array(np.add.reduceat(dl[rows[of]], first)), "docs": pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), docs)})


def build_blocks(docs: DataFrame, n_docs: int, url: str = "url", text: str = "text", cell_docs: int = CELL_DOCS) -> DataFrame:
    """Blocks ``(term, cell, n, max_tf, min_dl, sum_dl, docs)`` of every document that
    has a token; ``docs`` is ordered by url. One tokenising pass and one shuffle, of
    the documents' words by cell; a cell's blocks are made in one place. The tasks
    are as many as the bytes of the texts need, which are summed first.
    """
    split = max(1, -(-n_docs // cell_docs))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = min(MAX_TASKS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    held = docs.filter(F.col(text).rlike(S.TOKEN_CHAR)).select(F.col(url).alias("url"), S.tokens(F.col(text)).alias("_t"))
    dl = F.size("_t").cast("long")
    dealt = held.select(cell_of(dl, F.col("url"), split).alias("cell"), "url", dl.alias("dl"), F.array_join("_t", " ").alias("words")).repartition(tasks, "cell")
    key = docs.schema[url].dataType.simpleString()
    return dealt.groupBy("cell").applyInArrow(_cell_blocks, f"term string, cell long, n long, max_tf long, min_dl long, sum_dl long, docs array<struct<url:{key},dl:long,tf:long,at:array<int>>>")


def write_blocks(blocks: DataFrame, path: str, buckets: int = 64) -> None:
    """Blocks partitioned by term bucket and sorted by term and cell in each file. They
    are written where they were made, so each task leaves a file in a bucket, and a
    common term lies in several."""
    (with_bucket(blocks, "term", buckets).sortWithinPartitions(BUCKET, "term", "cell")
     .write.partitionBy(BUCKET).option("compression", "zstd").option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))


def read_blocks(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Stored blocks; with ``terms`` (a query's, few) only their folders and row groups,
    the empty term's always among them."""
    from webloom.sources.keyed import read_keyed
    if terms is None:
        return spark.read.parquet(path).drop(BUCKET)
    return read_keyed(spark, path, "term", ["", *terms], buckets)


def corpus(blocks: DataFrame) -> Column:
    """Struct ``(n_docs, avgdl)`` as a scalar, from the headers of the empty term."""
    total = blocks.filter(F.col("term") == "").agg(F.struct(F.sum("n").alias("n_docs"), (F.sum("sum_dl") / F.sum("n")).alias("avgdl")).alias("s"))
    return total.scalar()


def _part(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return idf * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


def _tasks(rows: DataFrame, made: str) -> int:
    """Tasks for the rows that come of these, by their column ``made``."""
    return min(MAX_TASKS, max(1, -(-(rows.agg(F.sum(made)).first()[0] or 0) // TASK_PAIRS)))


class Ranking:
    """Ranked search of a batch of queries ``(query_id, term)`` over stored blocks.

    ``first`` and ``rest`` are the cells ``(query_id, cell, pairs)`` that are read, in
    two steps; ``cells`` all that hold a query's term, with their bounds and their
    pairs of a query's term and a posting. Headers and postings are shuffled by cell,
    once for all queries, and meet these where they lie: what is made for each query
    is summed in its cell's place and never shuffled. So tasks are dealt by the rows
    that are made, not by the bytes that are read.
    """

    def __init__(self, blocks: DataFrame, queries: DataFrame, k: int, k1: float = BM25_K1, b: float = BM25_B):
        self.blocks, self.k, self.k1, self.b = blocks, k, k1, b
        terms = queries.select("query_id", "term").distinct()
        self.wanted = terms.select("term").distinct()
        # Rows of one url that differ in length may lie in several cells: few urls, if any.
        places = blocks.filter(F.col("term") == "").select(F.explode("docs.url").alias("parted")).groupBy("parted").agg(F.count(F.lit(1)).alias("n"))
        self.parted = written_table(places.filter("n > 1").select("parted"), "parted")
        self.is_parted = not self.parted.isEmpty()
        total = corpus(blocks)
        self.avgdl = total["avgdl"]
        df = blocks.select("term", "n").join(self.wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks"))
        idf = F.log(F.lit(1.0) + (total["n_docs"] - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
        held = written_table(terms.join(df, "term").select("query_id", "term", idf.alias("idf"), "blocks"), "terms")
        self.terms = held.drop("blocks")
        heads = blocks.select("term", "cell", "n", "max_tf", "min_dl").join(self.wanted, "term", "left_semi").repartition(_tasks(held, "blocks"), "cell")
        bound = _part(F.col("idf"), F.col("max_tf"), F.col("min_dl"), self.avgdl, k1, b)
        sums = [F.sum(bound).alias("bound"), F.max("n").alias("sure"), F.sum("n").alias("pairs")]
        self.cells = written_table(heads.join(self.terms, "term").groupBy("query_id", "cell").agg(*sums), "cells")
        by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
        # Each cell holds a match at least, so k of them are enough; the limit acts before the shuffle.
        best = self.cells.withColumn("r", F.row_number().over(by_bound)).filter(F.col("r") <= k)
        before = F.sum("sure").over(by_bound.rowsBetween(Window.unboundedPreceding, -1))
        self.first = written_table(best.withColumn("held", F.coalesce(before, F.lit(0))).filter(F.col("held") < k).select("query_id", "cell", "pairs"), "cells")
        self.found = written_table(self.scored(self.first, _tasks(self.first, "pairs"), few=True), "first")
        least = self._best(self.found).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        other = self.cells.join(self.first.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(least, "query_id", "left")
        self.rest = other.filter(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query_id", "cell", "pairs")

    def scored(self, cells: DataFrame, tasks: int, few: bool = False) -> DataFrame:
        """``(query_id, url, score)`` of every match in these cells; a document's terms
        lie in one cell, so no match is split over several, but where a url has rows in
        several cells: these are summed apart from the others. The blocks of other cells
        are left out before the shuffle where the cells are ``few``."""
        asked = cells.groupBy("cell").agg(F.collect_set("query_id").alias("asked")).repartition(tasks, "cell")
        own = self.blocks.join(self.wanted, "term", "left_semi").select("term", "cell", *[F.col(f"docs.{c}").alias(c) for c in ("url", "dl", "tf")])
        if few:
            own = own.join(cells.select("cell").distinct(), "cell", "left_semi")
        each = own.repartition(tasks, "cell").join(asked, "cell").join(self.terms, "term").filter(F.array_contains("asked", F.col("query_id")))
        each = each.select("query_id", "cell", "idf", F.explode(F.arrays_zip("url", "dl", "tf")).alias("d"))
        part = _part(F.col("idf"), F.col("d.tf"), F.col("d.dl"), self.avgdl, self.k1, self.b)
        sums = each.select("query_id", "cell", F.col("d.url").alias("url"), part.alias("part")).groupBy("query_id", "cell", "url").agg(F.sum("part").alias("score"))
        if self.is_parted:
            several = F.col("url").eqNullSafe(F.col("parted"))
            apart = sums.join(self.parted, several, "left_semi").groupBy("query_id", "url").agg(F.sum("score").alias("score"))
            sums = sums.join(self.parted, several, "left_anti").select("query_id", "url", "score").unionByName(apart)
        return sums.select("query_id", "url", report_round("score").alias("score"))

    def _best(self, scores: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("url"))
        return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def best(self) -> DataFrame:
        """``(query_id, url, score, rank)``: the k best by score at six places, ties by url."""
        return self._best(self.found.unionByName(self.scored(self.rest, _tasks(self.cells, "pairs"))))


def best(blocks: DataFrame, queries: DataFrame, k: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """The k best documents of each query of ``(query_id, term)``."""
    return Ranking(blocks, queries, k, k1, b).best()


def search_phrase(blocks: DataFrame, q: str) -> DataFrame:
    """``(url)`` of the documents that hold the query's tokens one after the other,
    from positions alone. Cells that lack one of the terms are left out by their
    headers before any postings are read."""
    slots = S.phrase_tokens(q)
    if not slots:
        return blocks.select(F.explode("docs.url").alias("url")).limit(0)
    terms = list(dict.fromkeys(slots))
    own = blocks.filter(F.col("term").isin(terms))
    whole = own.select("term", "cell").groupBy("cell").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") == len(terms)).select("cell")
    each = own.select("term", "cell", "docs").join(whole, "cell", "left_semi").select("term", F.explode("docs").alias("d"))
    lists = each.groupBy(F.col("d.url").alias("url")).agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("d.at").alias("at")))).alias("at"))

    def starts_of(slot: int, term: str) -> Column:
        return F.transform(F.col("at")[term], lambda p: p - F.lit(slot))

    starts = [starts_of(slot, term) for slot, term in enumerate(slots)]
    held = reduce(F.array_intersect, starts)
    return lists.filter(F.size("at") == len(terms)).filter(F.size(held) > 0).select("url")
