"""Ranked lexical search in a K2-treap over the term-document grid.

A block of documents is a grid: terms are rows (the frequent ones first),
documents are columns by id, and a cell holds the impact of a term in a
document. The grid is cut into quarters again and again; only quarters that
hold something are kept, each with the greatest impact in it (stored as the
difference from the quarter around it) and four bits that say which of its own
quarters are kept. To rank the block's documents for an item, the paths of the
item's terms descend together: a range of documents is worth at most the sum of
weight times greatest impact over the terms' cells, the ranges worth most are
halved first, and a range that cannot reach the k-th best document found is
left alone. A range of one document is worth exactly its score.

Blocks are rows of a written index (columns, terms with their document counts,
quarters), made once for all items; a block ends at ``BLOCK_POSTINGS`` cells, so
no word and no text, however common or long, decides how large a task is. Items
come in blocks of ``ITEM_BYTES``, the only thing that is broadcast, and each
block of items reads the index once. A document block gives at most k rows for
an item; the k best of all are kept by a window whose limit acts before the
shuffle.

Defined cases: a null or termless document is in no block and has no score; an
item without terms that occur has no rows. A null document id comes after all
others at equal scores. Repeated document rows are ranked each; repeated item
rows are one item, and rows of one item id with different texts are ranked each
for itself. Other columns are never read. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import written
from webloom.llm.textbatch import LOWER, groups, texts_of

TOP = 10
#: Cells of a block (a longer text is a block of its own) and bytes of a block of items.
BLOCK_POSTINGS = 250_000
ITEM_BYTES = 4 << 20
#: Cells that the items searched together may have in a block.
TOGETHER = 1_000_000
#: Ranges halved at once for each item, doubled from step to step.
FIRST_STEP, LARGEST_STEP = 8, 1024

#: The term bytes of the contract: 0-9, A-Z, a-z and all above ASCII.
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_BITS = np.array([bin(m).count("1") for m in range(16)], dtype=np.int64)
_none = np.zeros(0, np.int64)


# ---- terms ------------------------------------------------------------------

def term_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes begin a term."""
    inside = IS_TERM[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    fresh[heads] = inside[heads]
    return fresh


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms with their repeats, of each batch."""
    for batch in batches:
        held = terms = 0
        for _, data, offsets in groups(*texts_of(batch.column(0))):
            upto = np.append(0, np.cumsum(term_starts(data, offsets)))
            n = upto[offsets[1:]] - upto[offsets[:-1]]
            held, terms = held + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"held": [held], "terms": [terms]})


def postings(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, document, term, tf) of the cells of a group of texts, and each
    document's number of terms. Terms are told apart by their bytes, not by a hash."""
    fresh = term_starts(data, offsets)
    starts = np.flatnonzero(fresh)
    of = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(of, minlength=len(offsets) - 1)
    inside = IS_TERM[data]
    begins = np.append((np.cumsum(inside) - 1)[starts], inside.sum()).astype(np.int32)
    kept = np.ascontiguousarray(LOWER[data[inside]])
    listed = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(begins), pa.py_buffer(kept)]).dictionary_encode()
    names = listed.dictionary
    cell, tf = np.unique(of * len(names) + listed.indices.to_numpy(), return_counts=True)
    return names, cell // max(len(names), 1), cell % max(len(names), 1), tf, n


# ---- the tree ---------------------------------------------------------------

def plant(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[int, bytes]:
    """(depth, quarters) of a grid's distinct cells; values are above 0."""
    depth = max(int(max(rows.max(), columns.max())).bit_length(), 1)
    code = np.zeros(len(rows), dtype=np.uint64)
    for level in range(depth - 1, -1, -1):
        quarter = ((rows >> level) & 1) * 2 + ((columns >> level) & 1)
        code = (code << np.uint64(2)) | quarter.astype(np.uint64)
    order = np.argsort(code)
    code, top = code[order], values[order].astype(np.int64)
    masks, less = [], []
    for _ in range(depth):
        parent = code >> np.uint64(2)
        head = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        bit = (1 << (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        masks.append(np.bitwise_or.reduceat(bit, head))
        above = np.maximum.reduceat(top, head)
        less.append(np.repeat(above, np.diff(np.append(head, len(code)))) - top)
        code, top = parent[head], above
    mask = np.concatenate(masks[::-1])
    drop = np.concatenate([top, *less[::-1]]).astype("<u4")
    sizes = np.array([len(mask), len(drop)], dtype="<u4").tobytes()
    half = np.append(mask, np.zeros(len(mask) % 2, np.uint8))
    planes = drop.view(np.uint8).reshape(-1, 4).T.tobytes()
    return depth, zlib.compress(sizes + (half[::2] | half[1::2] << 4).tobytes() + planes, 1)


class Tree:
    """Quarters level by level: greatest impact, kept quarters, first of them."""

    def __init__(self, depth: int, packed: bytes):
        raw = zlib.decompress(packed)
        inner, all_ = np.frombuffer(raw, dtype="<u4", count=2)
        pairs = np.frombuffer(raw, dtype=np.uint8, count=(int(inner) + 1) // 2, offset=8)
        self.depth = depth
        self.mask = np.stack([pairs & 15, pairs >> 4], axis=1).ravel()[:inner]
        planes = np.frombuffer(raw, dtype=np.uint8, offset=8 + len(pairs)).reshape(4, int(all_))
        self.top = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        many = _BITS[self.mask]
        self.first = np.cumsum(many) - many + 1
        at, size = 0, 1
        for _ in range(depth):
            below = many[at:at + size]
            first, count = at + size, int(below.sum())
            self.top[first:first + count] = np.repeat(self.top[at:at + size], below) - self.top[first:first + count]
            at, size = first, count

    def best(self, item: np.ndarray, row: np.ndarray, weight: np.ndarray, items: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, column, score) of the k best columns of each item above score 0, ties to the
        least column. `item`, ascending, names the item of each (row, weight)."""
        found = (_none, _none, _none)
        level_score, last_column = np.zeros(items, np.int64), np.full(items, -1, np.int64)
        # Ranges: item, depth, column, bound, number of cells. Cells: row, weight, node.
        heads = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else _none
        bound = np.add.reduceat(weight * self.top[0], heads) if len(item) else _none
        ranges = [item[heads], np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64), bound, np.diff(np.append(heads, len(item)))]
        cells = [row, weight, np.zeros(len(row), np.int64)]
        step = FIRST_STEP
        while len(ranges[0]):
            of, deep, column, bound, size = ranges
            live = (bound > level_score[of]) | ((bound == level_score[of]) & (column < last_column[of]))
            order = np.lexsort((column, -bound, of))
            order = order[live[order]]
            start = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1])) if len(order) else _none
            place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            now = np.sort(order[place < step])
            later = np.sort(order[place >= step])
            step = min(2 * step, LARGEST_STEP)
            at = np.cumsum(size) - size
            rest, rest_cells = [x[later] for x in ranges], [x[_spans(at[later], size[later])] for x in cells]
            row, weight, node = (x[_spans(at[now], size[now])] for x in cells)
            owner = np.repeat(np.arange(len(now)), size[now])
            shift = self.depth - 1 - deep[now]
            half = ((row >> shift[owner]) & 1) * 2
            grown, grown_cells = [rest], [rest_cells]
            for side in (0, 1):
                quarter = half + side
                mask = self.mask[node].astype(np.int64)
                has = np.flatnonzero((mask >> quarter) & 1)
                child = self.first[node[has]] + _BITS[mask[has] & ((1 << quarter[has]) - 1)]
                mine = owner[has]
                head = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else _none
                worth = np.add.reduceat(weight[has] * self.top[child], head) if len(mine) else _none
                parent = now[mine[head]]
                new = [of[parent], deep[parent] + 1, column[parent] + (side << shift[mine[head]]), worth, np.diff(np.append(head, len(mine)))]
                leaf = new[1] == self.depth
                found = tuple(np.append(a, b[leaf]) for a, b in zip(found, (new[0], new[2], new[3])))
                inner = np.flatnonzero(~leaf)
                places = _spans(head[inner], new[4][inner])
                grown.append([x[inner] for x in new])
                grown_cells.append([row[has][places], weight[has][places], child[places]])
            ranges = [np.concatenate(x) for x in zip(*grown)]
            cells = [np.concatenate(x) for x in zip(*grown_cells)]
            found = _foremost(*found, k)
            number = np.bincount(found[0], minlength=items)
            full = np.flatnonzero(number[found[0]] == k)
            last = full[np.append(found[0][full][1:] != found[0][full][:-1], True)] if len(full) else full
            level_score[found[0][last]], last_column[found[0][last]] = found[2][last], found[1][last]
        return found


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, ..., start + size - 1 of each span, one after the other."""
    if not len(starts):
        return _none
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _foremost(item: np.ndarray, column: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each item: highest score, then least column."""
    good = score > 0
    item, column, score = item[good], column[good], score[good]
    order = np.lexsort((column, -score, item))
    item, column, score = item[order], column[order], score[order]
    if not len(item):
        return item, column, score
    start = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    place = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
    return item[place < k], column[place < k], score[place < k]


# ---- the index --------------------------------------------------------------

def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A term's impact in a document of n terms, before its weight: whole numbers only."""
    # 90 * n * documents passes 64 bits only beyond 1e17 for n * documents.
    m = 10 + (90 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


INDEX = "doc_ids array<long>, terms array<string>, df array<int>, depth int, quarters binary"


def _blocks(documents: int, terms: int):
    def block(parts: list[tuple]) -> tuple:
        ids = [i for p in parts for i in p[0]]
        by_id = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        column = np.empty(len(ids), dtype=np.int64)
        column[by_id] = np.arange(len(ids))
        encoded = pa.chunked_array([p[1] for p in parts]).combine_chunks().dictionary_encode()
        local = encoded.indices.to_numpy().astype(np.int64)
        shift = np.cumsum([0, *(len(p[1]) for p in parts)])
        term = np.concatenate([local[p[3] + s] for p, s in zip(parts, shift)])
        first = np.cumsum([0, *(len(p[0]) for p in parts)])
        doc = np.concatenate([p[2] + f for p, f in zip(parts, first)])
        tf, n = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        df = np.bincount(term, minlength=len(encoded.dictionary))
        frequent = np.argsort(-df, kind="stable")
        row = np.empty(len(df), dtype=np.int64)
        row[frequent] = np.arange(len(df))
        depth, packed = plant(row[term], column[doc], impact(tf, n[doc], documents, terms))
        return [ids[k] for k in by_id], encoded.dictionary.take(pa.array(frequent)), df[frequent], depth, packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, data, offsets in groups(*texts_of(batch.column(1))):
                names, doc, term, tf, n = postings(data, offsets)
                with_terms = np.flatnonzero(n)
                if not len(with_terms):
                    continue
                doc = np.searchsorted(with_terms, doc)
                parts.append(([ids[lo + k] for k in with_terms], names, doc, term, tf, n[with_terms]))
                held += len(doc)
                if held >= BLOCK_POSTINGS:
                    yield _index_row(block(parts))
                    parts, held = [], 0
        if parts:
            yield _index_row(block(parts))

    return run


def _index_row(row: tuple) -> pa.RecordBatch:
    ids, names, df, depth, packed = row
    return pa.RecordBatch.from_arrays([
        pa.array([ids], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
        pa.array([df.tolist()], pa.list_(pa.int32())), pa.array([depth], pa.int32()), pa.array([packed], pa.binary())],
        ["doc_ids", "terms", "df", "depth", "quarters"])


def build(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """The written index of all documents, the number of documents that hold a term, and
    the number of their terms with repeats."""
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = texts.select("text").mapInArrow(_counts, "held long, terms long").agg(F.sum("held"), F.sum("terms")).first()
    documents, terms = int(total[0] or 0), int(total[1] or 0)
    return written(texts.mapInArrow(_blocks(documents, terms), INDEX), "treap"), documents, terms


# ---- the search -------------------------------------------------------------

def weighted(items: DataFrame, index: DataFrame, documents: int, id: str, text: str) -> DataFrame:
    """(query, item_id, terms, weights) of every item with a term that occurs; `query` is its own."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.translate(F.coalesce(F.col(text), F.lit("")), upper, lower)
    asked = items.select(F.col(id).alias("item_id"), F.sort_array(F.array_distinct(F.array_remove(F.split(low, GAP), ""))).alias("terms")).distinct()
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()), "items")
    each = asked.select("query", "item_id", F.explode("terms").alias("term"))
    counted = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = counted.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * documents + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    listed = each.join(df, "term").groupBy("query", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("t"))
    return written(listed.select("query", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "weighted")


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        names = pa.array([t for _, terms, _ in items for t in terms], pa.string())
        of = np.repeat(np.arange(len(items)), np.array([len(terms) for _, terms, _ in items], dtype=np.int64))
        weight = np.array([w for _, _, weights in items for w in weights], dtype=np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                rows = pc.index_in(names, value_set=batch.column(1).slice(r, 1).flatten())
                here = np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False))
                if not len(here):
                    continue
                row = rows.fill_null(0).to_numpy()[here].astype(np.int64)
                df = batch.column(2).slice(r, 1).flatten().to_numpy()[row]
                ids = batch.column(0).slice(r, 1).flatten()
                tree = Tree(batch.column(3)[r].as_py(), batch.column(4)[r].as_py())
                for lo, hi in _together(of[here], df, len(items)):
                    mine = slice(*np.searchsorted(of[here], [lo, hi]))
                    item, column, score = tree.best(of[here][mine] - lo, row[mine], weight[here][mine], hi - lo, k)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([items[i][0] for i in item + lo], pa.int64()), ids.take(pa.array(column)), pa.array(score)], ["query", "doc_id", "score"])

    return run


def _together(of: np.ndarray, df: np.ndarray, items: int) -> Iterator[tuple[int, int]]:
    """Consecutive items (from, to) whose terms have about ``TOGETHER`` cells in all."""
    upto = np.cumsum(np.bincount(of, weights=df, minlength=items))
    lo = 0
    while lo < items:
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + TOGETHER, "right")))
        yield lo, hi
        lo = hi


def search(docs_index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every row of `items` (see ``weighted``)."""
    spark = items.sparkSession
    # The index is read once for each block of items, which alone is sent to the executors.
    found, block, size = None, [], 0

    def searched(last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        hits = docs_index.mapInArrow(_searcher(shared, k), "query long, doc_id long, score long")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        hits = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if not last:
            hits = written(hits, "hits")
            shared.unpersist()
        return hits if found is None else found.unionByName(hits)

    for r in items.select("query", "terms", "weights").toLocalIterator():
        block.append((r["query"], r["terms"], r["weights"]))
        size += sum(len(t.encode()) + 16 for t in r["terms"])
        if size >= ITEM_BYTES:
            found = searched(False)
            block, size = [], 0
    found = searched(True)
    return found.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    index, documents, _ = build(docs, id, text)
    return search(index, weighted(items, index, documents, item_id, item_text), k)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked(docs, items)


#: The same over all cells, for DuckDB.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, list_sort(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))) AS terms FROM benchmark),
q AS (SELECT row_number() OVER () AS q, item_id, terms FROM i),
e AS (SELECT q, item_id, unnest(terms) AS term FROM q),
s AS (SELECT count(DISTINCT r) AS n, count(*)::BIGINT AS l FROM d),
c AS (SELECT r, any_value(doc_id) AS doc_id, 10 + (90 * count(*) * (SELECT n FROM s)) // (SELECT l FROM s) AS m FROM d GROUP BY r),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM d GROUP BY r, term),
w AS (SELECT term, floor(1000.0 * ln((2.0 * (SELECT n FROM s) + 2) / (2.0 * count(*) + 1)))::BIGINT AS w FROM t GROUP BY term),
p AS (SELECT q, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM e JOIN t USING (term) JOIN w USING (term) JOIN c USING (r) GROUP BY q, item_id, doc_id, r HAVING score > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
