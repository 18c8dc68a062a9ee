"""Substring dedup by relative Lempel-Ziv parsing.

A window is 50 consecutive words. The corpus is cut into reference blocks by
window anchor, so that equal windows lie in the same block; a block is indexed
by its suffix array. Each text of a block is factored greedily against the texts
of smaller doc_id there: the longest match from the current word becomes a
factor, and a factor of at least 50 words is a duplicate span. A window can also
straddle the end of a factor, so the matches from the 49 words before it are
checked, too (the check at factor boundaries); then the spans cover exactly the
windows that start in a document of smaller doc_id.

Equal runs of windows are one content, which enters its block twice however many
copies there are: as the earliest document's and, factored like any other text,
as that of all later ones. Blocks hold about ``BLOCK_WORDS`` words, so there are
as many as the repeated runs need. An anchor with more than ``CROWD`` different
runs would make a block without bound: its windows are dealt singly, by their
own content, which finds the same duplicates.

Defined cases: a null text has no words. A null doc_id counts as the largest.
Rows that repeat both doc_id and text have equal results (their doc_ids are
not smaller than each other). Texts under 50 words lose nothing. Other columns
are never read, and stay as they are in ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import join_hot, keyed, row_key, written
from webloom.llm.repeats import (RUN, WINDOW_ROW, by_load, classes, covered, digest, repeated_of, repeated_runs, run_lists, wanted_runs,
                                 window_rows, with_texts)
from webloom.llm.textbatch import anchored_runs, gram_hashes, groups, joined_words, texts_of, word_hashes, words_of

WINDOW = 50
GRAM = 12
#: Different runs of one anchor that may share a block.
CROWD = 5000
#: Words of a reference block, on the average.
BLOCK_WORDS = 1 << 18


def order_of(id: str) -> Column:
    return F.coalesce(F.col(id).cast("long"), F.lit(2**63 - 1))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, digest and window runs of each text."""
    for batch in batches:
        for lo, data, offsets in groups(*texts_of(batch.column(3))):
            starts, ends, first = words_of(data, offsets)
            codes = word_hashes(data, starts, ends)
            text, at, rows = joined_words(data, starts, ends, first)
            grams = gram_hashes(codes, GRAM)
            begin, n, anchor = anchored_runs(grams, GRAM, first, WINDOW)
            stop = begin + n + WINDOW - 2
            view = memoryview(text)
            to = at + (ends - starts)
            marks = [digest(view[a:b]) for a, b in zip(at[begin].tolist(), to[stop].tolist())]
            row = np.searchsorted(first, begin, "right") - 1
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).slice(lo, len(first) - 1) for c in range(3)],
                pa.array(np.diff(first), pa.int64()),
                pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())], pa.string()),
                run_lists(grams[anchor], marks, begin - first[row], n, np.searchsorted(row, np.arange(len(first)))),
            ], ["key", "ord", "doc_id", "n_words", "sha", "runs"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted run, joined by one space."""
    for batch in batches:
        wanted = batch.column(2)
        for lo, data, offsets in groups(*texts_of(batch.column(1))):
            starts, ends, first = words_of(data, offsets)
            text, at, _ = joined_words(data, starts, ends, first)
            to = at + (ends - starts)
            out = []
            for k in range(len(first) - 1):
                for run in wanted[lo + k].as_py():
                    a = first[k] + run["start"]
                    out.append((run["anchor"], run["lo"], run["hi"], run["ord"], run["times"] > 1, text[at[a]:to[a + run["n"] + WINDOW - 2]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((*[pa.int64()] * 4, pa.bool_(), pa.binary()))], ["anchor", "lo", "hi", "ord", "again", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the wanted runs."""
    for batch in batches:
        wanted = batch.column(2)
        for lo, data, offsets in groups(*texts_of(batch.column(1))):
            starts, ends, first = words_of(data, offsets)
            codes = word_hashes(data, starts, ends)
            runs = [(first[k] + r["start"], r) for k in range(len(first) - 1) for r in wanted[lo + k].as_py()]
            yield window_rows([(r["anchor"], r["lo"], r["hi"], r["ord"]) for _, r in runs], [codes[a:a + r["n"] + WINDOW - 1] for a, r in runs], WINDOW)


def longest_earlier(codes: np.ndarray, first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each word of a block of texts (text r holds codes[first[r]:first[r + 1]]): the
    length of the longest match from it with a text of smaller `order`.

    The block's suffix array is sorted by doubling; the best source of a suffix is the
    nearest one of smaller order before or after it there.
    """
    if not len(codes):
        return np.zeros(0, np.int64)
    # An end mark that equals nothing keeps a match inside its text.
    of = np.searchsorted(first, np.arange(len(codes)), "right") - 1
    ids = np.unique(codes, return_inverse=True)[1]
    rank = np.empty(len(codes) + len(order), dtype=np.int64)
    place = np.arange(len(codes)) + of
    rank[place] = ids
    rank[first[1:] + np.arange(len(order))] = len(codes) + np.arange(len(order))
    n, step, levels = len(rank), 1, []
    while True:
        levels.append(rank.astype(np.int32))
        if step > int(np.diff(first).max()):
            break
        after = np.zeros(n, dtype=np.int64)
        after[:max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (2 * n + 1) + after, return_inverse=True)[1]
        step *= 2
    suffixes = np.argsort(rank)
    whose = np.full(n, np.iinfo(np.int32).max, dtype=np.int32)
    whose[place] = np.unique(order, return_inverse=True)[1][of]
    best = np.zeros(n, dtype=np.int64)
    for sequence in (suffixes, suffixes[::-1]):
        source = _nearest_smaller(whose[sequence])
        a, b = sequence[source >= 0], sequence[source[source >= 0]]
        size = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(levels))):
            x, y = a + size, b + size
            inside = np.maximum(x, y) < n
            same = np.zeros(len(a), dtype=bool)
            same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
            size[same] += 1 << k
        best[a] = np.maximum(best[a], size)
    return best[place]


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, or -1."""
    minima = [values]
    while (width := 1 << len(minima)) <= len(values):
        last, half = minima[-1], width // 2
        grown = last.copy()
        grown[half:] = np.minimum(last[half:], last[:-half])
        minima.append(grown)
    at = np.arange(len(values)) - 1
    for k in reversed(range(len(minima))):
        whole = at >= (1 << k) - 1
        larger = np.zeros(len(values), dtype=bool)
        larger[whole] = minima[k][at[whole]] >= values[whole]
        at[larger] -= 1 << k
    return at


def factor(longest: np.ndarray) -> list[tuple[int, int]]:
    """The greedy factors of a text, given the longest match from each word; a word
    without any is a factor of its own."""
    sizes, out, i = longest.tolist(), [], 0
    while i < len(sizes):
        out.append((i, i + max(1, sizes[i])))
        i = out[-1][1]
    return out


def duplicate_spans(longest: np.ndarray) -> list[tuple[int, int]]:
    """The factors of at least WINDOW words, and the matches of as many that straddle
    the end of a factor: together they cover every window that occurs earlier."""
    spans = []
    for a, b in factor(longest):
        if b - a >= WINDOW:
            spans.append((a, b))
        edge = max(a, b - WINDOW + 1)
        spans.extend((int(s), int(s + longest[s])) for s in np.flatnonzero(longest[edge:b] >= WINDOW) + edge)
    return spans


def _parse_block(table: pa.Table) -> pa.Table:
    """Factor the texts of one reference block, each against the earlier ones. A content
    that occurs again is factored a second time, for all its later copies (`late`)."""
    again = np.flatnonzero(table["again"].to_numpy(zero_copy_only=False))
    late = np.concatenate([np.zeros(table.num_rows, bool), np.ones(len(again), bool)])
    table = table.take(pa.array(np.concatenate([np.arange(table.num_rows), again])))
    data, offsets = texts_of(table["words"])
    starts, ends, first = words_of(data, offsets)
    order = 2 * np.unique(table["ord"].to_numpy(), return_inverse=True)[1] + late
    longest = longest_earlier(word_hashes(data, starts, ends), first, order)
    found = [(r, a, b) for r in range(len(order)) if (longest[first[r]:first[r + 1]] >= WINDOW).any() for a, b in duplicate_spans(longest[first[r]:first[r + 1]])]
    rows = np.array([f[0] for f in found], dtype=np.int64)
    runs = table.select(["anchor", "lo", "hi"]).take(pa.array(rows)).append_column("late", pa.array(late[rows]))
    return runs.append_column("from", pa.array([f[1] for f in found], pa.int32())).append_column("to", pa.array([f[2] for f in found], pa.int32()))


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, scanned, spans): every text; its words and digest; and for each text
    that has some, its duplicate spans in words (key, spans)."""
    spark = docs.sparkSession
    rows = docs.select(row_key(id, text).alias("key"), order_of(id).alias("ord"), F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = written(rows.mapInArrow(_scan, f"key long, ord long, doc_id long, n_words long, sha string, runs array<{RUN}>"), "scanned")
    again = repeated_runs(scanned.select("key", "ord", F.explode("runs").alias("run")).select("key", "ord", "run.*"))
    kinds = written(classes(again), "classes")
    usual, crowded = by_load(kinds, CROWD, "true")
    words = usual.agg(F.sum(F.col("n") + WINDOW - 1)).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BLOCK_WORDS))
    texts = with_texts(rows.select("key", "text"), wanted_runs(usual, "times")).mapInArrow(_runs, "anchor long, lo long, hi long, ord long, again boolean, words binary")
    parsed = texts.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).groupBy("block").applyInArrow(_parse_block, "anchor long, lo long, hi long, late boolean, from int, to int")
    windows = with_texts(rows.select("key", "text"), wanted_runs(crowded)).mapInArrow(_windows, WINDOW_ROW)
    parsed = parsed.unionByName(repeated_of(windows, WINDOW, "ord > least").withColumn("late", F.lit(False)))
    # The later copies of a crowded anchor's content are duplicates as a whole.
    end = (F.col("n") + WINDOW - 1).alias("to")
    parsed = parsed.unionByName(crowded.filter("times > 1").select("anchor", "lo", "hi", F.lit(True).alias("late"), F.lit(0).alias("from"), end))
    of_content = parsed.groupBy("anchor", "lo", "hi").agg(F.collect_set(F.struct("late", "from", "to")).alias("found"))
    named = written(of_content.join(kinds.select("anchor", "lo", "hi", "times", F.col("first.ord").alias("least")), ["anchor", "lo", "hi"]), "parsed")
    members = join_hot(again, named, ["anchor", "lo", "hi"], "times")
    own = F.filter("found", lambda s: s["late"] == (F.col("ord") > F.col("least")))
    parsed = members.select("key", "start", F.explode(own).alias("s")).select("key", (F.col("start") + F.col("s.from")).alias("a"), (F.col("start") + F.col("s.to")).alias("b"))
    spans = parsed.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return rows, scanned.drop("runs"), written(spans, "spans")


def _spans_of(batch: pa.RecordBatch, column: int, row: int) -> np.ndarray:
    spans = batch.column(column)[row].as_py()
    return np.array([(s["a"], s["b"]) for s in spans or ()], dtype=np.int64).reshape(-1, 2)


def _digest_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, shas = [], []
        for lo, data, offsets in groups(*texts_of(batch.column(1))):
            starts, ends, first = words_of(data, offsets)
            for k in range(len(first) - 1):
                gone = covered(_spans_of(batch, 2, lo + k), int(first[k + 1] - first[k]))
                view = data.tobytes() if len(first) == 2 else None
                raw = view if view is not None else data[offsets[k]:offsets[k + 1]].tobytes()
                base = 0 if view is not None else offsets[k]
                keep = np.flatnonzero(~gone) + first[k]
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip((starts[keep] - base).tolist(), (ends[keep] - base).tolist())])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["key", "n_removed", "kept"])


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows, scanned, spans = repeated_spans(docs, id, text)
    changed = with_texts(rows.select("key", "text"), spans).mapInArrow(_digest_kept, "key long, n_removed long, kept string")
    return scanned.join(changed, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with every duplicate span cut out of the text: the words and the
    white space after each, so that what is left keeps its layout. A text that
    repeats wholly becomes empty. Other columns are unchanged."""
    _, _, spans = repeated_spans(docs, id, text)
    docs_columns = list(docs.columns)
    at = docs_columns.index(text)
    joined = keyed(docs, id, text).join(spans, "key", "left")
    joined = joined.select(*[F.col("row").getField(c).alias(c) for c in docs_columns], F.col("spans").alias("_spans_of_row"))

    def cut(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for row in np.flatnonzero(batch.column(len(docs_columns)).is_valid().to_numpy(zero_copy_only=False)):
                raw = np.frombuffer(texts[row].encode(), dtype=np.uint8)
                starts, _, _ = words_of(raw, np.array([0, len(raw)]))
                gone = covered(_spans_of(batch, len(docs_columns), int(row)), len(starts))
                limits = np.append(starts, len(raw))
                drop = covered(np.stack([limits[:-1][gone], limits[1:][gone]], axis=1), len(raw))
                texts[row] = raw[~drop].tobytes().decode()
            arrays = [pa.array(texts, batch.schema.field(at).type) if c == at else batch.column(c) for c in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=docs_columns)

    return joined.mapInArrow(cut, docs.schema)
