"""Windows that repeat across a corpus, found without moving the texts.

Every window of a text belongs to one run: the consecutive windows that share
an anchor (``textbatch.anchored_runs``). Equal windows share the anchor, so
only runs whose anchor occurs again can hold a repeated window, and only these
rows are shuffled further. Runs of equal content (exact copies) are collapsed
to a class before any text is fetched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import holding, written
from webloom.llm.textbatch import gram_hashes, mix

RUN = "struct<anchor:bigint,lo:bigint,hi:bigint,start:int,n:int>"
_RUN = [("anchor", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]


def run_lists(anchors: np.ndarray, digests: list[bytes], starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs as a list column; row r holds runs first[r]:first[r + 1]."""
    pair = np.array(np.frombuffer(b"".join(digests), dtype=np.int64)).reshape(-1, 2) if digests else np.zeros((0, 2), np.int64)
    columns = [anchors.view(np.int64), pair[:, 0], pair[:, 1], starts.astype(np.int32), sizes.astype(np.int32)]
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c), t) for c, (_, t) in zip(columns, _RUN)], [name for name, _ in _RUN])
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32), pa.int32()), values)


def digest(content) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def repeated_runs(runs: DataFrame) -> DataFrame:
    """The runs (anchor, lo, hi, key, ord, start, n) whose anchor occurs again,
    with `mixed`: the anchor occurs in runs of different content."""
    again = written(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), (F.min("lo") != F.max("lo")).alias("mixed")).filter("times > 1").select("anchor", "mixed"), "anchors")
    return written(holding(runs, again, "anchor").join(again, "anchor"), "runs")


def classes(runs: DataFrame) -> DataFrame:
    """Runs of equal content as one row: the first of them by (ord, key, start),
    and how many there are."""
    return runs.groupBy("anchor", "lo", "hi").agg(
        F.min(F.struct("ord", "key", "start")).alias("first"), F.count(F.lit(1)).alias("times"),
        F.min("n").alias("n"), F.min("mixed").alias("mixed"))


def wanted_runs(of_classes: DataFrame, *more: str) -> DataFrame:
    """For each document the runs to read from its text, with `more` columns: key, wanted."""
    one = of_classes.select(F.col("first.key").alias("key"), F.struct("anchor", "lo", "hi", F.col("first.ord").alias("ord"), F.col("first.start").alias("start"), "n", *more).alias("run"))
    return one.groupBy("key").agg(F.sort_array(F.collect_list("run")).alias("wanted"))


def by_load(of_classes: DataFrame, most: int, which: str = "mixed") -> tuple[DataFrame, DataFrame]:
    """Classes (whose anchor has different contents, or `which` others): those of anchors
    with at most `most` of them, which may share a task, and the rest, which may not."""
    several = of_classes.filter(which)
    loads = written(several.groupBy("anchor").agg(F.count(F.lit(1)).alias("load")).filter(F.col("load") > most), "loads")
    return several.join(loads, "anchor", "left_anti"), several.join(loads.select("anchor"), "anchor", "left_semi")


def window_rows(runs: list[tuple], units: list[np.ndarray], window: int) -> pa.RecordBatch:
    """Each window of the runs (anchor, lo, hi, ord) with two hashes of its units."""
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    flat = np.concatenate([*units, np.zeros(0, np.uint64)])
    ends = np.cumsum(sizes)
    count = sizes - window + 1
    of = np.repeat(np.arange(len(units)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = (ends - sizes)[of] + at
    hashes = [gram_hashes(u, window)[start].view(np.int64) for u in (flat, mix(flat + np.uint64(1)))] if len(of) else [np.zeros(0, np.int64)] * 2
    own = [np.array([r[c] for r in runs], dtype=np.int64)[of] for c in range(4)] if runs else [np.zeros(0, np.int64)] * 4
    return pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(at.astype(np.int32)), *map(pa.array, hashes)], WINDOW_NAMES)


WINDOW_NAMES = ["anchor", "lo", "hi", "ord", "at", "one", "two"]
WINDOW_ROW = "anchor long, lo long, hi long, ord long, at int, one long, two long"


def repeated_of(windows: DataFrame, window: int, condition: str) -> DataFrame:
    """Spans (anchor, lo, hi, from, to) of the windows that repeat. Every window is a
    row, dealt by its own content and counted before the shuffle, so no anchor is
    gathered; `condition` compares `ord` with `least` and `times`."""
    rows = written(windows, "windows")
    kinds = rows.groupBy("one", "two").agg(F.min("ord").alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    return rows.join(kinds, ["one", "two"]).filter(condition).select("anchor", "lo", "hi", F.col("at").alias("from"), (F.col("at") + window).alias("to"))


def with_texts(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """`rows` (key, text, ...) joined with per-document lists; only documents
    that have a list are shuffled, and a repeated row stays once."""
    return holding(rows, lists, "key").join(lists, "key").dropDuplicates(["key"])


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in one of the (start, end) spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return np.cumsum(step[:-1]) > 0
