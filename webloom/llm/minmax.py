"""Near-duplicate documents by min-max hashing.

A document's set is its distinct shingles of `width` words (4 unless given;
lower-cased A-Z; a shorter text is one shingle). Under each permutation both the least and the greatest
value are kept, so a signature of 128 values costs 64 hash evaluations per
shingle; four values (two permutations) make a band. Texts with equal sets are
collapsed first. In every band bucket each class is compared with the bucket's
most copied class (the hub); full sets confirm a link. Whatever a bucket still
holds in several components is then compared exactly across them, in blocks,
so hubs only save work and no candidate is dropped.

Misses: a pair at similarity exactly 0.8 shares no band with probability
(1 - 0.8**4)**32 = 5e-8.

Defined cases: null or wordless texts have an empty set and link with nothing.
A null doc_id counts as the largest. Repeated rows are copies of each other.
Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import components, holding, join_hot, keyed, row_key, unkeyed, written
from webloom.llm.textbatch import LOWER, gram_hashes, groups, mix, span_hashes, texts_of, word_hashes, words_of

WIDTH = 4
BANDS = 32
PER_BAND = 2  # permutations, two values each
#: Shingles of a block in the exact comparison of a bucket (8 bytes each).
BLOCK = 250_000

_rng = np.random.Generator(np.random.PCG64(6))
_MULTIPLY = _rng.integers(0, 2**31, BANDS * PER_BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 2**32, BANDS * PER_BAND, dtype=np.uint32)
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    low = LOWER[data]
    starts, ends, first = words_of(low, offsets)
    words = word_hashes(low, starts, ends)
    grams = gram_hashes(words, width)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            s = np.sort(grams[a:b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(span_hashes(words[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(words[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys (rows x BANDS) of non-empty sets; a key carries its band's number."""
    flat = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    heads = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for p in range(BANDS * PER_BAND):
        value = (flat ^ _FLIP[p]) * _MULTIPLY[p]
        pair = (np.minimum.reduceat(value, heads).astype(np.uint64) << _U(32)) | np.maximum.reduceat(value, heads)
        band = p // PER_BAND
        keys[:, band] = mix(keys[:, band] * _U(31) + pair + _U(band + 1))
    return keys


def _list_array(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _sign(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offsets in groups(*texts_of(batch.column(2))):
            sets = shingle_sets(data, offsets, width)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands = [np.zeros(0, np.uint64)] * len(sets)
            identity = np.zeros((len(sets), 2), dtype=np.int64)
            if full:
                for k, b in zip(full, signatures([sets[k] for k in full])):
                    bands[k] = b
                    identity[k] = np.frombuffer(hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, len(sets)), batch.column(1).slice(lo, len(sets)),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(identity[:, 0]), pa.array(identity[:, 1]), _list_array(bands),
            ], ["key", "doc_id", "n_shingles", "set_lo", "set_hi", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offsets in groups(*texts_of(batch.column(2))):
            sets = shingle_sets(data, offsets, width)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), _list_array(sets)], ["node", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    near = pairs.join(left, "a").join(right, "b").filter("size(x) * 100 >= size(y) * 80 and size(y) * 100 >= size(x) * 80")
    return near.filter(common * 100 >= (F.size("x") + F.size("y") - common) * 80).select("a", "b")


def _across(table: pa.Table) -> pa.Table:
    """Confirmed links between different components of one block pair of a bucket,
    one for each pair of components; a pair is tested in its first common band."""
    node = table["node"].to_numpy()
    root = table["root"].to_numpy()
    side = table["side"].to_numpy()
    bands = np.stack(table["bands"].to_numpy())
    band = np.argmax(bands[0] == table["bucket"][0].as_py())
    sets = [s.view(np.uint64) for s in table["shingles"].to_numpy()]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    found = {}
    for k in range(len(sets)):
        other = (root > root[k]) & ((side == 2) | (side[k] == 2) | (side != side[k]))
        other &= ((bands == bands[k]).argmax(axis=1) == band) & (size * 100 >= size[k] * 80) & (size[k] * 100 >= size * 80)
        if not other.any():
            continue
        take = other[owner]
        at = np.minimum(np.searchsorted(sets[k], flat[take]), size[k] - 1)
        common = np.bincount(owner[take][sets[k][at] == flat[take]], minlength=len(sets))
        for m in np.flatnonzero(other & (common * 100 >= (size + size[k] - common) * 80)):
            found.setdefault((root[k], root[m]), (node[k], node[m]))
    a, b = zip(*found.values()) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _grouped(docs: DataFrame, id: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its set's identity (key, doc_id, n_shingles, set_lo, set_hi), and every
    class of rows with equal sets: its copies, first row and root. Rows without shingles
    are in no class."""
    rows = docs.select(row_key(id, text).alias("key"), F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(rows.mapInArrow(partial(_sign, width=width), "key long, doc_id long, n_shingles long, set_lo long, set_hi long, bands array<long>"), "signatures")
    filled = signed.filter("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    classes = filled.groupBy("set_lo", "set_hi").agg(
        F.min("key").alias("node"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("size"),
        F.min_by("bands", "key").alias("bands"), F.min(first).alias("first"))
    nodes = written(classes, "classes")

    banded = nodes.select("node", "copies", "size", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total"), F.max_by("node", F.struct("copies", "node")).alias("hub")).filter("members > 1")
    shared = written(banded.join(hubs, "bucket").select("bucket", "total", "node", "hub"), "buckets")
    pairs = shared.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    taking_part = shared.select(F.col("node").alias("key")).distinct()
    sets = written(holding(rows, taking_part, "key").dropDuplicates(["key"]).mapInArrow(partial(_sets, width=width), "node long, shingles array<long>"), "sets")
    links = written(_confirmed(pairs, sets), "confirmed")

    roots = components(links)
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    rest = written(rooted.join(split, "bucket").select("bucket", "total", "node", "root"), "rest")
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = rest.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "root",
                           F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    crossing = placed.join(nodes.select("node", "bands"), "node").join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(_across, "a long, b long")
    crossing = written(crossing.distinct(), "crossing")
    joined = roots if crossing.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(crossing))

    named = nodes.select("set_lo", "set_hi", "node", "copies", "first").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return signed, written(named.select("set_lo", "set_hi", "copies", "first", "root"), "named")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, doc_id, n_shingles, component_id, kept of every row."""
    signed, classes = _grouped(docs, id, text, width)
    light = ["key", "doc_id", "n_shingles"]
    roots = written(classes.groupBy("root").agg(F.count(F.lit(1)).alias("classes"), F.min("first").alias("first")).select("root", "classes", F.col("first.doc_id").alias("component_id")), "roots")
    named = written(join_hot(classes.select("set_lo", "set_hi", "copies", "root"), roots, ["root"], "classes").select("set_lo", "set_hi", "copies", "component_id"), "components")
    member = join_hot(signed.filter("n_shingles > 0").select(*light, "set_lo", "set_hi"), named, ["set_lo", "set_hi"], "copies")
    empty = signed.filter("n_shingles = 0").select(*light, F.col("doc_id").alias("component_id"))
    every = member.select(*light, "component_id").unionByName(empty)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id (of
    several, or of null ids alone, that of the least key), its columns
    unchanged; a repeated row stays once, and so does each without words."""
    signed, classes = _grouped(docs, id, text, width)
    one = classes.groupBy("root").agg(F.min("first").alias("first")).select("first.key")
    kept = one.unionByName(signed.filter("n_shingles = 0").select("key")).distinct()
    return unkeyed(keyed(docs, id, text).join(kept, "key").dropDuplicates(["key"]), docs.columns)
