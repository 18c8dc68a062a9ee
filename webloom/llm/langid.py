"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of every labelled text per language (summed
by Spark), the log-probability matrix (buckets x languages) is broadcast, and
whole texts are scored in numpy batches. With more languages than one matrix may
hold, blocks of them are scored one after the other and their best languages
and probability masses are combined, which gives the same result.

Defined cases: a null text, or one without any letter, is predicted ``und``
with score 0. Rows with a null text or null label are not learned from. With
nothing to learn from every text is ``und``. Repeated rows each count and each
get a result. Equal posteriors go to the alphabetically first language. Only
the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import join_hot, scratch, unkeyed, written
from webloom.llm.textbatch import groups, mix, texts_of
from webloom.operators.paging import with_row_index

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the broadcast matrix: languages x buckets x 8 bytes (256 MiB).
MAX_LANGUAGES = 512
#: Languages of a block, where one matrix cannot hold them all (64 MiB).
BLOCK_LANGUAGES = 128
#: Languages whose dense counts a counting task holds at a time (32 MiB).
DENSE = 64
SMOOTHING = 0.5
UNKNOWN = "und"

_CODES = [chr(i) for i in range(0x10000)]
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(_CODES)], dtype=np.uint32)
_LETTER = np.packbits(np.array([chr(i).isalpha() for i in range(0x110000)]))
_U = np.uint64


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order; log priors; log P(bucket | language)."""

    languages: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of UTF-8 rows."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    heads = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return points, heads[offsets]


def has_letter(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = (_LETTER[points >> 3] >> (7 - (points & 7)).astype(np.uint8)) & 1
    seen = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(letter, out=seen[1:])
    return seen[offsets[1:]] > seen[offsets[:-1]]


def ngram_buckets(points: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram at each position; BUCKETS where
    the row ends before the n-gram does."""
    low = np.where(points < 0x10000, _LOWER[np.minimum(points, 0xFFFF)], points).astype(np.uint64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(points))
    code = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code[:len(low) - n + 1] = code[:len(low) - n + 1] * _U(0x110001) + low[n - 1:] + _U(1)
        if n in ORDERS:
            bucket = (mix(code + _U(n << 56)) >> _U(48)).astype(np.int64)
            yield np.where(left >= n, bucket, BUCKETS)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket -1) and n-grams of each language. Dense counts of at most
    `DENSE` languages are held at a time; a language may come in several pieces."""
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}

    def piece(name, bucket, n, of_rows):
        return pa.RecordBatch.from_arrays([
            pa.array([name] * (len(bucket) + 1), pa.string()),
            pa.array(np.append(bucket, -1), pa.int32()),
            pa.array(np.append(n, of_rows), pa.int64())], ["language", "bucket", "n"])

    def flush():
        for name, c in counts.items():
            used = np.flatnonzero(c[:BUCKETS])
            yield piece(name, used, c[used], rows[name])
        counts.clear()
        rows.clear()

    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), dtype=object)
        for lo, data, offsets in groups(*texts_of(batch.column(0))):
            points, at = code_points(data, offsets)
            mine = labels[lo:lo + len(at) - 1]
            names, which = np.unique(mine.astype(str), return_inverse=True)
            of = np.repeat(which, np.diff(at))
            if len(names) > DENSE:
                code, n = np.unique(np.concatenate([of * (BUCKETS + 1) + bucket for bucket in ngram_buckets(points, at)]), return_counts=True)
                real = code % (BUCKETS + 1) < BUCKETS
                code, n = code[real], n[real]
                cuts = np.searchsorted(code, np.arange(len(names) + 1) * (BUCKETS + 1))
                for k, of_rows in enumerate(np.bincount(which)):
                    yield piece(names[k], code[cuts[k]:cuts[k + 1]] % (BUCKETS + 1), n[cuts[k]:cuts[k + 1]], int(of_rows))
                continue
            if len(counts.keys() | set(names)) > DENSE:
                yield from flush()
            for name, n in zip(names, np.bincount(which)):
                rows[name] = rows.get(name, 0) + int(n)
                counts.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))
            for bucket in ngram_buckets(points, at):
                for k, name in enumerate(names):
                    counts[name] += np.bincount(bucket[of == k], minlength=BUCKETS + 1)
    yield from flush()


def ngram_counts(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """language, bucket, n over every row with text and label (no sample: all are
    counted); bucket -1 counts a language's rows."""
    labelled = docs.select(F.col(text).alias("t"), F.col(label).cast("string").alias("l")).filter("t is not null and l is not null")
    counted = labelled.mapInArrow(_count_batches, "language string, bucket int, n long")
    return counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame, smoothing: float, rows: int | None = None) -> Model:
    """The model of the languages in `counts`. If these are a block of the
    languages, `rows` are the learned rows of all."""
    whole = F.sort_array(F.collect_list(F.struct("bucket", "n")))
    found = counts.groupBy("language").agg(whole.alias("c")).limit(MAX_LANGUAGES + 1).select("language", "c.bucket", "c.n").toArrow().sort_by("language")
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels in one matrix; identify scores more in blocks")
    table = np.full((BUCKETS + 1, max(1, len(found))), smoothing)
    docs_of = np.ones(max(1, len(found)))
    for k, (bucket, n) in enumerate(zip(found["bucket"], found["n"])):
        bucket, n = bucket.values.to_numpy(), n.values.to_numpy()
        docs_of[k] = n[0]
        table[bucket[1:], k] += n[1:]
    table[:BUCKETS] = np.log(table[:BUCKETS]) - np.log(table[:BUCKETS].sum(axis=0))
    table[BUCKETS] = 0.0
    return Model(tuple(found["language"].to_pylist()), np.log(docs_of / (docs_of.sum() if rows is None else rows)), table)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", smoothing: float = SMOOTHING) -> Model:
    """Learn from every row with text and label. One matrix holds at most
    `MAX_LANGUAGES` languages, more are refused; `identify` and
    `keep_identified` take any number of them, in blocks."""
    return _model(ngram_counts(docs, text, label), smoothing)


def fit_blocks(docs: DataFrame, text: str = "text", label: str = "lang", smoothing: float = SMOOTHING) -> Iterator[Model]:
    """Models of consecutive languages in alphabetical order: one, if
    `MAX_LANGUAGES` hold all, else one for each `BLOCK_LANGUAGES` of them. Their
    joint log probabilities compare, as all share the rows learned from."""
    counts = written(ngram_counts(docs, text, label), "ngrams")
    languages = counts.filter("bucket = -1").select("language", "n")
    many, rows = languages.agg(F.count(F.lit(1)), F.sum("n")).first()
    if many <= MAX_LANGUAGES:
        yield _model(counts, smoothing)
        return
    place = with_row_index(languages.select("language"), "language", name="place").select("language", F.floor(F.col("place") / BLOCK_LANGUAGES).alias("block"))
    placed = counts.join(place, "language")
    path = scratch(docs.sparkSession, "blocks")
    placed.write.partitionBy("block").parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    for block in range(-(-many // BLOCK_LANGUAGES)):
        yield _model(stored.filter(F.col("block") == block).select("language", "bucket", "n"), smoothing, rows)


def score_rows(points: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Log joint of each row and language, in pieces of bounded size."""
    out = np.tile(model.prior, (len(offsets) - 1, 1))
    step = max(1, (1 << 21) // len(model.prior))
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for bucket in ngram_buckets(points, offsets):
        for a in range(0, len(bucket), step):
            row = of[a:a + step]
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out[row[head]] += np.add.reduceat(model.table[bucket[a:a + step]], head, axis=0)
    return out


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text",
            held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the prediction) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id).alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches):
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            pred = np.full(batch.num_rows, len(model.languages))
            best = np.zeros(batch.num_rows)
            if model.languages:
                for lo, data, offsets in groups(*texts_of(batch.column(2))):
                    points, at = code_points(data, offsets)
                    letters = has_letter(points, at)
                    joint = score_rows(points, at, model)
                    joint = np.exp(joint - joint.max(axis=1, keepdims=True))
                    top = joint.argmax(axis=1)
                    pred[lo:lo + len(top)] = np.where(letters, top, len(model.languages))
                    best[lo:lo + len(top)] = np.where(letters, joint.max(axis=1) / joint.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[pred], pa.string()), pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _best_of_block(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text with a letter (columns 0 and 1: its key) the best language of
    a block, its joint log probability, and the block's mass in units of it."""
    for batch in batches:
        for lo, data, offsets in groups(*texts_of(batch.column(2))):
            points, at = code_points(data, offsets)
            joint = score_rows(points, at, model)
            top = joint.argmax(axis=1)
            best = joint.max(axis=1)
            mass = np.exp(joint - best[:, None]).sum(axis=1)
            letters = pa.array(has_letter(points, at))
            names = np.array(model.languages, dtype=object)[top]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, len(top)), batch.column(1).slice(lo, len(top)),
                pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(mass, pa.float64())], ["k1", "k2", "lang", "best", "mass"]).filter(letters)


def _text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits of a text, on which alone its prediction depends."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def best_over_blocks(docs: DataFrame, models: Iterable[Model], text: str = "text") -> DataFrame:
    """k1, k2, copies, lang_pred, score of every different text that has a letter: the
    blocks' best languages and masses, combined. Each block's matrix is broadcast,
    used and freed before the next; only keys and figures are shuffled."""
    spark = docs.sparkSession
    rows = docs.select(*_text_keys(F.col(text)), F.col(text).alias("t")).filter("t is not null")
    parts = []
    for model in models:
        shared = spark.sparkContext.broadcast(model)
        scored = rows.mapInArrow(lambda batches: _best_of_block(shared.value, batches), "k1 long, k2 long, lang string, best double, mass double")
        parts.append(written(scored.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("best", "mass", "lang")).alias("b")).select("k1", "k2", "copies", "b.*"), "block"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("lang", "best", "mass")).alias("blocks"))
    high = every.withColumn("high", F.array_max("blocks.best"))
    winners = F.filter("blocks", lambda b: b["best"] == F.col("high"))
    mass = F.aggregate("blocks", F.lit(0.0), lambda sum, b: sum + b["mass"] * F.exp(b["best"] - F.col("high")))
    return high.select("k1", "k2", "copies", F.array_min(F.transform(winners, lambda b: b["lang"])).alias("lang_pred"), (F.lit(1.0) / mass).alias("score"))


def held_out_rows(id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """The fold held out of training; a row without id is held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % folds == fold, F.lit(True))


def _models(docs: DataFrame, id: str, text: str, label: str) -> tuple[Model, Iterator[Model] | None]:
    """The one model of the rows to learn from, or the first block's and all of them."""
    blocks = fit_blocks(docs.filter(~held_out_rows(id)), text, label)
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Learn from the rows outside the held-out fold and predict every row."""
    held = held_out_rows(id)
    model, blocks = _models(docs, id, text, label)
    if blocks is None:
        return predict(docs, model, id, text, held)
    found = written(best_over_blocks(docs, blocks, text), "found")
    rows = docs.select(F.col(id).alias("doc_id"), held.alias("held_out"), *_text_keys(F.col(text)))
    return join_hot(rows, found, ["k1", "k2"], "copies", "left").select(
        "doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def keep_identified(docs: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", least: float = 0.5) -> DataFrame:
    """Rows whose language is recognised: not ``und`` and a posterior of at least
    `least`. Columns and values are unchanged; the filter is one narrow pass,
    or, with more languages than one matrix holds, a semi-join on the texts' keys."""
    model, blocks = _models(docs, id, text, label)
    if blocks is not None:
        good = best_over_blocks(docs, blocks, text).filter(F.col("score") >= least).select("k1", "k2", "copies")
        rows = docs.select(*_text_keys(F.col(text)), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        return unkeyed(join_hot(rows, written(good, "found"), ["k1", "k2"], "copies"), docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches):
        model = shared.value
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            if model.languages:
                for lo, data, offsets in groups(*texts_of(batch.column(at))):
                    points, rows = code_points(data, offsets)
                    joint = score_rows(points, rows, model)
                    sure = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1) >= least
                    good[lo:lo + len(sure)] = sure & has_letter(points, rows)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
