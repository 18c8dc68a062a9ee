"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to `ORDER` bytes, with counts of the
byte that follows each context in the training texts. A byte is predicted from
its longest context. If it was never seen there, the model escapes to the next
shorter context (method D: a context with n symbols of d kinds escapes with
probability d / 2n, and a kind seen c times has (2c - 1) / 2n), where every byte
seen in the longer context is excluded. Below the empty context all bytes not yet excluded are equally
likely. A text ends with the byte 0xFF and starts after 0xFE bytes, which never
occur in UTF-8, so code lengths are those of a proper distribution.

Nothing of the model is broadcast but its order-1 part (65,536 counts). Texts
are dealt into parts; a part asks for the n-grams and words that it holds, once
each. Requests are dealt by the last two context bytes, so one shard has every
longer context of its n-grams, sums the training counts, and answers with log
probabilities in the order asked. Parts then score their texts. What is
gathered grows with the input; a task holds one part or one shard.

The base score is that of the word unigram model with additive smoothing.

Words are told apart by 63-bit hashes of their bytes.

Defined cases: null texts are empty: they have the end alone. A null doc_id is
held out. Repeated rows each count and each get a result. With nothing to learn
from, bytes are equally likely and the base has N = V = 0. Other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import row_key, written
from webloom.llm.textbatch import LOWER, groups, mix, texts_of, word_hashes, words_of

ORDER = 5
PAD, END = 0xFE, 0xFF
SYMBOLS = 255  # all bytes but PAD
GRAMS, WORDS = 0, 1
_U = np.uint64


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram (ORDER context bytes, then the byte) of each byte and each end
    of the rows, and the first n-gram of each row."""
    size = np.diff(offsets)
    head = offsets[:-1] + (ORDER + 1) * np.arange(len(size)) + ORDER
    stream = np.full(len(data) + (ORDER + 1) * len(size), PAD, dtype=np.uint8)
    symbol = np.zeros(len(stream), dtype=bool)
    at = np.arange(len(data)) + np.repeat(head - offsets[:-1], size)
    stream[at] = data
    stream[head + size] = END
    symbol[at] = True
    symbol[head + size] = True
    keys = np.zeros(len(stream) - ORDER, dtype=np.uint64)
    for k in range(ORDER + 1):
        keys = (keys << _U(8)) | stream[k:len(stream) - ORDER + k]
    return keys[symbol[ORDER:]], offsets[:-1] + np.arange(len(size))


def asked(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams and words of a part, and their training counts."""
    found: dict[int, list] = {GRAMS: [], WORDS: []}
    train = table["train"].to_numpy(zero_copy_only=False).astype(np.uint64)
    for lo, data, offsets in groups(*texts_of(table["text"])):
        learn = train[lo:lo + len(offsets) - 1]
        grams, _ = gram_keys(data, offsets)
        found[GRAMS].append(_counted((grams << _U(1)) | np.repeat(learn, np.diff(offsets) + 1)))
        words, first = hashed_words(data, offsets)
        found[WORDS].append(_counted((words << _U(1)) | np.repeat(learn, np.diff(first))))
    return {kind: _merged(lists) for kind, lists in found.items()}


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, first = words_of(low, offsets)
    return word_hashes(low, starts, ends) & _U(2**63 - 1), first


def _counted(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how many of each carry the training bit."""
    marked.sort()
    keys = marked >> _U(1)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat((marked & _U(1)).astype(np.int64), head) if len(keys) else np.zeros(0, np.int64)


def _merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of sorted key lists."""
    keys = np.concatenate([k for k, _ in lists]) if lists else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in lists]) if lists else np.zeros(0, np.int64)
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counts, minlength=len(distinct)).astype(np.int64)


def shards_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """Grams are dealt by their last two context bytes."""
    return (mix((keys >> _U(8)) & _U(0xFFFF) if kind == GRAMS else keys) % _U(shards)).astype(np.int64)


def _by_shard(kind: int, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by shard, and the limits of each shard in that order."""
    shard = shards_of(kind, keys, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _request(shards: int):
    def request(table: pa.Table) -> pa.Table:
        rows = []
        part = table["part"][0].as_py()
        for kind, (keys, counts) in asked(table).items():
            order, limits = _by_shard(kind, keys, shards)
            for shard in np.flatnonzero(np.diff(limits)).tolist():
                take = order[limits[shard]:limits[shard + 1]]
                rows.append((kind, shard, part, keys[take].tobytes(), counts[take].astype(np.uint32).tobytes()))
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "shard", "part", "keys", "counts"])

    return request


def _pairs(batches):
    """Counts of (previous byte, byte), and of words as pair -1."""
    total, words = np.zeros(65536, dtype=np.int64), 0
    for batch in batches:
        for _, data, offsets in groups(*texts_of(batch.column(0))):
            grams, _ = gram_keys(data, offsets)
            total += np.bincount((grams & _U(0xFFFF)).astype(np.int64), minlength=65536)
            words += len(words_of(data, offsets)[0])
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], words), pa.int64())], ["pair", "n"])


def _step(c, n, d, x, k, below):
    """log P of symbols with count c in contexts of n symbols of d kinds, where
    symbols of k kinds that occur x times are excluded; `below` after an escape."""
    total = n - x
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.log10((c - 0.5) / total)
        escape = np.where(total > 0, np.log10((d - k) / 2 / total), 0.0)
    return np.where(c > 0, seen, escape + below)


def _contexts(grams: np.ndarray, counts: np.ndarray, shorter: np.ndarray):
    """For each gram the symbols (n), kinds (d) of its context, and how often those
    kinds occur in the next shorter context (x)."""
    _, at = np.unique(grams >> _U(8), return_inverse=True)
    total = lambda w: np.bincount(at, w)[at]
    return total(counts), total(counts > 0), total(np.where(counts > 0, shorter, 0))


def log_probabilities(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 P of each distinct gram. `grams` holds every gram seen in training
    that shares its last two context bytes with one asked; `pairs` is order 1."""
    zero = pairs.reshape(256, 256).sum(axis=0).astype(float)
    n0, d0 = zero.sum(), (zero > 0).sum()
    one = pairs.reshape(256, 256).astype(float)
    n1, d1, x1 = one.sum(axis=1), (one > 0).sum(axis=1), ((one > 0) * zero).sum(axis=1)
    uniform = -np.log10(max(1, SYMBOLS - d0))
    below = _step(zero[None, :], n0, d0, x1[:, None], d1[:, None], uniform).ravel()

    levels = [(grams, counts.astype(float))]
    parents = []
    for k in range(ORDER - 1, 1, -1):
        shorter, at = np.unique(levels[-1][0] & _U(2 ** (8 * (k + 1)) - 1), return_inverse=True)
        levels.append((shorter, np.bincount(at, levels[-1][1])))
        parents.append(at)
    parents.append((levels[-1][0] & _U(0xFFFF)).astype(np.int64))
    c, n, d = one.ravel(), np.repeat(n1, 256), np.repeat(d1, 256)
    for (keys, count), at in zip(reversed(levels), reversed(parents)):
        own_n, own_d, x = _contexts(keys, count, c[at])
        below = _step(c[at], n[at], d[at], x, own_d, below[at])
        c, n, d = count, own_n, own_d
    return _step(c, n, d, 0, 0, below)


def _answer(pairs: np.ndarray):
    def answer(table: pa.Table) -> pa.Table:
        kind, shard = table["kind"][0].as_py(), table["shard"][0].as_py()
        keys = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        counts = [np.frombuffer(c, np.uint32) for c in table["counts"].to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), minlength=len(distinct))
        values = log_probabilities(distinct, total, pairs).astype(np.float32) if kind == GRAMS else total.astype(np.int64)
        ends = np.cumsum([0, *map(len, keys)])
        blobs = [values[at[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        known = [int((total > 0).sum()) if kind == WORDS and k == 0 else 0 for k in range(len(keys))]
        return pa.table([table["part"], pa.array([kind] * len(keys), pa.int32()), pa.array([shard] * len(keys), pa.int32()), pa.array(blobs, pa.binary()), pa.array(known, pa.int64())], names=["part", "kind", "shard", "answers", "known"])

    return answer


class Lookup:
    """Values by 64-bit key: two hash tables, and bisection for what collides in both."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            bits = max(4, (2 * len(keys)).bit_length())
            factor, shift = _U(factor), _U(64 - bits)
            slot = (keys * factor) >> shift
            key, value = np.full(1 << bits, 2**64 - 1, dtype=np.uint64), np.zeros(1 << bits, dtype=values.dtype)
            key[slot], value[slot] = keys, values
            self.tables.append((factor, shift, key, value))
            left = key[slot] != keys
            keys, values = keys[left], values[left]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=self.values.dtype)
        left = np.arange(len(keys))
        for factor, shift, key, value in self.tables:
            slot = (keys[left] * factor) >> shift
            out[left] = value[slot]
            left = left[key[slot] != keys[left]]
        if len(left):
            at = np.searchsorted(self.keys, keys[left])
            if not len(self.keys) or at.max() == len(self.keys) or (self.keys[at] != keys[left]).any():
                raise KeyError("a text holds a key that its part did not ask for")
            out[left] = self.values[at]
        return out


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[r]:first[r + 1]]."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _score(shards: int):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        n = texts.num_rows
        log_p, logs, words, known, own = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n:
            own[0] = sum(answers["known"].to_pylist())
            blobs = {(k, s): a for k, s, a in zip(*(answers[c].to_pylist() for c in ("kind", "shard", "answers")))}
            lookup = {}
            for kind, (keys, _) in asked(texts).items():
                order, limits = _by_shard(kind, keys, shards)
                values = np.zeros(len(keys), np.float32 if kind == GRAMS else np.int64)
                for shard in np.flatnonzero(np.diff(limits)).tolist():
                    values[order[limits[shard]:limits[shard + 1]]] = np.frombuffer(blobs[kind, shard], values.dtype)
                lookup[kind] = Lookup(keys, values)
            for lo, data, offsets in groups(*texts_of(texts["text"])):
                rows = slice(lo, lo + len(offsets) - 1)
                grams, first = gram_keys(data, offsets)
                log_p[rows] = _sums(lookup[GRAMS](grams).astype(float), np.append(first, len(grams)))
                hashed, first = hashed_words(data, offsets)
                count = lookup[WORDS](hashed)
                logs[rows] = _sums(np.log10(count + 0.1), first)
                words[rows], known[rows] = np.diff(first), _sums(count > 0, first)
        return pa.table([texts["doc_id"], texts["train"], pa.array(words), pa.array(known), pa.array(logs), pa.array(log_p), pa.array(own)], names=["doc_id", "train", "words", "known", "logs", "score", "distinct"])

    return score


def score_texts(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every
    row, learning from the rows where `train` holds."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"), F.pmod(row_key(id, text), F.lit(parts)).cast("int").alias("part"))
    counts = rows.filter("train").select("text").mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs, words = np.zeros(65536, dtype=np.int64), 0
    for pair, n in counts:  # at most 65,537 rows
        if pair < 0:
            words = n
        else:
            pairs[pair] = n
    ends = int(pairs.reshape(256, 256)[:, END].sum())
    requests = rows.groupBy("part").applyInArrow(_request(parts), "kind int, shard int, part int, keys binary, counts binary")
    answers = requests.groupBy("kind", "shard").applyInArrow(_answer(pairs), "part int, kind int, shard int, answers binary, known long")
    kind = rows.schema["doc_id"].dataType.simpleString()
    # One query: the texts are dealt into parts once, for the requests and for the scores.
    scored = written(rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _score(parts), f"doc_id {kind}, train boolean, words long, known long, logs double, score double, distinct long"), "scores")
    distinct = (scored.agg(F.sum("distinct")).first()[0] or 0) + (ends > 0)
    n_tokens = F.col("words") + 1
    base = F.col("logs") + float(np.log10(ends + 0.1)) - n_tokens * float(np.log10(words + ends + 0.1 * (distinct + 1)))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), n_tokens.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(words + ends).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def report(docs: DataFrame) -> DataFrame:
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
