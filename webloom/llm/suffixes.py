"""Suffix-array dedup by external induced sorting.

A string of 400 bytes that starts at two places of the corpus marks the bytes
it covers. The corpus is dealt into shards by window anchor, so that equal
strings lie in the same shard (``repeats``); runs of windows with equal content
are collapsed first. An anchor with more than ``CROWD`` different runs would make
a shard without bound; its windows are dealt singly, by their own content, which
finds the same strings. Within a shard the suffixes are sorted by induction, with
the common prefix of neighbours:

1. suffixes are S or L by the order of their first two differing bytes; the
   LMS suffixes (S after L) are reduced to the names of their LMS substrings;
2. the reduced string is sorted by recursion on ever longer pieces: at each
   level the names of two neighbouring pieces give the name of their union,
   until the pieces of equal names are as long as a window; the names of all
   levels give the common prefixes of neighbouring LMS suffixes;
3. L suffixes are induced from the LMS suffixes in rising order, then S suffixes
   from the L suffixes in falling order. A priority queue with a first-in
   first-out list for each first byte carries (suffix, common prefix) tuples: an
   element's common prefix with its predecessor in the list is one more than
   the least common prefix scanned between their successors.

Text, names and queue entries above ``MEMORY`` bytes go to unnamed temporary
files of the task, which vanish with it; nothing another task reads is there.
Common prefixes count up to the window only, as no more is asked.

Defined cases: null texts are empty. Rows that repeat doc_id and text are two
documents whose strings repeat. Texts under 400 bytes lose nothing. Other
columns are never read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import row_key, written
from webloom.llm.repeats import (RUN, WINDOW_ROW, by_load, classes, covered, digest, repeated_of, repeated_runs, run_lists, wanted_runs,
                                 window_rows, with_texts)
from webloom.llm.textbatch import BYTE_CODE, anchored_runs, gram_hashes, groups, texts_of

WINDOW = 400
GRAM = 128
GROUP = 1 << 20
#: Different runs of one anchor that may share a shard (about 570 bytes each).
CROWD = 15000
MEMORY = 32 << 20
#: Queue entries scanned at once.
BLOCK = 1 << 18
SENTINEL, SEPARATOR = 0, 1  # below every byte, which is itself plus two
SIGMA = 258
_PIECE = 7  # characters of 9 bits in a sort key
_AFTER = 511  # follows the end of an LMS substring, as S sorts after L


def outside(array: np.ndarray) -> np.ndarray:
    """The array, on disk if it is large."""
    if array.nbytes <= MEMORY:
        return array
    with tempfile.TemporaryFile() as file:
        held = np.memmap(file, dtype=array.dtype, shape=array.shape)
        held[:] = array
        return held


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    rises = text[differs] < text[differs + 1]
    out = np.ones(n, dtype=bool)
    out[:differs[-1] + 1] = np.repeat(rises, np.diff(np.append(-1, differs)))
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of the rows of sort keys, the first key first; equal rows are equal."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), dtype=np.int64)
    for k in keys:
        s = k[order]
        fresh[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(fresh)
    return out


def substring_names(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, in their order."""
    stop = np.append(lms[1:], len(text) - 1)
    last = len(text) - 1

    def piece(at: np.ndarray, end: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), dtype=np.uint64)
        for k in range(_PIECE):
            key = (key << np.uint64(9)) | np.where(at + k <= end, text[np.minimum(at + k, last)], _AFTER).astype(np.uint64)
        return key

    names = _dense(piece(lms, stop))
    done = _PIECE
    while len(longer := np.flatnonzero(stop - lms + 1 >= done)):  # a piece may end with its substring
        _, first, times = np.unique(names[longer], return_index=True, return_counts=True)
        tied = longer[np.isin(names[longer], names[longer][first[times > 1]])]
        if not len(tied):
            break
        inner = np.zeros(len(names), dtype=np.int64)
        inner[tied] = _dense(piece(lms[tied] + done, stop[tied]))
        names = _dense(names, inner)
        done += _PIECE
    return names


def sorted_lms(text: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes in order (as far as a window reaches), and the common prefix of
    each with the one before."""
    n = len(lms)
    levels = [outside(substring_names(text, lms).astype(np.int32))]
    place = np.append(lms, np.full(1, len(text)))
    step = 1
    while True:
        name = levels[-1]
        times = np.bincount(name)
        tied = np.flatnonzero((times > 1)[name])
        tied = tied[place[np.minimum(tied + step, n)] - lms[tied] < WINDOW]
        if not len(tied):
            break
        after = np.full(n, -1, dtype=np.int64)
        after[:max(0, n - step)] = name[step:]
        # Names that stand for one suffix keep their place; only tied ones are told apart.
        inner = np.zeros(n, dtype=np.int64)
        groups_of = np.isin(name, name[tied])
        inner[groups_of] = _dense(after[groups_of])
        key = name.astype(np.int64) * (int(inner.max()) + 1) + inner
        levels.append(outside(np.unique(key, return_inverse=True)[1].astype(np.int32)))
        step *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        same = (a < n) & (b < n)
        same[same] = name[a[same]] == name[b[same]]
        to = np.minimum(a[same] + (1 << k), n)
        common[1:][same] += place[to] - lms[a[same]]
        a[same], b[same] = to, np.minimum(b[same] + (1 << k), n)
    first, second = lms[order[:-1]], lms[order[1:]]
    open_ = np.flatnonzero(common[1:] < WINDOW)
    while len(open_):
        x, y = first[open_] + common[1:][open_], second[open_] + common[1:][open_]
        inside = (x < len(text)) & (y < len(text))
        open_, x, y = open_[inside], x[inside], y[inside]
        open_ = open_[text[x] == text[y]]
        common[1:][open_] += 1
        open_ = open_[common[1:][open_] < WINDOW]
    return lms[order], np.minimum(common, WINDOW).astype(np.int16)


class InducedQueue:
    """A priority queue whose keys only rise (or fall): a list for each first byte."""

    def __init__(self):
        self.lists: list[list] = [[] for _ in range(SIGMA)]
        self.least = np.full(SIGMA, WINDOW, dtype=np.int16)  # since the last push
        self.used = np.zeros(SIGMA, dtype=bool)
        self.bytes = 0

    def push(self, char: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.bytes += suffixes.nbytes + common.nbytes
        if self.bytes > MEMORY:
            self.bytes = 0
            for entries in self.lists:  # what waits goes to disk
                if entries:
                    merged = [np.concatenate(x) for x in zip(*entries)]
                    entries[:] = [tuple(outside(x) for x in merged)]
        self.lists[char].append((suffixes, common))

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next entries of a list, about BLOCK of them."""
        entries = self.lists[char]
        if not entries:
            return None
        taken, size = [], 0
        while entries and size < BLOCK:
            suffixes, common = entries.pop(0)
            if len(suffixes) > BLOCK:
                entries.insert(0, (suffixes[BLOCK:], common[BLOCK:]))
                suffixes, common = suffixes[:BLOCK], common[:BLOCK]
            taken.append((suffixes, common))
            size += len(suffixes)
        return np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken])

    def induce(self, suffixes: np.ndarray, common: np.ndarray, target: np.ndarray) -> None:
        """Scan sorted suffixes; `target` is the first byte of the suffix one place
        before where that is to be pushed, else -1."""
        if not len(suffixes):
            return
        least = np.minimum(self.least, common.min())
        pushed = np.flatnonzero(target >= 0)
        chars = target[pushed].astype(np.uint16)
        order = np.argsort(chars, kind="stable")
        pushed, chars = pushed[order], chars[order]
        heads = np.flatnonzero(np.append(True, chars[1:] != chars[:-1])) if len(chars) else []
        for a, b in zip(heads, [*heads[1:], len(chars)]):
            char, at = int(chars[a]), pushed[a:b]
            cuts = np.append(0, at + 1)
            tail = cuts[-1] < len(common)
            lows = np.minimum.reduceat(common, cuts if tail else cuts[:-1])
            value = lows[:len(at)].copy()
            value[0] = min(value[0], self.least[char])
            value = np.minimum(value + np.int16(1), np.int16(WINDOW))
            if not self.used[char]:
                value[0], self.used[char] = 0, True
            self.push(char, suffixes[at] - 1, value)
            least[char] = lows[-1] if tail else WINDOW
        self.least = least


def repeated_windows(text: np.ndarray) -> np.ndarray:
    """Whether the WINDOW characters from each place also start elsewhere. The text
    (uint16) ends with the SENTINEL; results hold where no separator is near."""
    n = len(text)
    falls = s_types(text)
    lms = np.flatnonzero(falls[1:] & ~falls[:-1]) + 1
    seeds, seed_common = sorted_lms(text, lms)
    limits = np.searchsorted(text[seeds], np.arange(SIGMA + 1))
    text, falls = outside(text), outside(falls)
    repeated = np.zeros(n, dtype=bool)

    def run_of(place: int, char: int) -> int:
        piece = text[place:place + WINDOW] == char
        return len(piece) if piece.all() else int(np.argmin(piece))

    def between(a: int, b: int, char: int) -> int:
        """Common prefix of an L and an S suffix of one byte: both start with its run."""
        return min(run_of(a, char), run_of(b, char))

    def note(suffixes, common, before):
        """Neighbours with a whole window in common; `before`: the suffix scanned last."""
        same = np.flatnonzero(common >= WINDOW)
        repeated[suffixes[same]] = True
        repeated[suffixes[same[same > 0] - 1]] = True
        if len(same) and same[0] == 0 and before is not None:
            repeated[before] = True

    def targets(suffixes, want_s: bool):
        before = np.maximum(suffixes - 1, 0)
        return np.where((suffixes > 0) & (falls[before] == want_s), text[before].astype(np.int32), -1)

    queue = InducedQueue()
    lists: list[list] = [[] for _ in range(SIGMA)]
    for char in range(SIGMA):
        last = None
        while (entries := queue.pop(char)) is not None:
            suffixes, common = entries
            note(suffixes, common, last)
            lists[char].append((outside(suffixes), outside(common)))
            queue.induce(suffixes, common, targets(suffixes, False))
            last = int(suffixes[-1])
        a, b = limits[char], limits[char + 1]
        for k in range(a, b, BLOCK):
            suffixes, common = seeds[k:min(b, k + BLOCK)], seed_common[k:min(b, k + BLOCK)].copy()
            if k == a:
                common[0] = 0 if last is None else between(last, int(suffixes[0]), char)
            queue.induce(suffixes, common, targets(suffixes, False))

    queue = InducedQueue()
    queue.push(SENTINEL, np.array([n - 1]), np.zeros(1, np.int16))
    queue.used[SENTINEL] = True
    for char in range(SIGMA - 1, -1, -1):
        last = None
        while (entries := queue.pop(char)) is not None:
            suffixes, common = entries
            note(suffixes, common, last)
            queue.induce(suffixes, common, targets(suffixes, True))
            last = int(suffixes[-1])
        following = 0 if last is None or not lists[char] else between(int(lists[char][-1][0][-1]), last, char)
        if following >= WINDOW:
            repeated[[last, int(lists[char][-1][0][-1])]] = True
        while lists[char]:
            suffixes, common = lists[char].pop()
            down = np.append(np.int16(following), common[:0:-1])
            following = int(common[0])
            queue.induce(suffixes[::-1], down, targets(suffixes[::-1], True))
    return repeated


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digest and window runs of each text."""
    for batch in batches:
        for lo, data, offsets in groups(*texts_of(batch.column(2)), GROUP):
            grams = gram_hashes(BYTE_CODE[data], GRAM)
            begin, n, anchor = anchored_runs(grams, GRAM, offsets, WINDOW)
            view = memoryview(np.ascontiguousarray(data))
            marks = [digest(view[a:b]) for a, b in zip(begin.tolist(), (begin + n + WINDOW - 1).tolist())]
            row = np.searchsorted(offsets, begin, "right") - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, len(offsets) - 1), batch.column(1).slice(lo, len(offsets) - 1), pa.array(np.diff(offsets), pa.int64()),
                pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string()),
                run_lists(grams[anchor], marks, begin - offsets[row], n, np.searchsorted(row, np.arange(len(offsets)))),
            ], ["key", "doc_id", "n_bytes", "sha", "runs"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted run."""
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = (text or "").encode()
            out += [(r["anchor"], r["lo"], r["hi"], raw[r["start"]:r["start"] + r["n"] + WINDOW - 1]) for r in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "lo", "hi", "bytes"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the wanted runs."""
    for batch in batches:
        for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            codes = BYTE_CODE[np.frombuffer((text or "").encode(), dtype=np.uint8)]
            yield window_rows([(r["anchor"], r["lo"], r["hi"], 0) for r in wanted], [codes[r["start"]:r["start"] + r["n"] + WINDOW - 1] for r in wanted], WINDOW)


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _sort_shard(table: pa.Table) -> pa.Table:
    """The repeated windows of a shard's runs, as spans of bytes."""
    data, offsets = texts_of(table["bytes"])
    size = np.diff(offsets)
    text = np.full(len(data) + len(size) + 1, SEPARATOR, dtype=np.uint16)
    text[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data.astype(np.uint16) + 2
    text[-1] = SENTINEL
    head = offsets[:-1] + np.arange(len(size))
    repeated = repeated_windows(text)
    starts = np.zeros(len(text), dtype=np.int8)
    np.add.at(starts, head, 1)
    np.add.at(starts, head + size - WINDOW + 1, -1)
    a, b = stretches(repeated & (np.cumsum(starts) > 0))
    run = np.searchsorted(head, a, "right") - 1
    kept = table.select(["anchor", "lo", "hi"]).take(pa.array(run, pa.int64()))
    return kept.append_column("from", pa.array(a - head[run], pa.int32())).append_column("to", pa.array(b - 1 + WINDOW - head[run], pa.int32()))


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, scanned, spans): every text; its size and digest; and for each text that
    has some, the spans of bytes to remove (key, spans)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(row_key(id, text).alias("key"), F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = written(rows.mapInArrow(_scan, f"key long, doc_id long, n_bytes long, sha string, runs array<{RUN}>"), "scanned")
    runs = scanned.select("key", F.lit(0).cast("long").alias("ord"), F.explode("runs").alias("run")).select("key", "ord", "run.*")
    again = repeated_runs(runs)
    kinds = written(classes(again), "classes")
    copies = again.join(kinds.filter("times > 1").select("anchor", "lo", "hi"), ["anchor", "lo", "hi"])
    whole = copies.select("key", F.col("start").alias("a"), (F.col("start") + F.col("n") + WINDOW - 1).alias("b"))
    usual, crowded = by_load(kinds, CROWD)
    texts = with_texts(rows.select("key", "text"), wanted_runs(usual)).mapInArrow(_runs, "anchor long, lo long, hi long, bytes binary")
    shards = texts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(2 * parts))).groupBy("shard")
    found = shards.applyInArrow(_sort_shard, "anchor long, lo long, hi long, from int, to int")
    windows = with_texts(rows.select("key", "text"), wanted_runs(crowded)).mapInArrow(_windows, WINDOW_ROW)
    found = found.unionByName(repeated_of(windows, WINDOW, "times > 1"))
    part = again.join(found, ["anchor", "lo", "hi"]).select("key", (F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("to")).alias("b"))
    spans = whole.unionByName(part).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return rows, scanned.drop("runs"), written(spans, "spans")


def _cut(texts: pa.Array, spans: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text, of in zip(texts.to_pylist(), spans.to_pylist()):
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        yield raw, covered(np.array([(s["a"], s["b"]) for s in of], dtype=np.int64).reshape(-1, 2), len(raw))


def _digest_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(int(gone.sum()), len(stretches(gone)[0]), hashlib.sha256(raw[~gone].tobytes()).hexdigest()) for raw, gone in _cut(batch.column(1), batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], ["key", "n_removed", "n_spans", "kept"])


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows, scanned, spans = repeated_spans(docs, id, text)
    changed = with_texts(rows.select("key", "text"), spans).mapInArrow(_digest_kept, "key long, n_removed long, n_spans long, kept string")
    none = F.lit(0).cast("long")
    return scanned.join(changed, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the bytes left of each text that loses some (a cut may split a
    character, so these are bytes, not text)."""
    rows, _, spans = repeated_spans(docs, id, text)

    def cut(batches):
        for batch in batches:
            left = [raw[~gone].tobytes() for raw, gone in _cut(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary())], ["key", "left"])

    return with_texts(rows.select("key", "text"), spans).mapInArrow(cut, "key long, left binary")
