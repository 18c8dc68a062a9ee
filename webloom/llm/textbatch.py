"""Whole texts as numpy arrays: bytes, words and hashes of an Arrow batch.

A batch is cut into groups of consecutive rows of about ``GROUP_BYTES``; a
longer text is a group of its own, so memory is bounded by the longest text.
All hashes are 64-bit and depend on content alone, not on position or batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
BASE = int(_rng.integers(1, 2**60)) * 8 + 5
BASE_INVERSE = pow(BASE, -1, 2**64)

#: The white space bytes of the word pattern [^\x20\x09-\x0D]+.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def groups(data: np.ndarray, offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about `limit` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of codes[i] * BASE**i, and BASE**-i, modulo 2**64."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=sums[1:])
    return sums, powers(BASE_INVERSE, len(codes) + 1)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each pair."""
    sums, back = prefix_sums(codes)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive codes."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    sums, back = prefix_sums(codes)
    return mix((sums[n:] - sums[:-n]) * back[:len(codes) - n + 1] + _U(n))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of words; row r holds words first[r]:first[r + 1]."""
    inside = IS_WORD[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0], before[1:] = False, inside
    after = np.empty(len(data) + 1, dtype=bool)
    after[-1], after[:-1] = False, inside
    before[offsets], after[offsets] = False, False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(BYTE_CODE[data], starts, ends)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row joined by one space, rows end to end without a gap.

    Returns (bytes, word starts, row offsets); a word ends one byte before the
    next word of its row, or at the row's end.
    """
    sizes = ends - starts
    gap = np.ones(len(starts), dtype=np.int64)
    last = first[1:][first[1:] > first[:-1]] - 1
    gap[last] = 0
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes + gap, out=at[1:])
    out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[(at[1:] - 1)[gap == 1]] = False
    out[inside] = data[IS_WORD[data]]
    return out, at[:-1], at[first]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    if len(x) < width:
        return x[:0]
    step, n = 1, len(x) - width + 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step:width - step + n])


def anchored_runs(grams: np.ndarray, gram: int, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split the windows of each row into runs that share an anchor.

    `grams` holds the hash of each `gram` consecutive units of the whole group,
    `offsets` the rows' first units. The anchor of a window is the leftmost of
    its grams with the least hash, so equal windows have equal anchors at equal
    places: runs whose anchors differ share no window. Returns (first window
    start, number of windows, anchor position) of each run.
    """
    if len(grams) < window - gram + 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    keys = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keys, window - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, dtype=np.int64)
    fits = offsets[1:] - offsets[:-1] >= window
    np.add.at(valid, offsets[:-1][fits], 1)
    np.add.at(valid, offsets[1:][fits] - window + 1, -1)
    keep = np.cumsum(valid[:-1]) > 0
    at = np.flatnonzero(keep)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    chosen = anchor[at]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(fresh)
    return at[head], np.diff(np.append(head, len(at))), chosen[head]
