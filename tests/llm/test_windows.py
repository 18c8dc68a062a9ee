"""Suffix-array and Lempel-Ziv dedup against brute force."""

from collections import Counter

import numpy as np
import pytest

from webloom.llm import rlz, suffixes
from .data import documents, frame, sha, words


def spans_of(flags):
    return int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())


def removed_bytes(rows, window=400):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[k:k + window] for _, r in raw for k in range(len(r) - window + 1))
    for i, r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - window + 1):
            if count[r[k:k + window]] > 1:
                gone[k:k + window] = True
        yield i, len(r), int(gone.sum()), spans_of(gone), sha(np.frombuffer(r, np.uint8)[~gone].tobytes())


def removed_words(rows, window=50):
    least = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            least[g] = min(least.get(g, float("inf")), order(i))
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < order(i):
                gone[k:k + window] = [True] * window
        yield i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_brute_force(spark, seed):
    rows = documents(seed)
    same(suffixes.report(frame(spark, rows)).collect(), list(removed_bytes(rows)))


def test_lempel_ziv_equals_brute_force(spark):
    rows = documents(3)
    got = rlz.report(frame(spark, rows)).collect()
    same(got, list(removed_words(rows)))
    assert sum(r.n_removed for r in got) > 0


def test_lempel_ziv_rewrites_texts_and_keeps_other_columns(spark):
    rows = documents(4)
    docs = frame(spark, rows)
    out = rlz.remove_repeats(docs)
    assert out.schema == docs.schema
    got = sorted((r.doc_id, sha(b" ".join(words(r.text)))) for r in out.filter("doc_id is not null").collect())
    assert got == sorted((i, s) for i, _, _, s in removed_words(rows) if i is not None)
    assert out.filter("text is null").count() == docs.filter("text is null").count()
    assert out.select("source", "_key", "tokens_taken").distinct().count() == docs.select("source", "_key", "tokens_taken").distinct().count()


def test_crowded_anchors_are_dealt_by_window(spark, monkeypatch):
    """With a crowd of two runs most windows take the other way, to equal results."""
    monkeypatch.setattr(suffixes, "CROWD", 1)
    monkeypatch.setattr(rlz, "CROWD", 1)
    rows = documents(7)
    same(suffixes.report(frame(spark, rows)).collect(), list(removed_bytes(rows)))
    same(rlz.report(frame(spark, rows)).collect(), list(removed_words(rows)))


@pytest.mark.parametrize("report", [suffixes.report, rlz.report])
def test_empty_table(spark, report):
    assert report(frame(spark, [])).count() == 0
    assert report(frame(spark, [(1, None), (2, "")])).count() == 2


@pytest.mark.parametrize("memory,block", [(32 << 20, 1 << 18), (64, 7)])
def test_induced_sorting_in_memory_and_on_disk(monkeypatch, memory, block):
    monkeypatch.setattr(suffixes, "MEMORY", memory)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = np.random.default_rng(5)
    for window in (3, 8):
        monkeypatch.setattr(suffixes, "WINDOW", window)
        for _ in range(40):
            parts = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 50)) + 2 for _ in range(rng.integers(1, 6))]
            text = np.concatenate([np.append(p, suffixes.SEPARATOR) for p in parts] + [[suffixes.SENTINEL]]).astype(np.uint16)
            if len(text) < 3:
                continue
            whole = np.array([k + window <= len(p) for p in parts for k in range(len(p) + 1)] + [False])
            grams = [bytes(text[k:k + window]) for k in range(len(text))]
            count = Counter(g for g, w in zip(grams, whole) if w)
            want = np.array([w and count[g] > 1 for g, w in zip(grams, whole)])
            assert ((suffixes.repeated_windows(text) & whole) == want).all()


def matches(texts, order):
    """The longest match of every word with a text of smaller order, by plain comparison."""
    for r, t in enumerate(texts):
        for i in range(len(t)):
            best = 0
            for s, u in enumerate(texts):
                for j in range(len(u) if order[s] < order[r] else 0):
                    k = 0
                    while i + k < len(t) and j + k < len(u) and t[i + k] == u[j + k]:
                        k += 1
                    best = max(best, k)
            yield best


def test_longest_earlier_match_equals_plain_comparison():
    rng = np.random.default_rng(4)
    for _ in range(60):
        texts = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 14)).astype(np.uint64) for _ in range(rng.integers(1, 6))]
        order = rng.integers(0, 4, len(texts))
        first = np.cumsum([0, *map(len, texts)])
        got = rlz.longest_earlier(np.concatenate(texts), first, order)
        assert got.tolist() == list(matches(texts, order))


def test_factors_are_greedy_and_whole():
    assert rlz.factor(np.array([3, 9, 1, 0, 2, 1])) == [(0, 3), (3, 4), (4, 6)]
    assert rlz.factor(np.zeros(0, int)) == [] and rlz.duplicate_spans(np.zeros(0, int)) == []


def test_factors_are_checked_at_their_boundaries():
    """A window that straddles the end of a factor is found, too."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 2**60, 80).astype(np.uint64), rng.integers(1, 2**60, 80).astype(np.uint64)
    texts = [a, np.concatenate([a[40:], b]), np.concatenate([a, b[:30]])]
    first = np.cumsum([0, *map(len, texts)])
    longest = rlz.longest_earlier(np.concatenate(texts), first, np.arange(3))[first[2]:]
    assert rlz.factor(longest) == [(0, 80), (80, 110)]
    spans = rlz.duplicate_spans(longest)
    assert spans[0] == (0, 80) and (40, 110) in spans and longest[31] == 49
