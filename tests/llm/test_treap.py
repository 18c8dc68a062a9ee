"""The K2-treap search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from webloom.llm import treap
from .data import documents, frame

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scores(rows, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    for item, text in dict.fromkeys((i, tuple(sorted(set(terms(t))))) for i, t in items):
        found = []
        for doc, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            found.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in text if t in c), doc))
        found = sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        yield from ((item, r, doc, score) for r, (score, doc) in enumerate(found, 1))


def order(r):
    return repr(r[0]), r[1], r[3], repr(r[2])


@pytest.fixture(params=[250_000, 300])
def block(request, monkeypatch):
    monkeypatch.setattr(treap, "BLOCK_POSTINGS", request.param)
    return request.param


ITEMS = [(1, "w1 w2 w3 THE"), (2, None), (3, ""), (4, "nowhere unseen"), (5, "É naïve x"), (5, "É naïve x"), (6, "w7"), (7, "w7 w7 W7"),
         (None, "w10 w11"), (8, "one two three"), (9, " ".join(f"w{k}" for k in range(400))), (9, "w5 w6")]


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "q", 1, 2) for i, t in items], "item_id long, text string, query string, term int, score int")


def test_ranking_equals_scores_of_all_documents(spark, block):
    rows = documents(11)
    got = treap.ranked(frame(spark, rows).repartition(3), items_frame(spark, ITEMS)).collect()
    assert sorted(map(tuple, got), key=order) == sorted(scores(rows, ITEMS), key=order)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(treap, "ITEM_BYTES", 60)
    rows = documents(12)
    got = treap.ranked(frame(spark, rows), items_frame(spark, ITEMS)).collect()
    assert sorted(map(tuple, got), key=order) == sorted(scores(rows, ITEMS), key=order)


def test_empty_tables(spark):
    rows = documents(12)
    assert treap.ranked(frame(spark, []), items_frame(spark, ITEMS)).collect() == []
    assert treap.ranked(frame(spark, rows), items_frame(spark, [])).collect() == []
    assert treap.ranked(frame(spark, [(1, None), (2, "--")]), items_frame(spark, ITEMS)).collect() == []


def test_tree_keeps_every_cell_and_leaves_ranges_alone():
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(0, 5000 * 3000, 40_000))
    rows, columns = cells // 3000, cells % 3000
    values = rng.integers(1, 1_000_000, len(cells))
    values[rng.random(len(cells)) < 0.5] = 77  # many ties
    tree = treap.Tree(*treap.plant(rows, columns, values))
    leaves = len(tree.top) - len(tree.mask)
    assert leaves == len(cells) and sorted(tree.top[-leaves:]) == sorted(values)
    asked = [rng.choice(5000, 40, replace=False) for _ in range(5)]
    item = np.repeat(np.arange(5), 40)
    weight = rng.integers(0, 9000, 200)
    found = treap.Tree.best(tree, item, np.concatenate(asked), weight, 5, 10)
    for i, own in enumerate(asked):
        total = np.zeros(3000, np.int64)
        for r, w in zip(own, weight[item == i]):
            np.add.at(total, columns[rows == r], w * values[rows == r])
        best = sorted((c for c in range(3000) if total[c] > 0), key=lambda c: (-total[c], c))[:10]
        assert [(c, total[c]) for c in best] == list(zip(found[1][found[0] == i], found[2][found[0] == i]))


def test_terms_of_long_text():
    rng = random.Random(2)
    text = " ".join(rng.choice(["Ab", "é", "x1", "--", "日本語"]) for _ in range(50_000))
    data = np.frombuffer(text.encode(), np.uint8)
    names, doc, term, tf, n = treap.postings(data, np.array([0, len(data)]))
    want = Counter(terms(text))
    assert dict(zip(names.take(term).to_pylist(), tf.tolist())) == want and n.tolist() == [sum(want.values())]
