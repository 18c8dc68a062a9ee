"""Near-duplicates, containment and nearest neighbours against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from webloom.llm import common, containment, mih, minmax
from .data import WORD, documents, frame, lower


def shingles(text, width):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def groups(rows, width=4):
    """Component (least doc_id) of each row by all pairs; null ids are largest."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(rows)):
        for m in range(k):
            both = len(sets[k] & sets[m])
            if sets[k] and sets[m] and 100 * both >= 80 * (len(sets[k]) + len(sets[m]) - both):
                root[find(k)] = find(m)
    members = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[find(k)].append(i)
    for k, (i, _) in enumerate(rows):
        ids = [x for x in members[find(k)] if x is not None]
        least = min(ids) if ids and sets[k] else i
        yield i, len(sets[k]), least, i == least


def test_min_max_groups_equal_all_pairs(spark):
    rows = documents(5)
    got = minmax.near_duplicates(frame(spark, rows)).drop("key").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(groups(rows), key=repr)


def test_chains_and_far_members_of_a_bucket_are_linked(spark):
    """A chain in which only neighbours are similar is one component, whatever hub a bucket has."""
    base = [f"x{k}" for k in range(300)]
    chain = [(k, " ".join(base[12 * k:12 * k + 130])) for k in range(10)]
    got = {r.component_id for r in minmax.near_duplicates(frame(spark, chain)).collect()}
    assert got == {min(c for _, _, c, _ in groups(chain))} and len(got) == 1


def test_one_of_each_group_stays(spark):
    rows = documents(5)
    docs = frame(spark, rows)
    kept = minmax.keep_one_of_each(docs)
    assert kept.schema == docs.schema
    want = {(i, t) for (i, t), (_, _, _, stays) in zip(rows, groups(rows)) if stays}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert minmax.keep_one_of_each(frame(spark, [])).count() == 0


def test_width_of_the_shingles_is_a_parameter(spark):
    """Edits in 2.5 % of the words: over 0.8 by four words, under it by five."""
    base = [f"x{k}" for k in range(400)]
    edited = [" ".join(f"e{n}" if k % 40 == 20 else w for k, w in enumerate(base)) for n in range(3)]
    close = " ".join("e" if k % 100 == 50 else w for k, w in enumerate(base))
    rows = list(enumerate([" ".join(base), *edited, close]))
    for width, want in ((4, {0}), (5, {0, 1, 2, 3})):
        sets = [shingles(t, width) for _, t in rows]
        near = {(a, b) for a in range(5) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
        assert {a for a in range(5) if not any(a == x for x, _ in near)} == want
        assert {r.doc_id for r in minmax.keep_one_of_each(frame(spark, rows), width=width).collect()} == want
    assert {r.doc_id for r in minmax.keep_one_of_each(frame(spark, rows)).collect()} == {0}


def test_one_stays_of_a_group_with_null_or_repeated_ids(spark):
    text = lambda name, edit: " ".join(f"{name}{k}" for k in range(100)) + f" {edit}"
    rows = [(None, text("a", "x")), (None, text("a", "y")), (None, text("a", "z")), (4, text("b", "x")), (4, text("b", "y")), (9, text("b", "z")), (None, text("b", "w")), (None, None), (7, ""), (7, "")]
    got = [(r.doc_id, r.text) for r in minmax.keep_one_of_each(frame(spark, rows)).collect()]
    assert sorted((i, (t or "")[:1]) for i, t in got if i) == [(4, "b"), (7, "")]
    assert sorted((t or "")[:1] for i, t in got if i is None) == ["", "a"]


def test_components_of_a_long_path(spark):
    n = 200
    links = spark.createDataFrame([((k * 37) % n, ((k + 1) * 37) % n) for k in range(n - 1)], "a long, b long")
    got = common.components(links)
    assert {r.root for r in got.collect()} == {0} and got.count() == n - 1


def test_holding_keeps_every_wanted_row(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("k"), F.lit(1).alias("_word"))
    wanted = rows.filter("k % 7 = 0").select("k")
    got = common.holding(rows, wanted, "k")
    assert got.columns == ["k", "_word"] and got.join(wanted, "k").count() == wanted.count() and got.count() < 2000


def test_containment_equals_brute_force(spark):
    rows = documents(6)
    texts = [t for _, t in rows if t]
    items = [(0, " ".join(texts[1].split()[:30])), (1, texts[5]), (2, None), (3, ""), (4, "one two three"), (5, "not there at all in them"), (5, "not there at all in them"),
             (6, " ".join(texts[8].split()[5:45] + ["new", "words"])), (7, "ONE")]
    got = containment.report(frame(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")).collect()
    want = set()
    for d, t in rows:
        for i, s in items:
            a, b = shingles(t, 5), shingles(s, 5)
            if b and 100 * len(a & b) >= 80 * len(b):
                want.add((d, i, len(b), len(a & b)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and want


def test_items_of_every_size_are_found_up_to_what_they_may_lack(spark):
    """Each item lacks as many shingles as it may in one document, one more in the next."""
    rng = random.Random(9)
    items, docs, want = [], [], set()
    for n in range(1, 46):
        item = [f"i{n}x{k}" for k in range(n + 4)]
        items.append((n, " ".join(item)))
        for more in (0, 1):
            kept = n - n // 5 - more
            tail = [f"t{rng.random()}" for _ in range(rng.choice([1, 60]))]
            docs.append((2 * n + more, " ".join(tail + item[:kept + 4] + tail if kept else tail)))
            if 100 * kept >= 80 * n:
                want.add((2 * n + more, n, n, kept))
    got = containment.report(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) == 45


def test_decontamination_drops_only_what_holds_an_item(spark):
    rows = documents(6)
    docs = frame(spark, rows)
    item = next(t for _, t in rows if t and len(t.split()) > 40)
    left = containment.remove_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    want = [(i, t) for i, t in rows if 100 * len(shingles(t, 5) & shingles(item, 5)) < 80 * len(shingles(item, 5))]
    assert left.schema == docs.schema and sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)
    assert containment.remove_contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)


def exact(rows, k=5):
    ids = [i for i, v in rows]
    m = np.array([v for _, v in rows])
    size = np.linalg.norm(m, axis=1)
    out = {}
    for q, i in enumerate(ids):
        if i % 50 == 0:
            s = m @ m[q] / (size * size[q])
            order = [(-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i]
            out[i] = [(j, -x) for x, j in sorted(order)[:k]]
    return out


def test_neighbours_reach_the_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(16).astype(np.float32).tolist()) for k in range(1200)]
    got = mih.report(spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, k1 int")).collect()
    want = exact(rows)
    hits = sum(any(j == r.vec_id and abs(s - r.score) < 1e-12 for j, s in want[r.query_id]) for r in got)
    assert len(got) == 5 * len(want) and hits >= 0.9 * len(got)
    assert all(r.rank in range(1, 6) for r in got)


def test_neighbours_of_ties_and_unsound_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), *[(k, [2.0, 0.0]) for k in range(1, 9)], (9, None), (10, [0.0, 0.0]), (11, [nan, 1.0]), (12, [inf, 1.0]), (13, [1.0, None]),
            (14, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (15, [])]
    got = mih.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id: [x.vec_id for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == r.query_id] for r in got} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}
    few = mih.report(spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(0, 3, 0.0)]
    assert mih.report(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    for radius in (0, 3, 11, 25):
        index = mih.Index(codes, radius)
        for q in range(0, 500, 50):
            far = np.unpackbits(codes ^ codes[q], axis=1).sum(axis=1)
            assert index.within(codes[q]).tolist() == np.flatnonzero(far <= radius).tolist()
    assert Counter(mih._BITS.tolist())[4] == 70
