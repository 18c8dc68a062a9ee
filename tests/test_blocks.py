"""The block index: ranking, blocks left alone, phrases, hot terms."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import blocks as BL
from webloom.operators import search as S


@pytest.fixture(scope="module")
def docs(spark):
    """400 texts of 1 to 300 words; one word in nearly all of them, some nowhere else."""
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(k, " ".join(["the"] * (k % 7 > 0) + [rng.choice(words) for _ in range(rng.choice([1, 5, 20, 60, 300]))])) for k in range(400)]
    rows += [(900, ""), (901, None), (902, "-- !"), (903, "of the of the end"), (904, "Of THE."), (905, "the of"), (906, "of x the")]
    return spark.createDataFrame(rows, "url long, text string")


@pytest.fixture(scope="module")
def blocks(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "b")
    BL.write_blocks(BL.build_blocks(docs, docs.count(), cell_docs=16), path, 8)
    return BL.read_blocks(spark, path, None, 8)


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, q in enumerate(texts) for t in S.query_terms(q)], "query_id int, term string")


@pytest.mark.parametrize("q,k", [("the w1", 5), ("w2 w3 w9", 10), ("w77", 3), ("the", 400), ("nowhere", 5), ("w1 nowhere the w5", 1)])
def test_best_equals_scores_of_all(spark, docs, blocks, q, k):
    got = [(r.url, r.score) for r in BL.best(blocks, queries(spark, q), k).orderBy("rank").collect()]
    all_ = S.score(S.build_index(docs), q).select("url", BL.report_round("score").alias("score"))
    assert got == [(r.url, r.score) for r in all_.orderBy(F.desc("score"), "url").limit(k).collect()]


def test_several_queries_at_once(spark, blocks):
    texts = ["the w1", "w2 w3", "w40 w41 w42", "the"]
    each = [[(r.url, r.score) for r in BL.best(blocks, queries(spark, t), 4).orderBy("rank").collect()] for t in texts]
    together = BL.best(blocks, queries(spark, *texts), 4).orderBy("query_id", "rank").collect()
    assert [[(r.url, r.score) for r in together if r.query_id == i] for i in range(4)] == each


def test_most_blocks_are_left_alone(spark, blocks):
    ranking = BL.Ranking(blocks, queries(spark, "the w1"), 3)
    held = ranking.cells.count()
    read = ranking.first.count() + ranking.rest.count()
    assert read < held / 3 and ranking.best().count() == 3


def test_a_common_term_is_many_rows_of_bounded_size(blocks):
    own = blocks.filter("term = 'the'")
    assert own.count() > 20 and own.agg(F.max("n")).first()[0] <= 2 * 16 + 8
    stats = blocks.filter("term = ''").agg(F.sum("n"), F.sum(F.size("docs"))).first()
    assert tuple(stats) == (404, 404)


@pytest.mark.parametrize("q", ["of the", "Of the!", "the of", "of the of the", "the w1", "w1", "", "nowhere of", "the the"])
def test_phrases_equal_the_text_scan(docs, blocks, q):
    assert sorted(BL.search_phrase(blocks, q).collect()) == sorted(S.search_phrase(docs, q).collect())


def test_no_documents(spark, docs):
    none = BL.build_blocks(docs.limit(0), 0)
    assert BL.best(none, queries(spark, "the"), 5).collect() == [] and BL.search_phrase(none, "of the").collect() == []


def test_what_queries_make_of_blocks_is_not_shuffled(spark, docs, blocks, tmp_path):
    """Texts are dealt by cell, once, and no range is sampled; scores are summed where
    the cell's blocks lie, in tasks dealt by their pairs."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    built = plan(BL.build_blocks(docs, 407, cell_docs=16))
    assert built.count("Exchange") == built.count("Exchange hashpartitioning(cell") == 1
    BL.write_blocks(BL.build_blocks(docs, 407, cell_docs=16), str(tmp_path / "b"), 8)
    ranking = BL.Ranking(blocks, queries(spark, "the w1", "w2 w3 the"), 3)
    summed = plan(ranking.scored(ranking.cells, 7))
    assert "hashpartitioning(cell" in summed and "hashpartitioning(query_id" not in summed


def test_rows_of_one_document_and_ids_that_are_null_or_names(spark):
    rows = [("b", "x y x"), ("b", "x y x"), (None, "y x"), ("a", "y")]
    got = {r.term: [(d.url, d.dl, d.tf, d.at) for d in r.docs] for r in BL.build_blocks(spark.createDataFrame(rows, "url string, text string"), 1, cell_docs=1).collect() if r.term in ("x",) for _ in [0]}
    assert got["x"] in ([("b", 3, 4, [1, 1, 3, 3])], [(None, 2, 1, [2])])
    each = sorted((r.term, r.n, r.max_tf, r.min_dl, r.sum_dl) for r in BL.build_blocks(spark.createDataFrame(rows, "url string, text string"), 1, cell_docs=1).collect())
    assert each == [("", 1, 1, 1, 1), ("", 1, 1, 2, 2), ("", 1, 2, 3, 3), ("x", 1, 1, 2, 2), ("x", 1, 4, 3, 3), ("y", 1, 1, 1, 1), ("y", 1, 1, 2, 2), ("y", 1, 2, 3, 3)]


@pytest.mark.parametrize("url", [1, None])
def test_rows_of_one_url_in_several_cells_are_one_result(spark, url):
    rows = [(url, "x"), (url, "x " + "y " * 40), (2, "x z"), (3, "z")]
    blocks = BL.build_blocks(spark.createDataFrame(rows, "url long, text string"), 4, cell_docs=4)
    got = {r.url: r.score for r in BL.best(blocks, queries(spark, "x"), 5).collect()}
    assert set(got) == {url, 2} and BL.best(blocks, queries(spark, "x"), 5).count() == 2
    assert got[url] > got[2]
