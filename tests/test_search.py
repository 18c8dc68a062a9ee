import math

from pyspark.sql import functions as F

from webloom.operators import search as S


def _docs(spark):
    rows = [(1, "The widget für Berlin"), (2, "the red widget, the blue widget"),
            (3, "Nothing here"), (4, "red-widget of the year"), (5, "")]
    return spark.createDataFrame(rows, "url long, text string")


def test_query_terms_unicode():
    assert S.query_terms("Für the  WIDGET-x") == ["für", "the", "widget", "x"]


def test_index_tf(spark):
    idx = {(r["term"], r["url"]): r["tf"] for r in S.build_index(_docs(spark)).collect()}
    assert idx[("widget", 2)] == 2 and idx[("the", 2)] == 2 and idx[("für", 1)] == 1
    assert not any(t == "" for t, _ in idx)


def test_or_and(spark):
    idx = S.build_index(_docs(spark))
    assert {r["url"] for r in S.search(idx, "red widget").collect()} == {1, 2, 4}
    assert {r["url"] for r in S.search(idx, "red widget", "and").collect()} == {2, 4}


def test_phrase(spark):
    d = _docs(spark)
    got = {r["url"] for r in S.search_phrase(d, "Red Widget").collect()}
    assert got == {2, 4}
    assert {r["url"] for r in S.search_phrase(d, "widget red").collect()} == set()
    assert {r["url"] for r in S.search_phrase(d, "the red").collect()} == {2}
    assert S.search_phrase(d, "  ").count() == 0


def test_bm25_matches_hand_formula(spark):
    d = _docs(spark)
    idx = S.build_index(d)
    sc = {r["url"]: r["score"] for r in S.score(idx, "widget").collect()}
    lengths = {1: 4, 2: 6, 4: 5, 3: 2}
    n, avgdl = 4, sum(lengths.values()) / 4
    df = 3
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))

    def bm(tf, dl):
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert abs(sc[1] - bm(1, 4)) < 1e-12 and abs(sc[2] - bm(2, 6)) < 1e-12
    assert set(sc) == {1, 2, 4}


def test_hit_share_caption(spark):
    idx = S.build_index(_docs(spark))
    r = S.hit_share(idx, "widget", "the").first()
    assert (r["hits"], r["base_hits"]) == (3, 3)
    assert r["caption"] == '"widget" in 100.0% of wikipedia pages'
    r = S.hit_share(idx, "widget", "zzz").first()
    assert r["pct"] is None


def test_index_written_by_term_bucket_prunes(spark, tmp_path):
    idx = S.build_index(_docs(spark))
    path = str(tmp_path / "idx")
    S.write_index(idx, path, buckets=8)
    back = S.read_index(spark, path, ["widget"], buckets=8)
    assert {r["url"] for r in back.collect()} == {1, 2, 4}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan


def test_match_all_and_count(spark):
    assert S.match_all(_docs(spark)).count() == 5


def test_query_postings_equal_full_index_rows(spark):
    d = _docs(spark)
    full = {(r.term, r.url, r.tf) for r in S.build_index(d).filter("term in ('red', 'widget')")
            .collect()}
    part = {(r.term, r.url, r.tf) for r in S.query_postings(d, "Red widget").collect()}
    assert full == part
    assert S.query_postings(d, "").count() == 0


def test_batch_postings_are_the_index_of_the_asked_terms(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "B x"), (3, None), (4, "")], "url long, text string")
    terms = spark.createDataFrame([("a",), ("b",), ("zz",)], "term string")
    got = sorted(map(tuple, S.batch_postings(docs, terms).select("term", "url", "dl", "tf").collect()))
    assert got == [("a", 1, 4, 2), ("b", 1, 4, 1), ("b", 2, 2, 1)]


def test_many_tokens_of_a_batch_are_dealt_over_tasks_by_their_number(spark):
    """2,000 texts in one split: their 4,000 asked tokens are summed in pieces, not by split."""
    from pyspark.sql import functions as F
    docs = spark.range(2000, numPartitions=1).select(F.col("id").alias("url"), F.lit("the w the x").alias("text"))
    terms = spark.createDataFrame([("the",), ("w",)], "term string")
    found = S.batch_postings(docs, terms, rows_per_task=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() >= 60 and plan.rindex("HashAggregate") < plan.index("REPARTITION_BY_NUM")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, S.batch_postings(docs, terms).collect()))


def test_scores_are_equal_with_and_without_carried_lengths(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "B x"), (3, "c c c c d")], "url long, text string")
    lengths = S.text_lengths(docs)
    plain = sorted(map(tuple, S.score(S.query_postings(docs, "a b"), "a b", lengths=lengths).collect()))
    carried = sorted(map(tuple, S.score(S.query_postings(docs, "a b", with_length=True), "a b", lengths=lengths).collect()))
    assert plain == carried and len(plain) == 2


def test_texts_searched_in_one_pass_equal_the_index(spark):
    rows = [(1, "Red widget, red."), (2, "a WIDGET"), (3, "rediscovered widgets"), (4, None), (5, " -- "), (6, "red red red blue"), (6, "widget again"), (7, "blue")]
    docs = spark.createDataFrame(rows, "url long, text string")
    index = S.build_index(docs)
    for q in ("red widget", "widget", "RED red", "nothing", "", "blue nothing"):
        for mode in ("or", "and"):
            if q:
                assert sorted(S.search_texts(docs, q, mode).collect()) == sorted(S.search(index, q, mode).collect())
        got = {r.url: round(r.score, 9) for r in S.score_texts(docs, q).collect()}
        assert got == {r.url: round(r.score, 9) for r in S.score(index, q).collect()}


def test_one_light_shuffle_scores_texts(spark):
    docs = spark.createDataFrame([(1, "red widget"), (2, "blue")], "url long, text string")
    scored = S.score_texts(docs, "red widget")
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "text" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
