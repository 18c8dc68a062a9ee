"""Plan-shape checks on the registered queries, and the entry contract."""


import duckdb
import pytest

import __spark_entry__ as E
from webloom.plans import catalog
from webloom.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FITS_MODELS = {"cluster_labels", "cluster_centroids"}
TEXT_CLEANING = {"page_text", "archive_roundtrip", "escaped_text"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - FITS_MODELS))
def test_no_cartesian_no_python_in_core(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in TEXT_CLEANING:  # only text cleaning has the (backslash-only) Arrow UDF
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scans_are_pruned(spark):
    plan = plan_of(E.queries()["page_domain"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
    plan = plan_of(E.queries()["pagerank_r1"](spark, SF))
    assert "html" not in plan and "l_quantity" not in plan


def test_neighbour_topk_is_partial_before_shuffle(spark):
    df = E.queries()["search_neighbours"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in final


def test_batch_neighbour_topk_is_partial_before_shuffle(spark):
    df = E.queries()["batch_graph_nodes"](spark, SF)
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_request_plan_has_no_runtime_filter_on_tiny_sides(spark):
    df = E.queries()["graph_nodes"](spark, SF)
    assert "might_contain" not in plan_of(df)


def test_entry_contract(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and df.columns == ["url", "rank", "total_links"]
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", ["pagerank_r1", "graph_nodes", "graph_edges", "doc_bm25",
                                  "page_links", "batch_search", "index_page", "upsert_ranks"])
def test_oracle_at_smallest_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    want = sorted((tuple(_norm(r[ocols.index(c)]) for c in cols) for r in res.fetchall()),
                  key=repr)
    assert got == want


def test_a_common_word_of_a_batch_spans_tasks(spark):
    """With no broadcast the terms meet their postings by term and salt."""
    from pyspark.sql import functions as F

    from webloom.operators import search as S
    from webloom.plans import batch_search as BS
    docs = spark.range(2000).select(F.col("id").alias("url"), F.concat(F.lit("the w"), F.col("id") % 50).alias("text"))
    queries = spark.createDataFrame([(q, f"the w{q}") for q in range(20)], "query_id int, q string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scored = BS.batch_scores(S.build_index(docs), queries)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        n = scored.filter("query_id = 3").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n == 2000
    joined = [line for line in plan.splitlines() if "SortMergeJoin" in line and "term" in line]
    assert len(joined) >= 2 and sum("salt" in line for line in joined) >= 2


def test_pairs_of_a_batch_are_dealt_by_their_number(spark, monkeypatch):
    """2,000 postings of few bytes that 20 queries ask: 40,000 pairs are never one task."""
    from pyspark.sql import functions as F

    from webloom.operators import search as S
    from webloom.plans import batch_search as BS
    monkeypatch.setattr(BS, "PAIRS_PER_TASK", 1000, raising=False)
    docs = spark.range(2000).select(F.col("id").alias("url"), F.lit("the w").alias("text"))
    queries = spark.createDataFrame([(q, "the w") for q in range(20)], "query_id int, q string")
    scored = BS.batch_scores(S.build_index(docs), queries).withColumn("task", F.spark_partition_id())
    rows = [r["count"] for r in scored.groupBy("task").count().collect()]
    assert sum(rows) == 40_000 and max(rows) < 4000
    want = S.score(S.build_index(docs), "the w").select(F.round("score", 9).alias("s")).distinct().collect()
    assert scored.select(F.round("score", 9).alias("s")).distinct().collect() == want


def test_limited_requests_look_up_as_many_as_at_first(spark, tmp_path):
    """200 hits of the request and 20 of each query of the batch are looked up."""
    import duckdb

    from webloom.plans import catalog, oracle
    sf = str(tmp_path)
    duckdb.sql(f"COPY (SELECT i AS p_partkey, CASE WHEN i % 2 = 0 THEN 'red widget' ELSE 'blue widget' END AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, 1 AS p_size FROM range(1, 251) r(i)) TO '{sf}/part.parquet'")
    duckdb.sql(f"COPY (SELECT i AS l_orderkey, 1 + i * 31 % 250 AS l_partkey, i % 10 AS l_suppkey, CAST(1 AS INTEGER) AS l_linenumber FROM range(1, 4001) r(i)) TO '{sf}/lineitem.parquet'")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = {}
    for name in ("limited_analysis", "limited_batch_tables"):
        df = getattr(catalog, name)(spark, sf)
        found[name] = sorted(tuple(r) for r in df.collect())
        assert found[name] == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle.SQL[name]})").fetchall())
    few = con.execute(oracle._request(40, 50) + " SELECT count(*) FROM found").fetchall()[0][0]
    assert len(found["limited_analysis"]) > few
    assert len(found["limited_batch_tables"]) > 2 * 4


def test_tokens_of_a_common_word_meet_a_batch_in_many_tasks(spark):
    """2,000 texts hold one asked word: without a broadcast its tokens are dealt by url, too."""
    from pyspark.sql import functions as F

    from webloom.operators import search as S
    docs = spark.range(2000).select(F.col("id").alias("url"), F.lit("the the w").alias("text"))
    terms = spark.createDataFrame([("the",)], "term string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.batch_postings(docs, terms)
        plan = found._jdf.queryExecution().toString()
        got = found.agg(F.count("url"), F.countDistinct("url"), F.min("dl"), F.max("dl"), F.min("tf"), F.max("tf")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tuple(got) == (2000, 2000, 3, 3, 2, 2)
    joined = [line for line in plan.splitlines() if "SortMergeJoin" in line and "term" in line]
    assert joined and all("salt" in line for line in joined)


def test_terms_of_a_batch_plan_the_join_by_their_own_size(spark, tmp_path):
    """A part table above the broadcast limit whose names hold a few words: its tokens
    are not shuffled by word."""
    from pyspark.sql import functions as F

    from webloom.operators import graph as G
    from webloom.plans import catalog as C
    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.lit("red widget").alias("p_name"),
                               F.sha2(F.col("id").cast("string"), 512).alias("p_type"), F.lit("Brand#1").alias("p_brand")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans = []
    real = G.written_table
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        G.written_table = lambda df, prefix: plans.append((prefix, df._jdf.queryExecution().executedPlan().toString())) or real(df, prefix)
        pages = spark.read.parquet(str(tmp_path / "part.parquet")).select(F.col("p_partkey").alias("url"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
        n = C._batch_postings(spark, str(tmp_path), G.LinkGraph(pages=pages, links=None)).count()
    finally:
        G.written_table = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert n == 40_000
    assert "SortMergeJoin" not in dict(plans)["postings"] and "BroadcastHashJoin" in dict(plans)["postings"]
