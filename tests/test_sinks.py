import json

from pyspark.sql import functions as F

from webloom.sources import sinks as SK


def test_upsert_replaces_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "url string, rank double")
    new = spark.createDataFrame([("b", 5.0), ("c", 3.0)], "url string, rank double")
    once = SK.upsert(old, new)
    twice = SK.upsert(once, new)
    want = [("a", 1.0), ("b", 5.0), ("c", 3.0)]
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in twice.collect()) == want


def test_latest_per_key_uses_order(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 9.0, 3), ("a", 4.0, 2)],
                               "url string, rank double, version int")
    assert [tuple(r) for r in SK.latest_per_key(df, "url", "version").collect()] == [("a", 9.0, 3)]


def test_last_write_wins_whatever_the_row_order(spark, tmp_path):
    for n, rows in enumerate(([("a", "aa-first", 1), ("a", "zz-later", 2)], [("a", "zz-later", 2), ("a", "aa-first", 1)])):
        got = SK.store_upsert(str(tmp_path / str(n)), spark.createDataFrame(rows, "url string, plaintext string, written int"), "url", "written")
        assert [r.plaintext for r in got.collect()] == ["zz-later"]


def test_store_merges_over_runs(spark, tmp_path):
    store = str(tmp_path / "s")
    SK.store_upsert(store, spark.createDataFrame([("a", 1.0), ("b", 2.0)], "url string, rank double"))
    SK.store_upsert(store, spark.createDataFrame([("b", 3.0), ("c", 4.0)], "url string, rank double"))
    assert SK.store_version(spark, store) == 2
    assert sorted(map(tuple, SK.read_store(spark, store).collect())) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]


def test_rank_slices_layout(spark, tmp_path):
    df = spark.createDataFrame([("a", 3.0, 2), ("b", 5.0, 2), ("c", 1.0, 7)],
                               "url string, rank double, total_links long")
    out = str(tmp_path / "slices")
    SK.write_rank_slices(df, out)
    s2 = spark.read.parquet(out + "/total_links=2").collect()
    assert [r.url for r in s2] == ["b", "a"]


def test_export_text_and_graph(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "url string, rank double")
    SK.export_text(df, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a has rank: 1.5."]
    doc = spark.createDataFrame([([("n", 0, 1.0, 2)], [(0, 0, 1)])],
                                "nodes array<struct<name:string,group:int,rank:double,"
                                "total_links:long>>, links array<struct<source:long,target:long,"
                                "value:int>>")
    SK.write_graph(doc, str(tmp_path / "g"))
    line = spark.read.text(str(tmp_path / "g")).first().value
    assert json.loads(line) == {"nodes": [{"name": "n", "group": 0, "rank": 1.0, "total_links": 2}],
                                "links": [{"source": 0, "target": 0, "value": 1}]}


def test_bucketed_ranked_table(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i}", float(i), i) for i in range(50)],
                               "url string, rank double, total_links long")
    SK.save_ranked_table(df, "ranked_test", buckets=4)
    t = spark.table("ranked_test")
    assert t.count() == 50
    plan = t.join(t.select("url", F.col("rank").alias("r2")), "url")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    spark.sql("DROP TABLE ranked_test")
