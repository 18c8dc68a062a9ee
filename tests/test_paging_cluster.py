
from pyspark.sql import functions as F

from webloom.operators import cluster as CL
from webloom.operators import paging as PA


def test_row_index_matches_row_number(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"),
                                     F.col("id").alias("v")).repartition(5)
    got = {r.k: r.row_idx for r in PA.with_row_index(df, "k").collect()}
    assert got == {k: k for k in range(1000)}
    page = PA.index_page(df, 2, 100, "k").collect()
    assert sorted(r.k for r in page) == list(range(200, 300))
    r = PA.page_count(df, 300).first()
    assert (r.n_rows, r.n_pages) == (1000, 4)


def test_pages_of_one_listing(spark, tmp_path):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("row"), F.lit("x").alias("place")).repartition(5)
    path = str(tmp_path / "l")
    PA.write_listing(df, path, "k", block_rows=50)
    want = sorted((r.k, r.row, "x", r.k) for r in df.collect())
    for page, size in ((0, 100), (3, 64), (9, 100), (0, 5000), (7, 1000)):
        got = PA.listing_page(spark, path, page, size)
        assert got.columns == ["k", "row", "place", "row_idx"]
        assert sorted(map(tuple, got.collect())) == want[page * size:(page + 1) * size]
    assert [PA.listing_seek(spark, path, k) for k in (-1, 0, 1, 500, 999, 2000)] == [0, 0, 1, 500, 999, 1000]


def test_a_page_reads_its_blocks_alone(spark, tmp_path):
    """No sort, no shuffle; the folders and places are given to the scan."""
    path = str(tmp_path / "l")
    PA.write_listing(spark.range(100_000).repartition(8), path, "id", block_rows=1000)
    parts = spark.read.parquet(f"{path}/directory").agg(F.countDistinct("part")).first()[0]
    page = PA.listing_page(spark, path, 3, 100)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(place,300)" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert page.select(F.input_file_name().alias("f")).distinct().count() == 1 <= parts


def test_listing_of_nothing(spark, tmp_path):
    path = str(tmp_path / "l")
    PA.write_listing(spark.range(0), path, "id")
    assert PA.listing_page(spark, path, 0, 10).collect() == [] and PA.listing_seek(spark, path, 5) == 0


def test_kmeans_invariants(spark):
    rows = spark.createDataFrame(
        [(f"u{i}", float(2 + (i % 7) * 30 + i % 3), (i * 37) % 400 + 2) for i in range(120)],
        "url string, rank double, total_links long")
    model = CL.fit(rows, k=4, seed=3)
    lab = CL.assign(rows, model)
    assert lab.count() == 120
    assert lab.select("label").distinct().count() == 4
    centres = CL.model_centroids(model)
    for r in lab.collect():
        d = [(r.total_links - c[0]) ** 2 + (r.rank - c[1]) ** 2 for c in centres]
        assert d[r.label] == min(d)
    cents = CL.centroids(lab).collect()
    assert sum(c.n for c in cents) == 120


def test_scatter_points_range(spark):
    rows = spark.createDataFrame([("a", 2.5, 10), ("b", 600.0, 10), ("c", 3.0, 1)],
                                 "url string, rank double, total_links long")
    got = [(r.url, round(r.log_rank, 6)) for r in CL.scatter_points(rows).collect()]
    assert got == [("a", 0.39794)]


def test_clustering_job_on_saved_files(spark, tmp_path):
    import json
    from webloom.plans import clustering
    rows = [{"url": f"u{i}", "rank": 2.0 + (i % 5) * 40 + i * 0.01, "total_links": 10 + (i % 4) * 100}
            for i in range(40)]
    (tmp_path / "analysis_data_a.json").write_text(json.dumps(rows[:25]))
    (tmp_path / "analysis_data_b.json").write_text(json.dumps(rows[25:]))
    (tmp_path / "other.json").write_text(json.dumps(rows))
    c = clustering.run(spark, str(tmp_path), str(tmp_path / "out"))
    assert c.labelled.count() == 40
    assert spark.read.parquet(str(tmp_path / "out/centroids")).count() == 4


def test_wide_rows_keep_their_numbers(spark):
    wide = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("k"), F.col("id").alias("v"), F.md5(F.col("id").cast("string")).alias("pad"))
    numbered = PA.with_row_index(wide, "k")
    got = numbered.agg(F.count(F.lit(1)), F.count_distinct("row_idx"), F.min("row_idx"), F.max("row_idx")).first()
    assert tuple(got) == (400_000, 400_000, 0, 399_999)
    assert PA.index_page(wide, 100, 1000, "k").count() == 1000


def test_rows_without_a_feature_keep_a_null_label(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("b", None, 3), ("c", 9.0, 30), ("d", 2.0, None)], "url string, rank double, total_links int")
    got = {r.url: r.label for r in CL.assign(rows, CL.fit(rows, 2)).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["b"] is None and got["d"] is None and got["a"] != got["c"]
    assert sum(r.n for r in CL.centroids(CL.assign(rows, CL.fit(rows, 2))).collect()) == 2


def test_rounds_from_given_centres_equal_plain_ones(spark):
    points = [(float((i * 37) % 101), float((i * i) % 53)) for i in range(150)] + [(float("nan"), 1.0)]
    rows = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], "url long, rank double, total_links double")
    start = [(0.0, 0.0), (50.0, 50.0), (1e6, 1e6), (100.0, 0.0)]  # the third never has a row
    centres = list(start)
    for _ in range(5):
        own = {}
        for p in points[:-1]:
            far = [(p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2 for c in centres]
            own.setdefault(far.index(min(far)), []).append(p)
        centres = [tuple(sum(v) / len(own[k]) for v in zip(*own[k])) if k in own else c for k, c in enumerate(centres)]
    got = CL.lloyd(rows, start, 5)
    assert got[2] == start[2] and all(abs(a - b) < 1e-9 for g, c in zip(got, centres) for a, b in zip(g, c))
    last = CL.lloyd(rows, got, 100)
    assert CL.lloyd(rows, last, 3) == last
    picks = CL.spread_centres(rows, 4)
    assert len(set(picks)) == 4 and set(picks) <= set(points)
    assert CL.spread_centres(rows.limit(2), 4) == sorted(points[:2]) and CL.spread_centres(rows.limit(0), 4) == []
