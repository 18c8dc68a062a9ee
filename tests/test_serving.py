from webloom.operators import graph as G
from webloom.operators import search as S
from webloom.plans.search_request import search_request
from webloom.plans.serving import build_stores, served_request
from webloom.sources.tables import part_graph


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_served_request_equals_full_request(spark, tmp_path):
    g = part_graph(spark, "/root/testdata/sf0.001")
    ranked = G.ranked_pages(g, G.pagerank(g, 1))
    store = str(tmp_path / "stores")
    build_stores(g, ranked, g.pages, store, buckets=8)
    served = served_request(spark, store, "widget", buckets=8)
    full = search_request(S.build_index(g.pages), ranked, g.links, "widget",
                          lengths=S.text_lengths(g.pages))
    assert _rows(served.table) == _rows(full.table)
    assert _rows(served.nodes) == _rows(full.nodes)
    assert _rows(served.edges) == _rows(full.edges)
    assert len(_rows(served.nodes)) == 24



def test_keyed_lookup_finds_every_key_of_each_type(spark, tmp_path):
    from webloom.sources.keyed import read_keyed, write_keyed
    for kind, keys in (("string", ["", "a", "für", "x" * 100, "http://e.org/a?b=c"]),
                       ("long", [0, 1, -1, 2**62, -2**63, 123456789]), ("int", [0, 5, -7])):
        store = str(tmp_path / kind)
        write_keyed(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, n int"), store, "k", 16)
        got = read_keyed(spark, store, "k", keys + [None], 16)
        assert sorted(r.n for r in got.collect()) == list(range(len(keys)))
    assert read_keyed(spark, store, "k", [], 16).count() == 0


def test_keyed_lookup_prunes(spark, tmp_path):
    from pyspark.sql import functions as F
    from webloom.sources.keyed import read_keyed, write_keyed
    store = str(tmp_path / "kv")
    write_keyed(spark.range(1000).select(F.col("id").alias("url"), (F.col("id") * 2).alias("v")),
                store, "url", 16)
    got = read_keyed(spark, store, "url", [3, 500, 999], 16)
    assert sorted(tuple(r) for r in got.collect()) == [(3, 6), (500, 1000), (999, 1998)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(url), In(url" in plan or "In(url" in plan


def test_keyed_lookup_with_quotes_in_keys(spark, tmp_path):
    from webloom.sources.keyed import read_keyed, write_keyed
    keys = ["http://a/it's", 'http://a/"q"', "http://a/back\\slash", "plain"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "url string, v int")
    store = str(tmp_path / "kv")
    write_keyed(df, store, "url", 4)
    got = read_keyed(spark, store, "url", keys[:3], 4).collect()
    assert sorted(r.url for r in got) == sorted(keys[:3])


def test_hot_key_is_split_over_several_files(spark, tmp_path):
    import glob
    from pyspark.sql import functions as F
    from webloom.sources.keyed import read_keyed, write_keyed
    rows = spark.range(20000).select(
        F.when(F.col("id") < 15000, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50)
                                                                       .cast("string"))).alias("term"),
        F.col("id").alias("url"))
    store = str(tmp_path / "p")
    write_keyed(rows, store, "term", 8, partitions=8)
    b = spark.range(1).select(F.pmod(F.xxhash64(F.lit("hot")), F.lit(8))).first()[0]
    files = glob.glob(f"{store}/bucket={b}/*.parquet")
    assert len(files) > 1
    assert read_keyed(spark, store, "term", ["hot"], 8).count() == 15000
