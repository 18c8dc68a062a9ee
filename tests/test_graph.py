from pyspark.sql import functions as F

from webloom.operators import graph as G


def ranks_of(df):
    return {r["url"]: round(r["rank"], 9) for r in df.collect()}


def test_mini_graph_round_1(mini_graph):
    r = ranks_of(G.pagerank(mini_graph, 1))
    assert r == {"A": 1.425, "B": 0.49, "C": 1.765, "X": 0.32}


def test_mini_graph_round_2(mini_graph):
    r = ranks_of(G.pagerank(mini_graph, 2))
    assert r == {"A": 0.900125, "B": 0.6345, "C": 1.801125, "X": 0.39225}


def test_ranked_pages_drop_uncrawled_and_vanished(mini_graph):
    rp = G.ranked_pages(mini_graph, G.pagerank(mini_graph, 1)).collect()
    got = {r["url"]: (round(r["rank"], 6), r["total_links"]) for r in rp}
    assert got == {"A": (1.425, 5), "B": (0.49, 1), "C": (1.765, 2)}


def test_hot_source_path_gives_same_ranks(mini_graph):
    # Force every source with more than one distinct target to be "hot".
    edges = G.build_edges(mini_graph.links, hot_max_keys=10, hot_min_rows=1)
    assert sorted(r["src"] for r in edges.hot_src.collect()) == ["A", "C"]
    hot = ranks_of(G.pagerank(mini_graph, 2, edges=edges))
    cold = ranks_of(G.pagerank(mini_graph, 2))
    assert hot == cold


def test_checkpointed_rounds_match_unrolled(mini_graph):
    a = ranks_of(G.pagerank(mini_graph, 5, checkpoint_every=2))
    b = ranks_of(G.pagerank(mini_graph, 5, checkpoint_every=0))
    assert a == b


def test_one_capture_per_url(spark):
    rows = [("A", ["B"], "f2"), ("A", ["B", "C"], "f3"), ("A", ["C", "D"], "f1"), ("B", None, "f1")]
    df = spark.createDataFrame(rows, "url string, links array<string>, source_file string")
    got = {r["url"]: (r["links"], r["source_file"]) for r in G.one_capture_per_url(df).collect()}
    assert got["A"] == (["C", "D"], "f1")
    assert got["B"] == (None, "f1")


def test_out_degree_counts_repeats(mini_graph):
    got = {r["url"]: (r["out_degree"], r["n_targets"])
           for r in G.out_degree(mini_graph.links).collect()}
    assert got == {"A": (5, 3), "B": (1, 1), "C": (2, 2), "D": (1, 1)}


def test_graph_p_fixture_numbers(spark):
    from webloom.sources.tables import part_graph
    g = part_graph(spark, "/root/testdata/sf0.001")
    ranks = G.pagerank(g, 1)
    n, s = ranks.agg(F.count("*"), F.sum("rank")).first()
    assert n == 213 and abs(s - 201.95) < 1e-6
    kept = G.ranked_pages(g, ranks)
    assert kept.count() == 200
    top = G.top_ranks(ranks, 1).first()
    assert (top["url"], top["rank"]) == (0, 4.096979)


def test_hot_sources_across_checkpoint_segments(mini_graph):
    edges = G.build_edges(mini_graph.links, hot_max_keys=10, hot_min_rows=1)
    hot = ranks_of(G.pagerank(mini_graph, 5, checkpoint_every=2, edges=edges))
    plain = ranks_of(G.pagerank(mini_graph, 5, checkpoint_every=0))
    assert hot == plain


def test_ranked_pages_with_edge_degree_equals_recount(mini_graph):
    edges = G.build_edges(mini_graph.links)
    ranks = G.pagerank(mini_graph, 2, edges=edges)
    a = sorted(tuple(r) for r in G.ranked_pages(mini_graph, ranks, edges).collect())
    b = sorted(tuple(r) for r in G.ranked_pages(mini_graph, ranks).collect())
    assert a == b


def test_pagerank_accepts_edges_without_hot_branch(mini_graph):
    e = G.build_edges(mini_graph.links)
    no_hot = G.Edges(cold=e.cold, hot=None, hot_src=None, degree=e.degree)
    a = ranks_of(G.pagerank(mini_graph, 5, checkpoint_every=2, edges=no_hot))
    b = ranks_of(G.pagerank(mini_graph, 5, checkpoint_every=0))
    assert a == b


def test_scratch_tables_can_be_dropped(spark, mini_graph):
    from webloom.session import drop_scratch_tables
    drop_scratch_tables(spark)
    assert len(ranks_of(G.pagerank(mini_graph, 2))) == 4
    assert drop_scratch_tables(spark) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("webloom_")]


def test_a_round_of_bucketed_ranks_and_edges_has_one_shuffle(spark, mini_graph):
    """Ranks come out of a round in the buckets that the edges lie in."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [G.pagerank(mini_graph, n, checkpoint_every=0)._jdf.queryExecution().executedPlan().toString() for n in (3, 4)]
        cut = G.pagerank(mini_graph, 6, checkpoint_every=5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [p.count("Exchange hashpartitioning") for p in plans]
    assert shuffles[1] - shuffles[0] == 1 and cut.count("Exchange hashpartitioning") == 1


def test_rounds_end_once_nothing_moves(spark, mini_graph):
    far = {r.url: r.rank for r in G.pagerank(mini_graph, 64, checkpoint_every=8).collect()}
    near = {r.url: r.rank for r in G.pagerank(mini_graph, 500, checkpoint_every=8, until=1e-3).collect()}
    assert near.keys() == far.keys() and all(abs(near[k] - far[k]) < 0.02 for k in far)


def test_many_links_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """3,000 links in one split: they are summed in pieces, once by pair and once by source."""
    links = spark.range(3000, numPartitions=1).select((F.col("id") % 50).alias("url"), F.col("id").alias("pos"), (F.col("id") % 1000).alias("link"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plans = []
    real = G.written_table
    monkeypatch.setattr(G, "written_table", lambda df, prefix: plans.append((prefix, df._jdf.queryExecution().executedPlan().toString())) or real(df, prefix))
    dealt = G.build_edges(links, stored=True, rows_per_task=100)
    assert dealt.cold.rdd.getNumPartitions() >= 30 and dealt.cold.rdd.getNumPartitions() % n == 0
    pairs = dict(plans)["pairs"]
    assert pairs.count("Exchange") == 1 and "REPARTITION_BY_NUM" in pairs and pairs.rindex("HashAggregate") < pairs.index("Exchange")
    whole = G.build_edges(links, stored=True)
    assert sorted(map(tuple, dealt.cold.collect())) == sorted(map(tuple, whole.cold.collect()))
    assert sorted(map(tuple, dealt.degree.collect())) == sorted(map(tuple, whole.degree.collect()))


def test_dealt_links_with_hot_sources_give_the_same_edges(spark):
    """One source with most links, repeated links and null ends."""
    rows = [(1, i, i % 70) for i in range(300)] + [(2, 0, 5), (2, 1, 5), (None, 0, 5), (3, 0, None), (3, 1, None)]
    links = spark.createDataFrame(rows, "url long, pos long, link long")
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got, want = [sorted(map(tuple, e.cold.unionByName(e.hot).collect()), key=key)
                 for e in (G.build_edges(links, 10, 10, stored=True, rows_per_task=20), G.build_edges(links, 10, 10))]
    assert got == want and len(got) == 72
