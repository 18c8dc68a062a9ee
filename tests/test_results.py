from pyspark.sql import functions as F

from webloom.operators import graph as G
from webloom.operators import results as R
from webloom.operators.search import build_index
from webloom.plans.search_request import search_request


def _request(spark, mini_graph, budget=20, cutoff=0.4):
    ranked = G.ranked_pages(mini_graph, G.pagerank(mini_graph, 1))
    docs = spark.createDataFrame([(u, "common " + u) for u in "ABCDE"], "url string, text string")
    return search_request(build_index(docs), ranked, mini_graph.links, "common",
                          budget=budget, cutoff=cutoff)


def test_mini_graph_request(spark, mini_graph):
    res = _request(spark, mini_graph)
    table = [(r["url"], r["rank"]) for r in res.table.orderBy(F.desc("rank")).collect()]
    assert table == [("C", 1.765), ("A", 1.425), ("B", 0.49)]
    seeds = {r["seed_idx"]: r["url"] for r in res.seeds.collect()}
    assert seeds == {0: "C", 1: "A"}
    assert sorted((r["source"], r["target"], r["value"]) for r in res.seed_edges.collect()) == \
        [(0, 0, 1), (0, 1, 1), (1, 0, 1)]
    nodes = {r["node_id"]: (r["name"], r["group"]) for r in res.nodes.collect()}
    assert nodes == {0: ("C", 0), 1: ("A", 0), 2: ("A", 19), 3: ("C", 19),
                     4: ("B", 1), 5: ("C", 1), 6: ("X", 1)}
    edges = sorted((r["source"], r["target"], r["value"]) for r in res.edges.collect())
    assert edges == sorted([(0, 1, 1), (0, 0, 1), (1, 0, 1), (2, 0, 4), (3, 0, 4),
                            (4, 1, 4), (5, 1, 4), (6, 1, 4)])


def test_graph_document_shape(spark, mini_graph):
    doc = _request(spark, mini_graph).document().first()
    assert [n["name"] for n in doc["nodes"]] == ["C", "A", "A", "C", "B", "C", "X"]
    assert doc["nodes"][2]["rank"] is None
    assert len(doc["links"]) == 8
    assert doc["links"][0]["value"] == 1


def test_written_document_keeps_null_fields(spark, mini_graph, tmp_path):
    import json
    from webloom.sources.sinks import write_graph
    write_graph(_request(spark, mini_graph).document(), str(tmp_path / "g"))
    doc = json.loads(spark.read.text(str(tmp_path / "g")).first().value)
    assert doc["nodes"][0] == {"name": "C", "group": 0, "rank": 1.765, "total_links": 2}
    assert doc["nodes"][2] == {"name": "A", "group": 19, "rank": None, "total_links": None}
    assert doc["links"][:3] == [{"source": 0, "target": 0, "value": 1},
                                {"source": 0, "target": 1, "value": 1},
                                {"source": 2, "target": 0, "value": 4}]


def test_no_seeds_gives_empty_graph(spark, mini_graph):
    res = _request(spark, mini_graph, cutoff=100.0)
    doc = res.document().first()
    assert doc["nodes"] == [] and doc["links"] == []
    assert res.table.count() == 0


def test_seed_edges_are_not_capped_and_neighbours_fill_rest(spark):
    # Page S0 links to 12 other seeds: 12 seed edges, no neighbours.
    from webloom.operators.graph import link_pages_graph
    seeds = [f"S{i}" for i in range(13)]
    rows = [("S0", seeds[1:] + ["N1"])] + [(s, ["S0", "N2"]) for s in seeds[1:]]
    g = link_pages_graph(spark.createDataFrame(rows, "url string, links array<string>"))
    ranked = g.pages.select("url", F.lit(5.0).alias("rank"), F.lit(3).cast("long").alias("total_links"))
    found = R.above_rank(ranked)
    s = R.pick_seeds(found, 13)
    d = R.seed_links(g.links, s)
    se = R.seed_edges(d, s)
    nb = R.neighbours(d, se, s)
    s0 = s.filter("url = 'S0'").first()["seed_idx"]
    assert se.filter(F.col("source") == s0).count() == 12
    assert nb.filter(F.col("seed_idx") == s0).count() == 0
    # every other seed: 1 seed edge (to S0) -> up to 9 neighbours, it has 2 distinct links
    assert nb.count() == 12 * 2
    ids = sorted(r["node_id"] for r in nb.collect())
    assert ids == list(range(13, 13 + 24))


def test_colour_group(spark):
    df = spark.range(0, 41).select(R.colour_group(F.col("id")).alias("g"), "id")
    got = {r["id"]: r["g"] for r in df.collect()}
    assert got[0] == 19 and got[20] == 19 and got[1] == 1 and got[39] == 19 and got[21] == 1


def test_node_budget():
    assert R.node_budget("Max (1000 nodes)") == 1000
    assert R.seed_count(R.node_budget("Very Low (50 nodes)")) == 5


def test_limit_is_applied_before_cutoff(spark, mini_graph):
    ranked = G.ranked_pages(mini_graph, G.pagerank(mini_graph, 1))
    hits = spark.createDataFrame([("B", 3.0), ("A", 2.0), ("C", 1.0)], "url string, score double")
    first = R.first_hits(hits, 1)  # only B is looked up
    found = R.above_rank(R.lookup_pages(first, ranked), 1.0)
    assert found.count() == 0      # B is below the cutoff, A and C were never looked up


def test_url_with_quote_is_looked_up(spark):
    from webloom.operators.graph import link_pages_graph
    rows = [("http://x/it's", ["http://x/b", "http://x/it's"]), ("http://x/b", ["http://x/it's"])]
    g = link_pages_graph(spark.createDataFrame(rows, "url string, links array<string>"))
    ranked = G.ranked_pages(g, G.pagerank(g, 1))
    docs = spark.createDataFrame([(u, "quote page") for u, _ in rows], "url string, text string")
    res = search_request(build_index(docs), ranked, g.links, "quote", cutoff=0.0)
    assert {r.url for r in res.table.collect()} == {"http://x/it's", "http://x/b"}


def test_batch_graph_equals_single_requests(spark):
    from webloom.operators.search import query_postings, text_lengths
    from webloom.plans import batch_search as BS
    from webloom.sources.tables import part_graph
    g = part_graph(spark, "/root/testdata/sf0.001")
    ranked = G.ranked_pages(g, G.pagerank(g, 1))
    qs = spark.createDataFrame([("q1", "red widget"), ("q2", "blue bolt")], "query_id string, q string")
    found = BS.batch_search(build_index(g.pages), ranked, qs, cutoff=1.0,
                            lengths=text_lengths(g.pages))
    nodes, edges = BS.batch_graph(found, g.links, budget=50)
    for qid, q in [("q1", "red widget"), ("q2", "blue bolt")]:
        one = search_request(query_postings(g.pages, q), ranked, g.links, q, budget=50,
                             cutoff=1.0, lengths=text_lengths(g.pages))
        want_n = sorted(tuple(r) for r in one.nodes.collect())
        got_n = sorted(tuple(r)[1:] for r in nodes.filter(F.col("query_id") == qid).collect())
        assert got_n == want_n and len(want_n) > 0
        want_e = sorted(tuple(r) for r in one.edges.collect())
        got_e = sorted(tuple(r)[1:] for r in edges.filter(F.col("query_id") == qid).collect())
        assert got_e == want_e
