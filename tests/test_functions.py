from pyspark.sql import functions as F

from webloom.functions import text as TX
from webloom.functions import urls as U
from webloom.functions.numeric import report_round


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_strip_tags_not_across_newline(spark):
    assert one(spark, TX.strip_tags(F.col("v")), "a<b>c<d\ne>f") == "ac<d\ne>f"
    assert one(spark, TX.strip_tags(F.col("v")), "x<a\r>y") == "xy"


def test_ascii_only(spark):
    assert one(spark, TX.ascii_only(F.col("v")), "für café") == "fr caf"


def test_unescape_and_fallback(spark):
    assert one(spark, TX.clean_text(F.col("v")), "<p>a\\nb</p>") == "a\nb"
    assert one(spark, TX.clean_text(F.col("v")), "bad \\x escape") == "bad \\x escape"
    assert one(spark, TX.clean_text(F.col("v")), "<i>plain ü</i>") == "plain "


def test_json_part_and_key(spark):
    line = 'org,wiki)/a 2015 {"url": "http://x/a", "filename": "p/warc/f.warc.gz"}'
    assert one(spark, U.json_key(U.json_part(F.col("v"))), line) == "p/warc/f.warc.gz"
    assert one(spark, U.json_part(F.col("v")), "no json here") == ""
    assert one(spark, U.json_key(U.json_part(F.col("v"))), 'k t {"url": "u"}') is None


def test_archive_paths(spark):
    p = "crawl/seg/warc/CC-1.warc.gz"
    assert one(spark, U.text_archive_path(F.col("v")), p) == "crawl/seg/wet/CC-1.warc.wet.gz"
    assert one(spark, U.meta_archive_path(F.col("v")), p) == "crawl/seg/wat/CC-1.warc.wat.gz"
    assert one(spark, U.output_name(F.col("v")), p) == "crawl_seg_warc_CC-1.warc.gz.json"


def test_site_links_prefix_and_legacy(spark):
    links = ["", "/", "/wiki/A", "/wikipedia", "http://x/", "/wik", "w"]
    sch = "v array<string>"
    assert one(spark, U.site_links(F.col("v"), "/wiki/"), links, sch) == ["/wiki/A"]
    assert one(spark, U.site_links(F.col("v"), "/wiki", legacy=True), links, sch) == \
        ["", "/", "/wiki/A", "/wikipedia", "/wik", "w"]


def test_link_urls_drops_only_missing(spark):
    v = [{"url": "a"}, {"url": None}, {"url": "b"}]
    assert one(spark, U.link_urls(F.col("v")), v, "v array<struct<url:string>>") == ["a", "b"]


def test_absolute_links(spark):
    df = spark.createDataFrame([("https://h.example.com:8/p?q", ["/a", "http://o/b", "c"])],
                               "url string, links array<string>")
    got = df.select(U.absolute_links(F.col("links"), U.site_base(F.col("url")))).first()[0]
    assert got == ["https://h.example.com:8/a", "http://o/b", "https://h.example.com:8c"]


def test_url_patterns(spark):
    urls = ["http://a.example.com/x", "http://example.com/", "http://badexample.com/",
            "https://m.x/y", "http://exact/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    dom = {r.url for r in df.filter(U.url_matches(F.col("url"), "*.example.com")).collect()}
    assert dom == {"http://a.example.com/x", "http://example.com/"}
    pre = {r.url for r in df.filter(U.url_matches(F.col("url"), "https://m.*")).collect()}
    assert pre == {"https://m.x/y"}
    ex = {r.url for r in df.filter(U.url_matches(F.col("url"), "http://exact/")).collect()}
    assert ex == {"http://exact/"}


def test_labels(spark):
    for pattern, label in (("*.wikipedia.org", "domain-wikipedia.org-"), ("en.wikipedia.org/wiki/*", "prefix-en.wikipedia.org-wiki-"),
                           ("http://a.b/c d", "a.b-c%20d-"), ("//a.b/~x*y/", "a.b-~x%2Ay-"), ("", "-")):
        assert one(spark, U.dataset_label(F.col("v")), pattern, "v string") == label
    assert one(spark, U.page_label(F.col("v"), 120), 7, "v int") == "007"


def test_report_round_matches_plain_ieee_arithmetic(spark):
    import math
    vals = [0.2605625, 0.26056249999, 2.0000005, 1.5e-7, 123.4567895, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(report_round(F.col("v"))).collect()]
    want = [math.floor(round(v, 9) * 1e6 + 0.5) / 1e6 for v in vals]
    assert got == want
