import gzip
import json

from pyspark.sql import functions as F


from webloom.plans import production as PR
from webloom.sources import readers as RD
from webloom.sources import sinks as SK


def _record(uri, payload):
    body = payload.encode()
    return (f"WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: {uri}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def _meta(links):
    return json.dumps({"Envelope": {"Payload-Metadata": {"HTTP-Response-Metadata": {
        "HTML-Metadata": {"Links": links}}}}})


def test_archive_round_trip_gzip(spark, tmp_path):
    d = tmp_path / "wet"
    d.mkdir()
    data = (_record("http://en.wikipedia.org/wiki/A", "<b>Hello</b> wörld\nline2")
            + _record("http://other.org/x", "skip me"))
    with gzip.open(d / "a.warc.wet.gz", "wb") as f:
        f.write(data[: len(data) // 2])
    with gzip.open(d / "a.warc.wet.gz", "ab") as f:  # second gzip member
        f.write(data[len(data) // 2:])
    recs = RD.read_archive(spark, str(d)).collect()
    assert len(recs) == 2 and all(r["length_ok"] for r in recs)
    texts = PR.text_records(RD.read_archive(spark, str(d))).collect()
    assert [(t["url"], t["plaintext"]) for t in texts] == \
        [("http://en.wikipedia.org/wiki/A", "Hello wrld\nline2")]


def test_link_metadata_dirty_inputs(spark, tmp_path):
    d = tmp_path / "wat"
    d.mkdir()
    recs = [
        _record("http://en.wikipedia.org/wiki/A",
                _meta([{"url": "/wiki/B"}, {"path": "x", "ok": True}, {"url": "/wiki/B"},
                       {"url": "http://x/"}, {"url": "/wikipedia"}, {"url": None}])),
        _record("http://en.wikipedia.org/wiki/NoLinks", json.dumps({"Envelope": {}})),
        _record("http://en.wikipedia.org/wiki/Bad", "{not json"),
        _record("http://en.wikipedia.org/wiki/Empty", _meta([])),
    ]
    recs.append(_record("http://en.wikipedia.org/wiki/T",
                        _meta([{"url": "/wiki/construed_true"}, {"url": "/wiki/false_start"}])))
    (d / "m.warc.wat").write_bytes(b"".join(recs))
    meta = RD.read_link_metadata(spark, str(d))
    got = {r["url"]: r["links"] for r in meta.collect()}
    assert got["http://en.wikipedia.org/wiki/A"] == ["/wiki/B", "/wiki/B", "http://x/",
                                                     "/wikipedia"]
    assert got["http://en.wikipedia.org/wiki/NoLinks"] is None
    assert got["http://en.wikipedia.org/wiki/Bad"] is None
    assert got["http://en.wikipedia.org/wiki/T"] == ["/wiki/construed_true", "/wiki/false_start"]
    pages = {r["url"]: r["links"] for r in PR.link_records(meta, prefix="/wiki/").collect()}
    assert pages == {"http://en.wikipedia.org/wiki/A": ["http://en.wikipedia.org/wiki/B"] * 2,
                     "http://en.wikipedia.org/wiki/Empty": [],
                     "http://en.wikipedia.org/wiki/T": [
                         "http://en.wikipedia.org/wiki/construed_true",
                         "http://en.wikipedia.org/wiki/false_start"]}


def test_index_lines_and_paths(spark, tmp_path):
    d = tmp_path / "idx"
    d.mkdir()
    (d / "domain-wikipedia.org-00").write_text(
        'org,wikipedia,en)/wiki/a 2015 {"url": "http://en.wikipedia.org/wiki/a", '
        '"filename": "c/s1/warc/f1.warc.gz"}\n'
        "broken line without json\n"
        'org,wikipedia,en)/wiki/b 2015 {"url": "http://en.wikipedia.org/wiki/b"}\n'
        'org,wikipedia,en)/wiki/c 2015 {"url": "http://en.wikipedia.org/wiki/c", '
        '"filename": "c/s1/warc/f1.warc.gz"}\n')
    (d / ".DS_Store").write_text("junk")
    idx = RD.read_index(spark, str(d), glob="domain-*")
    assert idx.count() == 4 and idx.filter("valid").count() == 2
    paths = PR.archive_paths(idx, "*.wikipedia.org").collect()
    assert [(p.path, p.text_path, p.meta_path) for p in paths] == \
        [("c/s1/warc/f1.warc.gz", "c/s1/wet/f1.warc.wet.gz", "c/s1/wat/f1.warc.wat.gz")]
    out = str(tmp_path / "paths")
    SK.write_paths(PR.archive_paths(idx), out)
    assert [r.path for r in RD.read_paths(spark, out).collect()] == ["c/s1/warc/f1.warc.gz"]


def test_manifest_reports_true_status(spark):
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    recs = spark.createDataFrame([("a",), ("a",)], "source_file string")
    got = {r.source_file: (r.status, r.n_records) for r in SK.ingest_manifest(paths, recs).collect()}
    assert got == {"a": ("uploaded", 2), "b": ("NOTuploaded", 0)}


def test_read_analysis_array_files(spark, tmp_path):
    rows = [{"url": "u1", "rank": 2.5, "total_links": 10}, {"url": "u2", "rank": 3.0,
                                                             "total_links": 4}]
    (tmp_path / "analysis_data_q1.json").write_text(json.dumps(rows))
    (tmp_path / "graphing_q1.json").write_text(json.dumps({"nodes": []}))
    df = RD.read_analysis(spark, str(tmp_path), "analysis_data")
    assert sorted((r.url, r.rank, r.total_links) for r in df.collect()) == \
        [("u1", 2.5, 10), ("u2", 3.0, 4)]


def test_read_links_and_text(spark, tmp_path):
    (tmp_path / "a.wat.gz.json").write_text(
        json.dumps({"url": "u", "links": ["x", "y"]}) + "\n" + json.dumps({"url": "v"}) + "\n")
    (tmp_path / "a.wet.gz.json").write_text(json.dumps({"url": "u", "plaintext": "hi"}) + "\n")
    links = RD.read_links(spark, str(tmp_path / "*.wat.gz.json")).collect()
    assert [(r.url, r.links) for r in links] == [("u", ["x", "y"]), ("v", None)]
    text = RD.read_text(spark, str(tmp_path / "*.wet.gz.json")).collect()
    assert [(r.url, r.plaintext) for r in text] == [("u", "hi")]


def test_write_pages_per_archive(spark, tmp_path):
    df = spark.createDataFrame([("s/a.gz", "u1", "t"), ("s/b.gz", "u2", "t")],
                               "source_file string, url string, plaintext string")
    SK.write_pages(df, str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("archive="))
    assert names == ["archive=s_a.gz.json", "archive=s_b.gz.json"]


def test_archive_headers_map(spark, tmp_path):
    d = tmp_path / "w"
    d.mkdir()
    body = "payload"
    rec = (f"WARC/1.0\r\nWARC-Type: response\r\nwarc-target-uri: http://a/b\r\n"
           f"Content-Length: {len(body) + 3}\r\nX-Note: a: b\r\nx-note: again\r\n"
           f"WARC-Target-URI: http://dup/\r\n\r\n{body}\r\n\r\n").encode()
    (d / "x.warc").write_bytes(rec)
    from webloom.functions.urls import header
    r = RD.read_archive(spark, str(d)).select(
        "url", "length_ok", header(F.col("headers"), "WARC-TYPE").alias("t"),
        header(F.col("headers"), "x-note").alias("n"),
        header(F.col("headers"), "missing").alias("m")).first()
    assert (r.url, r.t, r.n, r.m) == ("http://a/b", "response", "a: b", None)
    assert r.length_ok is False       # declared length does not match: flagged, kept


def test_broken_json_lines_are_flagged_and_counted(spark, tmp_path):
    from webloom.sources import readers as RD
    (tmp_path / "p.json").write_text('{"url": "a", "links": ["x"]}\n{"url": "b", "links"\n{"links": ["y"]}\n')
    rows = RD.read_links(spark, str(tmp_path))
    assert sorted((r.url or "", r.valid) for r in rows.collect()) == [("", False), ("", False), ("a", True)]
    assert RD.rejected(rows).first().n_rejected == 2


def test_a_version_line_inside_a_payload_does_not_cut_it(spark, tmp_path):
    from webloom.plans import production as PR
    from webloom.sources import readers as RD
    def record(url, payload):
        return f"WARC/1.0\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"
    inner, cut = "AAA WARC/1.0\r\n BBB tail", "AAA\r\n\r\nWARC/1.0\r\nBBB"
    (tmp_path / "a.warc").write_bytes((record("http://w/1", inner) + record("http://w/2", cut) + record("http://w/3", "end")).encode())
    rows = RD.read_archive(spark, str(tmp_path))
    got = {r.url: (r.payload, r.length_ok) for r in rows.collect() if r.url}
    assert got["http://w/1"] == (inner, True) and got["http://w/3"] == ("end", True) and got["http://w/2"][1] is False
    assert {r.url for r in PR.text_records(rows, "http://w").collect()} == {"http://w/1", "http://w/3"}
    assert RD.rejected(rows, "length_ok").first().n_rejected == 1
