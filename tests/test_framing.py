"""Records framed by their length, rejected rows of every reader."""

import gzip

import pytest
from pyspark.sql import functions as F

from webloom.sources import readers as RD

SEP = "\r\n\r\nWARC/1.0\r\n"


def record(url, payload, declared=None):
    n = len(payload.encode()) if declared is None else declared
    return f"WARC/1.0\r\nWARC-Target-URI: {url}\r\nContent-Length: {n}\r\n\r\n{payload}\r\n\r\n"


FAKE = f"a{SEP}WARC-Target-URI: fake\r\nContent-Length: 9999\r\n\r\nb{SEP}c"


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_payloads_that_hold_separators_are_whole(spark, tmp_path, name):
    payloads = {"u0": "plain", "u1": FAKE, "u2": "", "u3": "é" * 50 + SEP + "é", "u4": f"x{SEP}", "u5": SEP + SEP, "u6": "end" + SEP + "Content-Length: 0\r\n\r\n"}
    data = "".join(record(u, p) for u, p in payloads.items()).encode()
    (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    rows = RD.read_archive(spark, str(tmp_path), stitch=True).collect()
    assert {r.url: r.payload for r in rows} == payloads and len(rows) == len(payloads)
    assert all(r.length_ok and r.reason is None for r in rows)


def test_a_cut_record_swallows_nothing(spark, tmp_path):
    """A declared length that ends inside a later record frames nothing; that record is flagged."""
    (tmp_path / "a.warc").write_bytes((record("u1", "short", 70) + record("u2", "whole") + record("u3", FAKE) + record("u4", "tail", 9000)).encode())
    rows = {r.url: r for r in RD.read_archive(spark, str(tmp_path), stitch=True).collect()}
    assert set(rows) == {"u1", "u2", "u3", "u4"} and rows["u3"].payload == FAKE
    assert [rows[u].reason for u in ("u1", "u2", "u3", "u4")] == [RD.CUT, None, None, RD.CUT]


def test_files_are_framed_each_for_itself(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.warc").write_bytes((record(f"a{k}", FAKE * k) + record(f"b{k}", "x" * k)).encode())
    got = {r.url: r.payload for r in RD.read_archive(spark, str(tmp_path), stitch=True).collect()}
    assert got == {f"a{k}": FAKE * k for k in range(5)} | {f"b{k}": "x" * k for k in range(5)}


def test_a_file_in_several_splits(spark, tmp_path):
    payloads = {f"u{k}": (FAKE if k % 3 == 0 else "p") * (k % 7) for k in range(200)}
    (tmp_path / "a.warc").write_bytes("".join(record(u, p) for u, p in payloads.items()).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = RD.read_archive(spark, str(tmp_path), stitch=True)
        assert RD._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 3
        assert {r.url: r.payload for r in frame.collect()} == payloads
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rejected_rows_of_every_reader_in_one_form(spark, tmp_path):
    for folder, text in (("pages", '{"url": "a", "links": []}\n{"links": []}\n{bad\n'), ("index", 'k 1 {"url": "u", "filename": "f"}\nk 1 {"url": "u"}\nnothing\n')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part").write_text(text)
    for folder, payload in (("text", "plain"), ("meta", '{"Envelope": {}}')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.warc").write_bytes((record("good", payload) + record("cut", payload, 500) + record("bad", "{broken")).encode())
    found = [RD.quarantine(RD.read_links(spark, str(tmp_path / "pages")), "links"), RD.quarantine(RD.read_index(spark, str(tmp_path / "index")), "index"),
             RD.quarantine(RD.read_archive(spark, str(tmp_path / "text")), "text"), RD.quarantine(RD.read_link_metadata(spark, str(tmp_path / "meta")), "meta")]
    assert len({tuple(f.columns) for f in found}) == 1
    got = [sorted((r.kind, r.url, r.reason) for r in f.collect()) if i in (2, 3) else sorted((r.kind, r.reason) for r in f.collect()) for i, f in enumerate(found)]
    assert got == [[("links", RD.NO_URL), ("links", RD.NOT_JSON)], [("index", RD.NO_FILE), ("index", RD.NOT_JSON)],
                   [("text", "cut", RD.CUT)], [("meta", "bad", RD.NOT_JSON), ("meta", "cut", RD.CUT)]]
    cut = RD.read_link_metadata(spark, str(tmp_path / "meta")).filter(F.col("url") == "cut").first()
    assert cut.links is None and cut.length_ok is False
