import json

from webloom.plans.ranking import rank_link_pages
from webloom.streaming import ingest


def test_incremental_link_ingest_is_exactly_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "p1.json").write_text("\n".join(json.dumps(r) for r in [
        {"url": "A", "links": ["B", "B", "C", "C", "X"]}, {"url": "B", "links": ["C"]},
        {"url": "Z"}]) + "\n")
    q = ingest.ingest_link_pages(spark, str(src), out, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2          # Z has no link section
    (src / "p2.json").write_text("\n".join(json.dumps(r) for r in [
        {"url": "C", "links": ["A", "C"]}, {"url": "D", "links": ["A"]},
        {"url": "E", "links": []}]) + "\n")
    q = ingest.ingest_link_pages(spark, str(src), out, ck)  # restart from the checkpoint
    q.awaitTermination(120)
    pages = spark.read.parquet(out)
    assert pages.count() == 5                              # no file read twice
    r = rank_link_pages(pages, 1)
    got = {x.url: round(x.rank, 9) for x in r.ranks.collect()}
    assert got == {"A": 1.425, "B": 0.49, "C": 1.765, "X": 0.32}


def test_text_ingest_cleans(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "t.json").write_text(json.dumps({"url": "u", "plaintext": "<b>hé</b>llo"}) + "\n")
    q = ingest.ingest_text_pages(spark, str(src), str(tmp_path / "o"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.plaintext for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["hllo"]


def test_ingest_log_counts_each_file_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"url": f"a{i}", "links": []})
                                          for i in range(3)) + "\n")
    ingest.ingest_log(ingest.link_page_stream(spark, str(src)), out, checkpoint_location=ck) \
        .awaitTermination(120)
    (src / "b.json").write_text(json.dumps({"url": "b", "links": ["x"]}) + "\n")
    ingest.ingest_log(ingest.link_page_stream(spark, str(src)), out, checkpoint_location=ck) \
        .awaitTermination(120)
    got = {r.source_file.rsplit("/", 1)[-1]: r.n_records
           for r in ingest.read_ingest_log(spark, out).collect()}
    assert got == {"a.json": 3, "b.json": 1}
