"""Merged stores: rows, bytes rewritten, concurrent merges, lookups."""

import pytest
from pyspark.sql import functions as F

from webloom.sources import store as ST


def rows(spark, n, step=1, written=0, start=0):
    return spark.range(start, n, step).select(F.col("id").alias("url"), F.sha2(F.concat_ws(":", "id", F.lit(written)), 512).alias("body"), F.lit(written).cast("long").alias("written"))


def state(df):
    return {r["url"]: r["written"] for r in df.select("url", "written").collect()}


def test_a_small_merge_writes_only_what_it_brings(spark, tmp_path):
    path = str(tmp_path / "s")
    first = ST.merge(spark, path, rows(spark, 40_000), buckets=16)
    second = ST.merge(spark, path, rows(spark, 40_000, 100, written=1))  # 1 %, in every bucket
    new = [p for p in second.parts if p not in first.parts]
    assert {p.seq for p in new} == {2} and len(new) == 16
    assert sum(p.bytes for p in new) < 0.05 * first.bytes()
    got = state(ST.read_store(spark, path))
    assert len(got) == 40_000 and all(v == (k % 100 == 0) for k, v in got.items())
    assert state(ST.read_store(spark, path, 1)) == dict.fromkeys(range(40_000), 0)  # earlier versions stay readable


def test_only_crowded_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "s")
    first = ST.merge(spark, path, rows(spark, 4000), buckets=8)
    one = ST.with_bucket(rows(spark, 4000, written=1), "url", 8).filter("bucket = 3").drop("bucket")
    second = ST.merge(spark, path, one)
    assert [p for p in second.parts if p.bucket != 3] == [p for p in first.parts if p.bucket != 3]
    assert [p.seq for p in second.parts if p.bucket == 3] == [0]  # rewritten, no delta left
    n = one.count()
    assert sum(v for v in state(ST.read_store(spark, path)).values()) == n and 0 < n < 4000
    assert ST.vacuum(spark, path) >= 1 and sum(v for v in state(ST.read_store(spark, path)).values()) == n


def test_many_merges_and_compaction_equal_a_plain_table(spark, tmp_path):
    path, want = str(tmp_path / "s"), {}
    for n in range(1, 6):
        new = rows(spark, 300 * n, 7 * n, written=n)
        want |= state(new)
        assert state(ST.store_upsert(path, new, buckets=4)) == want
    done = ST.compact(spark, path)
    assert {p.seq for p in done.parts} == {0} and state(ST.read_store(spark, path)) == want


def test_merges_that_end_together_both_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    ST.merge(spark, path, rows(spark, 100), buckets=4)
    publish, other = ST._publish, []

    def late(session, snap):
        if not other:  # another merge is first
            other.append(1)
            ST.merge(spark, path, rows(spark, 100, 10, written=1))
        return publish(session, snap)

    monkeypatch.setattr(ST, "_publish", late)
    done = ST.merge(spark, path, rows(spark, 100, 25, written=2))
    assert done.version == 3
    got = state(ST.read_store(spark, path))
    assert got == {k: 2 if k % 25 == 0 else int(k % 10 == 0) for k in range(100)}


def test_a_key_that_comes_twice_needs_an_order(spark, tmp_path):
    path = str(tmp_path / "s")
    twice = rows(spark, 10).unionByName(rows(spark, 3, written=5))
    with pytest.raises(ValueError, match="twice"):
        ST.merge(spark, path, twice, buckets=2)
    assert ST.store_version(spark, path) == 0
    assert state(ST.store_upsert(path, twice, order="written", buckets=2)) == {k: 5 * (k < 3) for k in range(10)}
    with pytest.raises(ValueError, match="holds"):
        ST.merge(spark, path, rows(spark, 3).drop("body"))


def test_null_keys_and_empty_merges(spark, tmp_path):
    path = str(tmp_path / "s")
    null = spark.createDataFrame([(None, "x", 1), (4, "y", 1)], "url long, body string, written long")
    ST.merge(spark, path, null, buckets=2)
    ST.merge(spark, path, null.withColumn("written", F.lit(2).cast("long")))
    ST.merge(spark, path, null.limit(0))
    assert state(ST.read_store(spark, path)) == {None: 2, 4: 2}
    empty = str(tmp_path / "e")
    assert ST.store_upsert(empty, null.limit(0)).collect() == []


def test_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    """Keys stay a relation; the scan names a runtime filter on the bucket folders."""
    path = str(tmp_path / "s")
    ST.merge(spark, path, rows(spark, 2000), buckets=32)
    ST.merge(spark, path, rows(spark, 2000, 500, written=1))
    keys = spark.createDataFrame([(0,), (1,), (1,), (7777,)], "k long")
    got = ST.read_keys(spark, path, keys)
    assert state(got) == {0: 1, 1: 0}
    assert "dynamicpruning" in got._jdf.queryExecution().toString()


def test_bucket_count_follows_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "BUCKET_BYTES", 8 << 10)
    assert ST.merge(spark, str(tmp_path / "s"), rows(spark, 20)).buckets == 8
    assert ST.merge(spark, str(tmp_path / "l"), rows(spark, 8000)).buckets > 32
