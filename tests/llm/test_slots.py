"""Virtual slots: sizes, numbering, groups, versions of the map."""

import tempfile
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from webloom.llm import common, slots
from .data import documents, frame


def shards_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard].append(r)
    return out


def test_every_row_has_one_place(spark):
    rows = documents(4, 200)
    got = slots.report(frame(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for shard, own in shards_of(got).items():
        assert 0 <= shard < 24 and sorted(r.slot for r in own) == list(range(len(own)))


def test_shards_are_even_and_groups_stay_together(spark):
    """600 texts and a group of 40 copies that fits a shard."""
    rows = [(k, f"text {k} " + "x" * (k * 37 % 900)) for k in range(600)] + [(1000 + k, "copied " * 20) for k in range(40)]
    got = slots.report(frame(spark, rows)).collect()
    loads = [sum(r.size for r in own) for own in shards_of(got).values()]
    by_slot = Counter()
    for r in got:
        by_slot[r.vslot] += r.size
    assert len(loads) == 24 and max(loads) - min(loads) <= max(by_slot.values())
    assert len({r.shard for r in got if r.doc_id >= 1000}) == 1


def test_a_group_larger_than_a_shard_is_split(spark):
    """A third of all rows are one row repeated: sizes stay even all the same."""
    rows = [(k, f"text {k} " + "x" * (k % 300)) for k in range(600)] + [(5000, "hot " * 50)] * 300
    got = slots.report(frame(spark, rows)).collect()
    loads = [sum(r.size for r in own) for own in shards_of(got).values()]
    assert len(got) == 900 and max(loads) - min(loads) <= 2 * 400
    assert len({r.shard for r in got if r.doc_id == 5000}) > 6


def test_map_versions_only_move_what_must_move(spark):
    path = tempfile.mkdtemp(prefix="webloom-slots-", dir="/tmp") + "/map"
    rows = frame(spark, [(k, f"text {k} " + "x" * (k * 37 % 900)) for k in range(2000)])
    found = slots.sharded(rows, path, 24).collect()
    first, size = {r.doc_id: r.shard for r in found}, {r.doc_id: r.size for r in found}
    again = {r.doc_id: r.shard for r in slots.sharded(rows, path, 24).collect()}
    assert again == first  # an even map is not edited
    grown = {r.doc_id: r.shard for r in slots.sharded(rows, path, 25).collect()}
    moved = sum(size[k] for k in first if grown[k] != first[k])
    # The new shard's share, 4 per cent, and no more than a slot beside it from each shard.
    assert set(grown.values()) == set(range(25)) and moved < 0.04 * sum(size.values()) + 25 * 950
    versions = spark.read.parquet(path).groupBy("version").count().collect()
    assert {r["version"]: r["count"] for r in versions} == {v: slots.SLOTS for v in (1, 2, 3)}
    latest = {r.vslot: r.shard for r in slots.load_map(spark, path).collect()}
    assert sorted(latest) == list(range(slots.SLOTS)) and max(latest.values()) == 24
    shrunk = slots.sharded(rows, path, 20).agg(F.max("shard")).first()[0]
    assert shrunk == 19


def test_empty_table(spark):
    assert slots.report(frame(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    mark = common.written_since()
    plan = slots.report(frame(spark, documents())).drop("law")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups"))
    assert common.written_since(mark)
