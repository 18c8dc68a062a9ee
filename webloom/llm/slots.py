"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

DataFrame operations only. A record's slot is fixed by its text (``SLOTS`` of
them, by md5), so equal texts share a slot and a slot never changes. Which
shard holds a slot is said by a map, a small table of one row a slot, stored in
versions that are never overwritten. Version 1 deals the slots in turn. Bytes
are then summed for each slot, and the map is edited to a new version: a shard
keeps its heaviest slots up to an even share, and the slots above it (or of a
shard that is no more) go, heaviest first, each to the shard that is lightest
by then. While the heaviest shard is within ``EVEN`` of an even share, or an
edit would not make it lighter, the map stays as it is.

A slot heavier than an even share fits no shard: a group of copies can be that
large, or one key that holds a third of all rows. Such slots (fewer than there
are shards, so this set may be broadcast) are split: their records are dealt
over all slots by their place in the input, and the map marks the slot, so that
a reader knows that its texts may be in any shard.

The law that holds is ``bytes``: shards differ in bytes by no more than one
undivided slot or one record. The place of a record in its shard comes from one
range-sorted table of light rows (no texts), without a window over a shard.

Defined cases: a null text has the bytes of an empty one, 8, and shares its
slot; a null id is allowed; repeated rows are records of their own. An empty
table gives no rows and leaves the map at version 1. Other columns are never
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import scratch, written
from webloom.operators.paging import with_row_index

SLOTS = 4096
SHARDS = 24
OVERHEAD = 8
#: A heaviest shard this near to an even share needs no edit.
EVEN = 1.01
LAW = "bytes"

MAP = "vslot int, shard int, bytes long, split boolean"


def slot_of(value: Column) -> Column:
    """The virtual slot of a string: its first hexadecimal md5 digits."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long") % SLOTS


def first_map(spark: SparkSession, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots dealt in turn, sizes not known yet."""
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("split"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a version; an existing one is an error, it is never overwritten."""
    slot_map.select("vslot", "shard", "bytes", "split").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest unless named."""
    stored = spark.read.schema(f"{MAP}, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).drop("version")


def heavy_slots(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Slots (vslot) whose bytes exceed an even share: fewer than `shards` rows."""
    share = loads.agg(F.sum("bytes").alias("b")).select((F.col("b") / shards).alias("b")).scalar()
    return loads.filter(F.col("bytes") > share).select("vslot")


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`slot_map` edited for the measured `loads` (vslot, bytes) and so many shards.

    All that is gathered is one row a slot, and their number is fixed."""
    sized = slot_map.select("vslot", "shard", "split").join(loads.select(F.col("vslot").cast("int").alias("vslot"), F.col("bytes").alias("now")), "vslot", "left")
    sized = sized.select("vslot", "shard", "split", F.coalesce("now", F.lit(0).cast("long")).alias("bytes"))
    share = sized.agg(F.sum("bytes").alias("b")).select((F.col("b") / shards).alias("b")).scalar()
    heaviest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    stays = (F.col("shard") < shards) & (F.sum("bytes").over(heaviest) <= share)
    marked = sized.withColumn("stays", stays)
    held = marked.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("b"))
    held = held.agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("held"))
    loose = marked.filter("not stays").agg(F.sort_array(F.collect_list(F.struct("bytes", (-F.col("vslot")).alias("low"), "split")), asc=False).alias("loose"))
    # Heaviest first, each to the lightest shard: a fold over at most SLOTS entries.
    fold = f"""aggregate(loose,
      named_struct('load', transform(sequence(0, {shards - 1}), s -> coalesce(held[s], 0L)), 'to', cast(array() as array<int>)),
      (acc, x) -> transform(array(array_position(acc.load, array_min(acc.load)) - 1), i -> named_struct(
        'load', transform(acc.load, (b, s) -> b + if(s = i, x.bytes, 0L)), 'to', array_append(acc.to, cast(i as int))))[0],
      acc -> acc.to)"""
    # Both sides are one row; the map of held bytes has one entry a shard.
    dealt = loose.select("loose", held.scalar().alias("held")).select("loose", F.expr(fold).alias("to"))
    moved = dealt.select(F.explode(F.arrays_zip("loose", "to")).alias("m")).select(
        (-F.col("m.loose.low")).alias("vslot"), F.col("m.to").alias("shard"), F.col("m.loose.bytes").alias("bytes"), F.col("m.loose.split").alias("split"))
    return marked.filter("stays").select("vslot", "shard", "bytes", "split").unionByName(moved)


def _light(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Identity and size of every record, without its text: `own` numbers the rows."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("doc_id"), (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
                       slot_of(whole).cast("int").alias("vslot"), F.monotonically_increasing_id().alias("own"))


def _loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))


def sharded(docs: DataFrame, path: str, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot (place in the shard, from 0) of every
    row, by a new version of the map stored at `path` (made if there is none)."""
    spark = docs.sparkSession
    rows = written(_light(docs, id, text), "records")
    heavy = written(heavy_slots(_loads(rows), shards), "heavy").withColumn("split", F.lit(True))
    rows = rows.join(F.broadcast(heavy), "vslot", "left")
    rows = rows.withColumn("vslot", F.when(F.col("split"), slot_of(F.concat_ws(":", "vslot", "own")).cast("int")).otherwise(F.col("vslot"))).drop("split")
    version = _latest(spark, path)
    if not version:
        version = 1
        save_map(first_map(spark, shards), path, version)
    # A slot that is split now stays marked: texts of it may lie in any shard from then on.
    marked = load_map(spark, path, version).drop("split").join(F.broadcast(heavy), "vslot", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    marked = written(marked, "map")
    loads = written(_loads(rows), "loads")
    edited = written(rebalanced(marked, loads, shards), "map")
    before, after = (m.join(loads.withColumnRenamed("bytes", "now"), "vslot").groupBy("shard").agg(F.sum("now").alias("b")).agg(
        F.max("b").alias("most"), F.sum("b").alias("all"), F.max("shard").alias("last")).first() for m in (marked, edited))
    if before["all"] and (before["last"] >= shards or before["most"] * shards > EVEN * before["all"] and after["most"] < before["most"]):
        version += 1
        save_map(edited, path, version)
    # One row a slot, SLOTS in all.
    placed = rows.join(F.broadcast(load_map(spark, path, version).select("vslot", "shard")), "vslot")
    numbered = with_row_index(placed, "shard", "vslot", "doc_id", "text_crc32", "own", name="at")
    first = numbered.groupBy("shard").agg(F.min("at").alias("first"))
    out = numbered.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("at") - F.col("first")).alias("slot"))


def _latest(spark: SparkSession, path: str) -> int:
    """Number of the latest stored version, 0 where there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max((int(n.partition("=")[2]) for n in names if n.startswith("version=")), default=0)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot of every row."""
    out = sharded(docs, scratch(docs.sparkSession, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
