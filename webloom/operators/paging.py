"""Paged listings of a large table (an index listing, page ``p`` of ``size`` rows).

Global row numbers without a single-partition window: the range-sorted rows are
written once, each with its partition and its place in it; the rows per
partition (one row each) become running offsets. Both the offsets and the rows
are read from that one written table, so they always agree.

A *listing* is such a table kept: sorted once, then read page by page. Beside
the rows it has a sparse directory, one row for every ``BLOCK_ROWS`` rows with
the block's first key and row number. A page finds its blocks in the directory
and reads only their folders and, inside them, the row groups and pages of the
wanted places; a key finds its row number by one block.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webloom.session import ensure_checkpoint_dir

BLOCK_ROWS = 100_000  # rows of a listing for each row of its directory
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def with_row_index(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """``df`` plus a 0-based global row number in ``order``.

    Rows that tie on ``order`` are numbered in an order that is fixed once the
    sorted table is written. The table lies under the checkpoint folder.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), _ROW_BITS)
    ordered = (df.repartitionByRange(*order).sortWithinPartitions(*order)
               .select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                       F.spark_partition_id().alias("_pid"), place.alias("_place")))
    path = f"{ensure_checkpoint_dir(spark)}/row-index-{uuid.uuid4().hex}"
    ordered.write.parquet(path)
    stored = spark.read.schema(ordered.schema).parquet(path)
    counts = stored.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition of the sorted table.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (stored.join(F.broadcast(offsets), "_pid")
            .select(*[F.col("_row").getField(c).alias(c) for c in df.columns], (F.col("_off") + F.col("_place")).alias(name)))


def write_listing(df: DataFrame, path: str, *order: str, block_rows: int = BLOCK_ROWS) -> None:
    """Sort ``df`` once and keep it at ``path`` with its directory. ``order`` should be
    total; rows that tie on it keep one order once written."""
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), _ROW_BITS)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("key"),
        place.alias("place"), F.spark_partition_id().alias("part"))
    placed.sortWithinPartitions("part", "place").write.partitionBy("part").parquet(f"{path}/rows")
    # The rows' type, which a listing of no rows has no file to tell.
    df.sparkSession.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")
    rows = _listed(df.sparkSession, path)
    block = F.expr(f"place div {block_rows}")
    blocks = rows.groupBy("part", block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    # One row for each partition of the sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.col("start") + F.col("block") * block_rows
    (blocks.join(starts, "part").select("part", "start", at.alias("lo"), (at + F.col("n")).alias("hi"), "first")
     .repartitionByRange("lo").sortWithinPartitions("lo").write.parquet(f"{path}/directory"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    kind = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()["value"]))
    return spark.read.schema(kind).parquet(f"{path}/rows")


def _rows(spark: SparkSession, path: str, blocks: list, lo: int, hi: int) -> DataFrame:
    """Rows ``[lo, hi)`` of the listing, from the blocks that hold them."""
    rows = _listed(spark, path)
    wanted = [(F.col("part") == b["part"]) & (F.col("place") >= max(lo, b["lo"]) - b["start"]) & (F.col("place") < min(hi, b["hi"]) - b["start"]) for b in blocks]
    start = reduce(lambda c, b: c.when(F.col("part") == b["part"], F.lit(b["start"])), blocks, F.when(F.lit(False), F.lit(0).cast("long")))
    return rows.filter(reduce(or_, wanted, F.lit(False))).withColumn("row_idx", F.col("place") + start)


def listing_page(spark: SparkSession, path: str, page: int, page_size: int) -> DataFrame:
    """Rows ``[page * page_size, (page + 1) * page_size)`` of a listing, with ``row_idx``.
    The directory rows that travel through the driver are those of the page's blocks."""
    lo, hi = page * page_size, (page + 1) * page_size
    directory = spark.read.parquet(f"{path}/directory")
    blocks = directory.filter((F.col("lo") < hi) & (F.col("hi") > lo)).select("part", "start", "lo", "hi").collect()
    return _rows(spark, path, blocks, lo, hi).select("row.*", "row_idx")


def listing_seek(spark: SparkSession, path: str, *key) -> int:
    """Number of the first row whose key is not below ``key`` (as many values as the
    listing's order has, or fewer from the left)."""
    directory = spark.read.parquet(f"{path}/directory")
    names = directory.schema["first"].dataType.names[:len(key)]
    below = lambda c: F.struct(*[F.col(f"{c}.{n}") for n in names]) < F.struct(*[F.lit(v).alias(n) for v, n in zip(key, names)])
    block = directory.filter(below("first")).orderBy(F.desc("lo")).select("part", "start", "lo", "hi").first()
    if block is None:
        return 0
    return block["lo"] + _rows(spark, path, [block], block["lo"], block["hi"]).filter(below("key")).count()


def index_page(df: DataFrame, page: int, page_size: int, *order: str) -> DataFrame:
    """One page of a table that is listed for this page alone; for more of them
    ``write_listing`` once and take ``listing_page`` of it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/listing-{uuid.uuid4().hex}"
    write_listing(df, path, *order)
    return listing_page(df.sparkSession, path, page, page_size)


def page_count(df: DataFrame, page_size: int) -> DataFrame:
    """One row ``(n_rows, n_pages)``."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), F.ceil(n / F.lit(page_size)).alias("n_pages"))

