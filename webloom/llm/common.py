"""Shared steps of the training-data operators: written tables, reduced joins
and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import ensure_checkpoint_dir

#: Bits of the membership bitmap, kept 64 to a row: at most 262,144 rows (4 MiB
#: of values) are broadcast, whatever the input.
BITMAP_BITS = 1 << 24

#: Keys that meet more than this many rows, and more than a HOT_KEYS-th of all, are hot;
#: so fewer than HOT_KEYS keys are, which bounds their broadcast.
HOT_ROWS = 1000
HOT_KEYS = 10_000

_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared checkpoint folder: cuts lineage, survives
    lost executors, and is computed once however often it is read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_since(mark: int | None = None) -> int | list[str]:
    """Without a mark, a mark; with one, the folders written since."""
    return len(_written) if mark is None else _written[mark:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders; call when the results that read them are stored."""
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*columns: str) -> Column:
    """64-bit identity of a row's id and text; equal rows have equal keys."""
    return F.xxhash64(*[c for name in columns for c in (F.col(name), F.col(name).isNull())])


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows as a struct ``row`` beside their ``key``, so that no column's name can clash."""
    return docs.select(row_key(id, text).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unkeyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def holding(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of `rows` whose long `key` may be in `wanted`: all that are, and few others.

    A bitmap of the wanted keys, of fixed size, is broadcast, so that rows which
    take no part in a following join on `key` are not shuffled for it.
    """
    place = F.col(key).bitwiseAND(F.lit(BITMAP_BITS - 1))
    marks = wanted.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_place & 63 as int)))").alias("_marks"))
    joined = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(marks), "_word")
    return joined.filter("getbit(_marks, cast(_place & 63 as int)) = 1").select(*[F.col(f"`{c}`") for c in rows.columns])


def join_hot(rows: DataFrame, named: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `named` (one row for each `on`, without nulls there; read three
    times, so stored), whose `weight` is the number of rows it meets. The few hot keys go
    by broadcast, so that their rows stay where they are; the others by shuffle."""
    total = named.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(HOT_ROWS, total // HOT_KEYS)
    many, few = named.filter(hot), named.filter(~hot)
    rest = rows.join(F.broadcast(many.select(*on)), on, "left_anti").join(few, on, how)
    return rows.join(F.broadcast(many), on).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the least node reachable.

    Alternating large-star and small-star steps: each round every node hands
    its neighbours to the least of them, so the number of rounds grows with the
    logarithm of the longest chain. Nothing is collected but two counters.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.filter("m < u").select("u", F.col("m").alias("v"))
        large = large.unionByName(kept).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
