"""Key-bucketed parquet stores: point and batched lookups without a full scan.

A store is written partitioned by ``bucket = pmod(xxhash64(key), buckets)``
and sorted by key inside each file. A lookup of a bounded set of keys reads
only the bucket directories of those keys (partition pruning) and, inside
them, only row groups whose key range covers a wanted key (min/max pruning).
This is what replaces a key-value store and a text store at serving time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"


def with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)))


def write_keyed(df: DataFrame, path: str, key: str, buckets: int = 64,
                mode: str = "overwrite", partitions: int | None = None, bloom: bool = True) -> None:
    """Write ``df`` as a key-bucketed, key-sorted parquet store.

    Range partitioning on ``(bucket, key, row hash)`` instead of hashing on the
    bucket: a bucket holding a hot key (a term in a third of all documents) is
    split over several tasks and files by key and row-hash ranges, never
    written by one task. Files stay sorted by key, and hold a Bloom filter of
    it (unless ``bloom`` is off, as for small files), for row-group pruning.
    Without ``partitions`` AQE sizes the ranges (it merges only ranges smaller
    than its advisory size, so a hot key still spans many files).
    """
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    keyed = with_bucket(df, key, buckets)
    ranged = (keyed.repartitionByRange(partitions, BUCKET, key, spread) if partitions
              else keyed.repartitionByRange(BUCKET, key, spread))
    (ranged.sortWithinPartitions(key).write.mode(mode).partitionBy(BUCKET)
     .option(f"parquet.bloom.filter.enabled#{key}", str(bloom).lower())
     # As large as the file's keys need; the fixed size would be 1 MiB in every file.
     .option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))


def read_keyed(spark: SparkSession, path: str, key: str, values: list,
               buckets: int = 64) -> DataFrame:
    """Rows of a keyed store whose key is in ``values`` (a bounded list).

    The bucket numbers are the writer's own expression over literals; Catalyst
    folds them and prunes the bucket directories with them."""
    store = spark.read.parquet(path)
    key_type = store.schema[key].dataType.simpleString()
    wanted = [v for v in values if v is not None]
    if not wanted:
        return store.drop(BUCKET).limit(0)
    literals = [_sql_literal(v, key_type) for v in wanted]
    hashed = ", ".join(f"pmod(xxhash64({v}), {buckets})" for v in literals)
    return store.filter(F.expr(f"{BUCKET} IN ({hashed})") & F.expr(f"`{key}` IN ({', '.join(literals)})")).drop(BUCKET)


def read_matching(spark: SparkSession, path: str, key: str, keys: DataFrame, buckets: int = 64) -> DataFrame:
    """Rows of a keyed store whose key is in the relation ``keys`` (one column).

    Joined on bucket and key, so that Spark prunes the bucket directories at run
    time from the keys it broadcasts; no list of keys passes through the driver,
    and keys too many to broadcast are shuffled instead."""
    wanted = with_bucket(keys.select(F.col(keys.columns[0]).alias("_key")).distinct(), "_key", buckets)
    wanted = wanted.select("_key", F.col(BUCKET).cast("int").alias("_bucket")).filter(F.col("_bucket") >= 0)
    store = spark.read.parquet(path)
    return store.join(wanted, (F.col(BUCKET) == F.col("_bucket")) & (F.col(key) == F.col("_key")), "left_semi").drop(BUCKET)


def _sql_literal(v, key_type: str) -> str:
    if key_type == "bigint":
        return f"{int(v)}L" if v != -(2**63) else "cast('-9223372036854775808' as bigint)"
    if key_type == "int":
        return f"cast({int(v)} as int)"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'" if key_type == "string" else f"cast('{text}' as {key_type})"
