"""Session helpers: the one place that knows about Spark configuration.

Library functions never create sessions; they take the caller's. The helpers
here only (a) build a local session for tests / bench and (b) make sure a
reliable checkpoint directory exists before an iterative job cuts lineage.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Fixed tuning for local runs; a cluster passes its own configuration.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Local runs list a few hundred directories faster on the driver than
    # through a listing job; clusters keep Spark's default.
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "1024",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Suggested settings for a large cluster (100 TB of crawl input, ~1000
# executors). Applied only when a caller passes them to the session builder;
# the library itself never changes cluster configuration.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    # Start wide; AQE coalesces small partitions after each shuffle.
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    # Runtime broadcast only for sides measured small; bounded sides are
    # broadcast explicitly by the operators.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Push a request's whole key list into the scan (row groups are then skipped
    # by range and Bloom filter), not only its range.
    "spark.sql.parquet.pushdown.inFilterThreshold": "10000",
    "spark.sql.session.timeZone": "UTC",
    # Set by the deployment to a shared file system, e.g. an object store path:
    # "spark.checkpoint.dir": "<shared path>",
}


def cluster_builder(app: str = "webloom", conf: dict | None = None) -> SparkSession.Builder:
    """A session builder carrying ``CLUSTER_CONF`` (and overrides)."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**CLUSTER_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    return builder


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "webloom", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.webloom.scanPartitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("WEBLOOM_DRIVER_MEM", "16g")))
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drop_scratch_tables(spark: SparkSession) -> int:
    """Drop the catalog tables that jobs of this library left; returns their number.
    Call when no result that reads them is still to be computed."""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("webloom_")]
    for name in names:
        spark.sql(f"DROP TABLE `{name}`")
    return len(names)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only for local runs.

    On a cluster the directory comes from ``spark.checkpoint.dir`` (a shared
    file system path). Only when nothing is configured *and* the master is
    local do we create a scratch directory, as tests do.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative jobs need a shared "
            "checkpoint directory on a cluster")
    path = tempfile.mkdtemp(prefix="webloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()
