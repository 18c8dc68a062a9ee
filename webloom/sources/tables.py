"""Readers for the parquet tables the library is tested and benchmarked on.

Each reader selects only the columns it needs, so the scan's ReadSchema is
pruned; filters written after it are pushed into the parquet scan by Catalyst.

Graph P (the ranking input): the driver tables contain no crawl whose links
point at crawled pages, so a link graph is derived from ``part`` and
``lineitem`` with a fixed rule:

* crawled page: each ``part`` row; its text is
  ``p_name || ' ' || p_type || ' ' || p_brand``;
* link: one per ``lineitem`` row: ``src = l_partkey``,
  ``dst = l_orderkey % (1 + (l_partkey * 7919 + l_suppkey) % N)`` with
  ``N = count(part) + count(part) div 10``, so that some targets are no part and
  stay un-crawled; links of a page appear in
  ``(l_orderkey, l_linenumber, l_suppkey)`` order.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.graph import LinkGraph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# fixed values: graph P rule
P_MULT = 7919


# Column types of the driver tables this library reads (no inference pass).
COLUMN_TYPES = {
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string",
             "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
                 "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
                 "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                 "l_linestatus": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
                  "n_chars": "bigint"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "events": {"event_id": "bigint", "user_id": "bigint", "event_type": "string",
               "value": "double", "props": "string"},
}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read the named columns of a driver table with an explicit schema (only
    those columns are read; no schema-inference job). Unknown tables or
    columns fall back to the file's own schema."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    types = COLUMN_TYPES.get(name, {})
    if columns and all(c in types for c in columns):
        ddl = ", ".join(f"`{c}` {types[c]}" for c in columns)
        return spark.read.schema(ddl).parquet(path)
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def part_graph(spark: SparkSession, sf_dir: str) -> LinkGraph:
    """Graph P: pages ``(url, text)`` and long links ``(url, pos, link)``."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    pages = part.select(F.col("p_partkey").alias("url"),
                        F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" "),
                                 F.col("p_brand")).alias("text"))
    n_part = read_table(spark, sf_dir, "part", "p_partkey").agg(F.expr("count(1) + count(1) div 10")).scalar()
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                    "l_linenumber")
    modulus = F.lit(1) + (F.col("l_partkey") * P_MULT + F.col("l_suppkey")) % n_part
    links = li.select(
        F.col("l_partkey").alias("url"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("pos"),
        (F.col("l_orderkey") % modulus).alias("link"))
    return LinkGraph(pages=pages, links=links)


SCAN_PARTITIONS = "spark.webloom.scanPartitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as the session's ``spark.webloom.scanPartitions``
    says, by the hash of its keys (a round robin would sort the rows first, to be
    repeatable); as scanned where that is not set: a crawl-sized input has splits
    enough, and its texts are tokenised where they are read."""
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n), *keys) if n else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text documents ``(url, text)`` keyed by ``doc_id``."""
    return spread(read_table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("url"), "text"), "url")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages ``(page_id, url, html)``."""
    return spread(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id")
