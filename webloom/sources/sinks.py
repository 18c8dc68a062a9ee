"""Writers and store maintenance: page files, path lists, upserts, rank slices,
text export, graph documents, analysis rows and the ingest manifest.

All writes go through the DataFrame writer (one file per task, committed by
the output committer), so a lost executor re-runs its tasks and never leaves
a half-written output visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.constants import STATUS_LOADED, STATUS_MISSING
from webloom.functions import urls as U
from webloom.sources.store import latest_per_key, read_store, store_upsert, store_version, upsert  # noqa: F401


def write_pages(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cleaned pages as JSON lines, one output directory per source archive."""
    (df.withColumn("archive", U.output_name(U.normalize_path(F.col("source_file"))))
     .drop("source_file")
     .write.mode(mode).partitionBy("archive").json(path))


def write_paths(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Archive path list as text, one path per line."""
    df.select("path").write.mode(mode).text(path)


def save_ranked_table(df: DataFrame, table: str, buckets: int = 64,
                      mode: str = "overwrite") -> None:
    """Key-value table of ranked pages: bucketed and sorted by url, so a later
    join or lookup on url reads co-located buckets without a shuffle."""
    (df.write.mode(mode).format("parquet").bucketBy(buckets, "url").sortBy("url")
     .saveAsTable(table))


def write_rank_slices(df: DataFrame, path: str, key: str = "total_links",
                      mode: str = "overwrite") -> None:
    """Rank slices: one directory per link count, rank descending inside.

    Range partitioning on ``(key, rank desc)`` splits a crowded link count
    over several tasks by rank range instead of sending it to one task.
    """
    (df.repartitionByRange(key, F.desc("rank"))
     .sortWithinPartitions(key, F.desc("rank"))
     .write.mode(mode).partitionBy(key).parquet(path))


def export_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Plain-text export ``<url> has rank: <rank>.`` (no driver collect)."""
    (df.select(F.format_string("%s has rank: %s.", F.col("url").cast("string"),
                               F.col("rank").cast("string")).alias("value"))
     .write.mode(mode).text(path))


def export_links(links: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Links of ranked pages in page order, long form, as JSON lines ``(url, pos, link)``."""
    links.select("url", "pos", "link").write.mode(mode).json(path)


def export_plaintext(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Plain texts of pages as JSON lines ``(url, plaintext)``."""
    pages.select("url", "plaintext").write.mode(mode).json(path)


def write_graph(doc: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Graph documents ``(nodes, links)`` as one JSON text line each."""
    doc.select(F.to_json(F.struct("nodes", "links"), {"ignoreNullFields": "false"})
               .alias("value")).write.mode(mode).text(path)


def write_analysis(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Analysis rows ``(url, rank, total_links)`` as JSON lines."""
    df.select("url", "rank", "total_links").write.mode(mode).json(path)


def ingest_manifest(paths: DataFrame, records: DataFrame,
                    path_col: str = "path", source_col: str = "source_file") -> DataFrame:
    """Per listed archive: ``(source_file, status, n_records)``, status from the
    records that actually arrived (not assumed)."""
    counts = records.groupBy(U.normalize_path(F.col(source_col)).alias("source_file")).agg(
        F.count(F.lit(1)).alias("n_records"))
    listed = paths.select(U.normalize_path(F.col(path_col)).alias("source_file")).distinct()
    j = listed.join(counts, "source_file", "left")
    n = F.coalesce(F.col("n_records"), F.lit(0)).cast("long")
    return j.select("source_file",
                    F.when(n > 0, F.lit(STATUS_LOADED)).otherwise(F.lit(STATUS_MISSING))
                    .alias("status"), n.alias("n_records"))


def records_per_file(records: DataFrame, source_col: str = "source_file") -> DataFrame:
    """Records produced per source file ``(source_file, n_records)``."""
    return records.groupBy(U.normalize_path(F.col(source_col)).alias("source_file")).agg(
        F.count(F.lit(1)).alias("n_records"))
