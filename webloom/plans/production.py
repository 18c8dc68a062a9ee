"""Archive production: index lines -> archive paths -> cleaned text and link pages.

``read_index -> url pattern -> filename -> text/metadata archive paths ->
read archives -> url descriptor -> clean text / site links -> write pages +
ingest manifest``. Each archive is read by Spark tasks; nothing is downloaded
or looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.constants import SITE_BASE, SITE_PREFIX, STATUS_LOADED, URL_DESCRIPTOR
from webloom.functions import text as TX
from webloom.functions import urls as U
from webloom.operators import pages as PG
from webloom.sources import readers, sinks
from webloom.sources.tables import spread


def archive_paths(index: DataFrame, pattern: str | None = None) -> DataFrame:
    """Valid index records (optionally matching a url pattern) -> distinct
    ``(path, text_path, meta_path)``."""
    rows = index.filter(F.col("valid"))
    if pattern:
        rows = PG.match_url(rows, pattern)
    return (rows.select(F.col("filename").alias("path")).distinct()
            .select("path", U.text_archive_path(F.col("path")).alias("text_path"),
                    U.meta_archive_path(F.col("path")).alias("meta_path")))


def text_records(records: DataFrame, descriptor: str = URL_DESCRIPTOR) -> DataFrame:
    """Text-archive records -> ``(source_file, url, plaintext)`` for matching urls;
    a record whose payload is cut short is left to ``readers.quarantine``."""
    whole = records.filter(F.coalesce("length_ok", F.lit(True))) if "length_ok" in records.columns else records
    rows = PG.url_contains(whole, descriptor).select("source_file", "url", "payload")
    return TX.with_clean_text(rows, "payload", "plaintext").drop("payload")


def link_records(meta: DataFrame, descriptor: str = URL_DESCRIPTOR, prefix: str = SITE_PREFIX,
                 base: str | None = SITE_BASE, legacy: bool = False) -> DataFrame:
    """Metadata records -> ``(source_file, url, links)``: pages with a link
    section, site-internal links only, made absolute against ``base`` (or the
    page's own ``scheme://host`` when ``base`` is None)."""
    rows = PG.with_links(PG.url_contains(meta, descriptor))
    site = U.site_links(F.col("links"), prefix, legacy)
    b = F.lit(base) if base is not None else U.site_base(F.col("url"))
    return rows.select("source_file", "url", U.absolute_links(site, b).alias("links"))


def run(spark: SparkSession, text_glob: str, meta_glob: str, out_dir: str,
        paths: DataFrame | None = None, descriptor: str = URL_DESCRIPTOR) -> DataFrame:
    """Produce cleaned text and link pages from archives; return the manifest.

    ``paths`` is the listed archives: ``(path)``, or ``(path, text_path,
    meta_path)`` as made by ``archive_paths``, in which case records from a
    derived archive count for the listed one.
    """
    # A .gz archive is one task; with fewer archives than cores, spread records.
    records = spread(readers.read_archive(spark, text_glob, stitch=True), "source_file", "url")
    texts = text_records(records, descriptor)
    meta = spread(readers.read_link_metadata(spark, meta_glob, stitch=True), "source_file", "url")
    links = link_records(meta, descriptor)
    sinks.write_pages(texts, f"{out_dir}/text")
    sinks.write_pages(links, f"{out_dir}/links")
    bad = readers.quarantine(records, "text").unionByName(readers.quarantine(meta, "metadata"))
    bad.write.mode("overwrite").json(f"{out_dir}/rejected")
    # Count per archive first (partial aggregate); only counts meet the path list.
    counts = sinks.records_per_file(
        readers.read_text(spark, f"{out_dir}/text").select(F.col("archive").alias("a"))
        .unionByName(readers.read_links(spark, f"{out_dir}/links")
                     .select(F.col("archive").alias("a"))), "a")
    if paths is None:
        return counts.select("source_file", F.lit(STATUS_LOADED).alias("status"), "n_records")
    derived = ["text_path", "meta_path"] if {"text_path", "meta_path"} <= set(paths.columns) \
        else []
    names = paths.select("path", F.explode(F.array("path", *derived)).alias("file"))
    by_name = names.select("path", U.output_name(U.normalize_path(F.col("file"))).alias("a"))
    per_path = (counts.join(by_name, counts["source_file"] == by_name["a"])
                .select(F.col("path").alias("source_file"), "n_records"))
    return sinks.ingest_manifest(paths.select("path"), per_path)
