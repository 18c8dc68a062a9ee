"""Crawl production on page tables: filters, text cleaning, link extraction.

These are the per-record transformations of archive production, expressed
as column expressions so they run inside whole-stage codegen on every
executor, one pass over the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as TX
from webloom.functions import urls as U


def url_contains(df: DataFrame, descriptor: str, col: str = "url") -> DataFrame:
    """Keep records whose url contains ``descriptor``."""
    return df.filter(F.col(col).contains(descriptor))


def path_contains(df: DataFrame, needle: str, col: str = "path") -> DataFrame:
    """Keep path-list entries containing ``needle``."""
    return df.filter(F.col(col).contains(needle))


def match_url(df: DataFrame, pattern: str, col: str = "url") -> DataFrame:
    """Index url pattern filter (``*.domain``, ``prefix*`` or exact)."""
    return df.filter(U.url_matches(F.col(col), pattern))


def text_pages(pages: DataFrame, html: str = "html", decode_escapes: bool = True) -> DataFrame:
    """Pages -> ``(..., plaintext)``: tags stripped, escapes decoded, ASCII only."""
    return TX.with_clean_text(pages, html, "plaintext", decode_escapes).drop(html)


def page_links(pages: DataFrame, html: str = "html", prefix: str | None = "/",
               legacy: bool = False) -> DataFrame:
    """Pages -> array-form links ``(..., links)``: href targets in page order,
    optionally restricted to site-internal ones, made absolute against the
    page's ``scheme://host``."""
    hrefs = U.href_links(F.col(html))
    if prefix is not None:
        hrefs = U.site_links(hrefs, prefix, legacy)
    return (pages.withColumn("links", U.absolute_links(hrefs, U.site_base(F.col("url"))))
            .drop(html))


def distinct_page_links(pages: DataFrame, key: str = "page_id", html: str = "html",
                        prefix: str | None = "/") -> DataFrame:
    """Long form ``(key, link, first_pos)``: each distinct link of a page once,
    with the position of its first appearance (0-based)."""
    arr = page_links(pages.select(key, "url", html), html, prefix)
    return (arr.select(key, F.posexplode("links").alias("pos", "link"))
            .groupBy(key, "link").agg(F.min("pos").cast("long").alias("first_pos")))


def with_links(link_pages: DataFrame) -> DataFrame:
    """Drop pages without a link section (an empty list stays)."""
    return link_pages.filter(F.col("links").isNotNull())


def select_fields(df: DataFrame, fields: str | list[str] | None) -> DataFrame:
    """Keep a chosen field list (``"url,timestamp"`` or a list); all when None."""
    if not fields:
        return df
    names = [f.strip() for f in fields.split(",")] if isinstance(fields, str) else list(fields)
    return df.select(*names)
