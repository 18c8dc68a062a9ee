"""Readers for crawl inputs: page tables (JSON lines), archives, index lines,
path lists and saved analysis files. Every reader passes an explicit schema.

Malformed records are never dropped silently: parsers keep the row and mark
it (``valid`` / ``length_ok``, and ``reason``, NULL for a good row), and
``quarantine`` brings the marked rows of every reader into one form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom import schemas as SC
from webloom.constants import ANALYSIS_TAG
from webloom.functions import urls as U
from webloom.operators.graph import written_table

# fixed values: archive record framing
RECORD_START = "WARC/1.0\r\n"
RECORD_SEPARATOR = "\r\n\r\n" + RECORD_START
HEADER_END = "\r\n\r\n"

# Why a row was rejected.
NOT_JSON, NO_URL, NO_FILE, CUT = "not JSON", "no url", "no filename", "cut short"


def _json_pages(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with ``source_file`` and ``valid``: the line is JSON and has a url."""
    rows = spark.read.schema(schema.add("_corrupt", "string")).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    reason = F.when(F.col("_corrupt").isNotNull(), NOT_JSON).when(F.col("url").isNull(), NO_URL)
    marked = rows.withColumn("source_file", F.input_file_name()).withColumn("valid", F.col("_corrupt").isNull() & F.col("url").isNotNull())
    return marked.withColumn("reason", reason).drop("_corrupt")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Link pages ``(url, links, source_file, valid)`` from JSON lines (a glob or
    directory; the per-archive directories of ``write_pages`` add ``archive``)."""
    return _json_pages(spark, path, T.StructType(list(SC.LINK_PAGE.fields)))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text pages ``(url, plaintext, source_file, valid)`` from JSON lines (plus
    ``archive`` when read from ``write_pages`` output)."""
    return _json_pages(spark, path, T.StructType(list(SC.TEXT_PAGE.fields)))


def rejected(rows: DataFrame, good: str = "valid") -> DataFrame:
    """Rows a parser could not use, per source file: ``(source_file, n_rejected)``."""
    return rows.filter(~F.coalesce(F.col(good), F.lit(good == "length_ok"))).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rejected"))


def quarantine(rows: DataFrame, kind: str) -> DataFrame:
    """The rows that a reader rejected, in one form for all readers:
    ``(kind, source_file, url, reason)``."""
    return rows.filter(F.col("reason").isNotNull()).select(F.lit(kind).alias("kind"), "source_file", F.col("url").cast("string").alias("url"), "reason")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between separators: ``(source_file, block, id, value)``; block and
    id give the order in a file, and are the same in every reading of it."""
    return spark.read.option("lineSep", RECORD_SEPARATOR).text(path).select(
        F.input_file_name().alias("source_file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def _stitches(pieces: DataFrame) -> DataFrame:
    """The pieces of records that a separator in their payload cut: ``(id, head, nth)``.

    A piece whose declared length reaches past its own end is the head of a record
    when that length ends exactly where a later piece of the file ends; all pieces
    between belong to it, whatever they look like. Lengths alone are compared (one
    light row a piece, by file); no payload is shuffled.
    """
    header_end = F.instr("value", HEADER_END)
    header = F.substring("value", F.lit(1), header_end + F.lit(len(HEADER_END) - 1))
    declared = F.regexp_extract(header, r"(?im)^content-length:[ \t]*(\d{1,18})", 1).try_cast("long")
    light = pieces.select("source_file", "block", "id", F.octet_length("value").cast("long").alias("size"),
                          F.when(header_end > 0, F.octet_length(header) + declared).alias("whole"))
    order = Window.partitionBy("source_file").orderBy("block", "id")
    gap = len(RECORD_SEPARATOR)
    placed = light.select("source_file", "id", F.row_number().over(order).alias("nth"), "size", "whole",
                          F.coalesce(F.sum(F.col("size") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
                          F.lead("id").over(order).isNull().alias("last"))
    placed = placed.withColumn("end", F.col("start") + F.col("size"))
    # The last piece of a file still carries the blank line that ends its record.
    ends = placed.select("source_file", F.col("nth").alias("to"), F.explode(F.when(F.col("last"), F.array(F.col("end"), F.col("end") - len(HEADER_END))).otherwise(F.array("end"))).alias("at"))
    heads = placed.filter(F.col("whole") > F.col("size")).select("source_file", F.col("nth").alias("from"), (F.col("start") + F.col("whole")).alias("at"))
    spans = heads.join(ends, ["source_file", "at"]).filter(F.col("to") > F.col("from"))
    # What looks like a head inside an earlier record is part of its payload.
    listed = spans.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    kept = F.aggregate("spans", F.expr("cast(array() as array<struct<from:int,to:int>>)"), lambda acc, x: F.when(
        F.coalesce(F.try_element_at(acc, F.lit(-1))["to"], F.lit(0)) < x["from"], F.array_append(acc, x)).otherwise(acc))
    spans = listed.select("source_file", F.inline(kept))
    inside = placed.join(spans, "source_file").filter(F.col("nth").between(F.col("from"), F.col("to")))
    return inside.select("id", F.struct("source_file", "from").alias("head"), "nth")


def read_archive(spark: SparkSession, path: str, stitch: bool = False) -> DataFrame:
    """Archive records ``(source_file, url, headers, payload, length_ok, reason)``.

    The text source splits on the record separator with the blank line that ends
    the record before it (gzip members decode transparently; a ``.gz`` file is one
    task, see ``production.run``). With ``stitch`` a payload that itself holds a whole
    separator is put together again by its declared length (one more pass over the
    lengths, and over the payloads of such records only); without, it is flagged. The header block ends at
    the first blank line and becomes a list of ``(name, value)`` pairs with
    lower-cased names; ``url`` is the first ``warc-target-uri``. ``length_ok``
    compares the payload with the declared content length, flagging a record that
    was cut short; ``rejected`` counts them.
    """
    raw = _pieces(spark, path)
    if stitch:
        cut = written_table(_stitches(raw), "stitches")
        if not cut.isEmpty():
            # The written pieces' size decides how they meet the payloads.
            marked = raw.join(cut, "id", "left")
            whole = marked.filter(F.col("head").isNull()).select("source_file", "value")
            parts = marked.filter(F.col("head").isNotNull()).groupBy("head").agg(F.sort_array(F.collect_list(F.struct("nth", "value"))).alias("p"))
            joined = parts.select("head.source_file", F.array_join("p.value", RECORD_SEPARATOR).alias("value"))
            raw = whole.unionByName(joined)
    raw = (raw.select("source_file", F.regexp_replace("value", "^" + RECORD_START.replace(".", r"\."), "").alias("value"))
           .filter(F.length("value") > 0))
    header_end = F.instr("value", HEADER_END)
    header = F.when(header_end > 0, F.substring("value", 1, header_end - 1)).otherwise(F.col("value"))
    body = F.when(header_end > 0, F.substr(F.col("value"), header_end + F.lit(len(HEADER_END)))
                  ).otherwise(F.lit(""))
    # Header lines as (name, value) pairs; a list, not a map, because records
    # may repeat a header and a map rejects duplicate keys.
    headers = F.transform(
        F.array_remove(F.split(header, "\r\n"), ""),
        lambda line: F.struct(F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"),
                              F.trim(F.substr(line, F.instr(line, ":") + 1)).alias("value")))
    rec = raw.select("source_file", headers.alias("headers"), body.alias("body"))
    declared = U.header(F.col("headers"), "Content-Length")
    # The last record of a file still carries the blank line that ends it.
    whole = F.octet_length("body") == declared.try_cast("long")
    payload = F.when(F.coalesce(whole, F.lit(False)), F.col("body")).otherwise(F.regexp_replace("body", r"\r\n\r\n$", ""))
    rec = rec.withColumn("payload", payload)
    length_ok = F.when(declared.isNull(), F.lit(None)).otherwise(F.octet_length("payload") == declared.try_cast("long"))
    return rec.select(
        "source_file", U.header(F.col("headers"), "WARC-Target-URI").alias("url"), "headers",
        "payload", length_ok.alias("length_ok"), F.when(~length_ok, CUT).alias("reason"))


def read_link_metadata(spark: SparkSession, path: str, stitch: bool = False) -> DataFrame:
    """Metadata archives -> ``(source_file, url, links, length_ok, reason)``.

    ``links`` is NULL when the record has no link section (or is not valid
    JSON, or cut short, as ``reason`` tells); a link object without ``url`` is
    dropped on its own.
    """
    rec = read_archive(spark, path, stitch).filter(F.col("url").isNotNull())
    meta = F.from_json("payload", SC.LINK_METADATA)
    links = meta["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"]
    whole = F.coalesce("length_ok", F.lit(True))
    # Permissive parsing makes a broken document a row without an envelope.
    broken = F.get_json_object("payload", "$").isNull()
    return rec.select("source_file", "url", F.when(whole, U.link_urls(links)).alias("links"), "length_ok",
                      F.coalesce("reason", F.when(broken, NOT_JSON)).alias("reason"))


def parse_index_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Index lines ``urlkey timestamp {json}`` -> ``(urlkey, timestamp, url, filename, valid,
    reason)``, and the ``source_file`` of lines that have one."""
    js = U.json_part(F.col(col))
    parts = F.split(F.col(col), " ", 3)
    parsed = F.from_json(js, SC.INDEX_JSON)
    return lines.select(
        F.try_element_at(parts, F.lit(1)).alias("urlkey"),
        F.try_element_at(parts, F.lit(2)).alias("timestamp"),
        parsed["url"].alias("url"),
        parsed["filename"].alias("filename"),
        (parsed["filename"].isNotNull()).alias("valid"),
        *[c for c in lines.columns if c == "source_file"],
        F.when(F.get_json_object(js, "$").isNull(), NOT_JSON).when(parsed["filename"].isNull(), NO_FILE).alias("reason"))


def read_index(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every index file of a directory (optionally only names matching ``glob``)."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return parse_index_lines(reader.text(path).withColumn("source_file", F.input_file_name()))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """Archive path list: ``(path)``, blank lines removed."""
    return (spark.read.text(path).select(F.trim("value").alias("path"))
            .filter(F.col("path") != ""))


def read_analysis(spark: SparkSession, directory: str, tag: str = ANALYSIS_TAG) -> DataFrame:
    """Saved analysis rows of every file whose name contains ``tag``.

    Accepts both JSON lines and one JSON array per file (each element a row).
    """
    return (spark.read.schema(SC.ANALYSIS_ROW).option("pathGlobFilter", f"*{tag}*")
            .json(directory))
