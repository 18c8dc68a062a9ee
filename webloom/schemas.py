"""Explicit schemas of every table the library reads or writes.

Readers always pass one of these, so no source pays a schema-inference pass
over the input (which on a crawl-sized corpus is a full extra scan).
"""

from pyspark.sql import types as T

# Crawl-index line, parsed (the raw line is `urlkey timestamp {json}`).
INDEX_RECORD = T.StructType([
    T.StructField("urlkey", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("filename", T.StringType()),
])

# JSON part of an index line; only the keys we use.
INDEX_JSON = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("filename", T.StringType()),
])

# One archive record: the file it came from, target url and raw payload.
ARCHIVE_RECORD = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("payload", T.StringType()),
])

# Metadata payload: Envelope -> Payload-Metadata -> HTTP-Response-Metadata
# -> HTML-Metadata -> Links[url].
_LINK = T.StructType([T.StructField("url", T.StringType())])
LINK_METADATA = T.StructType([
    T.StructField("Envelope", T.StructType([
        T.StructField("Payload-Metadata", T.StructType([
            T.StructField("HTTP-Response-Metadata", T.StructType([
                T.StructField("HTML-Metadata", T.StructType([
                    T.StructField("Links", T.ArrayType(_LINK)),
                ])),
            ])),
        ])),
    ])),
])

# Cleaned link page (JSON lines).
LINK_PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
])

# Cleaned text page (JSON lines).
TEXT_PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("plaintext", T.StringType()),
])

# Ranked page (the key-value table, key = url).
RANKED_PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("rank", T.DoubleType()),
    T.StructField("links", T.ArrayType(T.StringType())),
])

# Saved analysis row of a search (one JSON array per file).
ANALYSIS_ROW = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("rank", T.DoubleType()),
    T.StructField("total_links", T.LongType()),
])

GRAPH_NODE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("group", T.IntegerType()),
    T.StructField("rank", T.DoubleType()),
    T.StructField("total_links", T.LongType()),
])

GRAPH_EDGE = T.StructType([
    T.StructField("source", T.LongType()),
    T.StructField("target", T.LongType()),
    T.StructField("value", T.IntegerType()),
])

GRAPH_DOCUMENT = T.StructType([
    T.StructField("nodes", T.ArrayType(GRAPH_NODE)),
    T.StructField("links", T.ArrayType(GRAPH_EDGE)),
])

# Ingest manifest: per listed source file, did it load.
MANIFEST = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("n_records", T.LongType()),
])
