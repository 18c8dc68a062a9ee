"""WARC archives with a two-level capture index.

Archives: one gzip member per record, so a record is one range read. Of records
with equal payloads the one with the least page_id is a response, the others
are revisits that refer to it.

Index: captures are sorted by reversed-host URL key (`com,example,www)/path`),
then page, over all partitions. Each index file holds compressed blocks of
`BLOCK_LINES` lines and a sparse directory with the first key of each block;
the first key of each file (one row for each write task) is the top level. A
lookup searches the top level, the file's directory, then the block by
bisection, and range-reads the block and the record.

Files are written and read through ``pyarrow.fs`` under the shared checkpoint
folder. A task writes files of its own attempt, and only a finished attempt's
files are named in the index, so a lost executor leaves nothing half written in
it.

Defined cases: a null html is an empty payload, and a null url has the empty
key. A null page_id counts as the largest and is null again when read. Rows
that repeat a whole page are separate captures with equal keys; the first is
the response of each of them. Other columns are never read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import row_key, scratch, written

BLOCK_LINES = 1000
#: Bytes of keys and payloads that a task holds before it hands records on.
BATCH_BYTES = 8 << 20
MIN_REVISIT_BYTES = 0
DATE = "2015-10-02T00:00:00Z"
_OPEN_FILES = 64
_OFFSET = 1 << 63
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def url_key(url: str | None) -> str:
    """Reversed host, `)`, path and query: `http://a.b.c/d?e` -> `c,b,a)/d?e`."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def capture_key(url: str | None, page: int | None, key: int) -> str:
    """Sorts by URL key, then page; no part holds white space."""
    return f"{_SPACE.sub('%20', url_key(url))} {_OFFSET * 2 if page is None else page + _OFFSET:020d} {key + _OFFSET:020d}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page is None else page
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_SPACE.sub('%20', url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'none' if refers is None else refers}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Fields and payload of one record; a revisit has its payload's length only."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda f: None if (v := fields.get(f, "<urn:page:none>")[10:-1]) == "none" else int(v)
    out = {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"][5:], "payload": None}
    if out["record_type"] == "response":
        if len(payload) != length:
            raise ValueError(f"record of page {out['page_id']} is cut")
        out |= {"payload": payload, "payload_digest": digest32(payload)}
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, page, url = (batch.column(c) for c in range(3))
        payloads = [(h or "").encode() for h in batch.column(3).to_pylist()]
        captures = [capture_key(*x) for x in zip(url.to_pylist(), page.to_pylist(), key.to_pylist())]
        yield pa.RecordBatch.from_arrays([key, page, pa.array(captures, pa.string()), pa.array([len(p) for p in payloads], pa.int64()), pa.array([digest32(p) for p in payloads], pa.string())], ["key", "page_id", "capture", "size", "digest"])


def _archive(path: str):
    def write(batches):
        files, folder = store(path)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(folder, recursive=True)
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                member = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["first"], row["revisit"])
                out.write(member)
                rows.append((row["capture"], name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["capture", "file", "at", "size"])
        if out is not None:
            out.close()

    return write


def _index(path: str):
    """Sorted captures of a partition to one file: blocks, then the directory."""

    def write(batches):
        files, folder = store(path)
        name = f"{uuid.uuid4().hex}.idx"
        out, at, lines, directory = None, 0, [], []

        def block():
            nonlocal at, lines
            packed = zlib.compress("\n".join(lines).encode())
            out.write(packed)
            directory.append(f"{lines[0].partition(chr(9))[0]}\t{at}\t{len(packed)}")
            at, lines = at + len(packed), []

        for batch in batches:
            for key, file, start, size in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if out is None:
                    files.create_dir(folder, recursive=True)
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                lines.append(f"{key}\t{file}\t{start}\t{size}")
                if len(lines) == BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            packed = zlib.compress("\n".join(directory).encode())
            out.write(packed)
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [directory[0].partition("\t")[0]], "file": [name], "at": [at], "size": [len(packed)]})

    return write


def write_archives(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> tuple[str, list[tuple[str, str, int, int]], DataFrame]:
    """Write archives and index. Returns their folder, the top level of the index
    (first key, file, place and size of its directory, for each file: as many
    as shuffle partitions), and the captures (capture, file, at, size)."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    rows = pages.select(row_key(id, url, html).alias("key"), F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    light = written(rows.mapInArrow(_digests, "key long, page_id long, capture string, size long, digest string"), "payloads")
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)), "key")
    shared = light.groupBy("digest", "size").agg(F.min_by(F.struct("key", "page_id"), order).alias("least"), F.min("key").alias("low"), F.max("key").alias("high"))
    shared = shared.filter((F.col("low") != F.col("high")) & (F.col("size") >= MIN_REVISIT_BYTES)).select("digest", "size", "least")
    verdict = light.join(shared, ["digest", "size"], "left").groupBy("key").agg(
        F.first("capture").alias("capture"), F.first("digest").alias("digest"), F.first("least.page_id").alias("first"),
        F.first(F.coalesce(F.col("least.key") != F.col("key"), F.lit(False))).alias("revisit"))
    placed = rows.join(verdict, "key").select("page_id", "url", "html", "capture", "digest", "first", "revisit")
    captures = written(placed.mapInArrow(_archive(f"{path}/archive"), "capture string, file string, at long, size long"), "captures")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = captures.repartitionByRange(parts, "capture", "file", "at").sortWithinPartitions("capture", "file", "at").mapInArrow(_index(f"{path}/index"), "first string, file string, at long, size long")
    return path, sorted(map(tuple, files.collect())), captures


def read_records(path: str, top: list[tuple[str, str, int, int]], wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the captures in `wanted` (one column of capture keys, or of
    key prefixes such as a URL key and a space), by bisection and range reads.
    Without `payloads` they are read and digested, but null in the result."""
    spark = wanted.sparkSession
    shared = spark.sparkContext.broadcast(top)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = "capture string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def read(batches):
        files, folder = store(path)
        top = shared.value
        firsts = [t[0] for t in top]
        handles: OrderedDict = OrderedDict()
        kept: dict = {}

        def part(name, at, size):
            if name not in handles:
                if len(handles) == _OPEN_FILES:
                    handles.popitem(last=False)[1].close()
                handles[name] = files.open_input_file(f"{folder}/{name}")
            handles.move_to_end(name)
            return handles[name].read_at(size, at)

        def lines(level, name, at, size):
            """A directory or a block; the last of each stays, as lookups come sorted."""
            if kept.get(level, (None,))[0] != (name, at):
                rows = [line.split("\t") for line in zlib.decompress(part(f"index/{name}", at, size)).decode().split("\n")]
                kept[level] = (name, at), [r[0] for r in rows], rows
            return kept[level][1:]

        def found(prefix):
            """Lines whose key starts with the prefix: they may span blocks and files."""
            f = max(0, bisect.bisect_left(firsts, prefix) - 1)
            while f < len(top) and (firsts[f] <= prefix or firsts[f].startswith(prefix)):
                _, name, at, size = top[f]
                heads, blocks = lines("directory", name, at, size)
                b = max(0, bisect.bisect_left(heads, prefix) - 1)
                while b < len(blocks) and (heads[b] <= prefix or heads[b].startswith(prefix)):
                    keys, rows = lines("block", name, int(blocks[b][1]), int(blocks[b][2]))
                    k = bisect.bisect_left(keys, prefix)
                    while k < len(keys) and keys[k].startswith(prefix):
                        yield rows[k]
                        k += 1
                    b += 1
                f += 1

        def handed_on(rows):
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("capture", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

        for batch in batches:
            rows, held = [], 0
            for prefix in batch.column(0).to_pylist():
                for key, file, at, size in found(prefix):
                    row = {"capture": key, **parse(part(f"archive/{file}", int(at), int(size)))}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(key) + len(row["payload"] or b"")
                    if held >= BATCH_BYTES:
                        yield handed_on(rows)
                        rows, held = [], 0
            yield handed_on(rows)

    column = wanted.columns[0]
    spread = wanted.select(column).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    return spread.mapInArrow(read, fields)


def lookup(path: str, top: list[tuple[str, str, int, int]], urls: DataFrame, url: str = "url") -> DataFrame:
    """Every record captured from the given URLs."""
    keys = urls.select(F.col(url).alias("u")).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"prefix": [_SPACE.sub("%20", url_key(u)) + " " for u in b.column(0).to_pylist()]}) for b in batches), "prefix string")
    return read_records(path, top, keys)


def report(pages: DataFrame) -> DataFrame:
    """Write every page, then read every capture back through the index: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    path, top, captures = write_archives(pages)
    return read_records(path, top, captures.select("capture"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
