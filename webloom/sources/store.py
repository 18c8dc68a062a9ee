"""Key-bucketed stores that are merged in place of being rewritten.

A store is a folder of commits, each written once as
``<path>/commit=<id>/bucket=<n>`` and sorted by key, and beside it of manifests,
one for each version: which commits make up each bucket now. A merge writes only the
rows it brings, as a *delta* of the buckets they belong to; a bucket whose
deltas have grown past ``COMPACT_AT`` of its base (or past ``MAX_DELTAS`` in
number) is rewritten by the same merge, every other bucket keeps its files. A
reader takes the base rows whose key no delta holds, and each delta key's last
row; buckets without deltas need neither.

A version exists once its file in ``<path>.versions`` does, and that file is created
exclusively: of two merges that end at the same time one is first, and the
other goes on from what the first one wrote, with its delta as it is. A failed
merge leaves files that no manifest names; ``vacuum`` removes those, and the
versions before the last ones.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.keyed import BUCKET, with_bucket, write_keyed

COMPACT_AT = 0.25       # delta bytes of a bucket, as a share of its base
MAX_DELTAS = 16         # delta commits of a bucket
BUCKET_BYTES = 256 << 20


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``: the one written last, which is the one with the greatest
    ``order`` (a batch number, a file position, a time); ties go to the greatest row.

    ``max_by`` is a partial aggregate: a key written many times is combined
    map-side rather than gathered into one task.
    """
    others = [c for c in df.columns if c != key]
    rank_key = F.struct(F.col(order), *[F.col(c) for c in others if c != order])
    picked = df.groupBy(key).agg(F.max_by(F.struct(*others), rank_key).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "url",
           order: str | None = None) -> DataFrame:
    """Store upsert by key: incoming rows replace existing rows with the same key.

    ``existing ▷ incoming`` (anti join) ∪ ``incoming``. With ``order`` the last
    write of each key counts; without it ``incoming`` must hold a key once.
    Idempotent: applying the same incoming rows twice gives the same table.
    """
    new = latest_per_key(incoming, key, order) if order else incoming
    kept = existing.join(new.select(F.col(key).alias("_new_key")), F.col(key).eqNullSafe(F.col("_new_key")), "left_anti")
    return kept.unionByName(new.select(*existing.columns))


@dataclass(frozen=True)
class Part:
    """The files of one bucket in one commit. ``seq`` is 0 for a base, and for a
    delta the version that brought it."""
    bucket: int
    commit: str
    seq: int
    bytes: int


def _place(part: Part) -> tuple[int, int]:
    return part.bucket, part.seq


@dataclass(frozen=True)
class Snapshot:
    """A store as of one version."""
    path: str
    version: int = 0
    key: str = ""
    buckets: int = 0
    schema: str = ""
    parts: list[Part] = field(default_factory=list)

    def of(self, buckets: set[int] | None = None) -> list[Part]:
        return [p for p in self.parts if buckets is None or p.bucket in buckets]

    def bytes(self) -> int:
        return sum(p.bytes for p in self.parts)


# ---- versions -----------------------------------------------------------------

def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder, files = _files(spark, f"{path}.versions")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The store at ``path`` as of its last version, or of an earlier one that is
    still kept; version 0 where there is no store."""
    known = _versions(spark, path)
    if version is None:
        version = known[-1] if known else 0
    if not version:
        return Snapshot(path)
    if version not in known:
        raise ValueError(f"{path} has no version {version}")
    head = json.loads("\n".join(r.value for r in spark.read.text(f"{path}.versions/{version}").collect()))
    # One row for each bucket and commit, a bounded number a bucket.
    rows = spark.read.schema("bucket int, commit string, seq long, bytes long").json(f"{path}.manifests/{head['manifest']}").collect()
    return Snapshot(path, version, head["key"], head["buckets"], head["schema"], sorted((Part(**r.asDict()) for r in rows), key=_place))


def _publish(spark: SparkSession, snap: Snapshot) -> bool:
    """Make ``snap`` a version; False when that version exists already."""
    name = uuid.uuid4().hex
    rows = [(p.bucket, p.commit, p.seq, p.bytes) for p in snap.parts]
    spark.createDataFrame(rows, "bucket int, commit string, seq long, bytes long").coalesce(1).write.json(f"{snap.path}.manifests/{name}")
    at, files = _files(spark, f"{snap.path}.versions/{snap.version}")
    try:
        out = files.create(at, False)
    except Py4JJavaError as taken:
        if not files.exists(at):
            raise taken
        return False
    head = {"manifest": name, "key": snap.key, "buckets": snap.buckets, "schema": snap.schema}
    out.write(bytearray(json.dumps(head).encode()))
    out.close()
    return True


# ---- reading --------------------------------------------------------------------

def _scan(spark: SparkSession, snap: Snapshot, parts: list[Part]) -> DataFrame:
    """Rows of these parts with ``bucket`` and ``commit``."""
    paths = [f"{snap.path}/commit={p.commit}/{BUCKET}={p.bucket}" for p in parts]
    return spark.read.schema(f"{snap.schema}, commit string, {BUCKET} int").option("basePath", snap.path).parquet(*paths)


def _resolved(spark: SparkSession, snap: Snapshot, parts: list[Part]) -> DataFrame:
    """The current rows of these parts, with ``bucket``: base rows whose key no
    delta holds, and each delta key's last row."""
    base, deltas = [p for p in parts if not p.seq], [p for p in parts if p.seq]
    columns = [c for c in _scan(spark, snap, parts).columns if c != "commit"]
    if not deltas:
        return _scan(spark, snap, base).select(*columns)
    seq = F.create_map(*[F.lit(x) for p in sorted({(p.commit, p.seq) for p in deltas}) for x in p])
    last = latest_per_key(_scan(spark, snap, deltas).withColumn("_seq", seq[F.col("commit")]).drop("commit"), snap.key, "_seq").select(*columns)
    return upsert(_scan(spark, snap, base).select(*columns), last, snap.key) if base else last


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current rows of a store; only buckets that have deltas are joined with them."""
    snap = snapshot(spark, path, version)
    moving = {p.bucket for p in snap.parts if p.seq}
    still = [p for p in snap.parts if p.bucket not in moving]
    halves = ([_scan(spark, snap, still).drop("commit")] if still else []) + ([_resolved(spark, snap, snap.of(moving))] if moving else [])
    if not halves:
        return spark.createDataFrame([], snap.schema)
    whole = halves[0] if len(halves) == 1 else halves[0].unionByName(halves[1])
    return whole.drop(BUCKET)


def read_keys(spark: SparkSession, path: str, keys: DataFrame, column: str | None = None) -> DataFrame:
    """The current rows whose key is in ``keys`` (one column), each once.

    The keys stay a relation: no list of them passes through the driver. The store
    is joined on bucket and key, so that Spark prunes the bucket folders at run
    time by the buckets of the keys (when they are few enough to broadcast; else
    both sides are shuffled).
    """
    snap = snapshot(spark, path)
    wanted = with_bucket(keys.select(F.col(column or keys.columns[0]).alias("_key")).distinct(), "_key", snap.buckets)
    wanted = wanted.select("_key", F.col(BUCKET).cast("int").alias("_bucket")).filter(F.col("_bucket") >= 0)

    def asked(parts: list[Part]) -> DataFrame:
        rows = _scan(spark, snap, parts)
        return rows.join(wanted, (F.col(BUCKET) == F.col("_bucket")) & F.col(snap.key).eqNullSafe(F.col("_key")), "left_semi")

    base, deltas = [p for p in snap.parts if not p.seq], [p for p in snap.parts if p.seq]
    if not snap.parts:
        return spark.createDataFrame([], snap.schema)
    if not deltas:
        return asked(base).drop("commit", BUCKET)
    seq = F.create_map(*[F.lit(x) for p in sorted({(p.commit, p.seq) for p in deltas}) for x in p])
    last = latest_per_key(asked(deltas).withColumn("_seq", seq[F.col("commit")]).drop("commit", BUCKET), snap.key, "_seq").drop("_seq")
    return upsert(asked(base).drop("commit", BUCKET), last, snap.key) if base else last


# ---- writing --------------------------------------------------------------------

def _commit(rows: DataFrame, path: str, key: str, buckets: int, small: bool = False) -> list[Part]:
    """Write rows as a new commit; its parts (seq 0). Files of a ``small`` one have
    no Bloom filter, which takes 64 KiB at least."""
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    folder = f"{path}/commit={name}"
    write_keyed(rows, folder, key, buckets, bloom=not small)
    # What was written, from the files' own metadata: no data column is read.
    written = spark.read.schema(f"{_ddl(rows)}, {BUCKET} int").parquet(folder)
    files = written.groupBy(BUCKET, "_metadata.file_path").agg(F.first("_metadata.file_size").alias("bytes"))
    return [Part(r[BUCKET], name, 0, r["bytes"]) for r in files.groupBy(BUCKET).agg(F.sum("bytes").alias("bytes")).collect()]


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def bucket_count(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``rows`` written once, and the buckets of about ``BUCKET_BYTES`` they fill."""
    spark = rows.sparkSession
    folder = f"{path}.staged/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    staged = spark.read.schema(rows.schema).parquet(folder)
    size = staged.groupBy("_metadata.file_path").agg(F.first("_metadata.file_size").alias("b")).agg(F.sum("b")).first()[0] or 0
    return staged, max(8, 1 << math.ceil(math.log2(max(size, 1) / BUCKET_BYTES)) if size > BUCKET_BYTES else 8)


def merge(spark: SparkSession, path: str, incoming: DataFrame, key: str = "url", order: str | None = None,
          buckets: int | None = None, compact_at: float = COMPACT_AT) -> Snapshot:
    """Merge ``incoming`` into the store at ``path`` (made if absent): rows replace
    those of the same key. With ``order`` a key's last write counts; without it a
    key that comes twice is an error. Returns the new version."""
    snap = snapshot(spark, path)
    new = latest_per_key(incoming, key, order) if order else incoming
    if snap.version and (snap.key != key or snap.schema != _ddl(new)):
        raise ValueError(f"{path} holds {snap.schema} by {snap.key}, not {_ddl(new)} by {key}")
    if not snap.version and buckets is None:
        new, buckets = bucket_count(new, path)
    buckets = snap.buckets or buckets
    brought = _commit(new, path, key, buckets, small=snap.version > 0)
    fresh = Snapshot(path, 0, key, buckets, _ddl(new), brought)
    if not order and brought and not _scan(spark, fresh, brought).groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"a {key} comes twice, and no order says which row is the last")
    while True:
        version = snap.version + 1
        held: dict[int, list[Part]] = {}
        for p in snap.parts:
            held.setdefault(p.bucket, []).append(p)
        parts, crowded = list(snap.parts), set()
        for p in brought:
            own = held.get(p.bucket, [])
            base, deltas = sum(x.bytes for x in own if not x.seq), [x for x in own if x.seq]
            if len(deltas) >= MAX_DELTAS or own and sum(x.bytes for x in deltas) + p.bytes > compact_at * base:
                crowded.add(p.bucket)
            parts.append(Part(p.bucket, p.commit, version if own else 0, p.bytes))
        if crowded:
            whole = _resolved(spark, fresh, [p for p in parts if p.bucket in crowded]).drop(BUCKET)
            parts = [p for p in parts if p.bucket not in crowded] + _commit(whole, path, key, buckets)
        done = Snapshot(path, version, key, buckets, fresh.schema, sorted(parts, key=_place))
        if _publish(spark, done):
            return done
        snap = snapshot(spark, path)
        if snap.buckets != buckets or snap.schema != fresh.schema:
            raise ValueError(f"{path} was made by another merge in another form")


def compact(spark: SparkSession, path: str) -> Snapshot:
    """Fold every delta into its bucket's base; buckets without deltas keep their files."""
    while True:
        snap = snapshot(spark, path)
        moving = {p.bucket for p in snap.parts if p.seq}
        if not moving:
            return snap
        whole = _commit(_resolved(spark, snap, snap.of(moving)).drop(BUCKET), path, snap.key, snap.buckets)
        done = Snapshot(path, snap.version + 1, snap.key, snap.buckets, snap.schema, sorted([p for p in snap.parts if p.bucket not in moving] + whole, key=_place))
        if _publish(spark, done):
            return done


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete what only versions before the last ``keep`` name, and what none names;
    returns the number of commits deleted. Not to be run beside a merge."""
    known = _versions(spark, path)
    named = {p.commit for v in known[-keep:] for p in snapshot(spark, path, v).parts}
    for v in known[:-keep]:
        at, files = _files(spark, f"{path}.versions/{v}")
        files.delete(at, False)
    folder, files = _files(spark, path)
    gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().partition("=")[2] not in named]
    staged, _ = _files(spark, f"{path}.staged")
    for at in [*gone, staged]:
        files.delete(at, True)
    return len(gone)


def store_upsert(path: str, incoming: DataFrame, key: str = "url", order: str | None = None, buckets: int | None = None) -> DataFrame:
    """Merge ``incoming`` into the store at ``path`` and return the store."""
    merge(incoming.sparkSession, path, incoming, key, order, buckets)
    return read_store(incoming.sparkSession, path)


def store_version(spark: SparkSession, path: str) -> int:
    """Number of the store's current version, 0 where there is no store."""
    known = _versions(spark, path)
    return known[-1] if known else 0
