"""Approximate nearest neighbours by multi-index hashing.

Codes: `ROTATIONS` rotations of the unit vectors are learned by iterative
quantization on a bounded sample (`FIT_ROWS` rows of least hash); their signs
are a binary code. Codes are split into substrings of 8 bits, and each
substring is indexed: for every value a bitmap of the rows near it. By the
pigeonhole principle a code within Hamming radius r of a query lies within
r // m of it in at least one of the m substrings, so the union of the query's
bitmaps holds every code within the radius; these are checked, then reranked by
cosine on the original vectors.

The radius is the distance within which `REACH` of the sample's own true
neighbours lie. A block of the index that finds too few reranks all its rows.
Rows are indexed in blocks of about `BLOCK` and queries come in blocks, so a
task holds one of each. Equal vectors are one entry with its smallest ids.

Defined cases: vectors null, zero, holding null or non-finite components, or of
another length than most, take no part. Rows with a null id take no part. Rows
that repeat an id are one candidate if their vectors are equal. With fewer
candidates than asked, all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import written

FIT_ROWS = 4096
FIT_QUERIES = 512
ROTATIONS = 4
ROUNDS = 30
REACH = 0.98
BLOCK = 8192
QUERY_BLOCK = 4096
SUBSTRING = 8

_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_APART = _BITS[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


def rotations(unit: np.ndarray) -> np.ndarray:
    """Learned rotations, side by side: the signs of unit @ these are the code."""
    out = []
    for seed in range(ROTATIONS):
        rotation = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((unit.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(unit @ rotation >= 0, 1.0, -1.0).T @ unit)
            rotation = (u @ w).T
        out.append(rotation)
    return np.hstack(out)


def encode(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as bytes, one substring each."""
    return np.packbits(unit @ turn >= 0, axis=1)


def learn_radius(unit: np.ndarray, codes: np.ndarray, k: int) -> int:
    """Hamming distance within which REACH of the sample's neighbours lie."""
    far = [0]
    for q in range(min(FIT_QUERIES, len(unit))):
        near = np.argsort(-(unit @ unit[q]))[1:k + 1]
        far.extend(_BITS[codes[near] ^ codes[q]].sum(axis=1).tolist())
    return int(np.quantile(far, REACH))


class Index:
    """The rows of one block: a bitmap of near rows for each substring and value."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        m = codes.shape[1]
        reach, rest = divmod(radius, m)
        self.near = [np.packbits(_APART[:, codes[:, j]] <= (reach if j <= rest else reach - 1), axis=1) for j in range(m)]

    def within(self, code: np.ndarray) -> np.ndarray:
        """Rows within the radius."""
        union = self.near[0][code[0]].copy()
        for j in range(1, len(code)):
            union |= self.near[j][code[j]]
        rows = np.flatnonzero(np.unpackbits(union, count=len(self.codes)))
        return rows[_BITS[self.codes[rows] ^ code].sum(axis=1) <= self.radius]


def _search(turn: np.ndarray, radius: int, k: int):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("q1", "q2", "k1", "k2", "least", "score")}
        if index.num_rows and queries.num_rows:
            rows, asked = (np.stack(t["v"].to_numpy()).astype(np.float64) for t in (index, queries))
            size, query_size = np.linalg.norm(rows, axis=1), np.linalg.norm(asked, axis=1)
            table = Index(encode(rows / size[:, None], turn), radius)
            codes = encode(asked / query_size[:, None], turn)
            k1, k2, least = (index[c].to_numpy() for c in ("k1", "k2", "least"))
            q1, q2 = (queries[c].to_numpy() for c in ("k1", "k2"))
            for q in range(len(asked)):
                found = table.within(codes[q])
                if len(found) <= k:
                    found = np.arange(len(rows))
                score = rows[found] @ asked[q] / (size[found] * query_size[q])
                best = np.lexsort((least[found], -score))[:k + 1]
                at = found[best]
                for name, values in (("q1", np.repeat(q1[q], len(at))), ("q2", np.repeat(q2[q], len(at))), ("k1", k1[at]), ("k2", k2[at]), ("least", least[at]), ("score", score[best])):
                    out[name].append(values)
        kinds = {c: pa.float64() if c == "score" else pa.int64() for c in out}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in out.items()})

    return search


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    vectors = vectors.filter("id is not null and v is not null and size(v) > 0").filter(sound).filter(F.exists("v", lambda x: x != 0))
    usual = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.filter(F.size("v") == usual["n"]).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    sample = vectors.orderBy("k1", "id").limit(FIT_ROWS).select("v").collect()
    unit = np.array([r["v"] for r in sample], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turn = rotations(unit)
    radius = learn_radius(unit, encode(unit, turn), k)

    # Of equal vectors only the k + 1 smallest ids can be answers.
    twins = Window.partitionBy("k1", "k2").orderBy("id")
    members = written(vectors.select("k1", "k2", "id").distinct().withColumn("nth", F.row_number().over(twins)).filter(F.col("nth") <= k + 1), "members")
    entries = written(vectors.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.min_by("v", "id").alias("v"), F.max("asks").alias("asks")), "entries")
    n, asked = entries.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, query_blocks = -(-n // BLOCK), max(1, -(-asked // QUERY_BLOCK))
    some = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda count: F.pmod("k1", F.lit(count)).cast("int")
    index = entries.withColumn("b", block(blocks)).withColumn("qb", some(query_blocks)).select("b", "qb", "k1", "k2", "least", "v")
    asking = entries.filter("asks").withColumn("qb", block(query_blocks)).withColumn("b", some(blocks)).select("b", "qb", "k1", "k2", "v")
    found = index.groupBy("b", "qb").cogroup(asking.groupBy("b", "qb")).applyInArrow(_search(turn, radius, k), "q1 long, q2 long, k1 long, k2 long, least long, score double")
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least")
    found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).select("q1", "q2", "k1", "k2", "score")
    answers = found.join(members.select("k1", "k2", F.col("id").alias("vec_id")), ["k1", "k2"])
    queries = vectors.filter("asks").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("id").alias("query_id")).distinct()
    ranked = queries.join(answers, ["q1", "q2"]).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(rows: DataFrame) -> DataFrame:
    return nearest(rows, F.col("vec_id") % 50 == 0)
