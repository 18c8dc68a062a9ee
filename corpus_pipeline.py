"""The corpus pipeline: documents in, a training mix out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's `docs`. All but the last
return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import common, containment, langid, minmax, mixing, rlz

#: Words of a shingle in the near-duplicate stage (the query op6 has four by its contract).
SHINGLE_WORDS = 5

_earlier: list[str] = []


def _stage(f):
    """Free the scratch tables of the stage before, whose result is stored by now."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _earlier)
        _earlier.clear()
        mark = common.written_since()
        out = f(spark, docs, sf_dir)
        _earlier.extend(common.written_since(mark))
        return out

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no recognised language."""
    return langid.keep_identified(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles at 0.8."""
    return minmax.keep_one_of_each(docs, width=SHINGLE_WORDS)


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that an earlier document holds."""
    return rlz.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item."""
    return containment.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Read the sources to their target weights."""
    return mixing.taken_rows(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Learned and approximate stages have no SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
