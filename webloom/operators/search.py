"""Text index and keyword search (the text-store role, as Spark jobs).

Index layout: postings ``(term, url, tf)`` from lower-cased text split on runs
of non letters/digits. Written as parquet partitioned by a hash bucket of the
term and sorted by term inside, so a lookup of a few terms reads only their
buckets and, inside them, only row groups whose min/max cover the term.

Queries are tokenised on the driver (a query string is a parameter, not
data) and applied as an ``isin`` filter that is pushed into the scan.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

import regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.constants import (BASE_TERM, BM25_B, BM25_K1, SHARE_CHARS, SHARE_SUFFIX,
                               TOKEN_SPLIT)
from webloom.operators.graph import ROWS_PER_TASK, deal, sum_tasks

#: Places in which a term of a batch meets the tokens or postings that hold it.
SALTS = 16
_SPLIT = regex.compile(TOKEN_SPLIT)
TOKEN_CHAR = r"[\p{L}\p{N}]"   # a text has a token iff it holds one of these


def query_terms(q: str) -> list[str]:
    """Distinct tokens of a query string, in order of appearance."""
    seen: dict[str, None] = {}
    for t in _SPLIT.split(q.lower()):
        if t:
            seen.setdefault(t, None)
    return list(seen)


def phrase_tokens(q: str) -> list[str]:
    """Tokens of a phrase in order, repeats kept."""
    return [t for t in _SPLIT.split(q.lower()) if t]


def tokens(text: Column) -> Column:
    """Array of tokens of a text column (empty strings removed).

    ``array_remove`` rather than a lambda ``filter``: higher-order functions
    are evaluated outside generated code, this stays inside it.
    """
    return F.array_remove(F.split(F.lower(text), TOKEN_SPLIT), "")


def normalised(text: Column) -> Column:
    """Text as its tokens joined by single spaces, padded with a space on both
    sides, so a phrase test is a plain substring test on token boundaries."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def _exploded(docs: DataFrame, url: str, text: str, with_length: bool) -> DataFrame:
    """Tokens ``(url[, dl], term)``; the length comes from the same token list."""
    listed = docs.select(F.col(url).alias("url"), tokens(F.col(text)).alias("_t"))
    length = [F.size("_t").cast("long").alias("dl")] if with_length else []
    return listed.select("url", *length, F.explode("_t").alias("term"))


def build_index(docs: DataFrame, url: str = "url", text: str = "text",
                with_length: bool = False) -> DataFrame:
    """Postings ``(term, url, tf)`` over every document's whole text, with the
    document's length ``dl`` where asked.

    ``explode`` + a partial/final aggregate on ``(term, url)``: a frequent term
    is spread over its documents, never gathered on one key.
    """
    keys = ["term", "url", *(["dl"] if with_length else [])]
    return _exploded(docs, url, text, with_length).groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))


def query_postings(docs: DataFrame, q: str | list[str], url: str = "url",
                   text: str = "text", with_length: bool = False) -> DataFrame:
    """Postings ``(term, url, tf)`` (and ``dl`` where asked) of the query's terms
    only, from raw text.

    For a query over documents that have no stored index: each document is
    tokenised once and tokens that are not query terms are dropped in the same
    generated-code stage, before any shuffle, so only the query's postings are
    shuffled — not every posting of the corpus. The result is a valid index
    for any operator asked about these terms.
    """
    terms = query_terms(q) if isinstance(q, str) else list(q)
    keys = ["term", "url", *(["dl"] if with_length else [])]
    return (_exploded(docs, url, text, with_length).filter(F.col("term").isin(terms))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("tf")))


def batch_postings(docs: DataFrame, terms: DataFrame, url: str = "url", text: str = "text", salts: int = SALTS,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Postings ``(term, url, dl, tf)`` of the terms of a whole batch of queries
    (``terms``: one column ``term``, distinct). Other tokens are dropped by a semi
    join below the aggregate, so only the batch's postings are shuffled where the
    terms are known to be few, as stored ones are. Otherwise tokens meet them by
    ``(term, salt)``, the salt a hash of the url: a word that is in every document
    is never one task's. A text rarely repeats a word, so the tokens found are counted
    first, and many are dealt unsummed over as many tasks as they need."""
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    salted = _exploded(docs, url, text, True).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int"))
    wanted = salted.join(terms.select("term", every_salt), ["term", "salt"], "left_semi")
    wanted = deal(wanted.select("term", "url", "dl"), sum_tasks(wanted, rows_per_task), "term", "url")
    return wanted.groupBy("term", "url", "dl").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(index: DataFrame) -> DataFrame:
    """``(url, dl)``: tokens per document, from the postings."""
    return index.groupBy("url").agg(F.sum("tf").alias("dl"))


def text_lengths(docs: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """``(url, dl)`` straight from the documents: a narrow map, no shuffle.

    Documents without any token are left out, as they are from the postings.
    The filter tests for a letter or digit (the same documents) instead of
    ``dl > 0``: a filter on the alias would be pushed below the projection by
    substituting the expression, tokenising every document twice.
    """
    return (docs.filter(F.col(text).rlike(TOKEN_CHAR))
            .select(F.col(url).alias("url"),
                    F.size(tokens(F.col(text))).cast("long").alias("dl")))


def write_index(index: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Persist postings partitioned by term bucket, sorted by term within files."""
    from webloom.sources.keyed import write_keyed
    write_keyed(index, path, "term", buckets, mode)


def read_index(spark, path: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Read postings; with ``terms`` only their buckets and row groups."""
    from webloom.sources.keyed import BUCKET, read_keyed
    if terms is None:
        return spark.read.parquet(path).drop(BUCKET)
    return read_keyed(spark, path, "term", list(terms), buckets)


def postings(index: DataFrame, q: str | list[str]) -> DataFrame:
    terms = query_terms(q) if isinstance(q, str) else list(q)
    return index.filter(F.col("term").isin(terms))


def search(index: DataFrame, q: str, mode: str = "or") -> DataFrame:
    """Documents matching a keyword query: ``(url, matched)``.

    ``or`` (the default of a text store): any query term; ``and``: all terms.
    ``matched`` is the number of distinct query terms the document contains.
    """
    terms = query_terms(q)
    hits = postings(index, terms).groupBy("url").agg(F.count(F.lit(1)).alias("matched"))
    if mode == "and":
        hits = hits.filter(F.col("matched") == len(terms))
    elif mode != "or":
        raise ValueError(f"unknown mode {mode!r}")
    return hits


def search_phrase(docs: DataFrame, q: str, url: str = "url", text: str = "text") -> DataFrame:
    """Documents containing the query's tokens as a contiguous phrase: ``(url)``.

    One narrow pass over the documents, no shuffle: a cheap substring test of
    every query token on the lower-cased text (necessary for a match) discards
    most documents, and only the survivors are tokenised for the exact test
    on their whole normalised text.
    """
    terms = query_terms(q)
    if not terms:
        return docs.select(F.col(url).alias("url")).limit(0)
    phrase = " " + " ".join(phrase_tokens(q)) + " "
    low = F.lower(F.col(text))
    maybe = None
    for t in terms:
        c = F.instr(low, t) > 0
        maybe = c if maybe is None else (maybe & c)
    return (docs.filter(maybe).filter(F.instr(normalised(F.col(text)), phrase) > 0)
            .select(F.col(url).alias("url")))


def score(index: DataFrame, q: str, k1: float = BM25_K1, b: float = BM25_B,
          lengths: DataFrame | None = None) -> DataFrame:
    """BM25 relevance of matching documents: ``(url, score)``.

    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``; N and the average length are
    scalar subqueries over the length table, ``df`` is one row per query term.
    Postings that carry ``dl`` need the length table for these statistics only.
    """
    terms = query_terms(q)
    lengths = lengths if lengths is not None else doc_lengths(index)
    # One scalar subquery for both corpus statistics (one pass over lengths).
    stats = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                 F.avg("dl").alias("avgdl")).alias("s")).scalar()
    n_docs, avgdl = stats["n"], stats["avgdl"]
    p = postings(index, terms)
    df_t = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    # df_t has at most len(terms) rows: a bounded broadcast.
    weighted = p.join(F.broadcast(df_t.select("term", idf.alias("idf"))), "term")
    if "dl" not in p.columns:
        weighted = weighted.join(lengths, "url")
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    part = F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / norm
    return weighted.groupBy("url").agg(F.sum(part).alias("score"))


def text_counts(docs: DataFrame, terms: list[str], url: str = "url", text: str = "text") -> DataFrame:
    """``(url, dl, tf)`` of every document with a token; ``tf`` counts the given terms
    in their order. Each text is tokenised once, in the scan's own stage, and what
    is shuffled is one light row a document, not its text or its postings."""
    listed = docs.filter(F.col(text).rlike(TOKEN_CHAR)).select(F.col(url).alias("url"), tokens(F.col(text)).alias("_t"))
    times = [(F.size("_t") - F.size(F.array_remove("_t", F.lit(t)))).cast("long").alias(f"tf{i}") for i, t in enumerate(terms)]
    light = listed.select("url", F.size("_t").cast("long").alias("dl"), *times)
    sums = light.groupBy("url").agg(F.sum("dl").alias("dl"), *[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(terms))])
    return sums.select("url", "dl", F.array(*[F.col(f"tf{i}") for i in range(len(terms))]).cast("array<bigint>").alias("tf"))


def search_texts(docs: DataFrame, q: str, mode: str = "or", url: str = "url", text: str = "text") -> DataFrame:
    """``search`` over raw texts: ``(url, matched)`` without postings. Texts that lack
    the terms as plain substrings are dropped before they are tokenised."""
    terms = query_terms(q)
    if mode not in ("or", "and"):
        raise ValueError(f"unknown mode {mode!r}")
    if not terms:
        return docs.select(F.col(url).alias("url"), F.lit(0).cast("long").alias("matched")).limit(0)
    low = F.lower(F.col(text))
    held = [F.instr(low, t) > 0 for t in terms]
    # Any term, in either mode: the others may be in another row of the url.
    maybe = docs.filter(reduce(or_, held)).select(F.col(url).alias("url"), tokens(F.col(text)).alias("_t"))
    each = maybe.select("url", *[F.array_contains("_t", t).alias(f"m{i}") for i, t in enumerate(terms)])
    # Rows of one url are one document.
    hits = each.groupBy("url").agg(*[F.bool_or(f"m{i}").alias(f"m{i}") for i in range(len(terms))])
    matched = reduce(add, [F.col(f"m{i}").cast("long") for i in range(len(terms))])
    return hits.select("url", matched.alias("matched")).filter(F.col("matched") >= (len(terms) if mode == "and" else 1))


def score_texts(docs: DataFrame, q: str, k1: float = BM25_K1, b: float = BM25_B, url: str = "url", text: str = "text") -> DataFrame:
    """``score`` over raw texts: ``(url, score)``. Corpus statistics and scores come from
    the same light rows, whose one shuffle both read."""
    terms = query_terms(q)
    counts = text_counts(docs, terms, url, text)
    df = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    stats = counts.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *df).alias("s")).scalar()
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / stats["avgdl"])
    parts = [F.log(F.lit(1.0) + (stats["n"] - stats[f"df{i}"] + F.lit(0.5)) / (stats[f"df{i}"] + F.lit(0.5)))
             * F.col("tf")[i] * F.lit(k1 + 1.0) / (F.col("tf")[i] + norm) for i in range(len(terms))]
    hit = F.array_max("tf") > 0 if terms else F.lit(False)
    return counts.filter(hit).select("url", reduce(add, parts, F.lit(0.0)).alias("score"))


def match_all(docs: DataFrame) -> DataFrame:
    """Every stored document (the store's match-all listing)."""
    return docs.select("url")


def hit_count(index: DataFrame, q: str) -> DataFrame:
    """One row ``(hits)``: documents matching ``q`` (OR)."""
    return search(index, q).agg(F.count(F.lit(1)).alias("hits"))


def share_caption(hits: Column, base: Column, term: str, chars: int = SHARE_CHARS,
                  suffix: str = SHARE_SUFFIX) -> Column:
    """``"term" in 12.34<suffix>``: the percentage cut (not rounded) to ``chars``."""
    pct = F.try_divide(F.lit(100.0) * hits, base)
    cut = F.substring(pct.cast("string"), 1, chars)
    return F.concat(F.lit(f'"{term}" in '), cut, F.lit(suffix))


def hit_share(index: DataFrame, q: str, base_term: str = BASE_TERM) -> DataFrame:
    """``(hits, base_hits, pct, caption)`` for a query against a base term's hits."""
    h = hit_count(index, q).select("hits")
    base = hit_count(index, base_term).select(F.col("hits").alias("base_hits"))
    pct = F.try_divide(F.lit(100.0) * F.col("hits"), F.col("base_hits"))
    return (h.select("hits", base.scalar().alias("base_hits"))
            .select("hits", "base_hits", pct.alias("pct"),
                    share_caption(F.col("hits"), F.col("base_hits"), q).alias("caption")))
