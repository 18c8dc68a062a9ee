"""Mixing sources to target weights by hierarchical budgeting.

DataFrame operations only. The budget in tokens runs down the tree domain,
language, source. A node shares its budget among its children by weight; a
child never gets more than its leaves can give (their tokens times
`max_epochs`), and what it cannot use goes to its siblings in proportion to
their weights. As a node's own budget is limited by its leaves in the same
way, a shortage goes to siblings first and reaches the ancestors only when the
whole family is used up. A leaf then reads its documents in the seeded order of
each epoch: whole epochs first, then the prefix of the next one that fills its
budget, the last document in part.

The order of an epoch is the md5 of seed, epoch and doc_id. To find where a
prefix ends no leaf is ever sorted as a whole: tokens are summed by the first
hex digits of the md5, and only the slice in which the budget ends is sorted.
Documents meet these cuts by a join with one row for each leaf.

Defined cases: null levels are the name ``none``; a null text has no tokens and
is never taken in part; a null doc_id orders as the empty string. Rows that
repeat a doc_id within a leaf share a place in its order and are taken
together or not at all. An empty table allots nothing. Weights are whole
numbers, 1 where none is given. Shares are rounded down to whole tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import written
from webloom.llm.containment import word_list

DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5}
SHARE = 0.6
MAX_EPOCHS = 4
SEED = 17
#: Hex digits of a slice: 4,096 slices of each leaf.
DIGITS = 3

LEVELS = ("domain", "language", "leaf")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo four; others are ``none``."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("bigint")
    return F.coalesce(F.concat(F.lit("d"), (number % 4).cast("string")), F.lit("none"))


def _fill(nodes: DataFrame, parents: tuple[str, ...], name: str, weights: dict[str, int]) -> DataFrame:
    """Share `budget` (the parent's) among its children by weight, each at most its `cap`."""
    weight = F.lit(1).cast("long")
    for k, v in weights.items():
        weight = F.when(F.col(name) == k, F.lit(int(v)).cast("long")).otherwise(weight)
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("cap") / F.col("w"), name)
    n = nodes.withColumn("w", weight)
    n = n.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    n = n.withColumn("full", F.expr("cap * rest <= (budget - before) * w"))
    n = n.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)))
    n = n.withColumn("shared", F.sum(F.when(~F.col("full"), F.col("w"))).over(family))
    allotted = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(left * w) div shared"))
    return n.withColumn("budget", allotted).drop("w", "before", "rest", "full", "left", "shared")


def allot(leaves: DataFrame, share: float, max_epochs: int, domains: dict[str, int], languages: dict[str, int], sources: dict[str, int]) -> DataFrame:
    """Leaves (domain, language, leaf, tokens) with their `budget` in tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.least(F.floor(F.sum("tokens") * share), F.sum("cap")).cast("long").alias("budget")).first()["budget"]
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("budget", F.lit(total or 0).cast("long"))
    top = _fill(top, (), "domain", domains)
    mid = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(top.select("domain", "budget"), "domain")
    mid = _fill(mid, ("domain",), "language", languages)
    low = leaves.join(mid.select("domain", "language", "budget"), ["domain", "language"])
    return _fill(low, ("domain", "language"), "leaf", sources).drop("cap")


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source", share: float = SHARE,
          max_epochs: int = MAX_EPOCHS, seed: int = SEED, domains: dict[str, int] | None = None, languages: dict[str, int] | None = None,
          sources: dict[str, int] | None = None) -> DataFrame:
    """`docs` with a struct column ``_mix``: domain, language, leaf, n_tokens, epochs
    (times the document is read whole) and tokens_taken (in all)."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    name = F.coalesce(F.col(id).cast("string"), F.lit(""))
    place = lambda epoch: F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.col("name")))
    levels = [domain_of(F.col(source).cast("string")).alias("domain"), none(language).alias("language"), none(source).alias("leaf")]
    n_tokens = F.size(word_list(F.col(text))).cast("long")
    light = written(docs.select(*levels, name.alias("name"), n_tokens.alias("n_tokens")), "tokens")
    leaves = light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = allot(leaves, share, max_epochs, DOMAIN_WEIGHTS if domains is None else domains, LANGUAGE_WEIGHTS if languages is None else languages, sources or {})
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    leaves = written(leaves.withColumn("epochs", whole).withColumn("part", F.col("budget") - F.col("epochs") * F.col("tokens")), "leaves")

    placed = light.join(leaves.filter("part > 0").select(*LEVELS, "epochs", "part"), list(LEVELS)).withColumn("place", place(F.col("epochs")))
    placed = placed.withColumn("slice", F.substring("place", 1, DIGITS))
    slices = placed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("n"), F.first("part").alias("part"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("slice"))
    ends = slices.withColumn("before", upto - F.col("n")).filter("before <= part and part < before + n").select(*LEVELS, "slice", "before")
    last = placed.join(ends, [*LEVELS, "slice"]).groupBy(*LEVELS, "slice", "before", "part", "place").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"))
    at = F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS, "slice").orderBy("place"))
    crossing = last.withColumn("upto", at).filter("upto - n <= part and part < upto and n > 0")
    crossing = crossing.groupBy(*LEVELS).agg(F.min("place").alias("cut"), F.min_by(F.when(F.col("rows") == 1, F.expr("part - upto + n")).otherwise(F.lit(0)), "place").alias("piece"))
    cuts = written(leaves.select(*LEVELS, "epochs", "part").join(crossing, list(LEVELS), "left"), "cuts")

    own = list(docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), *levels, name.alias("name"), n_tokens.alias("n_tokens")).join(cuts, list(LEVELS))
    rows = rows.withColumn("place", place(F.col("epochs")))
    piece = F.when(F.col("part") == 0, F.lit(0)).when(F.col("place") < F.col("cut"), F.col("n_tokens")).when(F.col("place") == F.col("cut"), F.col("piece")).otherwise(F.lit(0))
    taken = F.col("epochs") * F.col("n_tokens") + piece
    mix = F.struct(*LEVELS, "n_tokens", (F.col("epochs") + F.when(piece == F.col("n_tokens"), 1).otherwise(0) * F.when(piece > 0, 1).otherwise(0)).cast("long").alias("epochs"), taken.cast("long").alias("tokens_taken"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in own], mix.alias("_mix"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, domain, language, leaf, n_tokens, epochs, tokens_taken of every row."""
    return mixed(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "_mix.*")


def taken_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix reads, with n_tokens, epochs and tokens_taken besides."""
    extra = ("n_tokens", "epochs", "tokens_taken")
    kept = mixed(docs, **options).filter("_mix.tokens_taken > 0")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns if c not in extra], *[F.col(f"_mix.{c}").alias(c) for c in extra])


def _sql_fill(nodes: str, parents: str, name: str, weights: dict[str, int], out: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    weight = " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items())
    weight = f"CASE {weight} ELSE 1 END" if weights else "1"
    return f"""
{out}_w AS (SELECT *, {weight} AS w FROM {nodes}),
{out}_o AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {out}_w),
{out}_f AS (SELECT *, cap * rest <= (up - before) * w AS f FROM {out}_o),
{out} AS (SELECT * EXCLUDE (w, before, rest, f, up), CASE WHEN f THEN cap ELSE
  ((up - coalesce(sum(CASE WHEN f THEN cap END) OVER ({by}), 0)) * w) // sum(CASE WHEN NOT f THEN w END) OVER ({by}) END AS budget FROM {out}_f)"""


#: The same over whole leaves, for DuckDB.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS language, coalesce(source, 'none') AS leaf,
    coalesce('d' || (try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4), 'none') AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
l AS (SELECT domain, language, leaf, sum(n_tokens) AS tokens, sum(n_tokens) * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
b AS (SELECT least(CAST(floor(sum(tokens) * CAST({SHARE} AS DOUBLE)) AS BIGINT), sum(cap)) AS up FROM l),
n1 AS (SELECT domain, sum(cap) AS cap, any_value(up) AS up FROM l, b GROUP BY domain),{_sql_fill("n1", "", "domain", DOMAIN_WEIGHTS, "f1")},
n2 AS (SELECT domain, language, sum(l.cap) AS cap, any_value(budget) AS up FROM l JOIN f1 USING (domain) GROUP BY domain, language),{_sql_fill("n2", "domain", "language", LANGUAGE_WEIGHTS, "f2")},
n3 AS (SELECT domain, language, leaf, tokens, l.cap, budget AS up FROM l JOIN f2 USING (domain, language)),{_sql_fill("n3", "domain, language", "leaf", {}, "f3")},
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM f3),
p AS (SELECT d.*, whole, budget - whole * tokens AS part, sum(n_tokens) OVER (PARTITION BY domain, language, leaf
    ORDER BY md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS upto
  FROM d JOIN e USING (domain, language, leaf)),
t AS (SELECT *, CASE WHEN part = 0 THEN 0 WHEN upto <= part THEN n_tokens WHEN upto - n_tokens <= part THEN part - upto + n_tokens ELSE 0 END AS piece FROM p)
SELECT doc_id, domain, language, leaf, n_tokens, CAST(whole + CASE WHEN piece = n_tokens AND piece > 0 THEN 1 ELSE 0 END AS BIGINT) AS epochs,
  CAST(whole * n_tokens + piece AS BIGINT) AS tokens_taken FROM t
"""
