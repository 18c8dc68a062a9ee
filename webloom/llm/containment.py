"""Benchmark decontamination: MinHash containment search.

DataFrame operations only. A text's set is its distinct 5-word shingles
(lower-cased A-Z; a shorter text is one shingle, which only an equally short
text can contain). An item's sketch is the least hashes of its set: one more than it may
lack, so that a document which contains the item holds one of them, and `SKETCH` at
most; from 40 shingles on an item escapes with probability 0.2**SKETCH = 3e-6.

Items are partitioned by size (powers of two), and each class has a threshold under
which the sketches of its items lie. A document searches the classes whose least item
it is long enough to contain: with its hashes under the greatest of their thresholds,
each emitted once, and against the sketches that its length admits. Each candidate is
verified by exact shingle containment.

Sketches reach the documents through a bitmap of fixed size (``holding``); what
passes it is joined by shuffle, so neither the items nor a common passage need
fit a task.

Defined cases: null or wordless texts have an empty set, contain nothing and
are contained in nothing. Repeated item rows, or repeated document rows, are
reported once. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import holding, keyed, row_key, unkeyed, written

WIDTH = 5
SKETCH = 8
CONTAINED = 80  # per cent

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+, lower-cased A-Z; empty for null."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.array_remove(words, "")


def with_shingles(rows: DataFrame, text: str, out: str) -> DataFrame:
    """`rows` with the distinct shingle hashes of `text` as `out`, instead of the text."""
    named = rows.withColumn("_h", F.transform(word_list(F.col(text)), lambda w: F.xxhash64(w))).drop(text)
    at = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WIDTH)])
    n = F.size("_h")
    grams = F.when(n >= WIDTH, F.transform(F.sequence(F.lit(0), n - WIDTH), at)).when(n > 0, F.array(F.xxhash64("_h"))).otherwise(F.array().cast("array<bigint>"))
    return named.withColumn(out, F.array_distinct(grams)).drop("_h")


def contained_items(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, doc_id, item_id, n_shingles (the item's), n_common: one row for each item
    of which a document holds at least 80 per cent of the shingles."""
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_t")).distinct()
    wanted = with_shingles(wanted, "_t", "item").filter("size(item) > 0")
    lacking = F.floor(F.size("item") * (100 - CONTAINED) / 100).cast("int")
    wanted = wanted.withColumn("size_class", F.floor(F.log2(F.size("item"))).cast("int")).withColumn("sketch", F.slice(F.sort_array("item"), 1, F.least(lacking + 1, F.lit(SKETCH))))
    wanted = written(wanted.withColumn("item_key", F.xxhash64("item_id", "item")), "items")
    # One row for each size class (at most 32), so this stays on the driver.
    classes = wanted.groupBy("size_class").agg(F.min(F.size("item")).alias("least"), F.max(F.element_at("sketch", -1)).alias("threshold")).collect()

    rows = docs.select(row_key(id, text).alias("key"), F.col(id).alias("doc_id"), F.col(text).alias("_t"))
    held = F.size("grams")
    long_enough = lambda item_size: held * 100 >= item_size * CONTAINED
    limit = F.greatest(F.lit(-(2**63)), F.lit(None).cast("long"), *[F.when(long_enough(F.lit(c["least"])), F.lit(c["threshold"])) for c in classes])
    sized = with_shingles(rows.drop("doc_id"), "_t", "grams").withColumn("limit", limit)
    probes = sized.select("key", held.alias("held"), F.explode(F.filter("grams", lambda g: g <= F.col("limit"))).alias("gram"))
    sketches = wanted.select("item_key", F.size("item").alias("item_size"), F.explode("sketch").alias("gram"))
    met = holding(probes, sketches, "gram").join(sketches, "gram").filter(F.col("held") * 100 >= F.col("item_size") * CONTAINED)
    pairs = written(met.select("key", "item_key").distinct(), "candidates")
    texts = with_shingles(holding(rows, pairs, "key").join(pairs.select("key").distinct(), "key").dropDuplicates(["key"]), "_t", "grams")
    common = F.size(F.array_intersect("item", "grams"))
    tested = pairs.join(wanted, "item_key").join(texts, "key").select("key", "doc_id", "item_id", F.size("item").cast("long").alias("n_shingles"), common.cast("long").alias("n_common"))
    return tested.filter(F.col("n_common") * 100 >= F.col("n_shingles") * CONTAINED)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_common of every contained item, once each."""
    return contained_items(docs, items).drop("key").distinct()


def remove_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that contain no test item, unchanged."""
    found = contained_items(docs, items, id, text).select("key").distinct()
    return unkeyed(keyed(docs, id, text).join(found, "key", "left_anti"), docs.columns)


#: The same by brute force over all shingles, for DuckDB.
SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') FROM benchmark),
f AS (SELECT kind, id, list_filter(ws, lambda x: x <> '') AS ws FROM w),
s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                       WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM f),
n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n_shingles) AS n_shingles, count(*) AS n_common
FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.g = i.g JOIN n ON n.item_id = i.id
GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(n_shingles) * 80
"""
