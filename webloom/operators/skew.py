"""Skew handling shared by the graph and result operators.

A "hot" key is one that holds more rows than ``max(min_rows, total/max_keys)``.
Because every hot key holds more than ``total/max_keys`` rows, fewer than
``max_keys`` keys can be hot: that is the proven size bound that lets us
broadcast the per-key side of a join restricted to hot keys, while the cold
keys (each holding at most the threshold) go through an ordinary shuffle join
whose partitions therefore stay bounded.

Everything here is lazy: the threshold is a scalar subquery, not a driver
round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.constants import HOT_MAX_KEYS, HOT_MIN_ROWS


def hot_keys(counts: DataFrame, key: str, weight: str,
             max_keys: int = HOT_MAX_KEYS, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Keys of ``counts`` (one row per key) whose ``weight`` is above the threshold.

    Returns a single-column DataFrame ``(key)`` with fewer than ``max_keys`` rows.
    """
    total = counts.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total"))
    threshold = F.greatest(F.lit(min_rows), F.ceil(total.scalar() / F.lit(max_keys)))
    return counts.filter(F.col(weight) > threshold).select(key)


def split_by_keys(df: DataFrame, key: str, hot: DataFrame, hot_key: str
                  ) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is hot, the others). ``hot`` is bounded, so it is broadcast."""
    hk = F.broadcast(hot.select(F.col(hot_key).alias("_hot_key")))
    cond = F.col(key) == F.col("_hot_key")
    return df.join(hk, cond, "left_semi"), df.join(hk, cond, "left_anti")

