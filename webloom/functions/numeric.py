"""Numeric reporting helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def report_round(x: str | Column, places: int = 6) -> Column:
    """Round to ``places`` with the same IEEE result on any engine.

    Last-bit noise from summation order is snapped first (``places + 3``), then
    ``floor(v * 10^p + 0.5) / 10^p`` is used instead of ``round``: engines
    disagree on how ``round`` treats a double sitting on a tie, but they all
    agree on this arithmetic.
    """
    scale = float(10 ** places)
    v = F.round(x if isinstance(x, Column) else F.col(x), places + 3)
    return F.floor(v * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
