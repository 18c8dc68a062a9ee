"""Column functions for cleaning page text. All JVM-side except ``unescape``.

Regex dialect note: Java's ``.`` also stops at ``\\r``, so "not across a line
break" is written ``[^\\n]`` to mean exactly one newline character.
"""

from __future__ import annotations

import codecs
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Python function below travels by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: cleaning patterns
TAG = r"<[^\n]*?>"            # shortest tag, never across a newline
NON_ASCII = r"[^\x00-\x7F]"


def strip_tags(text: Column) -> Column:
    """Remove ``<...>`` spans (shortest match, not across a newline)."""
    return F.regexp_replace(text, TAG, "")


def ascii_only(text: Column) -> Column:
    """Drop every character outside 7-bit ASCII."""
    return F.regexp_replace(text, NON_ASCII, "")


def _decode_escapes(s: str | None) -> str | None:
    if s is None:
        return None
    try:
        decoded = codecs.decode(s.encode("latin-1", "backslashreplace"), "unicode_escape")
    except (UnicodeDecodeError, ValueError):
        return s
    return decoded.encode("ascii", "ignore").decode("ascii")


@F.pandas_udf(T.StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(_decode_escapes)


def _escaped_only(text: Column) -> Column:
    """The text where it holds a backslash, NULL elsewhere.

    Spark evaluates a Python UDF for every row even inside CASE WHEN, so the
    UDF is given NULL for rows without a backslash: only escaped rows' text
    crosses to Python, the rest costs a validity bit in the Arrow batch.
    """
    return F.when(F.instr(text, "\\") > 0, text)


def unescape(text: Column) -> Column:
    """Decode backslash escapes; on failure the input is kept unchanged."""
    decoded = _unescape_udf(_escaped_only(text))
    return F.when(F.instr(text, "\\") > 0, decoded).otherwise(text)


def clean_text(text: Column, decode_escapes: bool = True) -> Column:
    """Tag-stripped, escape-decoded, ASCII-only text."""
    stripped = strip_tags(text)
    if decode_escapes:
        decoded = _unescape_udf(_escaped_only(stripped))
        return F.when(F.instr(stripped, "\\") > 0, decoded).otherwise(ascii_only(stripped))
    return ascii_only(stripped)


def with_clean_text(df: DataFrame, src: str, out: str, decode_escapes: bool = True) -> DataFrame:
    """``df`` plus ``out``: ``clean_text`` of column ``src``, with the tag-stripped
    text computed once as its own column (the optimizer keeps that projection,
    as inlining would repeat a regex over the whole text) before the optional
    escape-decoding UDF and the ASCII filter read it."""
    stripped = "_stripped"
    staged = df.withColumn(stripped, strip_tags(F.col(src)))
    col = F.col(stripped)
    if decode_escapes:
        decoded = _unescape_udf(_escaped_only(col))
        cleaned = F.when(F.instr(col, "\\") > 0, decoded).otherwise(ascii_only(col))
    else:
        cleaned = ascii_only(col)
    return staged.withColumn(out, cleaned).drop(stripped)
