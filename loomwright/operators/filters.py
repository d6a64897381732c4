"""Filters and tags by literal or regular expression, and personal-data flags.

Null never matches; other types match on their Spark string form.  Fields that
the table lacks are skipped.  Regular expressions are Java's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def _fields(df: DataFrame, fields: Sequence[str]) -> list[Column]:
    return [F.col(f"`{f}`").cast("string") for f in fields if f in df.columns]


def contains_any(df: DataFrame, fields: Sequence[str], values: Sequence[str]) -> Column:
    if not values:
        raise ValueError("values is empty")
    return _any([F.contains(c, F.lit(v)) for c in _fields(df, fields) for v in values])


def matches(df: DataFrame, fields: Sequence[str], regex: str) -> Column:
    if not regex:
        raise ValueError("regex is empty")
    return _any([c.rlike(regex.replace("(?P<", "(?<")) for c in _fields(df, fields)])


def filter_string(df: DataFrame, fields: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Without the rows in which any field contains any value."""
    return df.where(~contains_any(df, fields, values))


def filter_regex(df: DataFrame, fields: Sequence[str], regex: str) -> DataFrame:
    return df.where(~matches(df, fields, regex))


def tag_string(df: DataFrame, fields: Sequence[str], values: Sequence[str], tag: str) -> DataFrame:
    return df.withColumn(f"__tag__{tag}", contains_any(df, fields, values))


def tag_regex(df: DataFrame, fields: Sequence[str], regex: str, tag: str) -> DataFrame:
    return df.withColumn(f"__tag__{tag}", matches(df, fields, regex))


# Patterns in the common subset of Java's and RE2's syntax.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "credential": r"(?i)(password|passwd|pwd|api[_-]?key|secret)[ ]*[:=][ ]*[^ \n]+",
    "url": r"https?://[^ \n]+",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}


def detect_pii(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``__pii__email``, ``__pii__phone``, ``__pii__credential``; ``__pii__any`` counts every pattern, also those without a column."""
    flags = {name: matches(df, fields, p) for name, p in PII_PATTERNS.items()}
    out = {f"__pii__{name}": flags[name] for name in ("email", "phone", "credential")}
    return df.withColumns({**out, "__pii__any": reduce(lambda a, b: a | b, flags.values())})
