"""Paging and recency top-k (K6, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.functions.exprs import as_ntz


def keyset_page(df: DataFrame, ts: str, key: str, cursor_ts, cursor_key=None, size: int = 100) -> DataFrame:
    """K7: the ``size`` rows after the cursor in (ts, key) order; returns the page, whose last (ts, key) is the
    next cursor. The composite cursor never skips rows that share the cursor's timestamp (a date-only cursor
    would). ``ts >= cursor`` is a plain predicate, so it reaches the Parquet scan; the limit is the feature
    (TakeOrderedAndProject keeps ``size`` rows per task)."""
    c = as_ntz(cursor_ts)
    after = F.col(ts) > c
    if cursor_key is not None:
        after = after | ((F.col(ts) == c) & (F.col(key) > F.lit(cursor_key)))
    return df.where(F.col(ts) >= c).where(after).orderBy(ts, key).limit(size)


def newest(df: DataFrame, ts: str, key: str, n: int = 10) -> DataFrame:
    """K6 / K2: newest n rows, ties broken by key (a top-k report)."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)
