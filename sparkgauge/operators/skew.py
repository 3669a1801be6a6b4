"""Joins and groupings that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of all rows ...
HOT_SHARE = 1 / 500
#: ... or above this many rows, though not below the share of an average partition of a large table, so there are at most 1 / LEAST_SHARE hot keys.
HOT_CEILING, LEAST_SHARE = 50_000_000, 1 / 20_000
#: Below this many rows for one key a shuffle join copes by itself.
HOT_ROWS = 200_000


def hot_bound(total: int, share: float = HOT_SHARE, least: int = HOT_ROWS) -> float:
    """Rows above which a key of a table of ``total`` rows is hot."""
    return max(least, min(total * share, max(HOT_CEILING, total * LEAST_SHARE)))


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS, rows: int | None = None) -> list:
    """Values of ``key`` that hold more rows than ``hot_bound``.

    Counts are exact and combined map-side. At most ``1 / LEAST_SHARE`` values reach the driver.
    ``rows``, if known, is the number of rows or a bound on it and saves counting them.
    """
    total = df.count() if rows is None else rows
    if total <= least:
        return []
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where(F.col("n") > hot_bound(total, share, least)).select(key).collect() if r[0] is not None]


def hot_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", hot: list | None = None, rows: int | None = None) -> DataFrame:
    """Join ``big`` to ``small``, which has at most one row for each key, with ``how`` inner or left.

    Rows of hot keys (``hot``, else counted here) meet a broadcast of at most
    ``1 / LEAST_SHARE`` rows of ``small``; the rest take one shuffle join. Rows with a
    null key match nothing.
    """
    hot = hot_keys(big, key, rows=rows) if hot is None else hot
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = big.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how)
    return near.unionByName(big.where(~is_hot).join(small.where(~is_hot), key, how))
