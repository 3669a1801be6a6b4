"""Duplicates hidden by formatting differences.

The canonical form of a record drops white space and punctuation, folds letter case
and ignores the order of its fields; its key is the SHA-256 of that form. Counts of
each key are combined map-side first. A key above a share of all rows is hot; there
are at most ``1 / share`` of them, their summaries are combined in two levels over a
salt and meet their rows by broadcast. All other keys take one shuffle.

A row with a null field, or without an id, has no key and is left out. Rows of one id
count as one record for the number of copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.operators.skew import HOT_ROWS, HOT_SHARE, hot_keys
from sparkgauge.session import Scratch

SALTS = 32


def _bare(column: str) -> Column:
    return F.lower(F.regexp_replace(F.col(column), r"[\p{IsWhite_Space}\p{P}]+", ""))


def canonical_key(fields: Sequence[str]) -> Column:
    """Null where a field is null. Each field's length goes before it, so fields can't run into each other."""
    parts = F.array_sort(F.array(*[_bare(f) for f in fields]))
    whole = F.concat_ws("\u0000", F.transform(parts, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)))
    none = F.lit(False)
    for f in fields:
        none = none | F.col(f).isNull()
    return F.when(~none, F.unhex(F.sha2(whole, 256)))


def keyed(df: DataFrame, fields: Sequence[str], record: str, s: Scratch) -> DataFrame:
    """Distinct (key, id)."""
    rows = df.where(F.col(record).isNotNull()).select(canonical_key(fields).alias("key"), F.col(record).alias("id")).where("key is not null")
    return s.keep(rows)


def _cold(rows: DataFrame, hot: list) -> DataFrame:
    """Distinct rows of the other keys, laid out by key: what follows by key needs no further shuffle."""
    some = rows.where(~F.col("key").isin(hot)) if hot else rows
    return some.repartition("key").dropDuplicates(["key", "id"])


def _hot_sets(rows: DataFrame, hot: list) -> DataFrame:
    """(key, kept, copies) of the hot keys: by key and salt first, then by key."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    first = rows.where(F.col("key").isin(hot)).distinct().groupBy("key", salt).agg(F.min("id").alias("kept"), F.count(F.lit(1)).alias("copies"))
    return first.groupBy("key").agg(F.min("kept").alias("kept"), F.sum("copies").alias("copies"))


def distinct_records(df: DataFrame, fields: Sequence[str], record: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """(kept, copies): one row per distinct record, its least id and how many ids hold it."""
    s = Scratch(df.sparkSession, "copies")
    rows = keyed(df, fields, record, s)
    hot = hot_keys(rows, "key", share, least, s.rows(rows))
    out = _cold(rows, hot).groupBy("key").agg(F.min("id").alias("kept"), F.count(F.lit(1)).alias("copies"))
    if hot:
        out = out.unionByName(_hot_sets(rows, hot))
    return out.select("kept", "copies")


def copy_members(df: DataFrame, fields: Sequence[str], record: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """(kept, id): every copy but the kept one, with the least id of its set."""
    s = Scratch(df.sparkSession, "copies")
    rows = keyed(df, fields, record, s)
    hot = hot_keys(rows, "key", share, least, s.rows(rows))
    out = _cold(rows, hot).withColumn("kept", F.min("id").over(Window.partitionBy("key"))).select("kept", "id")
    if hot:
        near = rows.where(F.col("key").isin(hot)).join(F.broadcast(_hot_sets(rows, hot)), "key").select("kept", "id")
        out = out.unionByName(near.distinct())
    return out.where("id <> kept")
