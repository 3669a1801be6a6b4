"""Declarative constraints: all row predicates of a table run in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    pass


@dataclass(frozen=True)
class Check:
    """A row breaks the check where ``broken`` is true; null is no breach."""

    name: str
    broken: Column


def missing(column: str) -> Check:
    return Check(f"missing_{column}", F.col(column).isNull())


def outside(column: str, names: Sequence[str]) -> Check:
    return Check(f"vocabulary_{column}", F.col(column).isNotNull() & ~F.col(column).isin(*names))


def rating(column: str, low: int = 1, high: int = 5) -> Check:
    """Null or text that is no whole number within the scale breaks it."""
    n = F.expr(f"try_cast({column} as double)")
    return Check(f"rating_{column}", F.coalesce(~((n >= low) & (n <= high) & (n == F.floor(n))), F.lit(True)))


def binary(column: str) -> Check:
    n = F.expr(f"try_cast({column} as double)")
    return Check(f"binary_{column}", F.coalesce(~n.isin(0.0, 1.0), F.lit(True)))


def differs(name: str, a: Column, b: Column) -> Check:
    return Check(name, a.isNotNull() & b.isNotNull() & (a != b))


def finite(column: str) -> Check:
    return Check(f"finite_{column}", F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))


def width(column: str, n: int) -> Check:
    return Check(f"width_{column}", F.coalesce(F.size(column) != n, F.lit(True)))


def unit_interval(column: str) -> Check:
    return Check(f"interval_{column}", F.coalesce((F.col(column) < 0) | (F.col(column) > 1) | F.isnan(column), F.lit(True)))


def sums_to_one(columns: Sequence[str], tolerance: float = 1e-6) -> Check:
    return Check("unit_sum", F.coalesce(F.abs(reduce(lambda a, b: a + b, [F.col(c) for c in columns]) - 1) > tolerance, F.lit(True)))


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise ConstraintError(f"missing columns: {lacking}")


def exact_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if tuple(df.columns) != tuple(columns):
        raise ConstraintError(f"columns {df.columns} instead of {list(columns)}")


def report(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check_name, violations, row_count), one row per check, from one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c.broken).alias(f"v{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.col(f"v{i}").cast("bigint").alias("violations"), F.col("n").cast("bigint").alias("row_count")) for i, c in enumerate(checks)])
    return counted.select(F.inline(rows))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def wrong_sizes(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    return df.groupBy(*keys).count().where(F.col("count") != size)


def orphans(df: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def crossing_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups found in more than one fold."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi")).where("lo < hi").select(group)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side alone, with the side: ``missing`` from ``b`` or ``unexpected`` in it."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, list(keys), "full_outer").where("_a is null or _b is null")
    return both.select(*keys, F.when(F.col("_b").isNull(), "missing").otherwise("unexpected").alias("side"))


def summary(parts: dict[str, DataFrame]) -> DataFrame:
    """(check_name, violations) for tables of offenders."""
    rows = [df.agg(F.count(F.lit(1)).cast("bigint").alias("violations")).select(F.lit(name).alias("check_name"), "violations") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def enforce(df: DataFrame, checks: Sequence[Check], keys: Sequence[str], sample: int = 3) -> DataFrame:
    """``df`` itself, or an error naming each broken check and up to ``sample`` keys."""
    broken = [r for r in report(df, checks).collect() if r["violations"]]
    if broken:
        by = {c.name: c for c in checks}
        said = []
        for r in broken:
            some = [tuple(x) for x in df.where(by[r["check_name"]].broken).select(*keys).limit(sample).collect()]
            said.append(f"{r['check_name']}: {r['violations']} rows, such as {some}")
        raise ConstraintError("; ".join(said))
    return df


def label_structure(df: DataFrame, labels: str, clusters: str, names: Sequence[str]) -> DataFrame:
    """One row of counters over arrays of labels and of their clusters, from one pass over the rows and one over the labels."""
    repeated = lambda c: F.count_if(F.size(c) != F.size(F.array_distinct(c)))
    rows = df.agg(
        F.count_if(F.col(labels).isNull()).alias("missing_labels"),
        F.count_if(F.col(clusters).isNull()).alias("missing_clusters"),
        repeated(labels).alias("repeated_labels"),
        repeated(clusters).alias("repeated_clusters"),
        F.count_if((F.size(labels) > 0) & (F.size(clusters) == 0)).alias("labels_without_cluster"),
    )
    each = df.select(F.explode(labels).alias("l"))
    known = F.col("l").isin(*names)
    seen = each.agg(F.count_if(~known).alias("unknown_labels"), (F.lit(len(names)) - F.countDistinct(F.when(known, F.col("l")))).cast("bigint").alias("unobserved_labels"))
    return rows.crossJoin(F.broadcast(seen))  # one row each
