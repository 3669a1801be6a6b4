"""Nested probes over feature tables of any size: the rows stay where they are, every fit sums gradients over them.

Same folds, scaling, grid and choice as ``probes``; candidates are fitted one after the other, each over all executors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.functions import numeric as N
from sparkgauge.functions.vocab import C_GRID
from sparkgauge.operators.tasks import dense, fit_distributed
from sparkgauge.session import Scratch


def fold_column(salt: str, group: str, k: int) -> Column:
    """The fold that ``tasks.fold_of`` gives."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("bigint") % k).cast("int")


def moments(df: DataFrame, features: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each feature, constant ones at deviation 1: sums per partition, in two passes."""

    def summed(shift: np.ndarray, power: int) -> np.ndarray:
        def part(batches):
            out = np.zeros(width)
            for b in batches:
                if b.num_rows:
                    out += ((dense(b.column(0), width) - shift) ** power).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(out)], names=["pos", "v"])

        got = np.zeros(width)
        for r in df.select(features).mapInArrow(part, "pos bigint, v double").groupBy("pos").sum("v").collect():  # a row per feature
            got[r[0]] = r[1]
        return got

    n = df.count()
    mean = summed(np.zeros(width), 1) / n
    sd = np.sqrt(summed(mean, 2) / n)
    return mean, np.where(sd > 0, sd, 1.0)


def predict(df: DataFrame, keep: Sequence[str], features: str, target: str, width: int, scale: tuple[np.ndarray, np.ndarray], model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``keep`` columns with truth and p."""
    shared = df.sparkSession.sparkContext.broadcast((scale, model))

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        (mean, sd), (w, b) = shared.value
        p = N.softmax((dense(x, width) - mean) / sd @ w.T + b)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))

    return df.select(*keep, F.col(target).cast("int").alias("truth"), score(F.col(features)).alias("p"))


def nested_multiclass(df: DataFrame, item: str, features: str, target: str, group: str, outer: str, outer_folds: Sequence[int], classes: int, grid: Sequence[float] = C_GRID, inner_folds: int = 3, rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold table, selections): the smallest pooled inner loss, then the smaller C."""
    spark = df.sparkSession
    s = Scratch(spark, "bigprobe")
    rows = s.keep(df.select(item, features, target, group, outer))
    width = len(rows.select(features).first()[0])
    crossing = rows.groupBy(group).agg(F.countDistinct(outer).alias("n")).where("n > 1").limit(1).count()
    if crossing:
        raise ValueError("a group is on both sides of an outer fold")
    out, picks = None, []
    for f in outer_folds:
        train = rows.where(F.col(outer) != f).withColumn("_v", fold_column(f"inner-{f}", group, inner_folds))
        scored = {}
        for v in range(inner_folds):
            fit, val = train.where(F.col("_v") != v), train.where(F.col("_v") == v)
            if val.isEmpty():
                continue
            scale = moments(fit, features, width)
            for c in sorted(set(grid)):
                p = predict(val, [item], features, target, width, scale, fit_distributed(fit, features, target, classes, c, rounds, scale))
                loss = F.sum(-F.log2(F.least(F.greatest(F.element_at("p", F.col("truth") + 1), F.lit(1e-12)), F.lit(1.0))))
                bits, n = p.agg(loss, F.count(F.lit(1))).first()
                a, b = scored.get(c, (0.0, 0))
                scored[c] = (a + bits, b + n)
        best = min(scored, key=lambda c: (round(scored[c][0] / scored[c][1], 12), c))
        picks.append((int(f), float(best), 1.0, scored[best][0] / scored[best][1]))
        scale = moments(train, features, width)
        p = predict(rows.where(F.col(outer) == f), [item, outer, group], features, target, width, scale, fit_distributed(train, features, target, classes, best, rounds, scale))
        p = p.select(F.col(item).cast("string").alias("item_id"), F.col(outer).cast("int").alias("outer_fold"), F.col(group).cast("string").alias("group_id"), "truth", "p")
        out = p if out is None else out.unionByName(p)
    return out, spark.createDataFrame(picks, "outer_fold int, c double, multiplier double, loss double")
