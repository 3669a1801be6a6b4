"""Many small model fits as one job: a table of tasks over a broadcast matrix of checked size."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A matrix beyond this many bytes is not sent to the tasks: probes then go through ``big_probes``, which sum gradients over the partitions.
MOST_BYTES = 1 << 30


@dataclass(frozen=True)
class Matrix:
    """Rows in the order of their id."""

    item: np.ndarray
    x: np.ndarray
    y: np.ndarray
    outer: np.ndarray
    inner: np.ndarray  # (n, outer folds): validation fold within each outer training part
    group: np.ndarray
    blocks: tuple[int, ...]

    @property
    def folds(self) -> list[int]:
        return sorted(set(self.outer.tolist()))


def fold_of(values: Iterable, salt: str, k: int) -> np.ndarray:
    """Group-disjoint folds by hash."""
    seen: dict = {}
    for v in values:
        if v not in seen:
            seen[v] = int(hashlib.sha256(f"{salt}|{v}".encode()).hexdigest()[:8], 16) % k
    return np.array([seen[v] for v in values], dtype=np.int64)


def dense(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of one length as a matrix, without Python objects."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


class TooLarge(ValueError):
    pass


def fits_driver(df: DataFrame, features: str, most: int = MOST_BYTES) -> bool:
    """Whether the feature table may be sent to every task."""
    head = df.select(F.size(features)).first()
    return df.count() * ((head[0] if head else 0) + 8) * 8 <= most


def collect_matrix(df: DataFrame, item: str, features: str, target: str, group: str, outer: str, outer_folds: int, inner_folds: int = 3, blocks: Sequence[int] | None = None, most: int = MOST_BYTES) -> Matrix:
    """The feature table on the driver, after its size was checked; a larger one goes through ``big_probes``."""
    if not fits_driver(df, features, most):
        raise TooLarge(f"the features are more than {most} bytes; use big_probes")
    got = df.select(item, features, target, group, outer).toArrow()
    ids = got.column(0).to_pandas()
    order = ids.argsort(kind="stable").to_numpy()
    width = len(got.column(1)[0]) if got.num_rows else 0
    sizes = got.column(1).combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    if got.column(1).null_count or (sizes != width).any():
        raise ValueError("a row has no features, or another number of them")
    x = dense(got.column(1), width)[order] if got.num_rows else np.zeros((0, width))
    if not np.isfinite(x).all():
        raise ValueError("a feature is missing or not finite")
    labels = got.column(2)
    y = np.array(labels.to_pylist(), dtype=np.int64)[order] if pa.types.is_list(labels.type) else labels.to_numpy().astype(np.int64)[order]
    groups = got.column(3).to_pandas().to_numpy()[order]
    inner = np.column_stack([fold_of(groups, f"inner-{f}", inner_folds) for f in range(outer_folds)])
    return Matrix(ids.to_numpy()[order], x, y, got.column(4).to_numpy().astype(np.int64)[order], inner, groups, tuple(blocks or (width,)))


def run(spark: SparkSession, tasks: Sequence[dict], data: object, work: Callable[[dict, object], pd.DataFrame], schema: str, slots: int | None = None) -> DataFrame:
    """The rows of ``work(task, data)`` for every task. Tasks are spread evenly; a lost one is done again."""
    shared = spark.sparkContext.broadcast(data)
    rows = [(i, json.dumps(t)) for i, t in enumerate(tasks)]
    n = max(1, min(len(rows), slots or 4 * spark.sparkContext.defaultParallelism))

    def each(batches):
        for b in batches:
            for t in b["task"]:
                got = work(json.loads(t), shared.value)
                if len(got):
                    yield got

    return spark.createDataFrame(rows, "n int, task string").repartition(n, "n").mapInPandas(each, schema)


def fit_distributed(df: DataFrame, features: str, target: str, classes: int, c: float, rounds: int = 200, scale: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial probe over a table of any size: each step sums loss and gradient over the partitions.

    Partitions' vectors of (features + 1) times classes are added up by Spark; one comes back. The
    rows are read anew each step, so write ``df`` first if it is costly. ``scale`` (mean, deviation) is applied on the way.
    """
    from sparkgauge.functions.numeric import NotConverged, log_softmax, minimise

    n = df.count()
    d = len(df.select(features).first()[0])
    size = classes * (d + 1)
    sc = df.sparkSession.sparkContext
    rows = df.select(features, F.col(target).cast("bigint").alias("_y"))
    mean, sd = scale if scale is not None else (np.zeros(d), np.ones(d))
    there = {r[0] for r in rows.select("_y").distinct().collect()}  # at most the classes
    if there != set(range(classes)):
        raise ValueError(f"classes without a row: {sorted(set(range(classes)) - there)}")

    def f(v: np.ndarray) -> tuple[float, np.ndarray]:
        at = sc.broadcast(v)

        def part(batches):
            w, b = at.value[: classes * d].reshape(classes, d), at.value[classes * d :]
            out = np.zeros(size + 1)
            for t in batches:
                if not t.num_rows:
                    continue
                x, y = (dense(t.column(0), d) - mean) / sd, t.column(1).to_numpy()
                lp = log_softmax(x @ w.T + b)
                out[0] -= lp[np.arange(len(y)), y].sum()
                r = np.exp(lp)
                r[np.arange(len(y)), y] -= 1
                out[1:] += np.concatenate([(r.T @ x).ravel(), r.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(out)], names=["pos", "v"])

        summed = rows.mapInArrow(part, "pos bigint, v double").groupBy("pos").sum("v").collect()  # size + 1 rows
        got = np.zeros(size + 1)
        for r in summed:
            got[r[0]] = r[1]
        at.unpersist()
        w = v[: classes * d]
        g = got[1:] / n
        g[: classes * d] += w / (c * n)
        return got[0] / n + (w @ w) / (2 * c * n), g

    v, _, ok = minimise(f, np.zeros(size), rounds)
    if not ok:
        raise NotConverged("distributed multinomial fit")
    w, b = v[: classes * d].reshape(classes, d), v[classes * d :]
    return w - w.mean(axis=0), b - b.mean()
