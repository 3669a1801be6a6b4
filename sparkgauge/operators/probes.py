"""Nested cross-validated probes: every inner fit is a task, selection is a query, every outer fit a task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgauge.functions import numeric as N
from sparkgauge.functions.vocab import C_GRID, MULTIPLIERS, THRESHOLDS
from sparkgauge.operators import big_probes
from sparkgauge.operators.tasks import MOST_BYTES, Matrix, collect_matrix, fits_driver, run
from sparkgauge.session import Scratch


#: (C, multiplier) -> fit; fit(x, y, classes) -> predict; predict(new) -> probabilities. Sent to the tasks as it is.
Predict = Callable[[np.ndarray], np.ndarray]
Fit = Callable[[np.ndarray, np.ndarray, int], Predict]
Factory = Callable[[float, float], Fit]


def dense_multiclass(c: float, multiplier: float = 1.0) -> Fit:
    """The default estimator: a multinomial probe with strength 1 / C. The multiplier has gone into the features already."""

    def fit(x: np.ndarray, y: np.ndarray, classes: int) -> Predict:
        w, b = N.fit_multinomial(x, y, classes, c)
        return lambda new: N.softmax(new @ w.T + b)

    return fit


def dense_multilabel(c: float, multiplier: float = 1.0) -> Fit:
    """One binary probe for each label; a constant label predicts its share."""
    return lambda x, y, labels: lambda new: N.predict_labels(x, y, new, c)


def of_c(factory: Callable[[float], Fit]) -> Factory:
    """A factory of C alone as one of C and multiplier."""
    return lambda c, multiplier: factory(c)


def require_targets(m: Matrix, classes: int | None = None, labels: int | None = None) -> None:
    """Errors for a feature matrix or target that no probe can take: no rows or columns, values that aren't finite, classes out of range, labels that aren't 0 or 1, rows of different number."""
    n = len(m.item)
    if m.x.ndim != 2 or not m.x.shape[1] or n < 2 or len(m.x) != n:
        raise ValueError("features need at least two rows and one column, one row an item")
    if not np.isfinite(m.x).all():
        raise ValueError("a feature is missing or not finite")
    if len(m.y) != n or len(m.outer) != n or len(m.group) != n or len(m.inner) != n:
        raise ValueError("targets, folds or groups have another number of rows")
    if len(set(m.item.tolist())) != n:
        raise ValueError("an item is there twice")
    if classes is not None and (m.y.ndim != 1 or m.y.min() < 0 or m.y.max() >= classes):
        raise ValueError("a class is out of range")
    if labels is not None and (m.y.ndim != 2 or m.y.shape[1] != labels or not np.isin(m.y, (0, 1)).all()):
        raise ValueError("labels have to be 0 or 1, one column each")


def prepare(train: np.ndarray, blocks: Sequence[int], multiplier: float, pca: dict[int, int] | None = None):
    """A training-only transform: chosen blocks to principal axes, then block-wise standardisation, the last block times ``multiplier``."""
    parts, widths, at = [], [], 0
    for i, w in enumerate(blocks):
        own = slice(at, at + w)
        if pca and i in pca:
            t, _ = N.principal(train[:, own], pca[i], standardize=False)
            parts.append((own, t))
            widths.append(pca[i])
        else:
            parts.append((own, None))
            widths.append(w)
        at += w

    def first(x: np.ndarray) -> np.ndarray:
        return np.hstack([x[:, s] if t is None else t(x[:, s]) for s, t in parts])

    scale = N.scaler(first(train), widths, [1.0] * (len(widths) - 1) + [multiplier])
    return lambda x: scale(first(x))


def _selected(scores: DataFrame, order: Sequence) -> DataFrame:
    """The first candidate of each outer fold under the given order."""
    n = F.row_number().over(Window.partitionBy("outer_fold").orderBy(*order))
    return scores.withColumn("_n", n).where("_n = 1").drop("_n")


def select_multiclass(spark: SparkSession, m: Matrix, classes: int, grid: Sequence[float] = C_GRID, multipliers: Sequence[float] = MULTIPLIERS, metric: str = "log_loss", pca: dict[int, int] | None = None, folds: Sequence[int] | None = None, factory: Factory = dense_multiclass) -> DataFrame:
    """(outer_fold, c, multiplier, loss, macro_f1): the best candidate of each outer fold by its pooled inner predictions.

    By loss, then the smaller C, then the multiplier nearest 1, then the smaller; or by
    macro F1 first. With one block the multiplier is 1.
    """
    mult = sorted(set(multipliers)) if len(m.blocks) > 1 else [1.0]
    inner = sorted(set(m.inner.ravel().tolist()))
    tasks = [{"f": f, "v": v, "c": c, "m": w} for f in (m.folds if folds is None else folds) for c in sorted(set(grid)) for w in mult for v in inner]

    def work(t: dict, m: Matrix) -> pd.DataFrame:
        out = m.outer != t["f"]
        fit, val = out & (m.inner[:, t["f"]] != t["v"]), out & (m.inner[:, t["f"]] == t["v"])
        if not val.any():
            return pd.DataFrame()
        z = prepare(m.x[fit], m.blocks, t["m"], pca)
        p = factory(t["c"], t["m"])(z(m.x[fit]), m.y[fit], classes)(z(m.x[val]))
        hat, y = p.argmax(axis=1), m.y[val]
        tp = [int(((hat == k) & (y == k)).sum()) for k in range(classes)]
        return pd.DataFrame([{"outer_fold": t["f"], "c": t["c"], "multiplier": t["m"], "bits": float(N.bits(p, y).sum()), "n": int(val.sum()), "tp": tp, "said": np.bincount(hat, minlength=classes).tolist(), "true": np.bincount(y, minlength=classes).tolist()}])

    got = run(spark, tasks, m, work, "outer_fold int, c double, multiplier double, bits double, n bigint, tp array<bigint>, said array<bigint>, true array<bigint>")
    pooled = got.groupBy("outer_fold", "c", "multiplier").agg((F.sum("bits") / F.sum("n")).alias("loss"), *[F.sum(F.col(x)[k]).alias(f"{x}{k}") for x in ("tp", "said", "true") for k in range(classes)])
    f1 = sum((F.when(F.col(f"said{k}") + F.col(f"true{k}") > 0, 2 * F.col(f"tp{k}") / (F.col(f"said{k}") + F.col(f"true{k}"))).otherwise(0.0) for k in range(classes)), F.lit(0.0)) / classes
    pooled = pooled.select("outer_fold", "c", "multiplier", "loss", f1.alias("macro_f1"))
    loss, away = F.round("loss", 12), F.round(F.abs(F.log("multiplier")), 12)
    order = [loss, "c", away, "multiplier"] if metric == "log_loss" else [F.round(-F.col("macro_f1"), 12), loss, "c", away, "multiplier"]
    return _selected(pooled, order)


def _chosen(selected: DataFrame) -> list[dict]:
    return [r.asDict() for r in selected.orderBy("outer_fold").collect()]  # a row per outer fold


def nested_multiclass(spark: SparkSession, m: Matrix, classes: int, grid: Sequence[float] = C_GRID, multipliers: Sequence[float] = MULTIPLIERS, metric: str = "log_loss", pca: dict[int, int] | None = None, factory: Factory = dense_multiclass) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold table, selections): each item predicted once, by a fit that saw none of its group."""
    require_targets(m, classes)
    selected = Scratch(spark, "selected").keep(select_multiclass(spark, m, classes, grid, multipliers, metric, pca, factory=factory))
    tasks = [{"f": r["outer_fold"], "c": r["c"], "m": r["multiplier"]} for r in _chosen(selected)]

    def work(t: dict, m: Matrix) -> pd.DataFrame:
        test = m.outer == t["f"]
        if set(m.group[test]) & set(m.group[~test]):
            raise ValueError("a group is on both sides of an outer fold")
        z = prepare(m.x[~test], m.blocks, t["m"], pca)
        p = factory(t["c"], t["m"])(z(m.x[~test]), m.y[~test], classes)(z(m.x[test]))
        return pd.DataFrame({"item_id": m.item[test].astype(str), "outer_fold": t["f"], "group_id": m.group[test].astype(str), "truth": m.y[test], "p": list(p)})

    return run(spark, tasks, m, work, "item_id string, outer_fold int, group_id string, truth int, p array<double>"), selected


def fold_geometry(spark: SparkSession, m: Matrix, classes: int, selected: DataFrame, pca: dict[int, int] | None = None) -> DataFrame:
    """Per outer fold and site family: contrast, representation, empty cells, and how cells agree with the classes in training and test.

    Families: the linear probe's power sites, with and without weights, and the class centroids.
    """
    tasks = [{"f": r["outer_fold"], "c": r["c"], "m": r["multiplier"]} for r in _chosen(selected)]

    def work(t: dict, m: Matrix) -> pd.DataFrame:
        test = m.outer == t["f"]
        z = prepare(m.x[~test], m.blocks, t["m"], pca)
        train, held = z(m.x[~test]), z(m.x[test])
        w, b = N.fit_multinomial(train, m.y[~test], classes, t["c"])
        power, weights = N.power_form(w, b)
        means = N.class_means(train, m.y[~test], classes)
        rows = []
        for family, sites, om in (("power_sites", power, None), ("power_diagram", power, weights), ("class_centroids", means, None)):
            cells = N.nearest_site(train, sites, om)
            rep = N.representation(sites, train, cells)
            con = N.contrast(sites)
            row = {"outer_fold": t["f"], "site_family": family, "contrast_sum": con[0], "contrast_mean": con[1], "empty_cells": int(classes - len(set(cells.tolist()))), "status": "ok" if rep else "empty_cell", "representation_sum": rep[0] if rep else None, "representation_mean": rep[1] if rep else None}
            for side, x, y in (("train", train, m.y[~test]), ("test", held, m.y[test])):
                a = N.agreement(y, N.nearest_site(x, sites, om), classes)
                row |= {f"{side}_{k}": v for k, v in a.items()}
            rows.append(row)
        return pd.DataFrame(rows)

    cols = ", ".join(f"{s}_{k} double" for s in ("train", "test") for k in ("mi", "nmi", "ari", "macro_f1", "accuracy"))
    return run(spark, tasks, m, work, f"outer_fold int, site_family string, contrast_sum double, contrast_mean double, empty_cells int, status string, representation_sum double, representation_mean double, {cols}")


def sealed_test(spark: SparkSession, m: Matrix, role: np.ndarray, classes: int, grid: Sequence[float] = C_GRID, multipliers: Sequence[float] = MULTIPLIERS, pca: dict[int, int] | None = None) -> DataFrame:
    """Selects on the training role's inner folds, refits on all of it and predicts the sealed test items once."""
    tr = role == "train"
    # no row has outer fold 0, so fold 0's training part is the whole role
    one = Matrix(m.item[tr], m.x[tr], m.y[tr], np.ones(int(tr.sum()), dtype=np.int64), m.inner[tr][:, :1], m.group[tr], m.blocks)
    best = _chosen(select_multiclass(spark, one, classes, grid, multipliers, pca=pca, folds=[0]))[0]

    def work(t: dict, both: tuple[Matrix, Matrix, np.ndarray]) -> pd.DataFrame:
        tr, whole, role = both
        z = prepare(tr.x, tr.blocks, t["m"], pca)
        w, b = N.fit_multinomial(z(tr.x), tr.y, classes, t["c"])
        te = role == "test"
        p = N.softmax(z(whole.x[te]) @ w.T + b)
        return pd.DataFrame({"item_id": whole.item[te].astype(str), "group_id": whole.group[te].astype(str), "truth": whole.y[te], "p": list(p)})

    return run(spark, [{"c": best["c"], "m": best["multiplier"]}], (one, m, role), work, "item_id string, group_id string, truth int, p array<double>")


def nested_multilabel(spark: SparkSession, m: Matrix, labels: int, grid: Sequence[float] = C_GRID, thresholds: Sequence[float] = THRESHOLDS, factory: Factory = dense_multilabel) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold table with y, p and the fold's threshold, selections).

    C by pooled inner loss, then the smaller; the threshold by macro F1 at that C, then nearest one half, then the lower.
    """
    require_targets(m, labels=labels)
    inner = sorted(set(m.inner.ravel().tolist()))
    tasks = [{"f": f, "v": v, "c": c} for f in m.folds for c in sorted(set(grid)) for v in inner]
    ts = sorted(set(thresholds))

    def work(t: dict, m: Matrix) -> pd.DataFrame:
        out = m.outer != t["f"]
        fit, val = out & (m.inner[:, t["f"]] != t["v"]), out & (m.inner[:, t["f"]] == t["v"])
        if not val.any():
            return pd.DataFrame()
        z = N.scaler(m.x[fit])
        p = factory(t["c"], 1.0)(z(m.x[fit]), m.y[fit], labels)(z(m.x[val]))
        y = m.y[val]
        loss = float(-(y * np.log2(p) + (1 - y) * np.log2(1 - p)).mean(axis=1).sum())
        rows = []
        for th in ts:
            hat = p >= th
            rows.append({"outer_fold": t["f"], "c": t["c"], "threshold": th, "bits": loss, "n": int(val.sum()), "tp": (hat & (y == 1)).sum(axis=0).tolist(), "said": hat.sum(axis=0).tolist(), "true": y.sum(axis=0).tolist()})
        return pd.DataFrame(rows)

    got = run(spark, tasks, m, work, "outer_fold int, c double, threshold double, bits double, n bigint, tp array<bigint>, said array<bigint>, true array<bigint>")
    pooled = got.groupBy("outer_fold", "c", "threshold").agg((F.sum("bits") / F.sum("n")).alias("loss"), *[F.sum(F.col(x)[k]).alias(f"{x}{k}") for x in ("tp", "said", "true") for k in range(labels)])
    f1 = sum((F.when(F.col(f"said{k}") + F.col(f"true{k}") > 0, 2 * F.col(f"tp{k}") / (F.col(f"said{k}") + F.col(f"true{k}"))).otherwise(0.0) for k in range(labels)), F.lit(0.0)) / labels
    pooled = pooled.select("outer_fold", "c", "threshold", "loss", f1.alias("macro_f1"))
    selected = Scratch(spark, "selected").keep(_selected(pooled, [F.round("loss", 12), "c", F.round(-F.col("macro_f1"), 12), F.round(F.abs(F.col("threshold") - 0.5), 12), "threshold"]))
    final = [{"f": r["outer_fold"], "c": r["c"], "t": r["threshold"]} for r in _chosen(selected)]

    def last(t: dict, m: Matrix) -> pd.DataFrame:
        test = m.outer == t["f"]
        z = N.scaler(m.x[~test])
        p = factory(t["c"], 1.0)(z(m.x[~test]), m.y[~test], labels)(z(m.x[test]))
        return pd.DataFrame({"item_id": m.item[test].astype(str), "outer_fold": t["f"], "threshold": t["t"], "group_id": m.group[test].astype(str), "y": list(m.y[test]), "p": list(p)})

    return run(spark, final, m, last, "item_id string, outer_fold int, threshold double, group_id string, y array<int>, p array<double>"), selected


def probe_table(df: DataFrame, item: str, features: str, target: str, group: str, outer: str, outer_folds: int, classes: int, grid: Sequence[float] = C_GRID, metric: str = "log_loss", most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Nested probe of a feature table, by its size: fits as tasks over the broadcast matrix, or fits over the distributed rows."""
    if fits_driver(df, features, most):
        return nested_multiclass(df.sparkSession, collect_matrix(df, item, features, target, group, outer, outer_folds, most=most), classes, grid, metric=metric)
    if metric != "log_loss":
        raise ValueError("beyond the matrix's bound candidates are chosen by loss")
    return big_probes.nested_multiclass(df, item, features, target, group, outer, range(outer_folds), classes, grid)
