"""Counterfactual constellations and matched nulls.

A draw depends only on seed, fold and its own number, so results don't depend on where
or when a task runs. Draws are tasks over a broadcast matrix. One that isn't accepted
within its attempts is an error: results over the easy draws alone would be biased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions import numeric as N
from sparkgauge.functions.vocab import SEED
from sparkgauge.operators.bootstrap import plus_one, standardized_regressions
from sparkgauge.operators.tasks import Matrix, run

SITES, REPETITIONS, PERMUTATION, CELLS = 0, 1, 2, 3
LEARNERS = ("prototype", "knn")


def fold_code(fold: object) -> int:
    """First four bytes of the fold's SHA-256, low byte first."""
    return int.from_bytes(hashlib.sha256(str(fold).encode()).digest()[:4], "little")


def generator(seed: int, fold: object, number: int, stream: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, fold_code(fold), number, stream]))


def space(m: Matrix, fold: int, pca: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training and test points of a fold under a training-only transform, and the training rows' mask."""
    train = m.outer != fold
    t = N.principal(m.x[train], pca)[0] if pca else N.scaler(m.x[train])
    return t(m.x[train]), t(m.x[~train]), train


def spaces(pca: int | None) -> Callable[[Matrix, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``space`` by fold, made once in each partition of tasks."""
    made: dict = {}

    def of(m: Matrix, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if fold not in made:
            made[fold] = space(m, fold, pca)
        return made[fold]

    return of


def draw_sites(points: np.ndarray, k: int, rng: np.random.Generator, attempts: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """``k`` distinct points whose cells all hold points: (places, cells, attempts taken)."""
    for n in range(1, attempts + 1):
        at = rng.choice(len(points), size=k, replace=False)
        sites = points[at]
        if len(np.unique(sites, axis=0)) < k:
            continue
        cells = N.nearest_site(points, sites)
        if len(np.unique(cells)) == k:
            return at, cells, n
    return None


def sample_cells(cells: np.ndarray, k: int, most: int, rng: np.random.Generator) -> np.ndarray:
    """From each cell a random number of members, at most ``most``, without replacement."""
    out = []
    for c in range(k):
        own = np.nonzero(cells == c)[0]
        out.append(rng.choice(own, size=int(rng.integers(1, min(most, len(own)) + 1)), replace=False))
    return np.sort(np.concatenate(out))


def sample_groups(cells: np.ndarray, groups: np.ndarray, k: int, budget: int, rng: np.random.Generator, attempts: int = 1000) -> np.ndarray:
    """All members of ``budget`` random groups, drawn anew until every cell has one."""
    names = np.unique(groups)
    for _ in range(attempts):
        chosen = rng.choice(names, size=min(budget, len(names)), replace=False)
        at = np.nonzero(np.isin(groups, chosen))[0]
        if len(np.unique(cells[at])) == k:
            return at
    raise RuntimeError(f"no {budget} groups with a member in each of {k} cells in {attempts} attempts")


def pilot(spark: SparkSession, m: Matrix, sites: int = 13, constellations: int = 200, repetitions: int = 10, pca: int | None = None, most_per_cell: int = 25, scheme: str = "cells", budget: int = 50, seed: int = SEED, attempts: int = 1000) -> DataFrame:
    """One row per constellation, repetition and learner: geometry of the drawn sites, and how well samples of their cells teach the test cells."""
    tasks = [{"f": f, "n": n} for f in m.folds for n in range(constellations)]
    at_fold = spaces(pca)

    def work(t: dict, m: Matrix) -> pd.DataFrame:
        train, test, mask = at_fold(m, t["f"])
        got = draw_sites(train, sites, generator(seed, t["f"], t["n"], SITES), attempts)
        if got is None:
            raise RuntimeError(f"fold {t['f']}, constellation {t['n']}: no sites with distinct places and filled cells in {attempts} attempts")
        at, cells, tried = got
        s = train[at]
        truth = N.nearest_site(test, s)
        con, rep = N.contrast(s), N.representation(s, train, cells)
        rng = generator(seed, t["f"], t["n"], REPETITIONS)
        rows = []
        for r in range(repetitions):
            pick = sample_cells(cells, sites, most_per_cell, rng) if scheme == "cells" else sample_groups(cells, m.group[mask], sites, budget, rng)
            for learner, f in (("prototype", N.prototype_predict), ("knn", N.neighbour_predict)):
                a = N.agreement(truth, f(train[pick], cells[pick], test, sites), sites)
                rows.append({"constellation_id": f"{t['f']}-{t['n']}", "outer_fold": t["f"], "number": t["n"], "attempts": tried, "empty_test_cells": int(sites - len(np.unique(truth))), "contrast_sum": con[0], "contrast_mean": con[1], "representation_sum": rep[0], "representation_mean": rep[1], "repetition": r, "learner": learner, "sample_items": len(pick), **a})
        return pd.DataFrame(rows)

    return run(
        spark, tasks, m, work,
        "constellation_id string, outer_fold int, number int, attempts int, empty_test_cells int, contrast_sum double, contrast_mean double, representation_sum double, representation_mean double, repetition int, learner string, sample_items int, mi double, nmi double, ari double, macro_f1 double, accuracy double",
    )


def regressions(learnability: DataFrame, outcomes: Sequence[str] = ("nmi", "macro_f1"), adjust: bool = False) -> DataFrame:
    """Standardised regressions of mean learnability on contrast and representation, per fold and learner."""
    mean = learnability.groupBy("outer_fold", "constellation_id", "learner").agg(*[F.avg(o).alias(o) for o in outcomes], F.first("contrast_mean").alias("contrast"), F.first("representation_mean").alias("representation"), F.avg("sample_items").alias("sample_items"))
    x = ["contrast", "representation"] + (["sample_items"] if adjust else [])
    out = None
    for o in outcomes:
        r = standardized_regressions(mean, o, x, ["outer_fold", "learner"]).withColumn("outcome", F.lit(o))
        out = r if out is None else out.unionByName(r)
    return out


def observed(spark: SparkSession, m: Matrix, classes: int, pca: int | None = None) -> DataFrame:
    """Per fold: geometry of the class centroids as sites and how their cells fit the classes."""
    tasks = [{"f": f} for f in m.folds]

    def work(t: dict, m: Matrix) -> pd.DataFrame:
        train, test, mask = space(m, t["f"], pca)
        s = N.class_means(train, m.y[mask], classes)
        cells = N.nearest_site(train, s)
        rep, con = N.representation(s, train, cells), N.contrast(s)
        a, b = N.agreement(m.y[mask], cells, classes), N.agreement(m.y[~mask], N.nearest_site(test, s), classes)
        row = {"outer_fold": t["f"], "contrast": con[1], "representation": rep[1] if rep else None, "status": "ok" if rep else "empty_cell", "train_nmi": a["nmi"], "train_macro_f1": a["macro_f1"], "test_nmi": b["nmi"], "test_macro_f1": b["macro_f1"]}
        return pd.DataFrame([row])

    return run(spark, tasks, m, work, "outer_fold int, contrast double, representation double, status string, train_nmi double, train_macro_f1 double, test_nmi double, test_macro_f1 double")


def percentiles(obs: DataFrame, learnability: DataFrame) -> DataFrame:
    """Where the observed geometry stands among the constellations: add-one smoothed shares below it and dominated by it."""
    c = learnability.groupBy("outer_fold", "constellation_id").agg(F.first("contrast_mean").alias("c"), F.first("representation_mean").alias("r"))
    j = obs.join(c, "outer_fold")
    smooth = lambda cond: (1 + F.count_if(cond)) / (2 + F.count(F.lit(1)))
    known = F.first("representation").isNotNull()
    return j.groupBy("outer_fold").agg(
        F.first("status").alias("status"),
        smooth(F.col("c") <= F.col("contrast")).alias("contrast_percentile"),
        F.when(known, smooth(F.col("r") <= F.col("representation"))).alias("representation_percentile"),
        F.when(known, smooth((F.col("c") >= F.col("contrast")) & (F.col("r") <= F.col("representation")))).alias("dominated_by"),
        F.first("train_nmi").alias("train_nmi"),
        F.first("test_nmi").alias("test_nmi"),
    )


def nulls(spark: SparkSession, m: Matrix, classes: int, draws: int = 1000, pca: int | None = None, seed: int = SEED, attempts: int = 1000) -> DataFrame:
    """Null draws of both mechanisms: centroids of permuted labels, and centroids of the cells of drawn sites."""
    tasks = [{"f": f, "n": n, "k": k} for f in m.folds for k in ("permutation", "cell_centroid") for n in range(draws)]
    at_fold = spaces(pca)

    def work(t: dict, m: Matrix) -> pd.DataFrame:
        train, _, mask = at_fold(m, t["f"])
        y = m.y[mask]
        rng = generator(seed, t["f"], t["n"], PERMUTATION if t["k"] == "permutation" else CELLS)
        first = (None, None)
        for tried in range(1, attempts + 1):
            if t["k"] == "permutation":
                z = rng.permutation(y)
                if (z == y).all():
                    continue
                s = N.class_means(train, z, classes)
            else:
                got = draw_sites(train, classes, rng, 1)
                if got is None:
                    continue
                rep = N.representation(train[got[0]], train, got[1])
                first = (N.contrast(train[got[0]])[1], rep[1])
                s = N.class_means(train, got[1], classes)
            cells = N.nearest_site(train, s)
            rep = N.representation(s, train, cells)
            if rep is None:
                continue
            sup = np.bincount(cells, minlength=classes)
            row = {"draw_id": f"{t['f']}-{t['k']}-{t['n']}", "outer_fold": t["f"], "mechanism": t["k"], "attempts": tried, "contrast": N.contrast(s)[1], "representation": rep[1], "supports": sup.tolist(), "entropy_bits": N.entropy_bits(sup), "entropy_share": N.entropy_bits(sup) / np.log2(classes), "initial_contrast": first[0], "initial_representation": first[1]}
            return pd.DataFrame([row])
        raise RuntimeError(f"fold {t['f']}, {t['k']} draw {t['n']}: not accepted in {attempts} attempts")

    return run(spark, tasks, m, work, "draw_id string, outer_fold int, mechanism string, attempts int, contrast double, representation double, supports array<bigint>, entropy_bits double, entropy_share double, initial_contrast double, initial_representation double")


def null_summary(obs: DataFrame, draws: DataFrame) -> DataFrame:
    """Plus-one p values of the observed geometry in each fold under each mechanism; none where it has an empty cell."""
    j = obs.select("outer_fold", "status", F.col("contrast").alias("oc"), F.col("representation").alias("orep")).join(draws, "outer_fold")
    known = F.first("status") == "ok"
    return j.groupBy("outer_fold", "mechanism").agg(
        F.count(F.lit(1)).alias("draws"),
        F.sum("attempts").alias("attempts"),
        F.when(known, plus_one(F.col("contrast") >= F.col("oc"))).alias("p_contrast"),
        F.when(known, plus_one(F.col("representation") <= F.col("orep"))).alias("p_representation"),
        F.when(known, F.count_if((F.col("contrast") >= F.col("oc")) & (F.col("representation") <= F.col("orep"))) / F.count(F.lit(1))).alias("joint_domination"),
        F.avg("entropy_share").alias("mean_entropy_share"),
    )
