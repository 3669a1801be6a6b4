"""The decoder ladder: from class priors to discriminative multi-prototype decoders, nested and group-disjoint."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgauge.functions import arrays as A
from sparkgauge.functions import numeric as N
from sparkgauge.functions.vocab import FIT_CLIP, GAMMAS, LADDER_C, SEED, SITES_PER_CLASS
from sparkgauge.operators.bootstrap import paired_draws, summarise
from sparkgauge.operators.tasks import Matrix, run

# The decoders and the pairs that are contrasted.
DECODERS = ("D0", "D1", "D1o", "D2", "D3", "D4", "D4c", "D4d")
CONTRASTS = (("D1o", "D1"), ("D1o", "D3"), ("D4", "D3"), ("D4", "D1"), ("D4c", "D4"), ("D4d", "D4"), ("D4d", "D3"), ("D4c", "D1"))


def grid(decoder: str, gammas: Sequence[float] = GAMMAS, cs: Sequence[float] = LADDER_C, ms: Sequence[int] = SITES_PER_CLASS) -> list[dict]:
    g = [{"gamma": x} for x in gammas]
    c = [{"c": x} for x in cs]
    return {
        "D0": [{}],
        "D1": g,
        "D1o": [{**a, **b} for a in g for b in c],
        "D2": c,
        "D3": c,
        "D4": [{**a, "m": m} for a in g for m in ms],
        "D4c": [{**a, "m": m} for a in g for m in ms],
        "D4d": [{**a, "m": m} for a in c for m in ms],
    }[decoder]


#: Rounds of the optimiser; a decoder that would need more is used as it stands then.
ROUNDS = 500


class Fitter:
    """Fits the decoders on one training part; what several parameters share is fitted once.

    A class without a row in the part can't be predicted: its score is far below all others.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int, seed: int = SEED, restarts: int = 5):
        self.there = np.unique(y)
        self.x, self.y, self.k, self.all, self.seed, self.restarts = x, np.searchsorted(self.there, y), len(self.there), classes, seed, restarts
        self.linear = lru_cache(maxsize=None)(self._linear)
        self.sites = lru_cache(maxsize=None)(self._sites)
        self.means = N.class_means(x, self.y, self.k)

    def _linear(self, c: float) -> tuple[np.ndarray, np.ndarray]:
        return N.fit_multinomial(self.x, self.y, self.k, c, intercept_penalty=True, rounds=ROUNDS, strict=False)

    def _sites(self, m: int, keep: bool) -> np.ndarray:
        return N.class_sites(self.x, self.y, self.k, m, self.seed, self.restarts, keep)

    def scores(self, decoder: str, new: np.ndarray, gamma: float | None = None, c: float | None = None, m: int | None = None) -> np.ndarray:
        """Log-scores of the classes."""
        if decoder == "D0":
            return np.tile(np.log(N.class_prior(self.there[self.y], self.all)), (len(new), 1))
        out = np.full((len(new), self.all), -1e30)
        out[:, self.there] = self._scores(decoder, new, gamma, c, m)
        return out

    def _scores(self, decoder: str, new: np.ndarray, gamma: float | None, c: float | None, m: int | None) -> np.ndarray:
        if decoder == "D1":
            return -gamma * N.squared_distances(new, self.means)
        if decoder == "D1o":
            means, o = N.fit_offsets(self.x, self.y, self.k, gamma, c)
            return o - gamma * N.squared_distances(new, means)
        if decoder == "D2":
            s, o = N.fit_sites(self.x, self.y, self.means[:, None, :].copy(), np.zeros((self.k, 1)), c, free_weights=False, ridge="sites")
            return N.site_scores(new, s, o, 1.0)
        if decoder == "D3":
            w, b = self.linear(c)
            return new @ w.T + b
        if decoder in ("D4", "D4c"):
            s = self.sites(m, decoder == "D4c")
            return N.site_scores(new, s, np.full(s.shape[:2], -np.log(s.shape[1])), gamma)
        if decoder == "D4d":
            # starts from the linear decoder's site, spread by a little seeded noise
            sites, weights = N.power_form(*self.linear(c))
            noise = np.random.default_rng(self.seed).normal(scale=0.1 * max(self.x.std(), 1e-6), size=(self.k, m, self.x.shape[1]))
            start = sites[:, None, :] + noise
            s, o = N.fit_sites(self.x, self.y, start, np.repeat(weights[:, None], m, axis=1) - np.log(m), c, free_weights=True)
            return N.site_scores(new, s, o, 1.0)
        raise ValueError(decoder)


def _transform(train: np.ndarray, pca: int | None):
    return N.principal(train, pca)[0] if pca else N.scaler(train)


def ladder(spark: SparkSession, m: Matrix, classes: int, decoders: Sequence[str] = DECODERS, pca: int | None = None, folds: Sequence[int] | None = None, grids: dict[str, list[dict]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold table, selections) of all decoders.

    Each inner task fits all candidates of one decoder on one inner training part. A
    candidate's score is the plain mean of its inner folds' losses; an inner fold whose
    training part has fewer than two classes, or that has no validation rows, can't be scored, and
    ``inner_folds`` of the selections says how many could; the first candidate of the least mean wins. Seeds
    differ by outer and inner fold.
    """
    grids = {d: grid(d) for d in decoders} | (grids or {})
    folds = list(m.folds if folds is None else folds)
    inner = sorted(set(m.inner.ravel().tolist()))
    tasks = [{"f": f, "v": v, "d": d} for f in folds for d in decoders for v in inner if len(grids[d]) > 1]

    def work(t: dict, m: Matrix) -> pd.DataFrame:
        out = m.outer != t["f"]
        fit, val = out & (m.inner[:, t["f"]] != t["v"]), out & (m.inner[:, t["f"]] == t["v"])
        if len(set(m.y[fit].tolist())) < 2 or not val.any():
            return pd.DataFrame()
        z = _transform(m.x[fit], pca)
        fitter = Fitter(z(m.x[fit]), m.y[fit], classes, SEED + 97 * t["f"] + t["v"])
        new = z(m.x[val])
        rows = []
        for i, g in enumerate(grids[t["d"]]):
            p = N.softmax(fitter.scores(t["d"], new, **g))
            rows.append({"outer_fold": t["f"], "decoder": t["d"], "place": i, "loss": float(N.bits(p, m.y[val]).mean())})
        return pd.DataFrame(rows)

    scored = run(spark, tasks, m, work, "outer_fold int, decoder string, place int, loss double")
    mean = scored.groupBy("outer_fold", "decoder", "place").agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("inner_folds"))
    n = F.row_number().over(Window.partitionBy("outer_fold", "decoder").orderBy(F.round("mean_loss", 12), "place"))
    best = {(r["outer_fold"], r["decoder"]): r for r in mean.withColumn("n", n).where("n = 1").collect()}  # a row per fold and decoder
    lost = [(f, d) for f in folds for d in decoders if len(grids[d]) > 1 and (f, d) not in best]
    if lost:
        raise ValueError(f"no inner fold can be scored: {lost[:5]}")
    final = [{"f": f, "d": d, "place": best[f, d]["place"] if (f, d) in best else 0} for f in folds for d in decoders]

    def last(t: dict, m: Matrix) -> pd.DataFrame:
        test = m.outer == t["f"]
        z = _transform(m.x[~test], pca)
        p = N.softmax(Fitter(z(m.x[~test]), m.y[~test], classes, SEED + 97 * t["f"]).scores(t["d"], z(m.x[test]), **grids[t["d"]][t["place"]]))
        return pd.DataFrame({"decoder": t["d"], "item_id": m.item[test].astype(str), "outer_fold": t["f"], "group_id": m.group[test].astype(str), "truth": m.y[test], "p": list(p)})

    oof = run(spark, final, m, last, "decoder string, item_id string, outer_fold int, group_id string, truth int, p array<double>")
    picks = [(t["f"], t["d"], *[grids[t["d"]][t["place"]].get(k) for k in ("gamma", "c", "m")], *([best[t["f"], t["d"]][k] for k in ("mean_loss", "inner_folds")] if (t["f"], t["d"]) in best else [None, None])) for t in final]
    selections = spark.createDataFrame(picks, "outer_fold int, decoder string, gamma double, c double, m int, mean_loss double, inner_folds bigint")
    return oof, selections


def summary(oof: DataFrame, selections: DataFrame) -> DataFrame:
    """Per decoder: loss, its deviation over folds, gain over the prior, items, and the medians of the chosen parameters."""
    loss = oof.withColumn("bits", A.loss_bits(F.element_at("p", F.col("truth") + 1), FIT_CLIP)).withColumn("hit", (A.argmax(F.col("p")) == F.col("truth")).cast("int"))
    fold = loss.groupBy("decoder", "outer_fold").agg(F.avg("bits").alias("b"))
    all_of = loss.groupBy("decoder").agg(F.avg("bits").alias("log_loss_bits"), F.avg("hit").alias("accuracy"), F.countDistinct("item_id").alias("n_items"))
    sd = fold.groupBy("decoder").agg(F.stddev_samp("b").alias("fold_sd"))
    base = all_of.where("decoder = 'D0'").select(F.col("log_loss_bits").alias("prior"))
    picks = selections.groupBy("decoder").agg(F.median("gamma").alias("median_gamma"), F.median("c").alias("median_c"), F.median("m").alias("median_m"))
    out = all_of.join(sd, "decoder").join(picks, "decoder", "left").crossJoin(F.broadcast(base))  # one row
    return out.withColumn("delta_vs_prior", F.col("prior") - F.col("log_loss_bits")).drop("prior")


def merge(parts: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Runs over disjoint outer folds as one."""
    oof, sel = parts[0]
    for o, s in parts[1:]:
        oof, sel = oof.unionByName(o), sel.unionByName(s)
    return oof, sel


def contrasts(oof: DataFrame, pairs: Sequence[tuple[str, str]] = CONTRASTS, draws: int = 2000, seed: int = SEED) -> DataFrame:
    """Paired group bootstrap of the loss difference of each pair of decoders."""
    bits = oof.withColumn("bits", A.loss_bits(F.element_at("p", F.col("truth") + 1), FIT_CLIP))
    out = None
    for a, b in pairs:
        j = bits.where(F.col("decoder") == a).select("item_id", "group_id", F.col("bits").alias("a")).join(bits.where(F.col("decoder") == b).select("item_id", F.col("bits").alias("b")), "item_id")
        row = summarise(paired_draws(j, "group_id", "a", "b", draws, seed), j, "a", "b").select(F.lit(a).alias("decoder"), F.lit(b).alias("against"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def site_diagnostics(x: np.ndarray, y: np.ndarray, sites: np.ndarray, w: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """For each site of a multi-prototype decoder: its margin to the linear decoder's nearest boundary, the distance to its
    class's mean, and the share of its class's members nearest to it that the linear decoder gives to others."""
    k, m, d = sites.shape
    means = N.class_means(x, y, k)
    rows = []
    linear = (x @ w.T + b).argmax(axis=1)
    for c in range(k):
        own = x[y == c]
        near = N.squared_distances(own, sites[c]).argmin(axis=1)
        for j in range(m):
            s = sites[c, j]
            margins = [((s @ (w[c] - w[o])) + b[c] - b[o]) / max(np.linalg.norm(w[c] - w[o]), 1e-12) for o in range(k) if o != c]
            mine = near == j
            rows.append({"label": c, "site": j, "margin": float(min(margins)), "from_mean": float(np.linalg.norm(s - means[c])), "members": int(mine.sum()), "intrusion": float((linear[y == c][mine] != c).mean()) if mine.any() else None})
    return pd.DataFrame(rows)
