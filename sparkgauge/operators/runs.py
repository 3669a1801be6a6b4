"""Probe runs as artifacts: publishing, validation by recomputing, batches, and suites of many runs.

A run's tables are ``oof`` (item_id, outer_fold, group_id, truth, predicted, p), ``selections`` (a row per outer fold)
and ``metrics``. A validator counts breaches; ``require`` turns any into an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgauge.functions import arrays as A
from sparkgauge.functions.vocab import C_GRID, MULTIPLIERS, SEED
from sparkgauge.operators import checks
from sparkgauge.operators import metrics as M
from sparkgauge.session import Scratch
from sparkgauge.sources import store

#: What tells the runs of a suite apart; each may be null.
KEYS = ("target_scale", "model_key", "layer", "pooling", "rater_role", "pca_dimension")
TOLERANCE = 1e-6


def require(report: DataFrame) -> None:
    """An error that names every check with violations."""
    broken = {r["check_name"]: r["violations"] for r in report.where("violations > 0").collect()}  # a row per check
    if broken:
        raise checks.ConstraintError(f"violations: {broken}")


def with_prediction(oof: DataFrame) -> DataFrame:
    return oof.withColumn("predicted", A.argmax(F.col("p")).cast("int"))


def oof_checks(oof: DataFrame, classes: int, folds: int | None = None) -> DataFrame:
    """Violations of an out-of-fold table: keys, widths, values, sums, truths, stored predictions, and groups in two folds."""
    p = F.col("p")
    bad = lambda c: oof.where(F.coalesce(c, F.lit(True)))
    stored = oof.where(~F.col("predicted").eqNullSafe(A.argmax(p).cast("int"))) if "predicted" in oof.columns else oof.limit(0)
    parts = {
        "null_item": oof.where("item_id is null"),
        "repeated_item": checks.repeated_keys(oof.where("item_id is not null"), ["item_id"]),
        "wrong_width": bad(F.size(p) != classes),
        "not_finite": oof.where(checks.finite("p").broken),
        "outside_unit_interval": bad(F.exists(p, lambda x: (x < 0) | (x > 1))),
        "not_unit_sum": bad(F.abs(A.total(p) - 1) > TOLERANCE),
        "truth_out_of_range": bad(~F.col("truth").between(0, classes - 1)),
        "stored_prediction_differs": stored,
        "group_crosses_folds": checks.crossing_groups(oof, "group_id", "outer_fold"),
    }
    if folds is not None:
        parts["fold_out_of_range"] = bad(~F.col("outer_fold").between(0, folds - 1))
    return checks.summary(parts)


def selection_checks(selections: DataFrame, oof: DataFrame, grid: Sequence[float] = C_GRID, multipliers: Sequence[float] = (1.0, *MULTIPLIERS)) -> DataFrame:
    """Violations of the selections: folds without one or with several, candidates that aren't in the grid, losses that aren't finite."""
    within = lambda c, xs: F.exists(F.array(*[F.lit(float(x)) for x in xs]), lambda x: F.abs(x - F.col(c)) <= 1e-12)
    parts = {
        "repeated_fold": checks.repeated_keys(selections, ["outer_fold"]),
        "fold_without_selection": checks.difference(oof, selections, ["outer_fold"]),
        "c_not_in_grid": selections.where(~F.coalesce(within("c", grid), F.lit(False))),
        "loss_not_finite": selections.where(F.coalesce(F.isnan("loss") | (F.abs("loss") == float("inf")), F.lit(True))),
    }
    if "multiplier" in selections.columns:
        parts["multiplier_not_in_grid"] = selections.where(~F.coalesce(within("multiplier", multipliers), F.lit(False)))
    return checks.summary(parts)


def metric_checks(stored: DataFrame, oof: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Stored metrics that differ from those of the table itself."""
    now = M.multiclass(oof)
    names = [c for c, t in now.dtypes if c in stored.columns]
    one = stored.select(*[F.col(c).cast("double").alias(f"a_{c}") for c in names]).crossJoin(F.broadcast(now.select(*[F.col(c).cast("double").alias(f"b_{c}") for c in names])))  # one row each
    off = [F.struct(F.lit(f"metric_{c}").alias("check_name"), (~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.lit(False))).cast("bigint").alias("violations")) for c in names]
    return one.select(F.inline(F.array(*off)))


def run_checks(oof: DataFrame, selections: DataFrame, stored: DataFrame, classes: int, grid: Sequence[float] = C_GRID) -> DataFrame:
    return reduce(DataFrame.unionByName, [oof_checks(oof, classes), selection_checks(selections, oof, grid), metric_checks(stored, oof)])


def publish_run(target: str | Path, oof: DataFrame, selections: DataFrame, classes: int, request: dict, grid: Sequence[float] = C_GRID) -> dict:
    """Writes a run as one artifact after it was checked; an existing target is an error."""
    s = Scratch(oof.sparkSession, "run")
    oof, selections = s.keep(with_prediction(oof)), s.keep(selections)
    metrics = s.keep(M.multiclass(oof))
    require(run_checks(oof, selections, metrics, classes, grid))
    return store.publish({"oof": oof, "selections": selections, "metrics": metrics}, target, {"kind": "run", "request": request, "classes": classes, "grid": list(grid)})


def validate_run(spark: SparkSession, target: str | Path) -> dict:
    """The metadata of a run whose digests, schema, arithmetic and grid hold; else an error."""
    meta = store.metadata(spark, target)
    if meta.get("kind") != "run":
        raise checks.ConstraintError(f"{target} is no run")
    oof = store.load(spark, target, "oof", ["item_id", "outer_fold", "group_id", "truth", "predicted", "p"])
    selections = store.load(spark, target, "selections", ["outer_fold", "c", "loss"])
    require(run_checks(oof, selections, store.load(spark, target, "metrics"), meta["classes"], meta["grid"]))
    return meta


def resume_run(spark: SparkSession, target: str | Path, request: dict, build: Callable[[], tuple[DataFrame, DataFrame]], classes: int, grid: Sequence[float] = C_GRID) -> dict:
    """The run at ``target`` if it answers the same request and is sound; built and published if nothing is there."""
    if store.exists(spark, target):
        meta = validate_run(spark, target)
        if meta["request"] != request:
            raise checks.ConstraintError(f"{target} answers another request")
        return meta
    oof, selections = build()
    return publish_run(target, oof, selections, classes, request, grid)


def run_batch(spark: SparkSession, root: str, jobs: Sequence[dict], build: Callable[[dict], tuple[DataFrame, DataFrame]], classes: int, grid: Sequence[float] = C_GRID) -> list[dict]:
    """One run for each job, a dict of KEYS and ``representation``, below ``root``; those already there are validated, not repeated.

    Each job's fits are spread over the cluster, so the jobs follow one another. The manifest of the batch is written once.
    """
    rows = []
    for job in jobs:
        path = "/".join(f"{k}={job.get(k)}" for k in ("representation", *KEYS))
        meta = resume_run(spark, f"{root}/{path}", job, lambda job=job: build(job), classes, grid)
        rows.append({**job, "run_path": path, "oof_sha256": meta["tables"]["oof"]["sha256"]})
    store.publish_json(Path(root) / "manifest.json", rows)
    return rows


def load_runs(spark: SparkSession, root: str, rows: Sequence[dict]) -> DataFrame:
    """(run_path, representation, KEYS, item_id, outer_fold, group_id, truth, p) of many runs."""
    out = None
    for r in rows:
        cols = [F.lit(r["run_path"]).alias("run_path"), F.lit(r["representation"]).alias("representation"), *[F.lit(r.get(k)).cast("string").alias(k) for k in KEYS]]
        t = store.load(spark, f"{root}/{r['run_path']}", "oof").select(*cols, "item_id", "outer_fold", "group_id", "truth", "p")
        out = t if out is None else out.unionByName(t)
    return out


# suites


def suite_summary(runs: DataFrame) -> DataFrame:
    """Metrics of each run beside its keys."""
    keys = runs.select("run_path", "representation", *KEYS).distinct()
    return keys.join(M.multiclass(runs.select("run_path", "item_id", "truth", "p"), ["run_path"]), "run_path")


def suite_pairs(summary: DataFrame, a: str = "H", b: str = "AH") -> DataFrame:
    """(pair, path_a, path_b, KEYS): every run of representation ``a`` with every one of ``b`` under the same keys, nulls equal to nulls."""
    x = summary.where(F.col("representation") == a).select(F.col("run_path").alias("path_a"), *KEYS)
    y = summary.where(F.col("representation") == b).select(F.col("run_path").alias("path_b"), *[F.col(k).alias(f"_{k}") for k in KEYS])
    same = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
    return x.join(y, same).select(F.concat_ws(" | ", "path_a", "path_b").alias("pair"), "path_a", "path_b", *KEYS)


def suite_contrasts(runs: DataFrame, draws: int = 2000, seed: int = SEED, a: str = "H", b: str = "AH", level: float = 0.95) -> DataFrame:
    """For each pair: the loss of ``a`` less that of ``b``, its bootstrap interval over groups and standard error.

    Items, groups and truths of a pair have to be the same; anything else is an error. Draw and place decide the group by hash.
    """
    s = Scratch(runs.sparkSession, "suite")
    pairs = s.keep(suite_pairs(runs.select("run_path", "representation", *KEYS).distinct(), a, b))  # a row per pair
    bits = s.keep(runs.select("run_path", "item_id", "group_id", "truth", A.loss_bits(F.element_at("p", F.col("truth") + 1)).alias("loss")))
    side = lambda path, x: bits.join(F.broadcast(pairs.select("pair", F.col(path).alias("run_path"))), "run_path").select("pair", "item_id", F.col("group_id").alias(f"g{x}"), F.col("truth").alias(f"t{x}"), F.col("loss").alias(f"l{x}"))
    j = s.keep(side("path_a", "a").join(side("path_b", "b"), ["pair", "item_id"], "full_outer"))
    odd = [tuple(r) for r in j.where("la is null or lb is null or not (ga <=> gb) or not (ta <=> tb)").select("pair", "item_id").limit(3).collect()]
    if odd:
        raise checks.ConstraintError(f"items, groups or truths of a pair differ: {odd}")
    totals = j.groupBy("pair", F.col("ga").alias("g")).agg(F.min("item_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("la").alias("sa"), F.sum("lb").alias("sb"))
    k = (F.row_number().over(Window.partitionBy("pair").orderBy("first", "g")) - 1).cast("bigint")
    totals = s.keep(totals.withColumn("k", k))
    sizes = totals.groupBy("pair").agg(F.count(F.lit(1)).alias("groups"))
    grid = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
    point = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("j").cast("string")), 256), 1, 7), 16, 10).cast("bigint") % F.col("groups")
    drawn = grid.select("pair", "draw", point.alias("k")).groupBy("pair", "draw", "k").agg(F.count(F.lit(1)).alias("m")).join(totals, ["pair", "k"])
    delta = drawn.groupBy("pair", "draw").agg((F.sum(F.col("m") * (F.col("sa") - F.col("sb"))) / F.sum(F.col("m") * F.col("n"))).alias("delta"))
    tail = (1 - level) / 2
    d = delta.groupBy("pair").agg(F.percentile("delta", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.stddev_samp("delta").alias("se"), F.count(F.lit(1)).alias("draws"))
    o = totals.groupBy("pair").agg((F.sum(F.col("sa") - F.col("sb")) / F.sum("n")).alias("observed"), F.sum("n").alias("n_items"))
    return pairs.join(o, "pair").join(d, "pair").select(*KEYS, "path_a", "path_b", "observed", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "se", "draws", "n_items")


def suite(runs: DataFrame, draws: int = 2000, seed: int = SEED) -> DataFrame:
    """Each run's metrics with the contrasts of its key group, left where there are none; keys may be null on both sides."""
    left = suite_summary(runs)
    right = suite_contrasts(runs, draws, seed).select(*[F.col(k).alias(f"_{k}") for k in KEYS], "path_a", "path_b", "observed", "ci_low", "ci_high", "se")
    same = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
    return left.join(right, same, "left").drop(*[f"_{k}" for k in KEYS])


# stored analyses


def draw_checks(draws: DataFrame, stored: DataFrame, level: float = 0.95, tolerance: float = TOLERANCE) -> DataFrame:
    """Violations of a stored bootstrap: draws that repeat or aren't finite, and interval, error or number that the draws don't give."""
    tail = (1 - level) / 2
    now = draws.agg(F.percentile("delta", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.stddev_samp("delta").alias("_se"), F.count(F.lit(1)).alias("_n"))
    j = stored.crossJoin(F.broadcast(now))  # one row each
    differs = lambda a, b: ~F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return checks.summary(
        {
            "repeated_draw": checks.repeated_keys(draws, ["draw"]),
            "draw_not_finite": draws.where(F.coalesce(F.isnan("delta") | (F.abs("delta") == float("inf")), F.lit(True))),
            "ci_low_differs": j.where(differs(F.col("ci_low"), F.col("q")[0])),
            "ci_high_differs": j.where(differs(F.col("ci_high"), F.col("q")[1])),
            "se_differs": j.where(differs(F.col("se"), F.col("_se"))),
            "draws_differ": j.where(F.col("draws") != F.col("_n")),
            "interval_reversed": stored.where("ci_low > ci_high"),
        }
    )


def null_checks(draws: DataFrame, observed: DataFrame, stored: DataFrame, classes: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Violations of stored nulls: ids, supports, entropies and attempts of the draws, and p values that the draws don't give."""
    from sparkgauge.operators.counterfactual import null_summary

    e = A.entropy_bits(F.col("supports"))
    now = null_summary(observed, draws).select("outer_fold", "mechanism", *[F.col(c).alias(f"_{c}") for c in ("draws", "attempts", "p_contrast", "p_representation", "joint_domination")])
    j = stored.join(now, ["outer_fold", "mechanism"], "full_outer")
    off = lambda c: j.where(~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"_{c}").isNull() & F.col("draws").isNotNull() & F.col("_draws").isNotNull()))
    return checks.summary(
        {
            "repeated_draw": checks.repeated_keys(draws, ["draw_id"]),
            "wrong_supports": draws.where(F.coalesce((F.size("supports") != classes) | F.exists("supports", lambda x: x < 1), F.lit(True))),
            "entropy_differs": draws.where(F.coalesce(F.abs(e - F.col("entropy_bits")) > tolerance, F.lit(True))),
            "no_attempt": draws.where(F.coalesce(F.col("attempts") < 1, F.lit(True))),
            **{f"{c}_differs": off(c) for c in ("draws", "attempts", "p_contrast", "p_representation", "joint_domination")},
        }
    )


def learnability_checks(rows: DataFrame, constellations: int, repetitions: int, learners: Sequence[str]) -> DataFrame:
    """Violations of a pilot's table: keys, counts, geometry that differs within a constellation, and scores out of range."""
    per = rows.groupBy("constellation_id").agg(F.countDistinct("contrast_mean", "representation_mean").alias("geo"))
    n = rows.groupBy("outer_fold", "learner").agg(F.countDistinct("constellation_id").alias("c"), F.countDistinct("repetition").alias("r"), F.count(F.lit(1)).alias("n"))
    unit = ("nmi", "macro_f1", "accuracy")
    return checks.summary(
        {
            "repeated_row": checks.repeated_keys(rows, ["constellation_id", "repetition", "learner"]),
            "geometry_differs": per.where("geo <> 1"),
            "wrong_counts": n.where((F.col("c") != constellations) | (F.col("r") != repetitions) | (F.col("n") != constellations * repetitions)),
            "unknown_learner": rows.where(~F.coalesce(F.col("learner").isin(*learners), F.lit(False))),
            "score_out_of_range": rows.where(reduce(lambda a, b: a | b, [F.coalesce((F.col(c) < -TOLERANCE) | (F.col(c) > 1 + TOLERANCE), F.lit(True)) for c in unit])),
            "no_sample": rows.where("coalesce(sample_items, 0) < 1"),
        }
    )


# stored geometry and transforms


def geometry_rows(spark: SparkSession, fold: int, w: np.ndarray, b: np.ndarray, means: np.ndarray) -> DataFrame:
    """(outer_fold, class, coefficient, intercept, site, power_weight, centroid) of one fold's linear probe."""
    from sparkgauge.functions.numeric import power_form

    sites, weights = power_form(w, b)
    rows = [(fold, k, w[k].tolist(), float(b[k]), sites[k].tolist(), float(weights[k]), means[k].tolist()) for k in range(len(w))]
    return spark.createDataFrame(rows, "outer_fold int, class int, coefficient array<double>, intercept double, site array<double>, power_weight double, centroid array<double>")


GEOMETRY_COLUMNS = ("outer_fold", "class", "coefficient", "intercept", "site", "power_weight", "centroid")
TRANSFORM_COLUMNS = ("outer_fold", "mean", "scale", "components")


def geometry_checks(g: DataFrame, folds: int, classes: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Violations of stored fold geometry: columns, shapes, values, the gauge of zero sums, and sites and weights that the linear form doesn't give."""
    checks.exact_columns(g, GEOMETRY_COLUMNS)
    width = F.size("coefficient")
    half = F.exists(F.zip_with("coefficient", "site", lambda c, s: F.abs(c / 2 - s) > tolerance), lambda x: x)
    weight = F.col("intercept") + A.dot(F.col("coefficient"), F.col("coefficient")) / 4
    sums = g.select("outer_fold", F.posexplode("coefficient").alias("pos", "v")).groupBy("outer_fold", "pos").agg(F.sum("v").alias("s"))
    per = g.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class").alias("k"), F.abs(F.sum("intercept")).alias("b"), F.countDistinct(width).alias("w"))
    return checks.summary(
        {
            "wrong_folds": per.agg(F.count(F.lit(1)).alias("f")).where(F.col("f") != folds),
            "wrong_classes": per.where((F.col("n") != classes) | (F.col("k") != classes)),
            "wrong_shape": per.where("w <> 1").select("outer_fold").unionByName(g.where((F.size("site") != width) | (F.size("centroid") != width)).select("outer_fold")),
            "not_finite": g.where(checks.finite("coefficient").broken | checks.finite("site").broken | checks.finite("centroid").broken | F.isnan("intercept") | F.isnan("power_weight")),
            "no_gauge": sums.where(F.abs("s") > tolerance).select("outer_fold").unionByName(per.where(F.col("b") > tolerance).select("outer_fold")),
            "site_differs": g.where(half),
            "weight_differs": g.where(F.abs(weight - F.col("power_weight")) > tolerance),
        }
    )


def transform_rows(spark: SparkSession, fold: int, mean: np.ndarray, scale: np.ndarray, components: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(fold, mean.tolist(), scale.tolist(), components.tolist())], "outer_fold int, mean array<double>, scale array<double>, components array<array<double>>")


def transform_checks(t: DataFrame, folds: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Violations of stored transforms: columns, shapes, scales that aren't positive, and components that aren't orthonormal."""
    checks.exact_columns(t, TRANSFORM_COLUMNS)
    far = lambda c, d, i, j: F.abs(A.dot(c, d) - F.when(i == j, 1.0).otherwise(0.0)) > tolerance
    odd: Column = F.exists(F.transform("components", lambda c, i: F.exists(F.transform("components", lambda d, j: far(c, d, i, j)), lambda x: x)), lambda x: x)
    width = F.size("mean")
    return checks.summary(
        {
            "wrong_folds": t.agg(F.countDistinct("outer_fold").alias("f"), F.count(F.lit(1)).alias("n")).where((F.col("f") != folds) | (F.col("n") != folds)),
            "wrong_shape": t.where((F.size("scale") != width) | F.exists("components", lambda c: F.size(c) != width)),
            "scale_not_positive": t.where(F.exists("scale", lambda x: ~(x > 0))),
            "not_orthonormal": t.where(odd),
        }
    )


# layer summaries


def write_layer_summary(summary: DataFrame, path: str) -> None:
    """One CSV folder, by layer; an existing one is an error."""
    summary.repartitionByRange(1, "layer").sortWithinPartitions("layer").write.mode("errorifexists").csv(path, header=True)  # a row per layer


def read_layer_summary(spark: SparkSession, path: str, layers: int, columns: Sequence[str] = ("macro_f1", "log_loss_bits")) -> DataFrame:
    """A layer summary with each layer from 0 once and finite numbers; anything else is an error."""
    df = spark.read.csv(path, header=True)
    checks.require_columns(df, ["layer", *columns])
    df = df.select(F.expr("try_cast(layer as int)").alias("layer"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in columns])
    want = spark.range(layers).select(F.col("id").cast("int").alias("layer"))
    require(
        checks.summary(
            {
                "repeated_layer": checks.repeated_keys(df, ["layer"]),
                "missing_or_unexpected_layer": checks.difference(want, df, ["layer"]),
                "not_finite": df.where(reduce(lambda a, b: a | b, [F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)) for c in columns])),
            }
        )
    )
    return df


def provenance_checks(layers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of a summary over layers: provenance columns that don't agree over all of them."""
    return checks.summary({f"{k}_disagrees": layers.agg(F.countDistinct(F.coalesce(F.col(k).cast("string"), F.lit("\u0000"))).alias("n")).where("n > 1") for k in keys})
