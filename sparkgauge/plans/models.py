"""Queries that fit models: nested probes, the decoder ladder, counterfactuals and their tests. SQL can't express them; audits count breaches of what they promise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions import arrays as A
from sparkgauge.functions import numeric as N
from sparkgauge.functions.vocab import APPRAISALS, CLUSTERS, EMOTIONS, SEED, cluster_column, ordinal
from sparkgauge.operators import bootstrap as B
from sparkgauge.operators import counterfactual as C
from sparkgauge.operators import ladder as L
from sparkgauge.operators import metrics as M
from sparkgauge.operators import checks
from sparkgauge.operators import probes as P
from sparkgauge.operators import runs as R
from sparkgauge.operators.skew import hot_join
from sparkgauge.operators.tasks import Matrix, collect_matrix, run
from sparkgauge.plans import oof
from sparkgauge.session import Scratch, table

QUERIES = {}
SQL: dict[str, str] = {}


def sound(*names: str) -> str:
    """A report without a violation."""
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, 0::BIGINT AS violations" for n in names)


#: Axes of the appraisal block of the joint probes, which take the embedding's first columns for it.
A_WIDTH, H_WIDTH = 16, 48
#: Principal axes of the counterfactual space.
AXES = 21
#: Principal axes of the decoder ladder, and draws of every bootstrap here.
LADDER_AXES, DRAWS = 64, 2000


def query(f):
    QUERIES[f.__name__] = f
    return f


def audit(sql: str):
    """A query that counts breaches of what another one promises, with what has to come out."""

    def keep(f):
        SQL[f.__name__] = sql
        return query(f)

    return keep


def appraisal_points(generation: DataFrame) -> DataFrame:
    """(item_id, writer_id, label, x, outer_fold): items with an emotion and all ratings on the scale; folds by a hash of the writer."""
    ok = " and ".join(f"{a} between 1 and 5" for a in APPRAISALS)
    g = generation.where("item_id is not null and writer_id is not null").where(ok).dropDuplicates(["item_id"]).withColumn("label", ordinal(F.col("y_writer"), EMOTIONS)).where("label is not null")
    fold = (F.conv(F.substring(F.sha2("writer_id", 256), 1, 6), 16, 10).cast("bigint") % 5).cast("int")
    return g.select("item_id", "writer_id", "label", F.array(*[F.col(a).cast("double") for a in APPRAISALS]).alias("x"), fold.alias("outer_fold"))


def _appraisals(spark: SparkSession, d: str) -> Matrix:
    return collect_matrix(appraisal_points(table(spark, d, "generation")), "item_id", "x", "label", "writer_id", "outer_fold", 5)


def _embeddings(spark: SparkSession, d: str, blocks: tuple[int, ...] | None = None) -> Matrix:
    p = oof.embedding_points(table(spark, d, "embeddings"))
    return collect_matrix(p, "item_id", "x", "label", "group_id", "outer_fold", 5, blocks=blocks)


def _part(m: Matrix, keep: str) -> Matrix:
    if keep == "AH":
        return m
    s = slice(0, m.blocks[0]) if keep == "A" else slice(m.blocks[0], sum(m.blocks))
    return Matrix(m.item, m.x[:, s], m.y, m.outer, m.inner, m.group, (m.x[:, s].shape[1],))


@query
def appraisal_probe(spark, d):
    """Nested probe of the 21 appraisals on the writer's emotion: metrics of its out-of-fold table."""
    o, _ = P.probe_table(appraisal_points(table(spark, d, "generation")), "item_id", "x", "label", "writer_id", "outer_fold", 5, len(EMOTIONS))
    return M.multiclass(o)


@query
def appraisal_probe_selections(spark, d):
    return P.select_multiclass(spark, _appraisals(spark, d), len(EMOTIONS), metric="macro_f1")


@query
def representation_suite_of_slices(spark, d):
    """Probes of two slices of the embedding, standing for two representations, alone and together, and of the first one's principal axes."""
    m = _embeddings(spark, d, (A_WIDTH, H_WIDTH))
    out = None
    for name, part, pca in (("A", _part(m, "A"), None), ("H", _part(m, "H"), None), ("AH", m, None), ("A-pca8", _part(m, "A"), {0: 8})):
        o, _ = P.nested_multiclass(spark, part, 10, pca=pca)
        r = M.multiclass(o).select(F.lit(name).alias("representation"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def _bits(o: DataFrame, name: str) -> DataFrame:
    return o.select("item_id", "group_id", A.loss_bits(F.element_at("p", F.col("truth") + 1)).alias(name))


@query
def representation_gain_of_slices(spark, d):
    """Paired group bootstrap of the loss of the second slice of the embedding alone less that of both."""
    m = _embeddings(spark, d, (A_WIDTH, H_WIDTH))
    s = Scratch(spark, "gain")
    h, _ = P.nested_multiclass(spark, _part(m, "H"), 10)
    ah, _ = P.nested_multiclass(spark, m, 10)
    j = s.keep(_bits(h, "a").join(_bits(ah, "b").drop("group_id"), "item_id"))
    return B.summarise(B.paired_draws(j, "group_id", "a", "b", DRAWS), j, "a", "b")


@query
def probe_geometry(spark, d):
    m = _appraisals(spark, d)
    selected = Scratch(spark, "selected").keep(P.select_multiclass(spark, m, len(EMOTIONS)))
    return P.fold_geometry(spark, m, len(EMOTIONS), selected)


def sealing(points: DataFrame, validation: DataFrame) -> DataFrame:
    """(item_id, role): validated items, other items of their writers, and the rest."""
    test = validation.where("item_id is not null").select("item_id").distinct().withColumn("_t", F.lit(True))
    p = points.join(test, "item_id", "left")
    writers = p.where("_t").select("writer_id").distinct().withColumn("_w", F.lit(True))
    role = F.when(F.col("_t"), "test").when(F.col("_w"), "excluded_test_writer").otherwise("train")
    return hot_join(p, writers, "writer_id", "left").select("item_id", role.alias("role"))


@query
def sealed_probe(spark, d):
    """Items of the validation table are tested once by a probe that saw none of their writers.

    ``n`` of the ``sealed`` items are tested: all, or none with status ``training_lacks_class`` if the
    other writers, or what an inner fold leaves of them, lack an emotion.
    """
    pts = appraisal_points(table(spark, d, "generation"))
    m = collect_matrix(pts, "item_id", "x", "label", "writer_id", "outer_fold", 5)
    role_of = {r[0]: r[1] for r in sealing(pts, table(spark, d, "validation")).collect()}  # no more than the matrix holds
    role = np.array([role_of[i] for i in m.item])
    test = role == "test"
    train = role == "train"
    parts = [train] + [train & (m.inner[:, 0] != v) for v in np.unique(m.inner[:, 0])]
    if any(len(set(m.y[p])) < len(EMOTIONS) for p in parts):
        return spark.createDataFrame([(0, *[None] * 6, int(test.sum()), "training_lacks_class")], "n bigint, accuracy double, log_loss_bits double, brier double, macro_f1 double, macro_ap double, ece double, sealed bigint, status string")
    tested = M.multiclass(P.sealed_test(spark, m, role, len(EMOTIONS)))
    return tested.select("*", F.lit(int(test.sum())).cast("bigint").alias("sealed"), F.lit("ok").alias("status"))


@query
def cluster_probe(spark, d):
    """Nested multilabel probe of the three affect ratings on the nine clusters, thresholds chosen by fold."""
    cols = [cluster_column(c) for c in CLUSTERS]
    ok = " and ".join([f"{c} in (0, 1)" for c in cols] + [f"{v} between 1 and 5" for v in ("valence", "arousal", "dominance")])
    t = table(spark, d, "tweets").where("item_id is not null and conversation_id is not null").where(ok).dropDuplicates(["item_id"])
    fold = (F.conv(F.substring(F.sha2("conversation_id", 256), 1, 6), 16, 10).cast("bigint") % 5).cast("int")
    t = t.select("item_id", "conversation_id", F.array(*[F.col(v).cast("double") for v in ("valence", "arousal", "dominance")]).alias("x"), F.array(*cols).alias("y"), fold.alias("outer_fold"))
    m = collect_matrix(t, "item_id", "x", "y", "conversation_id", "outer_fold", 5)
    o, _ = P.nested_multilabel(spark, m, len(CLUSTERS))
    return M.multilabel(o, F.col("threshold"))


@query
def decoder_ladder(spark, d):
    """All decoders on the principal axes of the embeddings."""
    o, s = L.ladder(spark, _embeddings(spark, d), 10, pca=LADDER_AXES)
    k = Scratch(spark, "ladder")
    return L.summary(k.keep(o), k.keep(s))


@query
def ladder_contrasts(spark, d):
    o, _ = L.ladder(spark, _embeddings(spark, d), 10, pca=LADDER_AXES)
    return L.contrasts(Scratch(spark, "ladder").keep(o), draws=DRAWS)


@query
def site_placement(spark, d):
    """Where the prototypes of the ladder's clustering decoder lie against the linear decoder's boundaries, over all rows."""
    m = _embeddings(spark, d)
    z = N.principal(m.x, LADDER_AXES)[0](m.x)
    f = L.Fitter(z, m.y, 10)
    return spark.createDataFrame(L.site_diagnostics(z, m.y, f.sites(2, False), *f.linear(1.0)))


@query
def counterfactual_pilot(spark, d):
    return C.pilot(spark, _embeddings(spark, d), sites=10, pca=AXES)


@query
def counterfactual_regressions(spark, d):
    return C.regressions(Scratch(spark, "pilot").keep(C.pilot(spark, _embeddings(spark, d), sites=10, pca=AXES)))


@query
def observed_percentiles(spark, d):
    """One repetition: percentiles take the geometry of the constellations alone, which repetitions don't change."""
    m = _embeddings(spark, d)
    return C.percentiles(C.observed(spark, m, 10, AXES), C.pilot(spark, m, sites=10, pca=AXES, repetitions=1))


@query
def matched_nulls(spark, d):
    m = _embeddings(spark, d)
    return C.null_summary(C.observed(spark, m, 10, AXES), C.nulls(spark, m, 10, pca=AXES))


# what SQL can say of fits: their promises


_OK = " and ".join(f"{a} BETWEEN 1 AND 5" for a in APPRAISALS)
_EMOTIONS = ", ".join(f"'{e}'" for e in EMOTIONS)
_POINTS = f"SELECT DISTINCT ON (item_id) item_id, writer_id, y_writer FROM generation WHERE item_id IS NOT NULL AND writer_id IS NOT NULL AND {_OK}"
_OOF = ("null_item", "repeated_item", "wrong_width", "not_finite", "outside_unit_interval", "not_unit_sum", "truth_out_of_range", "stored_prediction_differs", "group_crosses_folds", "fold_out_of_range")
_SELECTED = ("repeated_fold", "fold_without_selection", "c_not_in_grid", "loss_not_finite", "multiplier_not_in_grid")


@audit(sound(*_OOF, *_SELECTED, "missing_item"))
def probe_audit(spark, d):
    """The appraisal probe's out-of-fold table and selections: every item once, by a fold that its group is not in."""
    s = Scratch(spark, "audit")
    points = s.keep(appraisal_points(table(spark, d, "generation")))
    o, chosen = P.probe_table(points, "item_id", "x", "label", "writer_id", "outer_fold", 5, len(EMOTIONS))
    o = s.keep(R.with_prediction(o))
    lost = checks.summary({"missing_item": checks.difference(points, o, ["item_id"])})
    return R.oof_checks(o, len(EMOTIONS), 5).unionByName(R.selection_checks(chosen, o)).unionByName(lost)


@audit("SELECT unnest(['D0', 'D1', 'D1o', 'D2', 'D3', 'D4', 'D4c', 'D4d']) AS decoder, (SELECT count(*)::BIGINT FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL) AS n_items, true AS once, true AS sums_to_one, 5::BIGINT AS folds, true AS all_inner_folds")
def ladder_audit(spark, d):
    """Each decoder predicts each item once, with probabilities, from folds whose inner folds could all be scored."""
    o, chosen = L.ladder(spark, _embeddings(spark, d), 10, pca=LADDER_AXES)
    s = Scratch(spark, "audit")
    per = s.keep(o).groupBy("decoder").agg(F.count(F.lit(1)).alias("n_items"), (F.countDistinct("item_id") == F.count(F.lit(1))).alias("once"), (F.max(F.abs(A.total(F.col("p")) - 1)) < 1e-9).alias("sums_to_one"), F.countDistinct("outer_fold").alias("folds"))
    inner = chosen.groupBy("decoder").agg(F.min(F.coalesce("inner_folds", F.lit(3)) == 3).alias("all_inner_folds"))
    return per.join(inner, "decoder")


@audit(sound("repeated_row", "geometry_differs", "wrong_counts", "unknown_learner", "score_out_of_range", "no_sample"))
def pilot_audit(spark, d):
    rows = Scratch(spark, "audit").keep(C.pilot(spark, _embeddings(spark, d), sites=10, pca=AXES))
    return R.learnability_checks(rows, 200, 10, C.LEARNERS)


@audit(sound("repeated_draw", "wrong_supports", "entropy_differs", "no_attempt", *[f"{c}_differs" for c in ("draws", "attempts", "p_contrast", "p_representation", "joint_domination")]))
def nulls_audit(spark, d):
    s, m = Scratch(spark, "audit"), _embeddings(spark, d)
    o, n = s.keep(C.observed(spark, m, 10, AXES)), s.keep(C.nulls(spark, m, 10, pca=AXES))
    return R.null_checks(n, o, s.keep(C.null_summary(o, n)), 10)


@audit(sound("wrong_folds", "wrong_classes", "wrong_shape", "not_finite", "no_gauge", "site_differs", "weight_differs", "transform.wrong_folds", "transform.wrong_shape", "transform.scale_not_positive", "transform.not_orthonormal"))
def fold_archive_audit(spark, d):
    """Linear probes and training-only transforms of every fold, stored and checked."""
    m = _embeddings(spark, d)

    def work(t: dict, m: Matrix):
        train = m.outer != t["f"]
        z, axes = N.principal(m.x[train], LADDER_AXES)[0], None
        x = z(m.x[train])
        w, b = N.fit_multinomial(x, m.y[train], 10, 1.0)
        sites, weights = N.power_form(w, b)
        means = N.class_means(x, m.y[train], 10)
        axes = z.rotation.T.tolist()
        return pd.DataFrame([{"outer_fold": t["f"], "class": k, "coefficient": w[k], "intercept": b[k], "site": sites[k], "power_weight": weights[k], "centroid": means[k], "mean": z.mean if not k else None, "scale": z.scale if not k else None, "components": axes if not k else None} for k in range(10)])

    vec = "array<double>"
    got = Scratch(spark, "archive").keep(run(spark, [{"f": f} for f in m.folds], m, work, f"outer_fold int, class int, coefficient {vec}, intercept double, site {vec}, power_weight double, centroid {vec}, mean {vec}, scale {vec}, components array<{vec}>"))
    t = R.transform_checks(got.where("mean is not null").select(*R.TRANSFORM_COLUMNS), 5)
    return R.geometry_checks(got.select(*R.GEOMETRY_COLUMNS), 5, 10).unionByName(t.withColumn("check_name", F.concat_ws(".", F.lit("transform"), "check_name")))


@audit("SELECT unnest(['multinomial', 'multinomial_intercept', 'binary', 'offsets', 'learned_sites', 'power_sites']) AS estimator, true AS at_optimum")
def fit_optimality(spark, d):
    """Whether each estimator's result can't be bettered: the objective's slope along every axis, by differences of values alone."""
    m = _embeddings(spark, d)
    z = N.principal(m.x, 8)[0](m.x)
    y, n, c = m.y, len(m.y), 1.0
    hot, means = np.eye(10)[y], N.class_means(z, y, 10)

    def ce(scores: np.ndarray) -> float:
        return float(-(N.log_softmax(scores) * hot).sum() / n)

    def split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:80].reshape(10, 8), v[80:]

    def linear(both: bool):
        def f(v: np.ndarray) -> float:
            w, b = split(v)
            return ce(z @ w.T + b) + ((w * w).sum() + (b * b).sum() * both) / (2 * c * n)

        return f

    def binary(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2.0 * (y == 0) - 1) * (z @ v[:-1] + v[-1])).mean() + (v[:-1] @ v[:-1]) / (2 * c * n))

    w, b = N.fit_multinomial(z, y, 10, c)
    wi, bi = N.fit_multinomial(z, y, 10, c, intercept_penalty=True)
    wb, bb = N.fit_binary(z, (y == 0).astype(int), c)
    _, o = N.fit_offsets(z, y, 10, 0.1, c)
    s, _ = N.fit_sites(z, y, means[:, None, :].copy(), np.zeros((10, 1)), c, False, "sites", 5000)
    sp, op = N.fit_sites(z, y, means[:, None, :].copy(), np.zeros((10, 1)), c, True, "linear", 5000)
    d2 = lambda mu: -N.squared_distances(z, mu)

    def power(v: np.ndarray) -> float:
        mu, om = split(v)
        tilde = om - (mu * mu).sum(axis=1)
        return ce(d2(mu) + om) + (4 * (mu * mu).sum() + (tilde * tilde).sum()) / (2 * c * n)

    every = {
        "multinomial": (linear(False), np.concatenate([w.ravel(), b])),
        "multinomial_intercept": (linear(True), np.concatenate([wi.ravel(), bi])),
        "binary": (binary, np.append(wb, bb)),
        "offsets": (lambda v: ce(0.1 * d2(means) + v) + (v @ v) / (2 * c * n), o),
        "learned_sites": (lambda v: ce(d2(v.reshape(10, 8))) + (v @ v) / (2 * c * n), s.ravel()),
        "power_sites": (power, np.concatenate([sp.ravel(), op.ravel()])),
    }
    rows = []
    for name, (f, v) in every.items():
        slopes = []
        for i in range(len(v)):
            e = np.zeros(len(v))
            e[i] = 1e-4
            slopes.append((f(v + e) - f(v - e)) / 2e-4)
        rows.append((name, bool(np.abs(slopes).max() < 1e-3)))
    return spark.createDataFrame(rows, "estimator string, at_optimum boolean")


@audit(
    f"""WITH p AS ({_POINTS}), q AS (SELECT * FROM p WHERE y_writer IN ({_EMOTIONS})), v AS (SELECT DISTINCT item_id FROM validation WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT writer_id FROM q WHERE item_id IN (SELECT item_id FROM v))
SELECT CASE WHEN item_id IN (SELECT item_id FROM v) THEN 'test' WHEN writer_id IN (SELECT writer_id FROM w) THEN 'excluded_test_writer' ELSE 'train' END AS role, count(*)::BIGINT AS n FROM q GROUP BY 1"""
)
def sealed_roles(spark, d):
    """Rows of each role of the sealed probe, from the roles that it trains and tests by."""
    pts = appraisal_points(table(spark, d, "generation"))
    return sealing(pts, table(spark, d, "validation")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query
def reader_probe(spark, d):
    """Nested probe of the writers' appraisals on the readers' majority; folds by a hash of the writer.

    One row: the metrics, or none with status ``training_lacks_class`` if an inner training part lacks an emotion.
    """
    v = table(spark, d, "validation").where("item_id is not null").dropDuplicates(["item_id"]).select("item_id", ordinal(F.col("y_reader_majority"), EMOTIONS).alias("read")).where("read is not null")
    pts = appraisal_points(table(spark, d, "generation")).join(v, "item_id")
    m = collect_matrix(pts, "item_id", "x", "read", "writer_id", "outer_fold", 5)
    parts = [(m.outer != f) & (m.inner[:, f] != k) for f in m.folds for k in np.unique(m.inner[:, f])]
    if any(len(set(m.y[p])) < len(EMOTIONS) for p in parts):
        return spark.createDataFrame([(0, *[None] * 6, "training_lacks_class")], "n bigint, accuracy double, log_loss_bits double, brier double, macro_f1 double, macro_ap double, ece double, status string")
    o, _ = P.nested_multiclass(spark, m, len(EMOTIONS))
    return M.multiclass(o).withColumn("status", F.lit("ok"))
