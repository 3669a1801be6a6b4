"""The model queries do the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import numeric as N
from sparkgauge.functions.vocab import C_GRID
from sparkgauge.operators import counterfactual as C
from sparkgauge.operators import ladder as L
from sparkgauge.operators import probes as P
from sparkgauge.operators.tasks import Matrix
from sparkgauge.plans import measures
from sparkgauge.plans import models as Q


def test_counterfactuals_take_the_references_counts(spark, data):
    p = Q.counterfactual_pilot(spark, data).groupBy("outer_fold", "learner").agg(F.countDistinct("constellation_id"), F.countDistinct("repetition"), F.count(F.lit(1))).collect()
    assert len(p) == 10 and {tuple(r)[2:] for r in p} == {(200, 10, 2000)}
    n = Q.matched_nulls(spark, data).collect()
    assert len(n) == 10 and {r["draws"] for r in n} == {1000}
    assert Q.AXES == 21


def test_a_draw_that_is_not_accepted_is_an_error(spark):
    n = 20
    x = np.repeat([[0.0], [1.0]], n // 2, axis=0)  # two distinct places can't give three sites
    clumped = Matrix(np.arange(n), x, np.arange(n) % 3, np.arange(n) % 2, np.zeros((n, 2), dtype=int), np.arange(n), (1,))
    with pytest.raises(Exception, match="constellation 0: no sites"):
        C.pilot(spark, clumped, sites=3, constellations=1, repetitions=1, attempts=5).collect()
    with pytest.raises(Exception, match="not accepted in 5 attempts"):
        C.nulls(spark, clumped, 3, draws=1, attempts=5).collect()
    with pytest.raises(RuntimeError, match="no 1 groups"):
        C.sample_groups(np.array([0, 1]), np.array(["a", "b"]), 2, 1, np.random.default_rng(1), attempts=5)


def test_sealed_items_are_all_tested_or_none(spark, data):
    r = Q.sealed_probe(spark, data).first()
    assert (r["n"], r["sealed"], r["status"], r["macro_f1"]) == (0, 132, "training_lacks_class", None)


def test_cluster_probe_searches_the_whole_grid(spark, data, monkeypatch):
    seen = []
    run = P.run
    monkeypatch.setattr(P, "run", lambda s, tasks, *a: seen.append(tasks) or run(s, tasks, *a))
    Q.cluster_probe(spark, data)
    assert {t["c"] for t in seen[0]} == set(C_GRID) and len(C_GRID) == 7


class Seen(Exception):
    pass


def test_ladder_and_bootstraps_are_whole(spark, data, monkeypatch):
    def stop(*a, **k):
        raise Seen(a, k)

    monkeypatch.setattr(Q.L, "ladder", stop)
    for q in (Q.decoder_ladder, Q.ladder_contrasts):
        with pytest.raises(Seen) as e:
            q(spark, data)
        assert e.value.args[1] == {"pca": 64}
    monkeypatch.setattr(measures.B, "hash_multiplicities", stop)
    for q in (measures.category_rank_stability, measures.rank_association_draws):
        with pytest.raises(Seen) as e:
            q(spark, data)
        assert e.value.args[0][2] == 2000


def blobs(seed=1, n=90, d=3, k=3):
    r = np.random.default_rng(seed)
    y = np.arange(n) % k
    return r.normal(size=(n, d)) + 1.5 * np.eye(k, d)[y], y


def test_learned_sites_minimise_their_own_ridge():
    """D2 charges half of |site|^2 / (C n): plain gradient descent on that objective, written out here, ends at the same sites."""
    x, y = blobs()
    n, k, c = len(y), 3, 0.5

    def loss(mu):
        s = -((x[:, None, :] - mu[None]) ** 2).sum(2)
        s = s - s.max(1, keepdims=True)
        p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
        r = p.copy()
        r[np.arange(n), y] -= 1
        return -np.log(p[np.arange(n), y]).mean() + (mu**2).sum() / (2 * c * n), 2 * (r[:, :, None] * (x[:, None, :] - mu[None])).sum(0) / n + mu / (c * n)

    mu = N.class_means(x, y, k)
    for _ in range(6000):
        mu = mu - 0.2 * loss(mu)[1]
    s, _ = N.fit_sites(x, y, N.class_means(x, y, k)[:, None, :], np.zeros((k, 1)), c, free_weights=False, ridge="sites")
    assert np.abs(loss(mu)[1]).max() < 1e-6 and np.allclose(s[:, 0], mu, atol=2e-3) and abs(loss(s[:, 0])[0] - loss(mu)[0]) < 1e-6
    got = L.Fitter(x, y, k).scores("D2", x, c=c)
    assert np.allclose(got, N.site_scores(x, s, np.zeros((k, 1)), 1.0))
    other, _ = N.fit_sites(x, y, N.class_means(x, y, k)[:, None, :], np.zeros((k, 1)), c, free_weights=False)
    assert not np.allclose(other[:, 0], mu, atol=1e-2)


@pytest.mark.parametrize("ridge,free", [("sites", False), ("linear", True), ("linear", False)])
def test_site_gradients(ridge, free):
    x, y = blobs(2)
    f = N.site_loss(x, y, (3, 2, 3), np.zeros((3, 2)), 0.3, free, ridge)
    v = np.random.default_rng(3).normal(size=18 + 6 * free)
    g = f(v)[1]
    for i in range(len(v)):
        e = np.zeros(len(v))
        e[i] = 1e-6
        assert abs((f(v + e)[0] - f(v - e)[0]) / 2e-6 - g[i]) < 1e-5


def test_a_failed_search_has_not_converged():
    """A gradient that points the wrong way: no step is lower, and the fit says so."""
    _, _, ok = N.minimise(lambda v: (float(v @ v), -2 * v), np.ones(2))
    assert not ok
    _, _, ok = N.minimise(lambda v: (float(v @ v), 2 * v), np.ones(2))
    assert ok
    with pytest.raises(N.NotConverged):
        x, y = blobs(4)
        N.fit_multinomial(x, y, 3, 1e6, rounds=2)


def test_absent_classes_get_no_probability():
    x, y = blobs(5)
    f = L.Fitter(x[y < 2], y[y < 2], 3)
    for d, a in (("D1", {"gamma": 1.0}), ("D2", {"c": 1.0}), ("D3", {"c": 1.0}), ("D4", {"gamma": 1.0, "m": 2})):
        p = N.softmax(f.scores(d, x, **a))
        assert p[:, 2].max() == 0 and np.allclose(p.sum(1), 1)


def test_probes_by_size_agree(spark):
    x, y = blobs(7, n=180)
    rows = [(i, v.tolist(), int(k), f"g{i // 3}", (i // 3) % 2) for i, (v, k) in enumerate(zip(x * [1, 10, 0.1] + 3, y))]
    df = spark.createDataFrame(rows, "item_id bigint, x array<double>, label int, grp string, fold int")
    grid = (0.01, 1.0)
    got = {}
    for most in (1 << 30, 0):
        o, s = P.probe_table(df, "item_id", "x", "label", "grp", "fold", 2, 3, grid, most=most)
        got[most] = ({r["item_id"]: r["p"] for r in o.collect()}, sorted((r["outer_fold"], r["c"]) for r in s.collect()))
    (a, sa), (b, sb) = got.values()
    assert sa == sb and a.keys() == b.keys() and len(a) == 180
    assert max(np.abs(np.array(a[k]) - b[k]).max() for k in a) < 5e-3
