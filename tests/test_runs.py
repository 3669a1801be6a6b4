"""Runs as artifacts: publishing, validation of tampered tables, batches, archives, and the command line around them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge import cli
from sparkgauge.functions import numeric as N
from sparkgauge.operators import embed, folds, runs
from sparkgauge.operators import probes as P
from sparkgauge.operators.checks import ConstraintError
from sparkgauge.operators.tasks import Matrix
from sparkgauge.plans import dag
from sparkgauge.sources import models, release, store


def matrix(n=60, seed=3):
    r = np.random.default_rng(seed)
    y = np.arange(n) % 3
    x = r.normal(size=(n, 2)) + 2 * np.eye(3, 2)[y]
    group = np.array([f"g{i // 3}" for i in range(n)])
    outer = (np.arange(n) // 3) % 2
    inner = np.column_stack([(np.arange(n) // 6) % 2] * 2)
    return Matrix(np.array([f"i{i:02d}" for i in range(n)]), x, y, outer, inner, group, (2,))


GRID = (0.1, 1.0)


def probe(spark, seed=3):
    return P.nested_multiclass(spark, matrix(seed=seed), 3, GRID)


def bad(report):
    return {r["check_name"] for r in report.where("violations > 0").collect()}


def test_run_artifacts(spark, tmp_path):
    at = str(tmp_path / "run")
    o, s = probe(spark)
    runs.publish_run(at, o, s, 3, {"seed": 3}, GRID)
    assert runs.validate_run(spark, at)["classes"] == 3
    assert runs.resume_run(spark, at, {"seed": 3}, None, 3, GRID)["request"] == {"seed": 3}
    with pytest.raises(ConstraintError, match="another request"):
        runs.resume_run(spark, at, {"seed": 4}, None, 3, GRID)
    with pytest.raises(FileExistsError):
        runs.publish_run(at, o, s, 3, {}, GRID)
    with pytest.raises(ConstraintError, match="c_not_in_grid"):
        runs.publish_run(str(tmp_path / "other"), o, s.withColumn("c", F.lit(0.5)), 3, {}, GRID)
    assert not store.exists(spark, str(tmp_path / "other"))


def test_tampered_tables_are_found(spark):
    o, s = probe(spark)
    o = runs.with_prediction(o).cache()
    assert not bad(runs.oof_checks(o, 3, 2)) and not bad(runs.selection_checks(s, o, GRID))
    one = F.col("item_id") == "i00"
    cases = {
        "stored_prediction_differs": o.withColumn("predicted", F.when(one, (F.col("predicted") + 1) % 3).otherwise(F.col("predicted"))),
        "repeated_item": o.unionByName(o.where(one)),
        "wrong_width": o.withColumn("p", F.when(one, F.slice("p", 1, 2)).otherwise(F.col("p"))),
        "not_unit_sum": o.withColumn("p", F.when(one, F.transform("p", lambda x: x / 2)).otherwise(F.col("p"))),
        "outside_unit_interval": o.withColumn("p", F.when(one, F.transform("p", lambda x: x - 2)).otherwise(F.col("p"))),
        "truth_out_of_range": o.withColumn("truth", F.when(one, 7).otherwise(F.col("truth"))),
        "group_crosses_folds": o.withColumn("outer_fold", F.when(one, 1 - F.col("outer_fold")).otherwise(F.col("outer_fold"))),
        "null_item": o.withColumn("item_id", F.when(~one, F.col("item_id"))),
    }
    for name, df in cases.items():
        assert name in bad(runs.oof_checks(df, 3, 2)), name
    assert "fold_without_selection" in bad(runs.selection_checks(s.limit(1), o, GRID))
    m = runs.M.multiclass(o)
    assert not bad(runs.metric_checks(m, o)) and "metric_brier" in bad(runs.metric_checks(m.withColumn("brier", F.col("brier") + 0.01), o))


def test_draws_and_archives(spark):
    draws = spark.createDataFrame([(i, i / 10) for i in range(11)], "draw int, delta double")
    stored = spark.createDataFrame([(0.025, 0.975, float(np.std([i / 10 for i in range(11)], ddof=1)), 11)], "ci_low double, ci_high double, se double, draws int")
    assert not bad(runs.draw_checks(draws, stored))
    assert bad(runs.draw_checks(draws, stored.withColumn("se", F.lit(0.5)).withColumn("ci_low", F.lit(2.0)))) == {"se_differs", "ci_low_differs", "interval_reversed"}
    m = matrix()
    w, b = N.fit_multinomial(m.x, m.y, 3, 1.0)
    g = runs.geometry_rows(spark, 0, w, b, N.class_means(m.x, m.y, 3))
    assert not bad(runs.geometry_checks(g, 1, 3))
    assert bad(runs.geometry_checks(g.withColumn("power_weight", F.col("power_weight") + 1), 1, 3)) == {"weight_differs"}
    assert "no_gauge" in bad(runs.geometry_checks(g.withColumn("intercept", F.col("intercept") + 1), 1, 3))
    with pytest.raises(ConstraintError):
        runs.geometry_checks(g.drop("site"), 1, 3)
    t = N.principal(m.x, 2)[0]
    rows = runs.transform_rows(spark, 0, t.mean, t.scale, t.rotation.T)
    assert not bad(runs.transform_checks(rows, 1))
    assert bad(runs.transform_checks(rows.withColumn("components", F.transform("components", lambda c: F.transform(c, lambda x: 2 * x))), 1)) == {"not_orthonormal"}


def test_suite_pairs_null_keys_and_refuses_unlike_tables(spark):
    rows = []
    for path, rep, layer in (("h", "H", None), ("ah", "AH", None), ("h5", "H", "5")):
        for i in range(6):
            p = [0.6, 0.4] if rep == "H" else [0.8, 0.2]
            rows.append((path, rep, None, "m", layer, None, None, None, f"i{i}", 0, f"g{i // 2}", 0, p))
    schema = "run_path string, representation string, target_scale string, model_key string, layer string, pooling string, rater_role string, pca_dimension string, item_id string, outer_fold int, group_id string, truth int, p array<double>"
    df = spark.createDataFrame(rows, schema)
    got = runs.suite_contrasts(df, 50).collect()
    assert [(r["path_a"], r["path_b"], r["layer"], r["draws"], r["n_items"]) for r in got] == [("h", "ah", None, 50, 6)]
    assert abs(got[0]["observed"] - np.log2(0.8 / 0.6)) < 1e-9
    s = {r["run_path"]: r["observed"] for r in runs.suite(df, 50).collect()}
    assert s["h5"] is None and s["h"] == s["ah"] == got[0]["observed"]
    with pytest.raises(ConstraintError, match="differ"):
        runs.suite_contrasts(df.where("run_path <> 'ah' or item_id <> 'i3'"), 50)


def test_batches_and_layer_summaries(spark, tmp_path):
    root = str(tmp_path / "batch")
    (tmp_path / "batch").mkdir()
    jobs = [{"representation": r, "model_key": "m", "layer": k} for r, k in (("H", "1"), ("AH", "1"))]
    made = []
    build = lambda j: made.append(j) or probe(spark, 3 if j["representation"] == "H" else 4)
    first = runs.run_batch(spark, root, jobs, build, 3, GRID)
    assert runs.run_batch(spark, root, jobs, build, 3, GRID) == first and len(made) == 2
    loaded = runs.load_runs(spark, root, first)
    assert loaded.count() == 120 and runs.suite_summary(loaded).count() == 2
    summary = spark.createDataFrame([(1, 0.5, 1.0), (0, 0.4, 1.2)], "layer int, macro_f1 double, log_loss_bits double")
    runs.write_layer_summary(summary, str(tmp_path / "s.csv"))
    assert runs.read_layer_summary(spark, str(tmp_path / "s.csv"), 2).count() == 2
    with pytest.raises(ConstraintError, match="missing_or_unexpected_layer"):
        runs.read_layer_summary(spark, str(tmp_path / "s.csv"), 3)
    assert bad(runs.provenance_checks(spark.createDataFrame([(0, "r1", "x"), (1, "r2", "x")], "layer int, revision string, mode string"), ["revision", "mode"])) == {"revision_disagrees"}


def test_factories_reach_the_tasks(spark):
    class Prior:
        def __init__(self, c):
            self.c = c

        def __call__(self, x, y, classes):
            p = np.bincount(y, minlength=classes) / len(y)
            return lambda new: np.tile(p, (len(new), 1))

    o, s = P.nested_multiclass(spark, matrix(), 3, GRID, factory=P.of_c(Prior))
    assert {tuple(np.round(r["p"], 6)) for r in o.collect()} == {(0.333333, 0.333333, 0.333333)} and {r["c"] for r in s.collect()} == {0.1}
    m = matrix()
    with pytest.raises(ValueError, match="out of range"):
        P.require_targets(m, classes=2)
    with pytest.raises(ValueError, match="0 or 1"):
        P.require_targets(m, labels=1)


def test_groups_are_reconciled(spark):
    outer = spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, test_fold int")
    inner = spark.createDataFrame([("a", "g"), ("b", "h")], "item_id string, group_id string")
    assert sorted(map(tuple, folds.reconcile_groups(outer, inner).collect())) == [("a", "g"), ("b", "h")]
    with pytest.raises(ConstraintError, match="two groups"):
        folds.reconcile_groups(outer, inner, spark.createDataFrame([("a", "z")], "item_id string, group_id string"))
    with pytest.raises(ConstraintError, match="without a group"):
        folds.reconcile_groups(outer, inner.limit(1))
    with pytest.raises(folds.TooFewGroups):
        folds.require_groups(spark.createDataFrame([("g1", 1), ("g1", 1), ("g2", 0)], "g string, c int"), "g", ["c"], 2)


def test_coarse_profiles_place_every_group(spark):
    rows = [(f"g{i}", i % 7, (i * 3) % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "group_id string, a int, b int")
    for most in (1000, 12, 9):
        got = folds.group_folds(df, "group_id", ["a", "b"], 5, most=most).collect()
        assert len(got) == 400 and {r["fold"] for r in got} == set(range(5))
        n = np.bincount([r["fold"] for r in got])
        assert n.min() >= 60
    with pytest.raises(ValueError):
        folds.group_folds(df, "group_id", ["a", "b"], 5, most=2)


def test_encoders(spark, tmp_path):
    e = embed.random_control(1, 3, 8, 6, 64)
    assert e.fingerprint() == embed.random_control(1, 3, 8, 6, 64).fingerprint() != embed.random_control(2, 3, 8, 6, 64).fingerprint()
    run = e.frozen(e.fingerprint())
    s = run(["a b c d e f g", "x"])
    assert s.hidden.shape == (3, 2, 6, 8) and s.truncated.tolist() == [True, False]
    with pytest.raises(ValueError):
        e.frozen("0" * 64)
    with pytest.raises(ValueError):
        e.parameters["table"][0] = 0
    df = spark.createDataFrame([("i1", "a b", "m b"), ("i2", "c", "c"), ("i3", None, None)], "item_id string, generated_text string, hidden_emo_text string")
    texts = embed.choose_text(df, "original")
    at = str(tmp_path / "e")
    build = lambda: embed.random_control(1, 3, 8, 6, 64).frozen()
    meta = embed.extract_to(texts, at, build, {"seed": 1})
    assert embed.extract_to(texts, at, build, {"seed": 1}) == meta and meta["tables"]["layers"]["rows"] == 12
    with pytest.raises(ConstraintError):
        embed.extract_to(texts, at, build, {"seed": 2})
    back = store.load(spark, at, "layers")
    assert not bad(embed.truncation_checks(back, 3)) and not bad(embed.store_checks(back, df.where("generated_text is not null"), 3, 8))
    want = {tuple(r) for r in store.load(spark, at, "digests").collect()}
    assert len(want) == 6 and {tuple(r) for r in embed.layer_digests(back.repartition(5)).select("pooling", "layer", "items", "sha256").collect()} == {(p, k, n, h) for p, k, n, h in want}
    with pytest.raises(ValueError):
        embed.choose_text(df, "neither")


def test_registry_release_and_graph(spark, tmp_path):
    assert models.pinned("roberta-base").layers == 13
    with pytest.raises(ConstraintError):
        models.pinned("unknown")
    models.lock_tokenizer(tmp_path / "cache", True)
    models.lock_tokenizer(tmp_path / "cache", True)
    with pytest.raises(ConstraintError):
        models.lock_tokenizer(tmp_path / "cache", False)
    (tmp_path / "README.md").write_text("x")
    (tmp_path / "k.py").write_text("token = 'AKIA" + "A" * 16 + "'")
    (tmp_path / "SUMS").write_text("0" * 64 + "  README.md\n")
    got = release.problems(tmp_path, ["README.md", "k.py", "gone.txt"], ("README.md", "LICENSE"), sums="SUMS")
    assert got == [("LICENSE", "missing"), ("README.md", "missing or changed"), ("gone.txt", "listed but missing"), ("k.py", "looks like a secret")]
    steps = [dag.Step("b", lambda s, r, d: {"t": store.load(s, f"{r}/a", "t")}, ("a",)), dag.Step("a", lambda s, r, d: {"t": s.range(3)}), dag.Step("c", lambda s, r, d: {"t": s.range(1)})]
    root = str(tmp_path)
    assert dag.run(spark, steps, root, "x", ["b"]) == ["a", "b"] and dag.run(spark, steps, root, "x") == ["c"]
    with pytest.raises(KeyError):
        dag.order(steps, ["zzz"])
    names = [s.name for s in dag.order(dag.experiments())]
    assert names.index("splits") < names.index("ladder") < names.index("ladder-contrasts")


def test_command_line(spark, tmp_path, data, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    assert set(cli.ANALYSES.values()) <= set(cli.QUERIES)
    cli.main(["models"])
    assert "roberta-base" in json.loads(capsys.readouterr().out)
    cli.main(["query", "label_support", data, "--output", str(tmp_path / "q")])
    cli.main(["index", str(tmp_path)])
    assert [r["path"] for r in json.loads(capsys.readouterr().out)] == ["q"]
    cli.main(["sites", data])
    cli.main(["lock", str(tmp_path / "q" / "metadata.json")])
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
