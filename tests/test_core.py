"""Hand-computed cases of the core operators."""

import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import arrays as A
from sparkgauge.functions import numeric as N
from sparkgauge.functions import text as T
from sparkgauge.functions.vocab import APPRAISALS, CLUSTERS, EMOTIONS, LABEL_CLUSTER
from sparkgauge.operators import bootstrap as B
from sparkgauge.operators import checks, components, folds, ingest
from sparkgauge.operators import counterfactual as C
from sparkgauge.operators import geometry as G
from sparkgauge.operators import metrics as M
from sparkgauge.operators.tasks import fit_distributed
from sparkgauge.sources import corpora, digests, store


def near(a, b, tol=1e-9):
    return abs(a - b) <= tol


def test_vocabularies():
    assert (len(EMOTIONS), len(APPRAISALS), len(CLUSTERS), len(LABEL_CLUSTER)) == (13, 21, 9, 28)
    assert set(LABEL_CLUSTER.values()) <= set(CLUSTERS)


def test_normalize(spark):
    assert T.normalize("  A ...   EVENT ") == "a ... event"
    assert T.normalize("Ｆｕｌｌ&amp;\n\tSTRASSE ß") == "full& strasse ss"
    df = spark.createDataFrame([("  A ...   EVENT ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.normalized_text(F.col("t"))).collect()] == ["a ... event", None, ""]


def test_reliability(spark):
    df = spark.createDataFrame([(0.8, 1), (0.6, 0)], "c double, k int")
    assert near(M.calibration_error(M.reliability(df, F.col("c"), F.col("k"))).first()["ece"], 0.4)
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.1000001, 0), (0.2, 1), (1.0, 0)], "c double, k int")
    got = {r["bin"]: r["n"] for r in M.reliability(df, F.col("c"), F.col("k")).collect()}
    assert got == {0: 2, 1: 2, 9: 1}
    odd = spark.createDataFrame([(0.30000000000000004,)], "c double")
    assert odd.select(M.bin_of(F.col("c"))).first()[0] == 2


def test_multiclass(spark):
    rows = [("a", 0, [0.8, 0.1, 0.1]), ("b", 1, [0.1, 0.8, 0.1]), ("c", 2, [0.1, 0.1, 0.8])]
    r = M.multiclass(spark.createDataFrame(rows, "item_id string, truth int, p array<double>")).first()
    assert near(r["accuracy"], 1) and near(r["macro_f1"], 1) and near(r["log_loss_bits"], -np.log2(0.8))
    assert near(r["brier"], 0.06) and near(r["ece"], 0.2) and near(r["macro_ap"], 1)
    absent = spark.createDataFrame(rows[:2], "item_id string, truth int, p array<double>")
    c = {x["class"]: x for x in M.classwise(absent).collect()}
    assert c[2]["support"] == 0 and c[2]["f1"] == 0 and c[2]["average_precision"] == 0
    assert near(M.multiclass(absent).first()["macro_f1"], 2 / 3)
    two = spark.createDataFrame([("a", 0, [0.8, 0.2]), ("b", 0, [0.3, 0.7])], "item_id string, truth int, p array<double>")
    assert [round(x["true_gap"], 9) for x in M.items(two).orderBy("item_id").collect()] == [0.6, -0.4]


def test_weights_equal_repetition(spark):
    rows = [("a", 0, [0.8, 0.2], 2), ("b", 1, [0.6, 0.4], 1), ("c", 1, [0.3, 0.7], 3)]
    one = M.classwise(spark.createDataFrame(rows, "item_id string, truth int, p array<double>, m int"), weight="m")
    many = M.classwise(spark.createDataFrame([r[:3] for r in rows for _ in range(r[3])], "item_id string, truth int, p array<double>"))
    x, y = (sorted(map(tuple, d.select("class", "support", "f1", "average_precision", "loss_bits", "ece").collect())) for d in (one, many))
    assert np.allclose(np.array(x), np.array(y))


def test_multilabel(spark):
    rows = [("i0", [1, 0], [0.9, 0.2]), ("i1", [0, 1], [0.1, 0.8]), ("i2", [1, 0], [0.4, 0.3]), ("i3", [0, 1], [0.2, 0.7])]
    r = M.multilabel(spark.createDataFrame(rows, "item_id string, y array<int>, p array<double>")).first()
    assert near(r["macro_f1"], 5 / 6) and near(r["macro_ap"], 1) and near(r["exact_match"], 0.75) and near(r["hamming_accuracy"], 0.875)


def test_tied_scores_count_at_once(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.4, 1)], "s double, y int").withColumn("class", F.lit(0))
    assert near(M.average_precision(df, ["class"]).first()["average_precision"], 0.5 * 0.5 + 0.5 * 2 / 3)


def sites(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "site int, x array<double>")


def points(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "point int, x array<double>")


def test_contrast_and_representation(spark):
    r = G.contrast(sites(spark, [(0, 0), (3, 0), (0, 4)])).first()
    assert near(r["contrast_sum"], 12) and near(r["contrast_mean"], 4)
    s, p = sites(spark, [(0,), (10,)]), points(spark, [(0,), (2,), (8,), (10,)])
    assert [x["cell"] for x in G.assign(p, s).orderBy("point").collect()] == [0, 0, 1, 1]
    r = G.representation(p, s).first()
    assert near(r["representation_sum"], 2) and near(r["representation_mean"], 1)
    tie = G.assign(points(spark, [(1,), (0,), (2,)]), sites(spark, [(0,), (2,)])).orderBy("point")
    assert [x["cell"] for x in tie.collect()] == [0, 0, 1]
    lone = points(spark, [(0,), (1,)])
    assert G.representation(lone, s).first()["representation_sum"] is None
    with pytest.raises(G.EmptyCell):
        G.require_cells(G.assign(lone, s), s)


def test_power_diagram_is_the_linear_argmax(spark):
    rng = np.random.default_rng(1)
    w, b, x = rng.normal(size=(4, 3)), rng.normal(size=4), rng.normal(size=(60, 3))
    lin = spark.createDataFrame([(i, w[i].tolist(), float(b[i])) for i in range(4)], "site int, w array<double>, b double")
    cells = G.assign(points(spark, x), G.power_diagram(lin), weight="weight").orderBy("point").collect()
    assert [c["cell"] for c in cells] == (x @ w.T + b).argmax(1).tolist()
    s, o = N.power_form(w, b)
    assert (N.nearest_site(x, s, o) == (x @ w.T + b).argmax(1)).all()


def test_neighbours(spark):
    train = np.array([[0.0], [2], [10]])
    assert N.neighbour_predict(train, np.array([0, 1, 2]), np.array([[0.0], [1.9], [9.8]]), 3, 2).tolist() == [0, 1, 2]
    assert N.neighbour_predict(np.array([[-1.0], [1], [3]]), np.array([2, 1, 0]), np.array([[0.0]]), 3, 1).tolist() == [2]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4)).round(1)
    test = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "test_id bigint, x array<double>")
    tr = spark.createDataFrame([(i, x[i].tolist()) for i in range(30, 90)], "train_id bigint, x array<double>")
    got = {}
    for r in G.nearest(test, tr, 3, block=16).collect():
        got.setdefault(r["test_id"], []).append((round(r["d2"], 9), r["train_id"]))
    for i in range(30):
        want = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), j) for j in range(30, 90))[:3]
        assert sorted(got[i]) == want


def test_partition_agreement_matches_the_kernel(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, 200), rng.integers(0, 4, 200)
    r = M.partition_agreement(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), "a", "b", 4).first()
    for k, v in N.agreement(a, b, 4).items():
        assert near(r[k], v)


def test_array_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [[1.0, 1.0], [5.0, 9.0], [3.0, 3.0]], [True, False, True])], "s array<double>, v array<array<double>>, k array<boolean>")
    r = df.select(A.softmax(F.col("s")).alias("p"), A.log_sum_exp(F.col("s")).alias("l"), A.masked_mean(F.col("v"), F.col("k")).alias("m"), A.entropy_bits(F.array(F.lit(2), F.lit(2), F.lit(0))).alias("h")).first()
    assert np.allclose(r["p"], N.softmax(np.array([[1.0, 2, 3]]))[0]) and near(r["l"], np.log(np.exp([1, 2, 3]).sum())) and r["m"] == [2.0, 2.0] and near(r["h"], 1)


def judgments(spark, rows):
    return spark.createDataFrame([("10", f"r{i}", lab, conf) for i, (lab, conf) in enumerate(rows)], "item_id string, reader_id string, y_reader string, reader_confidence int")


def test_vote(spark):
    r = ingest.aggregate_readers(judgments(spark, [("joy", 2), ("joy", 2), ("anger", 5), ("anger", 5), ("fear", 3)])).first()
    assert r["y_reader_majority"] == "anger" and r["reader_majority_tie"] and near(r["reader_prob__joy"], 0.4) and near(r["reader_prob__fear"], 0.2)
    assert r["reader_labels"] == ["joy", "joy", "anger", "anger", "fear"]
    r = ingest.vote(judgments(spark, [("joy", 3), ("fear", 3)])).first()
    assert r["y_reader_majority"] == "fear" and r["reader_majority_tie"]
    r = ingest.vote(judgments(spark, [("joy", 3), ("joy", None), ("fear", 5), ("strange", 5)])).first()
    assert r["y_reader_majority"] == "joy" and not r["reader_majority_tie"]


def test_panels(spark):
    j = judgments(spark, [("joy", 1)] * 5)
    p = ingest.panels(j).groupBy("reader_panel").count().collect()
    assert {r["reader_panel"]: r["count"] for r in p} == {"appraisal": 2, "emotion": 3}
    assert sorted(map(tuple, ingest.panels(j).collect())) == sorted(map(tuple, ingest.panels(j.repartition(3)).collect()))


def conversation(i):
    e = {"valence": 1, "arousal": 5, "dominance": 2, "emo_clusters": ["Annoyance", "Anger"], "emo_labels": ["Annoyance", "Anger"]}
    n = {**e, "emo_clusters": ["Neutral"], "emo_labels": ["Neutral"]}
    return {"id": i, "company": "c", "turns": [{"is_made_by_customer": True, "emotions": n, "tweets": [{"text": "x", "emotions": n}, {"text": "y", "emotions": e}]}, {"is_made_by_customer": False, "emotions": n, "tweets": [{"text": "z", "emotions": n}]}]}


def test_flatten_and_zip(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([conversation(2), conversation(10)]))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.write(tmp_path / "c.json", "full/c.json")
    rows = ingest.flatten(corpora.read_zipped_conversations(spark, tmp_path / "c.zip", "c.json", str(tmp_path / "w") if (tmp_path / "w").mkdir() is None else "")).orderBy("item_id").collect()
    assert [r["item_id"] for r in rows] == ["10:0:0", "10:0:1", "2:0:0", "2:0:1"]
    assert rows[1]["emo_clusters"] == ["Anger", "Annoyance"] and rows[1]["y__anger"] == 1 and rows[1]["y__joy"] == 0
    with pytest.raises(checks.ConstraintError):
        corpora.unzip_members(tmp_path / "c.zip", ["other.json"], tmp_path)


def test_read_tsv(spark, tmp_path):
    head = ["round_number", "emotion", "text_id", "prolific_id", "generated_text", "hidden_emo_text", *APPRAISALS]
    lines = ["\t".join(head)] + ["\t".join([str(1), e, str(i), f"writer-{i}", f'"A ""quoted""\nline {i}"', "An ... event", *["3"] * 21]) for i, e in ((10, "joy"), (11, "anger"))]
    (tmp_path / "g.tsv").write_text("\n".join(lines) + "\n")
    raw = corpora.generation_rows(corpora.read_tsv(spark, tmp_path / "g.tsv", corpora.GENERATION))
    got = {r["item_id"]: r for r in ingest.canonical_generation(raw).collect()}
    assert sorted(got) == ["10", "11"] and got["10"]["generated_text"] == 'A "quoted"\nline 10' and got["10"]["normalized_text_duplicate"] and got["10"]["effort"] == 3


def test_cluster_rules(spark):
    df = spark.createDataFrame([(["Neutral", "Disapproval"],), (["Curiosity"],), (["Joy", "Sadness", "Joy"],), ([],)], "l array<string>")
    assert [r[0] for r in df.select(ingest.expected_clusters(F.col("l"))).collect()] == [["Annoyance"], ["Neutral"], ["Disappointment", "Joy"], []]


def test_label_support_is_inclusive(spark):
    df = spark.createDataFrame([(1, 1)] * 99 + [(1, 0)] + [(0, 0)] * 50, "a int, b int")
    got = {r["label"]: (r["positives"], r["negatives"], r["eligible"]) for r in ingest.label_support(df, ["a", "b"]).collect()}
    assert got == {"a": (100, 50, True), "b": (99, 51, False)}


def test_checks(spark):
    df = spark.createDataFrame([("a", "3", 1.0), ("b", "6", 0.5), ("c", "x", None), (None, "2.5", 2.0)], "k string, r string, p double")
    got = {r["check_name"]: r["violations"] for r in checks.report(df, [checks.missing("k"), checks.rating("r"), checks.unit_interval("p"), checks.outside("k", ["a"])]).collect()}
    assert got == {"missing_k": 1, "rating_r": 3, "interval_p": 2, "vocabulary_k": 2}
    with pytest.raises(checks.ConstraintError, match="rating_r: 3 rows"):
        checks.enforce(df, [checks.rating("r")], ["k"])
    assert checks.enforce(df.limit(1), [checks.rating("r")], ["k"]).count() == 1


def test_components(spark):
    rows = [("c", "w1", "unique"), ("a", "w1", " Same  TEXT "), ("b", "w2", "same text"), ("d", "w3", "other"), ("e", None, None), ("e", None, None)]
    df = spark.createDataFrame(rows, "item_id string, writer_id string, t string")
    got = {r["item_id"]: r["group_id"] for r in components.duplicate_components(df, "item_id", "writer_id", T.normalized_text(F.col("t"))).collect()}
    assert got["a"] == got["b"] == got["c"] == "component-8badde10c760e9b7" and len({got["a"], got["d"], got["e"]}) == 3
    assert components.duplicate_components(df.limit(0), "item_id", "writer_id", F.col("t")).count() == 0


def test_group_folds(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{i // 3}", int(rng.integers(0, 3))) for i in range(600)]
    df = spark.createDataFrame(rows, "group_id string, y int").select("group_id", *[(F.col("y") == k).cast("int").alias(f"c{k}") for k in range(3)])
    f = folds.group_folds(df, "group_id", ["c0", "c1", "c2"], 5)
    assert f.count() == 200 == f.select("group_id").distinct().count()
    sizes = df.join(f, "group_id").groupBy("fold").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(3)]).toPandas()
    for k in range(3):
        assert sizes[f"c{k}"].max() - sizes[f"c{k}"].min() <= 6
    again = folds.group_folds(df.repartition(7), "group_id", ["c0", "c1", "c2"], 5)
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, again.collect()))


def test_nested_folds_pass_their_checks(spark):
    df = spark.createDataFrame([(f"i{i}", f"g{i // 2}", f"w{i // 2}", i % 2) for i in range(120)], "item_id string, group_id string, writer_id string, y int").selectExpr("*", "1 - y as n")
    o, i = folds.nested_folds(df, "group_id", ["y", "n"])
    outer = df.join(o, "group_id")
    inner = i.join(df.select("item_id", "group_id"), "group_id")
    assert all(r["violations"] == 0 for r in folds.outer_checks(outer, df, "writer_id").collect())
    assert all(r["violations"] == 0 for r in folds.inner_checks(outer, inner).collect())
    bad = inner.withColumn("group_id", F.when(F.col("item_id") == "i3", "g99").otherwise(F.col("group_id")))
    assert {r["check_name"]: r["violations"] for r in folds.inner_checks(outer, bad).collect()}["group_differs"] == 4


def test_external_roles(spark):
    df = spark.createDataFrame([("t", "w1", "g1"), ("s", "w1", "g2"), ("d", "w2", "g1"), ("x", "w3", "g3")], "item_id string, writer_id string, group_id string")
    r = folds.external_roles(df, spark.createDataFrame([("t",)], "item_id string"), "item_id", "writer_id", "group_id")
    assert {x["item_id"]: x["role"] for x in r.collect()} == {"t": "test", "s": "excluded_test_writer", "d": "excluded_test_duplicate", "x": "train"}


@pytest.mark.parametrize("mode", ["hash", "numpy"])
def test_bootstrap(spark, mode):
    five = spark.createDataFrame([(f"i{i}", g, float(b + 1), float(b)) for i, (g, b) in enumerate(zip(["w1", "w1", "w2", "w3", "w3"], [0, 2, 4, 6, 8]))], "item_id string, group_id string, a double, b double")
    d = B.paired_draws(five, "group_id", "a", "b", 40, mode=mode)
    assert {round(r["delta"], 9) for r in d.collect()} == {1.0}
    s = B.summarise(d, five, "a", "b").first()
    assert near(s["observed"], 1) and near(s["ci_low"], 1) and near(s["se"], 0)
    three = spark.createDataFrame([("i0", "large", 0.0, 0.0), ("i1", "large", 0.0, 0.0), ("i2", "small", 10.0, 0.0)], "item_id string, group_id string, a double, b double")
    assert {round(r["delta"], 9) for r in B.paired_draws(three, "group_id", "a", "b", 60, mode=mode).collect()} <= {0.0, round(10 / 3, 9), 10.0}
    free = B.paired_statistic(five, "group_id", "a", "b", np.mean, 40, mode=mode)
    assert {round(r["delta"], 9) for r in free.collect()} == {1.0}


def test_ranks_and_regressions(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 1.0), (3, 2.0, 2.0), (4, 5.0, 0.0)], "k int, a double, b double")
    assert [r["rank"] for r in B.with_rank(df, "a").orderBy("k").collect()] == [1.0, 2.5, 2.5, 4.0]
    c = B.rank_correlations(df, "a", "b").first()
    assert near(c["spearman"], np.corrcoef([1, 2.5, 2.5, 4], [4, 2, 3, 1])[0, 1]) and near(c["kendall"], -5 / np.sqrt(5 * 6))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=50)
    t = spark.createDataFrame(pd.DataFrame({"g": "q", "y": y, "u": x[:, 0], "v": x[:, 1]}))
    r = B.standardized_regressions(t, "y", ["u", "v"], ["g"]).first()
    z = (np.column_stack([y, x]) - np.column_stack([y, x]).mean(0)) / np.column_stack([y, x]).std(0)
    beta = np.linalg.lstsq(z[:, 1:], z[:, 0], rcond=None)[0]
    assert np.allclose([r["beta_u"], r["beta_v"]], beta) and near(r["r_squared"], 1 - ((z[:, 0] - z[:, 1:] @ beta) ** 2).sum() / (z[:, 0] ** 2).sum(), 1e-8)
    flat = B.standardized_regressions(t.withColumn("u", F.lit(1.0)), "y", ["u", "v"], ["g"]).first()
    assert flat["status"] == "constant_column" and flat["beta_v"] is None


def test_probe_against_spark_ml_and_distributed_fit(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 4))
    y = (x @ rng.normal(size=(4, 3)) + rng.normal(size=(240, 3))).argmax(1)
    df = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "y": y.astype(float)}))
    w, b = N.fit_multinomial(x, y, 3, 0.5)
    ml = LogisticRegression(featuresCol="f", labelCol="y", family="multinomial", regParam=1 / (0.5 * 240), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10).fit(df.withColumn("f", array_to_vector("x")))
    assert np.allclose(w, ml.coefficientMatrix.toArray(), atol=1e-3) and np.allclose(b, ml.interceptVector.toArray(), atol=1e-3)
    dw, db = fit_distributed(df.withColumn("y", F.col("y").cast("int")), "x", "y", 3, 0.5)
    assert np.allclose(w, dw, atol=1e-3) and np.allclose(b, db, atol=1e-3)


def test_site_gradient():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(40, 3)), np.arange(40) % 3
    start = rng.normal(size=(3, 2, 3))
    s, o = N.fit_sites(x, y, start, np.zeros((3, 2)), 1.0, True)
    loss = lambda s, o: N.bits(N.softmax(N.site_scores(x, s, o, 1.0)), y).mean()
    assert loss(s, o) < loss(start, np.zeros((3, 2)))
    w, b = N.fit_multinomial(x, y, 3, 1.0, intercept_penalty=True)
    sites1, weights = N.power_form(w, b)
    p = N.softmax(N.site_scores(x, sites1[:, None], weights[:, None], 1.0))
    assert np.allclose(p, N.softmax(x @ w.T + b), atol=1e-9)


def test_samplers():
    groups = np.repeat(["a", "b", "c"], 3)
    cells = np.array([0, 1, 2, 0, 0, 0, 1, 2, 0])
    at = C.sample_groups(cells, groups, 3, 2, np.random.default_rng(1))
    assert set(cells[at]) == {0, 1, 2} and all((groups == g).sum() == (groups[at] == g).sum() for g in set(groups[at]))
    pick = C.sample_cells(cells, 3, 2, np.random.default_rng(1))
    assert set(cells[pick]) == {0, 1, 2} and max(np.bincount(cells[pick])) <= 2


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("a", 1)], "k string, v int")
    meta = store.publish({"t": df}, tmp_path / "art", {"kind": "demo"})
    assert sorted(map(tuple, store.load(spark, tmp_path / "art", "t", ["k"]).collect())) == [("a", 1), ("a", 1), ("b", 2)]
    with pytest.raises(FileExistsError):
        store.publish({"t": df}, tmp_path / "art")
    assert digests.table_digest(df.orderBy("k").select("v", "k")).first()[0] == meta["tables"]["t"]["sha256"]
    assert digests.table_digest(df.distinct()).first()[0] != meta["tables"]["t"]["sha256"]
    assert digests.ordered_digest(df, ["k"]).first()[0] != digests.ordered_digest(df.withColumn("k", F.concat(F.lit("z"), "k")), ["k"]).first()[0]
    rows = store.index(tmp_path)
    assert [r["path"] for r in rows] == ["art"] and store.validate_index(tmp_path, rows) is None
    assert store.publish_json(tmp_path / "x.json", {"a": 1}) and not store.publish_json(tmp_path / "x.json", {"a": 1})
    with pytest.raises(FileExistsError):
        store.publish_json(tmp_path / "x.json", {"a": 2})
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "art" / "t.parquet"))
    with pytest.raises(checks.ConstraintError, match="changed"):
        store.load(spark, tmp_path / "art", "t")
    n = []
    build = lambda: n.append(1) or {"t": df}
    for _ in range(2):
        store.resume(spark, tmp_path / "art2", {"c": 1}, build)
    assert len(n) == 1
    with pytest.raises(checks.ConstraintError):
        store.resume(spark, tmp_path / "art2", {"c": 2}, build)
    lock = store.lock(spark, str(tmp_path / "x.json"))
    assert lock.first()["sha256"] == digests.file_digest(tmp_path / "x.json")


def test_split_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", "g", "w", 1), ("a", "g", "w", 0)], "item_id string, group_id string, writer_id string, test_fold int")
    corpora.write_splits({"crowd_full_outer": df}, tmp_path)
    assert [tuple(r) for r in corpora.read_split(spark, tmp_path / "crowd_full_outer.csv", "crowd_full_outer").collect()] == [("a", "g", "w", 0), ("b", "g", "w", 1)]
    with pytest.raises(FileExistsError):
        corpora.write_splits({"crowd_full_outer": df}, tmp_path)
    (tmp_path / "bad.csv").write_text("item_id,group_id,writer_id,test_fold\na,g,w,1.5\n")
    with pytest.raises(checks.ConstraintError):
        corpora.read_split(spark, tmp_path / "bad.csv", "crowd_full_outer")


def test_hot_bound_has_a_ceiling():
    from sparkgauge.operators import skew

    assert skew.hot_bound(1000) == skew.HOT_ROWS
    assert skew.hot_bound(10**9) == 2_000_000
    assert skew.hot_bound(10**12) == skew.HOT_CEILING
    assert skew.hot_bound(10**14) == 10**14 / 20_000


def test_neighbours_by_cells_equal_brute_force(spark):
    import numpy as np
    from sparkgauge.operators import geometry as G

    r = np.random.default_rng(11)
    x = np.concatenate([r.normal(size=(250, 4)) + 4 * r.integers(0, 3, size=(250, 1)), np.ones((150, 4))])  # a third of the points is one and the same
    fold = r.integers(0, 3, size=400)
    df = spark.createDataFrame([(int(i), v.tolist(), int(f)) for i, (v, f) in enumerate(zip(x, fold))], "id bigint, x array<double>, f int")
    test, train = df.withColumnRenamed("id", "test_id"), df.withColumnRenamed("id", "train_id")
    want = {}
    for i in range(400):
        d = ((x[i] - x) ** 2).sum(1)
        d[fold == fold[i]] = np.inf
        want[i] = sorted((d[j], j) for j in range(400))[:3]
    for most in (None, 0):
        got = {}
        for q in G.nearest(test, train, 3, apart="f", block=32, most=most).collect():
            got.setdefault(q["test_id"], []).append((q["d2"], q["train_id"]))
        assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}
    assert G.nearest(test, train.limit(0), 3).count() == 0


def test_numpy_draws_in_parts(spark):
    from sparkgauge.operators import bootstrap as B

    a = sorted(map(tuple, B.numpy_multiplicities(spark, 7, 9).collect()))
    assert a == sorted(map(tuple, B.numpy_multiplicities(spark, 7, 9, most=20).collect()))
    n = sorted((r["v"], r["k"]) for r in B.numbered(spark.createDataFrame([(f"{i * 7919 % 1000:03d}",) for i in range(1000)], "v string"), ["v"]).collect())
    assert n == [(f"{i:03d}", i) for i in range(1000)]


def test_bundle_is_strict_about_rare_labels(spark):
    from sparkgauge.operators import folds

    g = spark.createDataFrame([(f"i{i}", f"w{i}", "joy" if i else "fear", f"text {i}") for i in range(12)], "item_id string, writer_id string, y_writer string, hidden_emo_text string")
    v = g.select("item_id", F.col("y_writer").alias("y_reader_majority")).limit(3)
    t = spark.createDataFrame([(f"t{i}", f"c{i}", f"x {i}", i % 2) for i in range(12)], "item_id string, conversation_id string, text string, y int")
    with pytest.raises(folds.TooFewGroups):
        folds.split_bundle(g, v, t, F.col("hidden_emo_text"), F.col("text"), ("joy", "fear"), ["y"], strict=True)
