"""Consensus, splits, contraction and copies against brute force on small inputs."""

import random
from collections import defaultdict

import pytest

from sparkgauge.llm import consensus as cons
from sparkgauge.llm import contract as ctr
from sparkgauge.llm import copies as cop
from sparkgauge.llm import splits as spl
from sparkgauge.operators import skew


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def random_graph(seed, nodes=60, edges=70):
    r = random.Random(seed)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    star = [("s000", f"s{i:03d}") for i in range(1, 30)]
    return chain + star + [(f"n{r.randrange(nodes):03d}", f"n{r.randrange(nodes):03d}") for _ in range(edges)]


@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_equals_union_find(spark, seed):
    e = random_graph(seed)
    rows = e + [(b, a) for a, b in e[:20]] + e[:5] + [(None, "x"), ("y", None)]
    got = {r.record: r.root for r in ctr.contract(spark.createDataFrame(rows, "u string, v string"), seed=seed).collect()}
    assert got == components([x for x in e if x[0] != x[1]])


def test_contraction_with_hot_vertices(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (1 / 500, 5, None))
    e = random_graph(3)
    got = {r.record: r.root for r in ctr.contract(spark.createDataFrame(e, "u string, v string")).collect()}
    assert got == components([x for x in e if x[0] != x[1]])


def test_matches_of_different_fields_never_meet(spark):
    rows = [("a", "b", "item_id", True), ("b", "c", "item_id", True), ("b", "z", "writer_id", True), ("c", "d", "item_id", False), ("d", "e", "item_id", None), ("f", "f", "item_id", True), (None, "q", "item_id", True), ("q", "r", None, True)]
    df = spark.createDataFrame(rows, "left_id string, right_id string, matched_field string, is_match boolean")
    got = {(r.matched_field, r.record_id, r.root_id) for r in ctr.group_matches(df).collect()}
    assert got == {("item_id", "a", "a"), ("item_id", "b", "a"), ("item_id", "c", "a"), ("writer_id", "b", "b"), ("writer_id", "z", "b")}
    assert ctr.group_matches(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed,retire", [(4, 0.1), (5, 1.0), (8, 0.5), (9, 0.0)])
def test_hash_to_min_equals_union_find(spark, seed, retire):
    e = random_graph(seed)
    rows = spl.hash_to_min(spark.createDataFrame(e, "u string, v string"), retire=retire).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got)
    assert got == components(e)


def test_splits_keep_groups_together(spark):
    r = random.Random(7)
    rows = [(f"i{i}", r.choice([None, f"g{r.randrange(40)}"]), r.choice([None, f"w{r.randrange(40)}"]), "old") for i in range(300)]
    df = spark.createDataFrame(rows, "item_id string, g string, w string, split string")
    out = spl.assign_splits(df, ("g", "w"), "item_id").collect()
    assert len(out) == 300
    for field in ("g", "w"):
        by = defaultdict(set)
        for x in out:
            if x[field] is not None:
                by[x[field]].add(x["split"])
        assert all(len(v) == 1 for v in by.values())
    assert spl.assign_splits(df.limit(0), ("g", "w"), "item_id").count() == 0


def test_rendezvous_follows_the_weights_and_moves_little(spark):
    df = spark.range(20000).selectExpr("cast(id as string) c")
    from pyspark.sql import functions as F

    n = {r.s: r["count"] for r in df.select(spl.rendezvous(F.col("c")).alias("s")).groupBy("s").count().collect()}
    assert abs(n["train"] / 20000 - 0.8) < 0.02 and abs(n["test"] / 20000 - 0.1) < 0.02
    two = df.select(spl.rendezvous(F.col("c"), {"train": 0.8, "test": 0.2}).alias("a"), spl.rendezvous(F.col("c")).alias("b"))
    assert two.where("a <> b and b <> 'validation'").count() < 20000 * 0.12


def test_broken_keys(spark):
    rows = [("a", "g1", "w1", 0), ("b", "g1", "w2", 1), ("c", "g2", "w2", 1), ("d", "g3", None, 2), ("d", "g3", None, 2), ("e", None, "w9", 0), ("f", None, "w9", None), ("g", None, None, 3)]
    df = spark.createDataFrame(rows, "item_id string, group_id string, writer_id string, test_fold int")
    got = {tuple(r) for r in spl.broken_keys({"t": (df, ("group_id", "writer_id"))}).collect()}
    assert got == {("t", "group_id", "g1")}


def test_broken_keys_need_the_components(spark, monkeypatch):
    """The middle record joins two components' folds; a component table cut in two loses the key that crosses them."""
    rows = [("a", "g1", "w1", 0), ("b", "g2", "w1", 1), ("c", "g2", "w2", 1)]
    df = spark.createDataFrame(rows, "item_id string, group_id string, writer_id string, test_fold int")
    tables = {"t": (df, ("group_id", "writer_id"))}
    assert {tuple(r) for r in spl.broken_keys(tables).collect()} == {("t", "writer_id", "w1")}
    whole = spl.hash_to_min
    monkeypatch.setattr(spl, "hash_to_min", lambda e: whole(e).withColumn("component", spl.F.col("node")))
    assert spl.broken_keys(tables).count() == 0


def test_hash_to_min_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (1 / 500, 5, None))
    e = random_graph(6)
    got = {r.node: r.component for r in spl.hash_to_min(spark.createDataFrame(e, "u string, v string")).collect()}
    assert got == components(e)


def test_shares_lie_within_their_tolerance(spark):
    rows = [(f"i{i}", f"g{i % 701 if i % 10 else 0}", None) for i in range(6000)]
    df = spark.createDataFrame(rows, "item_id string, g string, w string")
    got = spl.shares(spl.assign_splits(df, ("g", "w"), "item_id")).collect()
    assert sum(r["row_count"] for r in got) == 6000 and sum(r["components"] for r in got) == 701
    assert all(abs(r["share"] - r["target"]) <= r["tolerance"] for r in got)


def test_copies(spark):
    rows = [
        ("3", "Hello, World!", "x y"),
        ("1", "hello world", "X-Y"),
        ("1", "hello world", "X-Y"),
        ("2", "xy", "HELLO  world."),
        ("4", "hello worlds", "xy"),
        ("5", None, "xy"),
        ("6", "hello world", None),
        (None, "hello world", "xy"),
        ("7", "", ""),
        ("8", "...", " \t"),
        ("9", "helloworldx", "y"),
    ]
    df = spark.createDataFrame(rows, "item_id string, a string, b string").selectExpr("*", "1 as key", "2 as kept")
    want = {("1", "2"), ("1", "3"), ("7", "8")}
    for least in (10**6, 1):
        assert {tuple(r) for r in cop.copy_members(df, ("a", "b"), "item_id", least=least).collect()} == want
        assert {tuple(r) for r in cop.distinct_records(df, ("a", "b"), "item_id", least=least).collect()} == {("1", 3), ("7", 2), ("4", 1), ("9", 1)}
    assert cop.copy_members(df.limit(0), ("a", "b"), "item_id").count() == 0


def readers(n_items=240, seed=3):
    r = random.Random(seed)
    labels = ["anger", "fear", "joy", "no-emotion", "shame"]
    care = {f"r{i:02d}": 0.9 if i % 3 else 0.15 for i in range(24)}
    rows, truth = [], {}
    for i in range(n_items):
        t = truth[f"i{i}"] = r.choice(labels)
        for who in r.sample(sorted(care), 5):
            said = t if r.random() < care[who] else r.choice([x for x in labels if x != t])
            said = r.choice([said, said.upper(), f" {said}", said.replace("-", " ") + "\t"])
            rows += [(f"i{i}", who, said)] * r.choice([1, 1, 2])
    return rows, truth, {w for w, c in care.items() if c < 0.5}


def test_consensus_finds_careless_readers(spark):
    rows, truth, careless = readers()
    rows += [("i0", None, "joy"), (None, "r01", "joy"), ("i1", "r01", None), ("i1", "r02", "  ")]
    df = spark.createDataFrame(rows, "item_id string, reader_id string, y_reader string").selectExpr("*", "1 as item", "2 as who", "3 as label")
    c = cons.consensus(df, "item_id", "reader_id", "y_reader")
    assert {r.who for r in cons.careless(c).collect()} == careless
    got = {r.item: r for r in c.items.collect()}
    assert len(got) == len(truth)
    assert sum(got[i].consensus == t for i, t in truth.items()) > 0.95 * len(truth)
    assert all(0 <= r.agreement <= 1 for r in got.values())
    rel = {r.who: r.reliability for r in c.annotators.collect()}
    assert max(rel[w] for w in careless) < min(v for w, v in rel.items() if w not in careless)


def test_consensus_edges(spark):
    schema = "item_id string, reader_id string, y_reader string"
    one = cons.consensus(spark.createDataFrame([("i", "r", "Joy")], schema), "item_id", "reader_id", "y_reader")
    assert [(r.consensus, r.agreement) for r in one.items.collect()] == [("joy", 1.0)]
    tie = cons.consensus(spark.createDataFrame([("i", "a", "joy"), ("i", "b", "anger")], schema), "item_id", "reader_id", "y_reader")
    assert [r.consensus for r in tie.items.collect()] == ["anger"]
    none = cons.consensus(spark.createDataFrame([], schema), "item_id", "reader_id", "y_reader")
    assert none.items.count() == none.annotators.count() == cons.careless(none).count() == 0


def test_messages_that_do_not_settle_are_an_error(spark):
    rows, _, _ = readers(60)
    df = spark.createDataFrame(rows, "item_id string, reader_id string, y_reader string")
    with pytest.raises(cons.NotSettled):
        cons.consensus(df, "item_id", "reader_id", "y_reader", max_rounds=2, tolerance=1e-12)


def test_the_messages_settle_the_class(spark):
    """Three careless readers outvote two careful ones on i0; the messages follow the careful ones, a plain vote would not."""
    rows = [("i0", "a", "joy"), ("i0", "b", "joy"), ("i0", "x", "fear"), ("i0", "y", "fear"), ("i0", "z", "fear")]
    for i in range(1, 13):
        rows += [(f"i{i}", w, "joy" if i % 2 else "fear") for w in ("a", "b", "c", "d", "e")]
        rows += [(f"i{i}", w, ["anger", "joy", "fear", "shame"][(i * k + k) % 4]) for k, w in enumerate(("x", "y", "z"), 1)]
    c = cons.consensus(spark.createDataFrame(rows, "item_id string, reader_id string, y_reader string"), "item_id", "reader_id", "y_reader")
    got = {r["item"]: r for r in c.items.collect()}
    assert got["i0"]["consensus"] == "joy" and got["i0"]["plain_share"] == 0.6 and got["i0"]["agreement"] > 0.5
    rel = {r["who"]: r["reliability"] for r in c.annotators.collect()}
    assert min(rel[w] for w in "abcde") > max(rel[w] for w in "xyz")
