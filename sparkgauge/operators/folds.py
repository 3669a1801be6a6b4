"""Group-disjoint folds, sealed external roles and their constraints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.functions.vocab import SEED
from sparkgauge.operators import checks
from sparkgauge.operators.components import duplicate_components
from sparkgauge.operators.skew import hot_join
from sparkgauge.session import Scratch

#: Groups that a hash part of a profile may hold about; places within a profile are exact and no window spans more than one part.
PART = 1_000_000
LEAST_PARTS = 64
#: Distinct class profiles that may reach the driver; beyond it they are taken coarser.
MOST_PROFILES = 500_000


def spread(profiles: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """How many groups of each profile (row of class counts, or of mean counts) go to each fold.

    Every k groups of one profile go one to each fold. The rest go, most uneven profile
    first, each to the fold that keeps the classes' shares most even, then to the smallest.
    """
    out = np.repeat((many // k)[:, None], k, axis=1)
    per_class = np.maximum((profiles * many[:, None]).sum(0), 1)
    held = np.einsum("pf,pc->fc", out.astype(float), profiles.astype(float))
    order = sorted(range(len(profiles)), key=lambda i: (-profiles[i].std(), -profiles[i].sum(), i))
    for i in order:
        for _ in range(int(many[i] % k)):
            best = None
            for f in range(k):
                held[f] += profiles[i]
                key = (round(float((held / per_class).std(0).mean()), 12), held[f].sum(), f)
                held[f] -= profiles[i]
                if best is None or key < best[0]:
                    best = (key, f)
            held[best[1]] += profiles[i]
            out[i, best[1]] += 1
    return out


def _profiles(per: DataFrame, counts: Sequence[str], most: int) -> tuple[DataFrame, list]:
    """``per`` with ``profile``, and the rows (profile, n, s0, s1, ...) of at most ``most`` profiles with their groups and summed counts.

    Profiles are the class counts; if these are too many, their powers of two; then the greatest class and the power of two of the sum.
    """
    two = lambda c: F.when(c > 0, F.floor(F.log2(c.cast("double"))) + 1).otherwise(0)
    cols = [F.col(c) for c in counts]
    total = sum(cols[1:], cols[0])
    top = F.array_position(F.array(*cols), F.greatest(*cols) if len(cols) > 1 else cols[0])
    for level in ([c.cast("string") for c in cols], [two(c).cast("string") for c in cols], [top.cast("string"), two(total).cast("string")]):
        named = per.withColumn("profile", F.concat_ws(",", *level))
        rows = named.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(counts)]).limit(most + 1).collect()
        if len(rows) <= most:
            return named, sorted(rows, key=lambda r: r["profile"])
    raise ValueError(f"more than {most} profiles even by greatest class and size")


def group_folds(items: DataFrame, group: str, classes: Sequence[str], k: int, seed: int = SEED, most: int = MOST_PROFILES) -> DataFrame:
    """(group, fold): stratified folds over 0/1 or count columns ``classes`` of items; a group is never divided.

    Groups with the same class counts are alike. Only the number of groups of each profile reaches
    the driver, which decides how many of them each fold gets; which ones is settled where they are, by their rank in a seeded
    hash order: the groups of earlier hash parts, added up over the parts of a profile, and the place within the part.
    """
    spark = items.sparkSession
    s = Scratch(spark, "profiles")
    counts = [f"k{i}" for i in range(len(classes))]
    per = s.keep(items.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(n) for n, c in zip(counts, classes)]))
    parts = max(LEAST_PARTS, s.rows(per) // PART)
    per, rows = _profiles(per.withColumn("h", F.xxhash64(F.lit(seed), F.col(group))).withColumn("part", F.pmod("h", F.lit(parts)).cast("int")), counts, most)
    many = np.array([r["n"] for r in rows], dtype=np.int64)
    mean = np.array([[r[f"s{i}"] / r["n"] for i in range(len(classes))] for r in rows]).reshape(len(rows), len(classes))
    plan = [(r["profile"], [int(x) for x in np.cumsum(share)]) for r, share in zip(rows, spread(mean, many, k))]
    ends = spark.createDataFrame(plan, "profile string, ends array<bigint>")
    before = Window.partitionBy("profile").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part of a profile
    starts = per.groupBy("profile", "part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count").join(F.broadcast(ends), "profile")
    rank = F.row_number().over(Window.partitionBy("profile", "part").orderBy("h", group)) - 1
    placed = per.withColumn("r", rank).join(starts, ["profile", "part"])
    fold = F.size(F.filter("ends", lambda e: e <= F.col("start") + F.col("r")))
    return placed.select(group, fold.cast("int").alias("fold"))


def label_columns(df: DataFrame, label: str, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    cols = [f"is_{i}" for i in range(len(names))]
    return df.select("*", *[(F.col(label) == n).cast("int").alias(c) for c, n in zip(cols, names)]), cols


class TooFewGroups(ValueError):
    pass


def require_groups(items: DataFrame, group: str, classes: Sequence[str], k: int) -> None:
    """An error if a class has rows in fewer than ``k`` groups, so that some fold must lack it."""
    held = items.groupBy(group).agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in classes]).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in classes]).first()
    few = {c: held[c] for c in classes if held[c] < k}
    if few:
        raise TooFewGroups(f"groups with a row of the class, {k} needed: {few}")


def outer_folds(items: DataFrame, group: str, classes: Sequence[str], outer: int = 5, seed: int = SEED) -> DataFrame:
    """(group, test_fold)."""
    return Scratch(items.sparkSession, "outer").keep(group_folds(items, group, classes, outer, seed).withColumnRenamed("fold", "test_fold"))


def inner_folds(items: DataFrame, o: DataFrame, group: str, classes: Sequence[str], outer: int = 5, inner: int = 3, seed: int = SEED) -> DataFrame:
    """(outer_fold, group, validation_fold): folds of each outer training part."""
    with_outer = items.join(o, group)
    parts = None
    for f in range(outer):
        part = group_folds(with_outer.where(F.col("test_fold") != f), group, classes, inner, seed + f)
        part = part.select(F.lit(f).alias("outer_fold"), group, F.col("fold").alias("validation_fold"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def nested_folds(items: DataFrame, group: str, classes: Sequence[str], outer: int = 5, inner: int = 3, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(group, test_fold) and (outer_fold, group, validation_fold), the inner folds over each outer training part."""
    o = outer_folds(items, group, classes, outer, seed)
    return o, inner_folds(items, o, group, classes, outer, inner, seed)


@dataclass
class Rows:
    """What folds are made from: items with their group and identity, and the table and columns that are stratified."""

    keys: DataFrame
    by: DataFrame
    classes: list[str]

    def outer(self, k: int = 5, seed: int = SEED) -> DataFrame:
        return self.keys.join(outer_folds(self.by, "group_id", self.classes, k, seed), "group_id")

    def nested(self, outer: int = 5, inner: int = 3, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
        o, i = nested_folds(self.by, "group_id", self.classes, outer, inner, seed)
        return self.keys.join(o, "group_id"), i.join(self.keys, "group_id")


def labelled_rows(items: DataFrame, identity: str, text, label: str, names: Sequence[str], comp: DataFrame | None = None) -> Rows:
    """Items of one label each. ``comp`` (item_id, group_id), if there, saves finding the components again."""
    s = Scratch(items.sparkSession, "folds")
    comp = duplicate_components(items, "item_id", identity, text) if comp is None else comp
    rows, cols = label_columns(items.select("item_id", identity, label).join(comp, "item_id"), label, names)
    rows = s.keep(rows)
    return Rows(rows.select("item_id", "group_id", identity), rows, cols)


def writer_rows(generation: DataFrame, text, names: Sequence[str], comp: DataFrame | None = None) -> Rows:
    return labelled_rows(generation, "writer_id", text, "y_writer", names, comp)


def tweet_rows(tweets: DataFrame, text, columns: Sequence[str]) -> Rows:
    """Tweets, stratified over a group's greatest indicator of each label."""
    s = Scratch(tweets.sparkSession, "folds")
    comp = duplicate_components(tweets, "item_id", "conversation_id", text)
    rows = s.keep(tweets.select("item_id", "conversation_id", *columns).join(comp, "item_id"))
    top = s.keep(rows.groupBy("group_id").agg(*[F.max(c).alias(c) for c in columns]))
    return Rows(rows.select("item_id", "group_id", "conversation_id"), top, list(columns))


def writer_splits(generation: DataFrame, text, names: Sequence[str], outer: int = 5, inner: int = 3, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Outer and inner folds of the writers' items by label, components kept together."""
    return writer_rows(generation, text, names).nested(outer, inner, seed)


def tweet_splits(tweets: DataFrame, text, columns: Sequence[str], outer: int = 5, inner: int = 3, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    return tweet_rows(tweets, text, columns).nested(outer, inner, seed)


def split_bundle(generation: DataFrame, validation: DataFrame, tweets: DataFrame, masked, tweet_text, names: Sequence[str], columns: Sequence[str], seed: int = SEED, strict: bool = False) -> dict[str, DataFrame]:
    """All eight split tables. ``strict``: a label with fewer groups than folds is an error. The reader split finds its components among the validated items alone; the external one
    seals them and folds what may be trained on in three.

    ``validation`` has item_id and y_reader_majority; one without a known item is an error.
    """
    s = Scratch(generation.sparkSession, "bundle")
    g = s.keep(generation)
    comp = s.keep(duplicate_components(g, "item_id", "writer_id", masked))
    full = writer_rows(g, masked, names, comp)
    if strict:
        require_groups(full.by, "group_id", full.classes, 5)
    full_outer, full_inner = full.nested(seed=seed)
    unknown = [r[0] for r in checks.orphans(validation.where("item_id is not null"), g, ["item_id"]).select("item_id").limit(3).collect()]
    if unknown:
        raise checks.ConstraintError(f"validated items that nobody wrote: {unknown}")
    read = s.keep(g.select("item_id", "writer_id", "hidden_emo_text").join(validation.where("item_id is not null").dropDuplicates(["item_id"]).select("item_id", "y_reader_majority"), "item_id"))
    reader_outer, reader_inner = labelled_rows(read, "writer_id", masked, "y_reader_majority", names).nested(seed=seed)
    roles = s.keep(external_roles(g.select("item_id", "writer_id").join(comp, "item_id"), read, "item_id", "writer_id", "group_id"))
    inside, cols = label_columns(roles.where("role = 'train'").join(g.select("item_id", "y_writer"), "item_id"), "y_writer", names)
    inside = s.keep(inside)
    three = group_folds(inside, "group_id", cols, 3, seed).withColumnRenamed("fold", "validation_fold")
    by_tweet = tweet_rows(tweets, tweet_text, columns)
    if strict:
        require_groups(by_tweet.by, "group_id", by_tweet.classes, 5)
    tweet_outer, tweet_inner = by_tweet.nested(seed=seed)
    return {
        "crowd_full_outer": full_outer,
        "crowd_full_inner": full_inner,
        "crowd_reader_outer": reader_outer,
        "crowd_reader_inner": reader_inner,
        "crowd_external": roles,
        "crowd_external_inner": inside.select("item_id", "group_id", "writer_id").join(three, "group_id"),
        "emotwics_outer": tweet_outer,
        "emotwics_inner": tweet_inner,
    }


def external_checks(roles: DataFrame, inner: DataFrame, test_items: DataFrame, k: int = 3) -> DataFrame:
    """Violations of sealed roles: unknown roles, roles never used, test items not sealed, training items that share a writer or a component with
    a test item, roles other than their precedence gives, and an inner split that isn't the training role."""
    test, train = roles.where("role = 'test'"), roles.where("role = 'train'")
    again = external_roles(roles.select("item_id", "writer_id", "group_id"), test_items, "item_id", "writer_id", "group_id").withColumnRenamed("role", "want")
    names = roles.sparkSession.createDataFrame([(n,) for n in ("train", "test", "excluded_test_writer", "excluded_test_duplicate")], "role string")
    shared = lambda c: train.where(F.col(c).isNotNull()).join(test.select(c).dropna().distinct(), c, "left_semi")
    return checks.summary(
        {
            "repeated_item": checks.repeated_keys(roles, ["item_id"]),
            "unknown_role": roles.where(F.col("role").isNull()).unionByName(roles.where("role is not null").join(names, "role", "left_anti").select(*roles.columns)),
            "test_not_sealed": checks.difference(test_items, test, ["item_id"]),
            "writer_on_both_sides": shared("writer_id"),
            "component_on_both_sides": shared("group_id"),
            "other_role": roles.join(again.select("item_id", "want"), "item_id").where(~F.col("role").eqNullSafe(F.col("want"))),
            "inner_is_not_training": checks.difference(train, inner, ["item_id"]),
            "inner_fold_out_of_range": inner.where(~F.coalesce(F.col("validation_fold").between(0, k - 1), F.lit(False))),
            "inner_group_crosses_folds": checks.crossing_groups(inner, "group_id", "validation_fold"),
        }
    )


def bundle_checks(b: dict[str, DataFrame]) -> DataFrame:
    """How the eight tables fit each other: full and external items and groups are the same, readers' items are the external test."""
    parts = {
        "full_external": alignment(b["crowd_full_outer"], b["crowd_external"], "item_id", ["group_id", "writer_id"]).where("side <> 'same'"),
        "reader_external_test": alignment(b["crowd_reader_outer"], b["crowd_external"].where("role = 'test'"), "item_id", ["writer_id"]).where("side <> 'same'"),
    }
    out = checks.summary(parts)
    for name, outer, inner, who in (("crowd_full", "crowd_full_outer", "crowd_full_inner", "writer_id"), ("crowd_reader", "crowd_reader_outer", "crowd_reader_inner", "writer_id"), ("emotwics", "emotwics_outer", "emotwics_inner", "conversation_id")):
        out = out.unionByName(inner_checks(b[outer], b[inner], who).withColumn("check_name", F.concat_ws(".", F.lit(name), "check_name")))
    return out


def fold_shares(folds: DataFrame, items: DataFrame, label: str, fold: str = "test_fold") -> DataFrame:
    """(fold, label, n, share): each fold's share of each label's items."""
    n = folds.join(items.select("item_id", F.col(label).alias("label")), "item_id").groupBy(F.col(fold).alias("fold"), "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def reconcile_groups(outer: DataFrame, inner: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(item_id, group_id) that all sources agree on; items with two groups, or with none, are an error.

    Each source that has a ``group_id`` may name an item's group; the sources are the outer folds, the inner ones and an explicit table.
    """
    named = None
    for df in (outer, inner, explicit):
        if df is not None and "group_id" in df.columns:
            part = df.where("item_id is not null and group_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("group_id").cast("string").alias("group_id"))
            named = part if named is None else named.unionByName(part)
    if named is None:
        raise checks.ConstraintError("no source names groups")
    one = named.groupBy("item_id").agg(F.min("group_id").alias("group_id"), F.max("group_id").alias("_other"))
    odd = [tuple(r) for r in one.where("group_id <> _other").limit(3).collect()]
    if odd:
        raise checks.ConstraintError(f"items with two groups: {odd}")
    lost = [r[0] for r in outer.select(F.col("item_id").cast("string").alias("item_id")).distinct().join(one, "item_id", "left_anti").limit(3).collect()]
    if lost:
        raise checks.ConstraintError(f"items without a group: {lost}")
    return one.select("item_id", "group_id")


def external_roles(items: DataFrame, test_items: DataFrame, item: str, identity: str, group: str) -> DataFrame:
    """(item, identity, group, role): test items, other items of their writers, others of their components, the rest."""
    test = test_items.select(item).distinct().withColumn("_test", F.lit(True))
    flagged = items.join(test, item, "left")
    writers = flagged.where("_test").select(identity).dropna().distinct().withColumn("_same", F.lit(True))
    groups = flagged.where("_test").select(group).dropna().distinct().withColumn("_dup", F.lit(True))
    # a writer or a component may hold much of all rows
    flagged = hot_join(hot_join(flagged, writers, identity, "left"), groups, group, "left")
    role = F.when(F.col("_test"), "test").when(F.col("_same"), "excluded_test_writer").when(F.col("_dup"), "excluded_test_duplicate").otherwise("train")
    return flagged.select(item, identity, group, role.alias("role"))


def role_partition(roles: DataFrame, item: str = "item_id") -> dict[str, DataFrame]:
    """The disjoint tables of each role that may be trained or tested on."""
    return {r: roles.where(F.col("role") == r).select(item) for r in ("train", "test")}


def outer_checks(outer: DataFrame, items: DataFrame, identity: str, k: int = 5) -> DataFrame:
    """Violations of an outer split: repeats, folds out of range, folds never used, groups and identities across folds, items on one side alone."""
    s = outer.sparkSession
    folds = s.range(k).select(F.col("id").cast("int").alias("test_fold"))
    return checks.summary(
        {
            "repeated_item": checks.repeated_keys(outer, ["item_id"]),
            "null_fold": outer.where("test_fold is null"),
            "fold_out_of_range": outer.where(F.col("test_fold").isNotNull() & ~F.col("test_fold").between(0, k - 1)),
            "fold_unused": folds.join(outer.select("test_fold").distinct(), "test_fold", "left_anti"),
            "group_crosses_folds": checks.crossing_groups(outer, "group_id", "test_fold"),
            "identity_crosses_folds": checks.crossing_groups(outer, identity, "test_fold"),
            "identity_in_two_groups": checks.crossing_groups(outer, identity, "group_id"),
            "item_missing": checks.difference(items.where("item_id is not null"), outer, ["item_id"]).where("side = 'missing'"),
            "item_unexpected": checks.difference(items, outer.where("item_id is not null"), ["item_id"]).where("side = 'unexpected'"),
        }
    )


def inner_checks(outer: DataFrame, inner: DataFrame, identity: str | None = None) -> DataFrame:
    """Violations of an inner split against its outer one; ``identity``, if given, has to be the same in both."""
    who = F.col(identity) if identity else F.lit(None).cast("string")
    o = outer.select("item_id", F.col("group_id").alias("outer_group"), who.alias("outer_identity"), "test_fold")
    joined = inner.join(o, "item_id", "left")
    folds = inner.select("outer_fold").distinct()
    wanted = outer.join(F.broadcast(folds), outer["test_fold"] != folds["outer_fold"]).select("outer_fold", "item_id")  # a row per fold
    return checks.summary(
        {
            "repeated_item": checks.repeated_keys(inner, ["outer_fold", "item_id"]),
            "group_differs": joined.where(~F.col("group_id").eqNullSafe(F.col("outer_group"))),
            "identity_differs": joined.where(~who.eqNullSafe(F.col("outer_identity"))),
            "test_item_in_training": joined.where("test_fold = outer_fold"),
            "group_crosses_folds": inner.groupBy("outer_fold", "group_id").agg(F.countDistinct("validation_fold").alias("n")).where("n > 1"),
            "item_missing": checks.difference(wanted, inner, ["outer_fold", "item_id"]).where("side = 'missing'"),
        }
    )


def alignment(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(side, rows): how the keys of two tables meet, and where matched rows differ."""
    x = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    y = b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(differs, "different").otherwise("same")
    return x.join(y, key, "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("row_count"))
