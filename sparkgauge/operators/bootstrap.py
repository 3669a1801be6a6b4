"""Grouped bootstrap, plus-one Monte-Carlo tests and rank statistics.

A draw takes as many groups as there are, with replacement. Only group totals enter, so
a draw costs the number of groups. In ``hash`` mode every draw is a function of seed, draw
and place, computed where the data are; ``numpy`` mode repeats NumPy's generator, which is
sequential, on the driver, and hands its multiplicities on in parts of ``MOST_NUMPY``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgauge.functions import arrays as A
from sparkgauge.functions.vocab import SEED
from sparkgauge.session import Scratch

MOST_NUMPY = 5_000_000


def group_totals(paired: DataFrame, group: str, a: str, b: str, item: str = "item_id") -> DataFrame:
    """(g, first, n, sum_a, sum_b): totals of each group and its first item."""
    return paired.groupBy(F.col(group).alias("g")).agg(F.min(item).alias("first"), F.count(F.lit(1)).alias("n"), F.sum(a).alias("sum_a"), F.sum(b).alias("sum_b"))


def numbered(totals: DataFrame, order: Sequence[str], out: str = "k") -> DataFrame:
    """``totals`` with ``out`` from 0 in the given order. Ranks are exact: by range partition, then within it."""
    spark = totals.sparkSession
    s = Scratch(spark, "numbered")
    # the id holds the partition above 33 bits and the place within it below; written, both stay
    ranged = s.keep(totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    starts, at = [], 0
    for r in ranged.groupBy(part.alias("_p")).count().orderBy("_p").collect():  # a row per partition
        starts.append((r["_p"], at))
        at += r["count"]
    offsets = spark.createDataFrame(starts or [(0, 0)], "_p bigint, _o bigint")
    return ranged.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(out, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_o")


def hash_multiplicities(spark: SparkSession, n_groups: int, draws: int, seed: int = SEED) -> DataFrame:
    """(draw, k, m): how often group k is drawn; place j of a draw takes the group that 28 bits of a SHA-256 point at."""
    grid = spark.range(draws * n_groups).select((F.col("id") / n_groups).cast("bigint").alias("draw"), (F.col("id") % n_groups).alias("j"))
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("j").cast("string")), 256), 1, 7), 16, 10).cast("bigint")
    return grid.select("draw", (bits % n_groups).alias("k")).groupBy("draw", "k").agg(F.count(F.lit(1)).alias("m"))


def numpy_multiplicities(spark: SparkSession, n_groups: int, draws: int, seed: int = SEED, most: int = MOST_NUMPY) -> DataFrame:
    """The same by NumPy's generator, draw after draw. Parts of about ``most`` multiplicities are written as they come."""
    rng = np.random.default_rng(seed)
    s, out = Scratch(spark, "multiplicities"), None
    each = max(1, most // max(n_groups, 1))
    for first in range(0, draws, each):
        rows = []
        for d in range(first, min(first + each, draws)):
            c = np.bincount(rng.choice(n_groups, size=n_groups, replace=True), minlength=n_groups)
            at = np.nonzero(c)[0]
            rows.append(pd.DataFrame({"draw": np.full(len(at), d, dtype=np.int64), "k": at.astype(np.int64), "m": c[at].astype(np.int64)}))
        part = spark.createDataFrame(pd.concat(rows))
        if draws > each:
            part = s.keep(part)
        out = part if out is None else out.unionByName(part)
    return out


def paired_draws(paired: DataFrame, group: str, a: str, b: str, draws: int = 2000, seed: int = SEED, mode: str = "hash", item: str = "item_id") -> DataFrame:
    """(draw, delta): the mean of a less the mean of b in each draw. Groups count in order of their first item."""
    t = numbered(group_totals(paired, group, a, b, item), ["first", "g"])
    n = t.count()
    make = {"hash": hash_multiplicities, "numpy": numpy_multiplicities}[mode]
    m = make(paired.sparkSession, n, draws, seed)
    w = m.join(t, "k").groupBy("draw").agg(F.sum(F.col("m") * F.col("n")).alias("n"), F.sum(F.col("m") * F.col("sum_a")).alias("a"), F.sum(F.col("m") * F.col("sum_b")).alias("b"))
    return w.select("draw", ((F.col("a") - F.col("b")) / F.col("n")).alias("delta"))


def summarise(draws: DataFrame, paired: DataFrame, a: str, b: str, level: float = 0.95) -> DataFrame:
    """Observed difference, percentile interval by linear interpolation, standard error with n - 1."""
    tail = (1 - level) / 2
    d = draws.agg(F.percentile("delta", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.stddev_samp("delta").alias("se"), F.count(F.lit(1)).alias("draws"))
    o = paired.agg((F.avg(a) - F.avg(b)).alias("observed"), F.count(F.lit(1)).alias("n_items"))
    return o.crossJoin(F.broadcast(d)).select("observed", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "se", "draws", "n_items")  # one row each


def paired_statistic(paired: DataFrame, group: str, a: str, b: str, statistic: Callable[[np.ndarray], float], draws: int, seed: int = SEED, mode: str = "hash", item: str = "item_id") -> DataFrame:
    """The same for any statistic of the drawn values; a draw's values have to fit one task."""
    t = numbered(group_totals(paired, group, a, b, item), ["first", "g"]).select("g", "k")
    make = {"hash": hash_multiplicities, "numpy": numpy_multiplicities}[mode]
    m = make(paired.sparkSession, t.count(), draws, seed)
    rows = m.join(t, "k").join(paired.select(F.col(group).alias("g"), F.col(a).alias("a"), F.col(b).alias("b")), "g").select("draw", "m", "a", "b")

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"draw": [key[0]], "delta": [float(statistic(np.repeat(df["a"].to_numpy(), df["m"]))) - float(statistic(np.repeat(df["b"].to_numpy(), df["m"])))]})

    return rows.groupBy("draw").applyInPandas(run, "draw bigint, delta double")


def plus_one(extreme: Column) -> Column:
    """Monte-Carlo p of an aggregate: (1 + extreme draws) / (1 + draws)."""
    return (1 + F.count_if(extreme)) / (1 + F.count(F.lit(1)))


def average_rank(value: str, by: Sequence[str] = (), descending: bool = False) -> tuple[Column, Column]:
    """Rank with ties averaged, as (rank, tie size) windows: rank + (ties - 1) / 2."""
    order = F.col(value).desc() if descending else F.col(value)
    w = Window.partitionBy(*by).orderBy(order)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(w), ties


def with_rank(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False, out: str = "rank") -> DataFrame:
    r, t = average_rank(value, by, descending)
    return df.withColumn(out, r + (t - 1) / F.lit(2.0))


def rank_correlations(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman's rho and Kendall's tau-b of two columns within each group; groups are as small as a class axis."""
    ranked = with_rank(with_rank(df, a, by, out="_ra"), b, by, out="_rb")
    rho = ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))
    left = df.select(*by, F.col(a).alias("a1"), F.col(b).alias("b1"), F.monotonically_increasing_id().alias("i"))
    packed = left.groupBy(*by).agg(F.collect_list(F.struct("a1", "b1")).alias("v"))
    sign = lambda x: F.signum(x.cast("double"))
    pairs = F.flatten(F.transform("v", lambda x, i: F.transform(F.filter("v", lambda y, j: j > i), lambda y: F.struct(sign(x["a1"] - y["a1"]).alias("s"), sign(x["b1"] - y["b1"]).alias("t")))))
    s = packed.withColumn("p", pairs)
    count = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, q: acc + f(q))
    tau = count(lambda q: q["s"] * q["t"]) / F.sqrt(count(lambda q: F.abs(q["s"])) * count(lambda q: F.abs(q["t"])))
    tau = s.select(*by, tau.alias("kendall"))
    return rho.join(tau, list(by)) if by else rho.crossJoin(F.broadcast(tau))  # one row each


def rank_stability(ranks: DataFrame, by: Sequence[str], rank: str = "rank", classes: int = 13, level: float = 0.95) -> DataFrame:
    """Mean, variance, interval and stability 1 - var / ((K^2 - 1) / 12) of each key's ranks over draws."""
    tail = (1 - level) / 2
    g = ranks.groupBy(*by).agg(F.avg(rank).alias("mean_rank"), F.coalesce(F.var_samp(rank), F.lit(0.0)).alias("rank_variance"), F.percentile(rank, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return g.select(*by, "mean_rank", "rank_variance", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), (1 - F.col("rank_variance") / F.lit((classes**2 - 1) / 12)).alias("stability"))


def standardized_regressions(df: DataFrame, outcome: str, predictors: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Ordinary least squares on z-scores (n in the denominator) per group: betas, R^2, rank and status.

    Only the sums of products leave the data; a group's normal equations are solved from them.
    """
    names = [outcome, *predictors]
    sums = [F.sum(F.col(x).cast("double")).alias(f"s_{i}") for i, x in enumerate(names)]
    prods = [F.sum(F.col(x).cast("double") * F.col(y).cast("double")).alias(f"p_{i}_{j}") for i, x in enumerate(names) for j, y in enumerate(names) if i <= j]
    agg = df.dropna(subset=names).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *prods)
    p = len(predictors)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in agg.schema.fields if f.name in by] + ["n bigint", "matrix_rank int", *[f"beta_{x} double" for x in predictors], "r_squared double", "status string"])

    def solve(batches):
        for b in batches:
            out = []
            for _, r in b.iterrows():
                n = r["n"]
                mean = np.array([r[f"s_{i}"] / n for i in range(p + 1)])
                cov = np.zeros((p + 1, p + 1))
                for i in range(p + 1):
                    for j in range(i, p + 1):
                        cov[i, j] = cov[j, i] = r[f"p_{i}_{j}"] / n - mean[i] * mean[j]
                sd = np.sqrt(np.maximum(np.diag(cov), 0))
                row = {**{k: r[k] for k in by}, "n": n, **{f"beta_{x}": None for x in predictors}, "r_squared": None, "matrix_rank": 0, "status": "ok"}
                if n < p + 2:
                    row["status"] = "too_few_rows"
                elif (sd < 1e-12).any():
                    row["status"] = "constant_column"
                else:
                    c = cov / np.outer(sd, sd)
                    row["matrix_rank"] = int(np.linalg.matrix_rank(c[1:, 1:], tol=1e-9)) + 1
                    if row["matrix_rank"] < p + 1:
                        row["status"] = "rank_deficient"
                    else:
                        beta = np.linalg.solve(c[1:, 1:], c[1:, 0])
                        row.update({f"beta_{x}": float(v) for x, v in zip(predictors, beta)})
                        row["r_squared"] = float(beta @ c[1:, 0])
                out.append(row)
            yield pd.DataFrame(out, columns=[*by, "n", "matrix_rank", *[f"beta_{x}" for x in predictors], "r_squared", "status"])

    return agg.mapInPandas(solve, schema)


DIAGNOSTICS = {"f1": True, "loss_bits": False, "brier": False}


def class_totals(oof: DataFrame, by: Sequence[str] = (), group: str = "group_id") -> DataFrame:
    """(by, group, class, n, support, said, tp, loss, square): what a group adds to each class's diagnostics, one against the rest."""
    d = oof.withColumn("_hat", A.argmax(F.col("p")))
    long = d.select(*by, F.col(group).alias("g"), "truth", "_hat", F.posexplode("p").alias("class", "s"))
    y, hat = (F.col("class") == F.col("truth")).cast("int"), (F.col("class") == F.col("_hat")).cast("int")
    return long.groupBy(*by, "g", "class").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("support"), F.sum(hat).alias("said"), F.sum(y * hat).alias("tp"), F.sum(A.cell_bits(y, F.col("s"))).alias("loss"), F.sum(F.pow(F.col("s") - y, F.lit(2.0))).alias("square"))


def class_draws(totals: DataFrame, multiplicities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, draw, class, diagnostic, value): F1, loss and Brier score of each class in each draw, from the groups' totals alone.

    ``multiplicities`` has draw, g and m; a draw costs its groups times the classes, whatever the number of items.
    """
    w = totals.join(multiplicities, "g")
    add = lambda c: F.sum(F.col("m") * F.col(c)).alias(c)
    v = w.groupBy(*by, "draw", "class").agg(*[add(c) for c in ("n", "support", "said", "tp", "loss", "square")])
    f1 = F.when(F.col("support") + F.col("said") > 0, 2 * F.col("tp") / (F.col("support") + F.col("said"))).otherwise(0.0)
    return v.select(*by, "draw", "class", F.explode(F.create_map(F.lit("f1"), f1, F.lit("loss_bits"), F.col("loss") / F.col("n"), F.lit("brier"), F.col("square") / F.col("n"))).alias("diagnostic", "value"))


def diagnostic_ranks(values: DataFrame, by: Sequence[str], digits: int = 9) -> DataFrame:
    """``values`` with ``rank``, 1 for the best class of each group of ``by``: the greatest F1, the least loss. Ties share their mean rank."""
    better = F.when(F.col("diagnostic").isin(*[k for k, up in DIAGNOSTICS.items() if up]), -F.col("value")).otherwise(F.col("value"))
    return with_rank(values.withColumn("_v", F.round(better, digits)), "_v", [*by, "diagnostic"]).drop("_v")
