"""Design geometry: contrast of sites, representation of their cells, nearest-site and power assignment.

Sites are few (one per class or constellation); their number is checked before they are
broadcast, and many sites are searched like neighbours. Points stay distributed. ``sites`` has ``site`` and ``x``, ``points`` an id and ``x``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.functions import arrays as A
from sparkgauge.operators.tasks import dense
from sparkgauge.session import Scratch

#: Sites that go to every task at once.
MOST_SITES = 100_000
#: Bytes of a table of points that goes to every task at once.
MOST_POINTS = 64 << 20
#: Points of which the search for neighbours knows the distance to every row.
MOST_PIVOTS = 2048


class EmptyCell(ValueError):
    pass


def centroids(points: DataFrame, label: str, x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """(by, site, x, n): mean vector of each label, coordinates averaged map-side."""
    long = points.select(*by, F.col(label).alias("site"), F.posexplode(x).alias("pos", "v"))
    means = long.groupBy(*by, "site", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    packed = means.groupBy(*by, "site").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c"), F.max("n").alias("n"))
    return packed.select(*by, "site", F.transform("c", lambda s: s["m"]).alias("x"), "n")


def pairwise(sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, d): distance of every unordered pair of sites."""
    a = sites.select(*by, F.col("site").alias("a"), F.col("x").alias("xa"))
    b = sites.select(*by, F.col("site").alias("b"), F.col("x").alias("xb"))
    j = a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))  # sites are few
    return j.where("a < b").select(*by, "a", "b", F.sqrt(A.squared_distance(F.col("xa"), F.col("xb"))).alias("d"))


def contrast(sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pairwise(sites, by).groupBy(*by).agg(F.sum("d").alias("contrast_sum"), F.avg("d").alias("contrast_mean"))


def assign(points: DataFrame, sites: DataFrame, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``points`` with ``cell`` and ``cell_distance``: the site of least squared distance less its weight, the first of equals.

    Without weights and groups, more than ``MOST_SITES`` sites are searched by ``nearest``; ``points`` then has an ``item_id``.
    """
    if not by and weight is None and sites.count() > MOST_SITES:
        found = nearest(points.select(F.col("item_id").alias("test_id"), "x"), sites.select(F.col("site").alias("train_id"), "x"), 1)
        return points.join(found.select(F.col("test_id").alias("item_id"), F.col("train_id").alias("cell"), F.col("d2").alias("cell_distance")), "item_id")
    best = F.array_sort(F.collect_list(F.struct("site", "x", *([weight] if weight else []))))
    table = sites.groupBy(*by).agg(best.alias("_s"))
    j = points.join(F.broadcast(table), list(by)) if by else points.crossJoin(F.broadcast(table))  # one row of sites a group
    own = lambda s: A.squared_distance(F.col("x"), s["x"]) - (s[weight] if weight else F.lit(0.0))
    d = j.withColumn("_d", F.transform("_s", own))
    at = A.argmin(F.col("_d"))
    return d.withColumn("cell", F.col("_s")[at]["site"]).withColumn("cell_distance", F.array_min("_d")).drop("_s", "_d")


def representation(points: DataFrame, sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum and mean of the distances of sites to the centroids of their cells, null where a cell is empty."""
    cells = centroids(assign(points, sites, by=by), "cell", by=by).select(*by, "site", F.col("x").alias("cx"))
    j = sites.join(cells, [*by, "site"], "left").withColumn("d", F.sqrt(A.squared_distance(F.col("x"), F.col("cx"))))
    full = F.count_if(F.col("cx").isNull()) == 0
    return j.groupBy(*by).agg(F.when(full, F.sum("d")).alias("representation_sum"), F.when(full, F.avg("d")).alias("representation_mean"), F.count_if(F.col("cx").isNull()).alias("empty_cells"))


def scores(points: DataFrame, sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c, r = contrast(sites, by), representation(points, sites, by)
    return c.join(r, list(by)) if by else c.crossJoin(F.broadcast(r))  # one row each


def require_cells(assigned: DataFrame, sites: DataFrame) -> None:
    empty = [r["site"] for r in sites.select("site").join(assigned.select(F.col("cell").alias("site")).distinct(), "site", "left_anti").limit(10).collect()]
    if empty:
        raise EmptyCell(f"cells without points: {sorted(empty)}")


def power_diagram(coefficients: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Linear class scores (site, w, b) as sites and weights: gauge of zero sums, sites w / 2, weights b + |w|^2 / 4."""
    long = coefficients.select(*by, "site", "b", F.posexplode("w").alias("pos", "v"))
    mean_w = long.groupBy(*by, "pos").agg(F.avg("v").alias("m"))
    means = mean_w.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_m"))
    mean_b = coefficients.groupBy(*by).agg(F.avg("b").alias("_b"))
    side = means.join(mean_b, list(by)) if by else means.crossJoin(F.broadcast(mean_b))
    j = coefficients.join(F.broadcast(side), list(by)) if by else coefficients.crossJoin(F.broadcast(side))  # one row
    w = F.zip_with("w", F.transform("_m", lambda s: s["m"]), lambda a, m: a - m)
    j = j.withColumn("_w", w)
    return j.select(*by, "site", F.transform("_w", lambda v: v / 2).alias("x"), (F.col("b") - F.col("_b") + A.dot(F.col("_w"), F.col("_w")) / 4).alias("weight"))


_FOUND = "i bigint, j bigint, d2 double"


def _top(i: np.ndarray, a: np.ndarray, fi: np.ndarray, j: np.ndarray, b: np.ndarray, fj: np.ndarray, k: int) -> pa.Table:
    """The k nearest rows of b for each row of a whose mark differs, ties by id."""
    order = np.argsort(j, kind="stable")
    b, j, fj = b[order], j[order], fj[order]
    out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    for s in range(0, len(a), 256):
        if not len(b):
            break
        d = np.array([((row - b) ** 2).sum(1) for row in a[s : s + 256]])
        d[fi[s : s + 256, None] == fj[None, :]] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        dd = np.take_along_axis(d, top, 1).ravel()
        ok = np.isfinite(dd)
        out[0].append(np.repeat(i[s : s + 256], top.shape[1])[ok])
        out[1].append(j[top].ravel()[ok])
        out[2].append(dd[ok])
    return pa.table({"i": pa.array(np.concatenate(out[0]), pa.int64()), "j": pa.array(np.concatenate(out[1]), pa.int64()), "d2": pa.array(np.concatenate(out[2]), pa.float64())})


def nearest(test: DataFrame, train: DataFrame, k: int, test_id: str = "test_id", train_id: str = "train_id", apart: str | None = None, block: int = 4096, most: int | None = None) -> DataFrame:
    """(test_id, train_id, d2): the k nearest training rows, ties by training id, exact.

    Rows whose values of ``apart`` are equal don't count for each other. Training rows of at most ``most``
    bytes go to every task. More are put into cells about pivots, which are training rows. A test row is first compared with the
    nearest cells that hold k rows; its k-th distance then rules out every cell whose pivot is further away than that and the
    cell's radius, and it meets only the others. Cells of more than ``block`` rows are met in blocks, so equal points overload no task.
    """
    spark = test.sparkSession
    mark = lambda df: F.col(apart).cast("bigint") if apart else F.lit(None).cast("bigint")
    t = test.select(F.col(test_id).cast("bigint").alias("i"), F.col("x").alias("xi"), F.coalesce(mark(test), F.lit(-1)).alias("fi"))
    r = train.select(F.col(train_id).cast("bigint").alias("j"), F.col("x").alias("xj"), F.coalesce(mark(train), F.lit(-2)).alias("fj"))
    first = r.select(F.size("xj")).first()
    width = first[0] if first else 0
    rows = r.count()
    best = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))).where(F.col("n") <= k).drop("n")
    if rows * (width + 2) * 8 <= (MOST_POINTS if most is None else most):
        got = r.toArrow()
        shared = spark.sparkContext.broadcast((got.column("j").to_numpy(), dense(got.column("xj"), width or 1), got.column("fj").to_numpy()))

        def scan(batches):
            for b in batches:
                yield from _top(b.column(0).to_numpy(), dense(b.column(1), width or 1), b.column(2).to_numpy(), *shared.value, k).to_batches()

        found = t.mapInArrow(scan, _FOUND)
        return found.select(F.col("i").alias(test_id), F.col("j").alias(train_id), "d2")
    s = Scratch(spark, "nearest")
    pivots = r.orderBy(F.xxhash64("j"), "j").limit(max(1, min(MOST_PIVOTS, rows // block))).toArrow()
    centre = spark.sparkContext.broadcast(dense(pivots.column("xj"), width))

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = dense(b.column(1), width)
                d = np.array([((row - centre.value) ** 2).sum(1) for row in x])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d.argmin(1), pa.int32()), pa.array(np.sqrt(d.min(1)), pa.float64())], names=["j", "xj", "fj", "cell", "away"])

    placed = s.keep(r.mapInArrow(place, "j bigint, xj array<double>, fj bigint, cell int, away double"))
    cells = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row per pivot
    radius, size = np.full(pivots.num_rows, -np.inf), np.zeros(pivots.num_rows, dtype=np.int64)
    for c in cells:
        radius[c["cell"]], size[c["cell"]] = c["radius"], c["n"]
    about = spark.sparkContext.broadcast((radius, size))
    blocks = {int(c): -(-int(n) // block) for c, n in enumerate(size) if n}
    many, sized = F.col("blocks"), spark.createDataFrame(list(blocks.items()), "cell int, blocks int")

    def in_blocks(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(sized), "cell")  # a row per pivot

    def homes(batches):
        """Cells to look into first: the nearest ones until they hold k rows that count."""
        radius, size = about.value
        for b in batches:
            if b.num_rows:
                out = []
                for row in dense(b.column(1), width):
                    d = ((row - centre.value) ** 2).sum(1)
                    order = np.argsort(d, kind="stable")
                    out.append(order[: int(np.searchsorted(np.cumsum(size[order]), k) + 1)].tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int32()))], names=["i", "xi", "fi", "home"])

    def others(batches):
        """The other cells that may hold a row as near as the k-th one found; all of them if fewer were found."""
        radius, size = about.value
        for b in batches:
            if b.num_rows:
                out = []
                for row, home, far in zip(dense(b.column(1), width), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    reach = np.inf if far is None else np.sqrt(far) * (1 + 1e-9) + 1e-12
                    d = np.sqrt(((row - centre.value) ** 2).sum(1))
                    may = (size > 0) & (d - radius <= reach)
                    may[home] = False
                    out.append(np.nonzero(may)[0].tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int32()))], names=["i", "xi", "fi", "home"])

    def meet(asked: DataFrame) -> DataFrame:
        """Each asked row with each block of its cells; a pair of blocks is one small task."""
        a = in_blocks(asked.select("i", "xi", "fi", F.explode("home").alias("cell"))).withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
        b = in_blocks(placed.select("j", "xj", "fj", "cell")).withColumn("part", F.pmod(F.xxhash64("j"), many).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            return _top(left.column("i").to_numpy(), dense(left.column("xi"), width), left.column("fi").to_numpy(), right.column("j").to_numpy(), dense(right.column("xj"), width), right.column("fj").to_numpy(), k)

        pairs = a.select("i", "xi", "fi", "cell", "part", "salt").groupBy("cell", "part", "salt").cogroup(b.select("j", "xj", "fj", "cell", "part", "salt").groupBy("cell", "part", "salt"))
        return pairs.applyInArrow(run, _FOUND)

    salts = max(1, -(-t.count() // (block * max(1, len(blocks)))))
    asked = s.keep(t.mapInArrow(homes, "i bigint, xi array<double>, fi bigint, home array<int>"))
    near = s.keep(best(meet(asked)))
    far = near.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("d2")).select("i", F.when(F.col("n") == k, F.col("d2")).alias("far"))
    rest = asked.join(far, "i", "left").select("i", "xi", "fi", "home", "far").mapInArrow(others, "i bigint, xi array<double>, fi bigint, home array<int>")
    return best(near.unionByName(meet(rest))).select(F.col("i").alias(test_id), F.col("j").alias(train_id), "d2")


def vote_inverse_distance(neighbours: DataFrame, labels: DataFrame, test_id: str = "test_id", train_id: str = "train_id") -> DataFrame:
    """(test_id, predicted): inverse squared distances add up by label; exact matches vote alone; the least label wins ties."""
    exact = 1e-24
    j = neighbours.join(labels, train_id)
    seen = j.groupBy(test_id).agg(F.min("d2").alias("least"))
    w = F.when(F.col("least") <= exact, (F.col("d2") <= exact).cast("double")).otherwise(1 / F.greatest("d2", F.lit(exact)))
    votes = j.join(seen, test_id).groupBy(test_id, "label").agg(F.sum(w).alias("w"))
    return votes.groupBy(test_id).agg(F.max(F.struct("w", (-F.col("label")).alias("m"))).alias("top")).select(test_id, (-F.col("top.m")).alias("predicted"))
