"""Out-of-fold tables that other plans measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.functions import arrays as A

FOLDS = 5


def embedding_points(embeddings: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(item_id, label, x, outer_fold, group_id) of the embeddings table. A group, the id modulo 97, lies in one fold."""
    return embeddings.where("embedding is not null and label is not null").select(
        F.col("vec_id").alias("item_id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.col("vec_id") % 97 % folds).cast("int").alias("outer_fold"), (F.col("vec_id") % 97).alias("group_id")
    )


def train_centroids(points: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(outer_fold, site, x): centroids of each class over all folds but the test fold.

    Sums are taken once per fold and class; a fold's training sums are the others' sums added up.
    """
    sums = points.select("outer_fold", "label", F.posexplode("x").alias("pos", "v")).groupBy("outer_fold", "label", "pos").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    others = sums.withColumn("test", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("outer_fold"))))
    mean = others.groupBy("test", "label", "pos").agg((F.sum("s") / F.sum("n")).alias("m"))
    packed = mean.groupBy("test", "label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c"))
    return packed.select(F.col("test").alias("outer_fold"), F.col("label").alias("site"), F.transform("c", lambda z: z["m"]).alias("x"))


def nearest_centroid(points: DataFrame, gamma: float, classes: int = 10, folds: int = FOLDS) -> DataFrame:
    """``points`` with ``truth`` and ``p``: softmax of minus gamma times the squared distance to each class's training centroid.

    The centroids are one row of ``classes`` vectors a fold, whatever the number of points.
    """
    table = train_centroids(points, folds).groupBy("outer_fold").agg(F.array_sort(F.collect_list(F.struct("site", "x"))).alias("c"))
    return with_distances(points, table, lambda d: A.softmax(F.transform(d, lambda v: -v * F.lit(gamma)))).withColumn("truth", F.col("label")).drop("c", "d")


def with_distances(points: DataFrame, table: DataFrame, to_p) -> DataFrame:
    j = points.join(F.broadcast(table), "outer_fold")
    d: Column = F.transform("c", lambda s: A.squared_distance(F.col("x"), s["x"]))
    return j.withColumn("d", d).withColumn("p", to_p(F.col("d")))


def prior(points: DataFrame, classes: int = 10, folds: int = FOLDS) -> DataFrame:
    """``points`` with ``truth`` and ``p``: the training folds' class shares, clipped and made to sum to 1."""
    n = points.groupBy("outer_fold", "label").agg(F.count(F.lit(1)).alias("n"))
    others = n.withColumn("test", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("outer_fold"))))
    counts = others.groupBy("test").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).cast("double").alias(f"k{k}") for k in range(classes)])
    raw = F.array(*[F.col(f"k{k}") for k in range(classes)])
    clipped = lambda z: A.let(A.total(z), lambda t: F.transform(z, lambda v: F.greatest(v / t, F.lit(1e-12))))
    p = A.let(A.let(raw, clipped), lambda z: A.let(A.total(z), lambda t: F.transform(z, lambda v: v / t)))
    return points.join(F.broadcast(counts.select(F.col("test").alias("outer_fold"), p.alias("p"))), "outer_fold").withColumn("truth", F.col("label"))
