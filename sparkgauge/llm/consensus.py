"""Consensus from several annotators' labels by message passing.

Every item that somebody labelled with class c is a binary task "c against the rest";
an annotator's vote on the item is +1 for that task if it says c, else -1. Messages
run along the edges of tasks and annotators: a task tells an annotator how its other
annotators, weighted by their reliability, vote; an annotator tells a task how well
its votes on all other tasks fit what those tasks said. Both leave out what came from
the receiver. When the annotators' reliabilities stand still, the last messages give the
result: each item takes the class whose task the votes, weighted by the annotators'
messages, speak for most, and an annotator's reliability is the mean of its messages.
Task messages are means over the senders and annotator messages are means shrunk by
``PRIOR`` silent votes, so that an annotator with a tenth of all rows weighs no more
than one with few rows and the same care. Where annotators mostly contradict each other the
messages would swing; once their moves stop shrinking, task messages are averaged with
those of the round before, which has the same resting points and none that swings. If
they then fall silent, all annotators count alike. Messages that never settle are an error.

Labels that differ in case, blanks, hyphens or underscores are one label. Rows without
an item, an annotator or a label are no votes. Repeated votes count once; of an
annotator's different labels for one item the least counts. Of equally strong classes
that with more votes wins, then the least. An item with one vote takes it, with an
agreement of 1. An empty table gives empty results. There may be any number of labels:
within an item a class is its place among the item's own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.operators.bootstrap import numbered
from sparkgauge.operators.skew import hot_join, hot_keys
from sparkgauge.session import Scratch

PRIOR = 3.0
MAX_ROUNDS = 60
#: Ends when the annotators' reliabilities move by less than this, relative to their size.
TOLERANCE = 0.02
#: Reliabilities of this size, where agreement gives about 0.3, are rounding.
SILENCE = 1e-6
#: An annotator table with at most this many rows of three values is broadcast; beyond it, it is joined by shuffle.
BROADCAST_ANNOTATORS = 200_000


class NotSettled(RuntimeError):
    pass


@dataclass
class Consensus:
    items: DataFrame
    annotators: DataFrame
    votes: DataFrame
    rounds: int
    residual: float


def label_key(label: Column) -> Column:
    k = F.regexp_replace(F.lower(F.regexp_replace(label, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")), r"[\p{IsWhite_Space}_-]+", "-")
    return F.when(k != "", k)


def clean_votes(df: DataFrame, item: str, annotator: str, label: str) -> DataFrame:
    """(item, who, label), one row per item and annotator."""
    v = df.select(F.col(item).cast("string").alias("item"), F.col(annotator).cast("string").alias("who"), label_key(F.col(label)).alias("label"))
    return v.dropna().groupBy("item", "who").agg(F.min("label").alias("label"))


def _meet(big: DataFrame, who: DataFrame, n_who: int, hot: list, key: str) -> DataFrame:
    if n_who <= BROADCAST_ANNOTATORS:
        return big.join(F.broadcast(who), key)
    return hot_join(big, who, key, hot=hot)


def consensus(df: DataFrame, item: str, annotator: str, label: str, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> Consensus:
    """Items with their consensus, agreement and votes; annotators with their reliability and how often they gave the consensus."""
    s = Scratch(df.sparkSession, "consensus")
    votes = s.keep(clean_votes(df, item, annotator, label))
    hot_item = hot_keys(votes, "item", rows=s.rows(votes))
    hot_who = hot_keys(votes, "who", rows=s.rows(votes))
    who = s.keep(numbered(votes.select("who").distinct(), ["who"], "w_id").select("who", F.col("w_id").cast("int")))
    n_who = s.rows(who)
    # the classes of an item: at most as many as there are labels, whatever the number of its votes
    classes = s.keep(votes.groupBy("item").agg(F.array_sort(F.collect_set("label")).alias("classes")))
    edges = hot_join(_meet(votes, who, n_who, hot_who, "who"), classes, "item", hot=hot_item)
    edges = edges.select("item", "w_id", F.array_position("classes", F.col("label")).alias("l"), F.explode(F.sequence(F.lit(1), F.size("classes"))).alias("c"))
    edges = edges.select("item", F.col("c").cast("int").alias("c"), "w_id", F.when(F.col("c") == F.col("l"), 1.0).otherwise(-1.0).cast("float").alias("a"))
    x = s.keep(_by_task(edges.withColumn("y", F.lit(1.0).cast("float")), hot_item))
    hot_id = [r[0] for r in who.where(F.col("who").isin(hot_who)).select("w_id").collect()] if hot_who else []
    trust, residual, size, calm = None, None, None, False
    for rounds in range(1, max_rounds + 1):
        sums = x.groupBy("w_id").agg(F.sum(F.col("a") * F.col("x")).alias("y_all"), F.count(F.lit(1)).alias("e"))
        sums = s.keep(sums.withColumn("w", F.col("y_all") / (F.col("e") + PRIOR)))
        if trust is None:
            square, along = sums.agg(F.avg(F.col("w") * F.col("w"))).first()[0], None
        else:
            square, along = sums.join(trust.select("w_id", F.col("w").alias("was")), "w_id").agg(F.avg(F.col("w") * F.col("w")), F.avg(F.col("w") * F.col("was"))).first()
        if not square or square < SILENCE**2:  # nobody shares a task with anybody, or what all say cancels out
            trust = None
            break
        # both vectors at length 1: the square of their distance is 2 less twice their cosine
        before, residual = residual, None if trust is None else max(2 - 2 * along / (math.sqrt(square) * size), 0.0) ** 0.5
        calm = calm or (before is not None and residual > 0.9 * before)
        trust, size = sums, math.sqrt(square)
        y = (F.col("y_all") - F.col("a") * F.col("x")) / (F.col("e") - 1 + PRIOR) / F.lit(size)
        state = _meet(x, sums.select("w_id", "y_all", "e"), n_who, hot_id, "w_id").select("item", "c", "w_id", "a", y.cast("float").alias("y"), *(["x"] if calm else []))
        if residual is not None and residual < tolerance:
            break
        after = s.keep(_by_task(state, hot_item))
        s.drop(x)
        x = after
    else:
        raise NotSettled(f"reliabilities still move by {residual} after {max_rounds} rounds")
    if trust is None:
        state = x.select("item", "c", "w_id", "a", F.lit(1.0).alias("y"))
    said = F.col("a") > 0  # an annotator's own class
    scored = state.groupBy("item", "c").agg(F.sum(F.col("a") * F.col("y")).alias("score"), F.sum(F.when(said, F.greatest(F.col("y"), F.lit(0.0))).otherwise(0.0)).alias("weight"), F.count_if(said).alias("n"))
    items = scored.groupBy("item").agg(_best("score", "n", "c", "weight").alias("b"), F.sum("weight").alias("all_weight"), F.sum("n").alias("votes"), F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("most"))
    agreement = F.when(F.col("all_weight") > 0, F.least(F.col("b.w") / F.col("all_weight"), F.lit(1.0))).otherwise(F.lit(1.0) / F.col("n_classes"))
    items = items.join(classes, "item").select("item", F.element_at("classes", F.col("b.c")).alias("consensus"), "votes", F.col("n_classes").alias("classes"), (F.col("most") / F.col("votes")).alias("plain_share"), agreement.alias("agreement"))
    items = s.keep(items)
    seen = hot_join(votes, items.select("item", "consensus"), "item", hot=hot_item).groupBy("who").agg(F.count(F.lit(1)).alias("judgments"), F.count_if(F.col("label") == F.col("consensus")).alias("agreed"))
    seen = seen.select("who", "judgments", "agreed", (F.col("agreed") / F.col("judgments")).alias("agreement"))
    if trust is None:
        annotators = seen.withColumn("reliability", F.lit(1.0))
    else:
        annotators = seen.join(who.join(trust.select("w_id", (F.col("w") / F.lit(size)).alias("reliability")), "w_id").select("who", "reliability"), "who", "left")
    return Consensus(items, s.keep(annotators), votes, rounds, residual or 0.0)


def _best(score: str, n: str, c: str, weight: str) -> Column:
    """The class with the greatest score, then the most votes, then the least name, with its weight ``w``."""
    return F.min(F.struct((-F.round(score, 6)).alias("s"), (-F.col(n)).alias("n"), F.col(c).alias("c"), F.col(weight).alias("w")))


def _by_task(state: DataFrame, hot_item: list) -> DataFrame:
    """Each edge (item, c, w_id, a) with the mean ``x`` of the other votes of its task, weighted by their messages y; 0 if there is no other.
    A state that holds ``x`` already gets the average of the former and the new one.

    An item's edges meet in one place by one shuffle. Items that hold a large share of
    the votes don't: their tasks' totals, at most 1 / HOT_SHARE items times the labels,
    are added up in parts and broadcast.
    """
    votes = F.col("a") * F.col("y")
    x = F.when(F.col("d") > 1, (F.col("x_all") - votes) / (F.col("d") - 1)).otherwise(0.0)
    if "x" in state.columns:
        x = (x + F.col("x")) / 2
    x = x.cast("float").alias("x")
    task = Window.partitionBy("item", "c")
    is_hot = F.col("item").isin(hot_item) if hot_item else F.lit(False)
    cold = (state.where(~is_hot) if hot_item else state).repartition("item").withColumn("x_all", F.sum(votes).over(task)).withColumn("d", F.count(F.lit(1)).over(task)).select("item", "c", "w_id", "a", x)
    if not hot_item:
        return cold
    totals = state.where(is_hot).groupBy("item", "c").agg(F.sum(votes).alias("x_all"), F.count(F.lit(1)).alias("d"))
    return cold.unionByName(state.where(is_hot).join(F.broadcast(totals), ["item", "c"]).select("item", "c", "w_id", "a", x))


def careless(c: Consensus, least: int = 15, below: float = 0.5) -> DataFrame:
    """(who): annotators of at least ``least`` items who gave the consensus in less than ``below`` of them."""
    return c.annotators.where((F.col("judgments") >= least) & (F.col("agreed") < F.lit(below) * F.col("judgments"))).select("who")
