"""Metrics of out-of-fold probability tables, from long form, with optional row weights.

A multiclass table has ``item_id``, ``truth`` (place of the true class from 0) and ``p``
(an array over a fixed class axis). A multilabel table has ``y`` and ``p`` arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.functions import arrays as A
from sparkgauge.functions.vocab import CLIP
from sparkgauge.session import Scratch

#: Upper edges of ten equal bins as floating-point steps, the way equal spacing yields them.
EDGES = tuple(i * 0.1 for i in range(1, 10))


def once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of ``df``, written and read back: what is measured several times is worked out once."""
    return Scratch(df.sparkSession, "measured").keep(df.select(*columns))


def wide_to_arrays(df: DataFrame, labels: Sequence[str], truth: str = "y_true") -> DataFrame:
    """prob__<label> columns to ``p``, and ``truth`` to its place in the class axis."""
    p = F.array(*[F.col(f"prob__{x}").cast("double") for x in labels])
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(truth)) - 1
    return df.withColumn("p", p).withColumn("truth", place.cast("int"))


def bin_of(confidence: Column) -> Column:
    """Ten bins, the first closed on both sides, the others open below."""
    out = F.when(confidence <= EDGES[0], 0)
    for i, e in enumerate(EDGES[1:], 1):
        out = out.when(confidence <= e, i)
    return out.otherwise(9)


def reliability(df: DataFrame, confidence: Column, correct: Column, by: Sequence[str] = ()) -> DataFrame:
    """Bins that hold rows: count, mean confidence, accuracy, gap and weight."""
    b = df.select(*by, confidence.alias("c"), correct.cast("double").alias("k")).groupBy(*by, bin_of(F.col("c")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_confidence"), F.avg("k").alias("accuracy"))
    all_of = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # at most ten rows a group
    return b.withColumn("gap", F.col("accuracy") - F.col("mean_confidence")).withColumn("weight", F.col("n") / F.sum("n").over(all_of))


def calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(F.sum(F.col("weight") * F.abs("gap")).alias("ece"))


def items(df: DataFrame) -> DataFrame:
    """Per item: prediction, confidence, correctness, gaps, loss in bits, Brier score."""
    p, t = F.col("p"), F.col("truth")
    return df.select(
        "*",
        A.argmax(p).alias("predicted"),
        F.array_max(p).alias("confidence"),
        (A.argmax(p) == t).cast("int").alias("correct"),
        A.true_gap(p, t).alias("true_gap"),
        A.top_margin(p).alias("top_margin"),
        A.loss_bits(F.element_at(p, t + 1)).alias("loss_bits"),
        A.brier(p, t).alias("brier"),
    )


#: Score ranges of a class; a running sum spans one range and the ranges' totals, never a whole class.
RANGES = 4096


def average_precision(long: DataFrame, by: Sequence[str], score: str = "s", hit: str = "y", weight: str | None = None) -> DataFrame:
    """Sum of precision times recall steps over falling scores, tied scores taken at once; 0 without positives.

    Running sums are exact and in two levels: over the score ranges of a class, which are
    at most ``RANGES`` rows, and within a range.
    """
    w = F.col(weight) if weight else F.lit(1)
    span = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * (RANGES - 1)).cast("int").alias("_r")
    steps = long.groupBy(*by, score, span).agg(F.sum(F.col(hit) * w).alias("_tp"), F.sum(w).alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = steps.groupBy(*by, "_r").agg(F.sum("_tp").alias("_rtp"), F.sum("_n").alias("_rn"))
    spans = spans.select(*by, "_r", F.coalesce(F.sum("_rtp").over(above), F.lit(0)).alias("_atp"), F.coalesce(F.sum("_rn").over(above), F.lit(0)).alias("_an"), F.sum("_rtp").over(Window.partitionBy(*by)).alias("_pos"))
    run = Window.partitionBy(*by, "_r").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = steps.join(spans, [*by, "_r"]).select(*by, "_tp", (F.sum("_tp").over(run) + F.col("_atp")).alias("_ctp"), (F.sum("_n").over(run) + F.col("_an")).alias("_cn"), "_pos")
    part = F.when((F.col("_pos") > 0) & (F.col("_cn") > 0), F.col("_tp") / F.col("_pos") * F.col("_ctp") / F.col("_cn")).otherwise(0.0)
    return cum.groupBy(*by).agg(F.sum(part).alias("average_precision"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def explode_classes(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, class, s, y, hat): one row per item and class."""
    d = df.withColumn("_hat", A.argmax(F.col("p")))
    long = d.select(*keep, "truth", "_hat", F.posexplode("p").alias("class", "s"))
    return long.select(*keep, "class", "s", (F.col("class") == F.col("truth")).cast("int").alias("y"), (F.col("class") == F.col("_hat")).cast("int").alias("hat"))


def classwise(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per class, one against the rest: support, precision, recall, F1, average precision, binary loss and calibration error."""
    keep = [*by, *([weight] if weight else [])]
    return _classwise(explode_classes(df, keep), [*by, "class"], weight)


def _classwise(long: DataFrame, key: list[str], weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    sums = long.groupBy(*key).agg(
        F.sum(F.col("y") * w).alias("support"),
        F.sum(F.col("hat") * w).alias("predicted"),
        F.sum(F.col("y") * F.col("hat") * w).alias("tp"),
        (F.sum(A.cell_bits(F.col("y"), F.col("s")) * w) / F.sum(w)).alias("loss_bits"),
        (F.sum(F.pow(F.col("s") - F.col("y"), F.lit(2.0)) * w) / F.sum(w)).alias("brier"),
    )
    pr, re = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    sums = sums.select(*key, "support", pr.alias("precision"), re.alias("recall"), f1.alias("f1"), "loss_bits", "brier")
    binned = long.groupBy(*key, bin_of(F.col("s")).alias("bin")).agg(F.sum(w).alias("n"), F.sum(F.col("s") * w).alias("cs"), F.sum(F.col("y") * w).alias("ys"))
    ece = binned.groupBy(*key).agg((F.sum(F.abs(F.col("ys") - F.col("cs"))) / F.sum("n")).alias("ece"))
    return sums.join(average_precision(long, key, weight=weight), key).join(ece, key)


def multiclass(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row: accuracy, macro F1 and average precision over the fixed axis, loss in bits, Brier score, calibration error.

    The table is read three times, so what is measured is written once.
    """
    df = once(df, [*by, "truth", "p"])
    each = items(df)
    head = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg("loss_bits").alias("log_loss_bits"), F.avg("brier").alias("brier"))
    ece = calibration_error(reliability(each, F.col("confidence"), F.col("correct"), by), by)
    macro = classwise(df, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg("average_precision").alias("macro_ap"))
    return _side_by_side([head, macro, ece], by)


def _side_by_side(tables: list[DataFrame], by: Sequence[str]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(by)) if by else out.crossJoin(F.broadcast(t))  # single rows
    return out


def explode_labels(df: DataFrame, threshold: Column, keep: Sequence[str] = ()) -> DataFrame:
    z = df.select(*keep, threshold.alias("_t"), F.posexplode(F.arrays_zip("y", "p")).alias("class", "z"))
    return z.select(*keep, "class", F.col("z.p").alias("s"), F.col("z.y").cast("int").alias("y"), (F.col("z.p") >= F.col("_t")).cast("int").alias("hat"))


def multilabel(df: DataFrame, threshold: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row: exact match, Hamming accuracy, macro F1 and average precision, loss, Brier score over cells, calibration error of all cells."""
    threshold = F.lit(0.5) if threshold is None else threshold
    df = once(df.withColumn("_threshold", threshold), [*by, "y", "p", "_threshold"])
    threshold = F.col("_threshold")
    d = df.withColumn("_p", A.over(F.col("p"), threshold))
    right = F.zip_with("_p", F.transform("y", lambda x: x.cast("int")), lambda a, b: (a == b).cast("double"))
    head = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.forall(right, lambda x: x == 1).cast("int")).alias("exact_match"),
        F.avg(A.total(right) / F.size("p")).alias("hamming_accuracy"),
        F.avg(A.multilabel_bits(F.transform("y", lambda x: x.cast("double")), F.col("p"))).alias("log_loss_bits"),
        F.avg(A.total(F.zip_with("y", "p", lambda a, b: F.pow(a - b, F.lit(2.0)))) / F.size("p")).alias("brier"),
    )
    long = explode_labels(df, threshold, by)
    macro = _classwise(long, [*by, "class"]).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg("average_precision").alias("macro_ap"))
    ece = calibration_error(reliability(long, F.col("s"), F.col("y"), by), by)
    return _side_by_side([head, macro, ece], by)


def multilabel_classwise(df: DataFrame, threshold: Column | None = None) -> DataFrame:
    return _classwise(explode_labels(df, F.lit(0.5) if threshold is None else threshold), ["class"])


summarize_multiclass = reconstruct_multiclass = multiclass
reconstruct_multilabel = multilabel


# agreement of partitions


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def partition_agreement(df: DataFrame, truth: str, predicted: str, n_labels: int, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information in nats, its normalised form, adjusted Rand index, macro F1 over ``n_labels`` and accuracy."""
    t = contingency(df, truth, predicted, by)
    rows = t.groupBy(*by, "a").agg(F.sum("n").alias("ra"))
    cols = t.groupBy(*by, "b").agg(F.sum("n").alias("cb"))
    whole = t.groupBy(*by).agg(F.sum("n").alias("whole_n"))
    on = list(by)
    j = t.join(rows, [*on, "a"]).join(cols, [*on, "b"])
    j = j.join(whole, on) if on else j.crossJoin(F.broadcast(whole))
    pairs = lambda x: x * (x - 1) / 2
    mi = j.groupBy(*by).agg(F.sum(F.col("n") / F.col("whole_n") * F.log(F.col("whole_n") * F.col("n") / (F.col("ra") * F.col("cb")))).alias("mi"), F.sum(pairs(F.col("n"))).alias("ij"), F.first("whole_n").alias("whole_n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("hits"), F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("n") / (F.col("ra") + F.col("cb"))).otherwise(0.0)).alias("f1"))
    join_n = (lambda d: d.join(whole, on)) if on else (lambda d: d.crossJoin(F.broadcast(whole)))
    h = lambda d, c, out: join_n(d).groupBy(*by).agg((-F.sum(F.col(c) / F.col("whole_n") * F.log(F.col(c) / F.col("whole_n")))).alias(f"h_{out}"), F.sum(pairs(F.col(c))).alias(f"p_{out}"))
    out = _side_by_side([mi, h(rows, "ra", "a"), h(cols, "cb", "b")], by)
    expected = F.col("p_a") * F.col("p_b") / pairs(F.col("whole_n"))
    top = (F.col("p_a") + F.col("p_b")) / 2
    mean_h = (F.col("h_a") + F.col("h_b")) / 2
    return out.select(
        *by,
        "mi",
        F.when(mean_h > 0, F.col("mi") / mean_h).otherwise(1.0).alias("nmi"),
        F.when(top == expected, 1.0).otherwise((F.col("ij") - expected) / (top - expected)).alias("ari"),
        (F.col("f1") / n_labels).alias("macro_f1"),
        (F.col("hits") / F.col("whole_n")).alias("accuracy"),
    )


def loss_column(p_true: Column, clip: float = CLIP) -> Column:
    return A.loss_bits(p_true, clip)
