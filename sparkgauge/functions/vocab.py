"""Closed vocabularies. Their order settles every tie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The emotions of the crowd corpus, in order.
EMOTIONS = ("anger", "boredom", "disgust", "fear", "guilt", "joy", "pride", "relief", "sadness", "shame", "surprise", "trust", "no-emotion")

# The appraisals, in order.
APPRAISALS = (
    "suddenness", "familiarity", "predict_event", "pleasantness", "unpleasantness", "goal_relevance", "chance_responsblt",
    "self_responsblt", "other_responsblt", "predict_conseq", "goal_support", "urgency", "self_control", "other_control",
    "chance_control", "accept_conseq", "standards", "social_norms", "attention", "not_consider", "effort",
)

# The clusters of the tweet corpus, in order.
CLUSTERS = ("Anger", "Annoyance", "Desire", "Disappointment", "Gratitude", "Joy", "Nervousness", "Neutral", "Relief")

# The cluster of each label; the keys, in order, are the label vocabulary.
LABEL_CLUSTER = {
    "Admiration": "Joy",
    "Amusement": "Joy",
    "Anger": "Anger",
    "Annoyance": "Annoyance",
    "Approval": "Joy",
    "Caring": "Relief",
    "Confusion": "Neutral",
    "Curiosity": "Neutral",
    "Desire": "Desire",
    "Disappointment": "Disappointment",
    "Disapproval": "Annoyance",
    "Disgust": "Anger",
    "Embarrassment": "Neutral",
    "Excitement": "Joy",
    "Fear": "Nervousness",
    "Gratitude": "Gratitude",
    "Grief": "Neutral",
    "Joy": "Joy",
    "Love": "Joy",
    "Nervousness": "Nervousness",
    "Optimism": "Desire",
    "Pride": "Neutral",
    "Realization": "Neutral",
    "Relief": "Relief",
    "Remorse": "Neutral",
    "Sadness": "Disappointment",
    "Surprise": "Neutral",
    "Neutral": "Neutral",
}

SEED = 20240804
CLIP = 1e-15
FIT_CLIP = 1e-12

# Grids of the probes and of the decoder ladder.
C_GRID = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
MULTIPLIERS = (0.1, 0.3, 1.0, 3.0, 10.0)
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
GAMMAS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
LADDER_C = (0.01, 0.1, 1.0, 10.0, 100.0)
SITES_PER_CLASS = (2, 3)


def cluster_column(cluster: str) -> str:
    return "y__" + cluster.lower()


def count_column(emotion: str) -> str:
    return "reader_count__" + emotion.replace("-", "_")


def prob_column(emotion: str) -> str:
    return "reader_prob__" + emotion.replace("-", "_")


def vocabulary(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(name, ordinal), a table of a few rows."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ordinal int")


def ordinal(column: Column, names: Sequence[str]) -> Column:
    """Place in the vocabulary from 0; null outside it."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), column), F.lit(0)) - 1


def in_order(column: Column, names: Sequence[str]) -> Column:
    """The array's members sorted by vocabulary place, repeats kept, strangers last by name."""
    keyed = F.transform(column, lambda x: F.struct(F.coalesce(ordinal(x, names), F.lit(len(names))).alias("o"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def emotion_key(column: Column) -> Column:
    """Spelling of the emotion vocabulary: lower case, trimmed, blanks and underscores as hyphens; null if blank."""
    k = F.regexp_replace(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), r"[\s_]+", "-")
    return F.when(k != "", k)
