"""Typed tables from the raw corpora, and the aggregates of readers' judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.functions.text import normalized_text
from sparkgauge.functions.vocab import APPRAISALS, CLUSTERS, EMOTIONS, LABEL_CLUSTER, SEED, cluster_column, count_column, emotion_key, in_order, ordinal, prob_column
from sparkgauge.operators.checks import require_columns, summary

E = "struct<valence:int,arousal:int,dominance:int,emo_clusters:array<string>,emo_labels:array<string>>"
CONVERSATIONS = f"id bigint, company string, turns array<struct<is_made_by_customer:boolean,emotions:{E},tweets:array<struct<text:string,emotions:{E}>>>>"


def one_each(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows delivered again count once. Of different rows with one key the least by all columns stays."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def canonical_generation(raw: DataFrame) -> DataFrame:
    """Writer texts: ids as strings, ratings as integers, the normalised masked text and whether another item has it."""
    require_columns(raw, ["item_id", "writer_id", "hidden_emo_text", *APPRAISALS])
    typed = raw.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.col("writer_id").cast("string").alias("writer_id"),
        F.col("round_number").cast("string").alias("round_number"),
        "y_writer",
        "generated_text",
        "hidden_emo_text",
        *[F.expr(f"try_cast({a} as int)").alias(a) for a in APPRAISALS],
    )
    typed = typed.where("item_id is not null").dropDuplicates(["item_id"]).withColumn("normalized_text", normalized_text(F.col("hidden_emo_text")))
    shared = typed.where("normalized_text is not null").groupBy("normalized_text").agg((F.count(F.lit(1)) > 1).alias("normalized_text_duplicate"))
    return typed.join(shared, "normalized_text", "left")


def canonical_judgments(raw: DataFrame) -> DataFrame:
    """One row per item and reader, labels in the spelling of the vocabulary."""
    return raw.where("item_id is not null and reader_id is not null").withColumn("y_reader", emotion_key(F.col("y_reader"))).dropDuplicates(["item_id", "reader_id"])


def join_generation(judgments: DataFrame, generation: DataFrame) -> DataFrame:
    """Each judgment with its writer's columns; ``generation`` holds one row per item. No judgment is lost."""
    take = [c for c in generation.columns if c == "item_id" or c not in judgments.columns]
    return judgments.join(generation.select(*take), "item_id", "left")


def vote(judgments: DataFrame, item: str = "item_id", label: str = "y_reader", confidence: str = "reader_confidence", names: Sequence[str] = EMOTIONS) -> DataFrame:
    """Majority per item: most votes, then the voters' mean confidence, then vocabulary order.

    Also whether the top count is shared, and count and share of every label.
    Judgments without a label of the vocabulary don't vote.
    """
    place = ordinal(F.col(label), names)
    by_label = judgments.withColumn("_o", place).where("_o is not null").groupBy(item, "_o").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("_c"))
    counts = [F.sum(F.when(F.col("_o") == i, F.col("_n")).otherwise(0)).cast("int").alias(count_column(n)) for i, n in enumerate(names)]
    per = by_label.groupBy(item).agg(F.max(F.struct("_n", "_c", (-F.col("_o")).alias("_m"))).alias("_top"), F.sort_array(F.collect_list("_n"), asc=False).alias("_all"), *counts)
    n = F.aggregate("_all", F.lit(0).cast("bigint"), lambda s, x: s + x)
    label_of = F.element_at(F.array(*[F.lit(x) for x in names]), (1 - F.col("_top")["_m"]).cast("int"))
    return per.select(
        item,
        label_of.alias("y_reader_majority"),
        ((F.size("_all") > 1) & (F.col("_all")[0] == F.col("_all")[1])).alias("reader_majority_tie"),
        *[F.col(count_column(x)) for x in names],
        *[(F.col(count_column(x)) / n).alias(prob_column(x)) for x in names],
    )


def reader_lists(judgments: DataFrame, item: str = "item_id", reader: str = "reader_id", label: str = "y_reader") -> DataFrame:
    """The item's labels and readers in the readers' order. A judged item has few readers."""
    rows = F.sort_array(F.collect_list(F.struct(reader, label)))
    return judgments.groupBy(item).agg(rows.alias("_l")).select(item, F.transform("_l", lambda r: r[label]).alias("reader_labels"), F.transform("_l", lambda r: r[reader]).alias("reader_ids"))


def aggregate_readers(judgments: DataFrame) -> DataFrame:
    return vote(judgments).join(reader_lists(judgments.where("y_reader is not null")), "item_id", "left")


def panels(judgments: DataFrame, appraisal_readers: int = 2, panel: int = 0, seed: int = SEED) -> DataFrame:
    """reader_panel of each judgment: the readers with the least hashes give appraisals, the rest emotions."""
    rank = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(panel)), "item_id", "reader_id"), 256)
    n = F.row_number().over(Window.partitionBy("item_id").orderBy(rank, "reader_id"))
    return judgments.withColumn("reader_panel", F.when(n <= appraisal_readers, "appraisal").otherwise("emotion"))


def aggregate_panels(judgments: DataFrame, appraisal_readers: int = 2, seed: int = SEED) -> DataFrame:
    """Emotion votes of one panel beside the mean appraisals of the other, disjoint one, with both panels' sizes."""
    split = panels(judgments, appraisal_readers, seed=seed)
    a = split.where("reader_panel = 'appraisal'")
    rated = a.groupBy("item_id").agg(*[F.avg(f"reader_appraisal__{x}").alias(f"reader_appraisal__{x}") for x in APPRAISALS], F.sort_array(F.collect_list("reader_id")).alias("appraisal_reader_ids"))
    sizes = split.groupBy("item_id").agg(F.count_if(F.col("reader_panel") == "appraisal").alias("appraisal_panel"), F.count_if(F.col("reader_panel") == "emotion").alias("emotion_panel"))
    voted = vote(split.where("reader_panel = 'emotion'"))
    return voted.join(rated, "item_id", "left").join(sizes, "item_id", "left")


def panel_checks(split: DataFrame, appraisal_readers: int = 2, emotion_readers: int = 3) -> DataFrame:
    """Violations of the panels of ``panels``: sizes other than asked, and readers of one item in both."""
    per = split.groupBy("item_id").agg(F.count_if(F.col("reader_panel") == "appraisal").alias("a"), F.count_if(F.col("reader_panel") == "emotion").alias("e"))
    both = split.groupBy("item_id", "reader_id").agg(F.countDistinct("reader_panel").alias("k")).where("k > 1")
    return summary({"appraisal_panel_not_two": per.where(F.col("a") != appraisal_readers), "emotion_panel_not_three": per.where(F.col("e") != emotion_readers), "reader_in_both_panels": both})


def diagnostics(generation: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row of counts and rates."""
    g = generation.agg(
        F.count(F.lit(1)).alias("generation_rows"),
        F.countDistinct("item_id").alias("items"),
        F.countDistinct("writer_id").alias("writers"),
        F.sum(F.col("generated_text").isNull().cast("bigint")).alias("null_texts"),
    )
    j = judgments.agg(
        F.count(F.lit(1)).alias("judgment_rows"),
        F.countDistinct("reader_id").alias("readers"),
        F.countDistinct("item_id").alias("judged_items"),
        F.avg("reader_confidence").alias("mean_confidence"),
    )
    return g.crossJoin(F.broadcast(j))  # one row by one row


# tweets


def nest(tweets: DataFrame) -> DataFrame:
    """Conversations as nested documents, with an operator's turn wherever a number is left out."""
    e = F.struct("valence", "arousal", "dominance", "emo_clusters", "emo_labels")
    turn = tweets.groupBy("conversation_id", "company", "turn_index").agg(F.sort_array(F.collect_list(F.struct("tweet_index", "text", e.alias("emotions")))).alias("tweets"))
    turns = turn.select("conversation_id", "company", F.struct("turn_index", F.lit(True).alias("is_made_by_customer"), "tweets").alias("t"))
    return turns.groupBy("conversation_id", "company").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def flatten(conversations: DataFrame) -> DataFrame:
    """Customer tweets of nested conversations with places from 0, the composite key and 0/1 columns of the clusters."""
    turns = conversations.select(F.col("id").cast("string").alias("conversation_id"), "company", F.posexplode("turns").alias("turn_index", "turn")).where("turn.is_made_by_customer")
    each = turns.select("conversation_id", "company", "turn_index", F.posexplode("turn.tweets").alias("tweet_index", "tw"))
    flat = each.select(
        F.concat_ws(":", "conversation_id", "turn_index", "tweet_index").alias("item_id"),
        "conversation_id",
        "turn_index",
        "tweet_index",
        "company",
        F.col("tw.text").alias("text"),
        in_order(F.col("tw.emotions.emo_clusters"), CLUSTERS).alias("emo_clusters"),
        in_order(F.col("tw.emotions.emo_labels"), tuple(LABEL_CLUSTER)).alias("emo_labels"),
        *[F.col(f"tw.emotions.{v}").alias(v) for v in ("valence", "arousal", "dominance")],
    )
    return one_hot(flat)


def one_hot(df: DataFrame, column: str = "emo_clusters") -> DataFrame:
    return df.select("*", *[F.coalesce(F.array_contains(column, c), F.lit(False)).cast("int").alias(cluster_column(c)) for c in CLUSTERS])


def expected_clusters(labels: Column) -> Column:
    """The clusters of an array of labels in order; Neutral gives way to any other."""
    table = F.create_map(*[F.lit(x) for kv in LABEL_CLUSTER.items() for x in kv])
    mapped = F.array_distinct(F.filter(F.transform(labels, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull()))
    return in_order(F.when(F.size(mapped) > 1, F.array_remove(mapped, "Neutral")).otherwise(mapped), CLUSTERS)


def label_support(tweets: DataFrame, columns: Sequence[str], least_positive: int = 100, least_negative: int = 50) -> DataFrame:
    """Positives, negatives and whether both reach their minimum, for each 0/1 column, from one pass."""
    sums = tweets.agg(*[F.sum(F.col(c)).cast("bigint").alias(f"p_{c}") for c in columns], *[F.count_if(F.col(c) == 0).cast("bigint").alias(f"n_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("label"), F.coalesce(F.col(f"p_{c}"), F.lit(0)).alias("positives"), F.col(f"n_{c}").alias("negatives")) for i, c in enumerate(columns)])
    return sums.select(F.inline(rows)).withColumn("eligible", (F.col("positives") >= least_positive) & (F.col("negatives") >= least_negative))
