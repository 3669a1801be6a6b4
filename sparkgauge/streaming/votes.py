"""Votes on a stream of judgments.

The batch operators have no notion of arrival; this keeps a running vote per item while
judgments come in, with late and repeated ones handled by event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions.vocab import emotion_key


def read_judgments(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The judgments of a folder of Parquet files as they arrive."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_votes(judgments: DataFrame, late: str = "60 days", window: str = "30 days") -> DataFrame:
    """(window, item_id, label, votes): votes by submission window; repeats within the watermark count once.

    State is held for as long as the watermark allows and no longer.
    """
    j = judgments.where("item_id is not null and reader_id is not null").withColumn("ts", F.col("submitted_at").cast("timestamp")).withWatermark("ts", late)
    j = j.dropDuplicatesWithinWatermark(["item_id", "reader_id"]).withColumn("label", emotion_key(F.col("y_reader"))).where("label is not null")
    return j.groupBy(F.window("ts", window), "item_id", "label").agg(F.count(F.lit(1)).alias("votes"))


def run_once(votes: DataFrame, target: str, checkpoint: str):
    """Works off what is there, appending closed windows to a Parquet folder, and stops. A restart goes on where it ended."""
    q = votes.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
