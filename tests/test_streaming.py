"""The running vote over a stream equals the batch count over the same rows; the command line publishes a query."""

from pyspark.sql import functions as F

from sparkgauge import cli
from sparkgauge.functions.vocab import emotion_key
from sparkgauge.streaming import votes


def test_stream_equals_batch(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/validation_judgments.parquet").where("submitted_at is not null").withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    last = src.limit(1).withColumn("item_id", F.lit("end")).withColumn("submitted_at", F.expr("timestamp '2031-01-01'"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    last.write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run closes the windows behind the watermark
        votes.run_once(votes.running_votes(votes.read_judgments(spark, str(tmp_path / "in")), window="3650 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["item_id"], r["label"]): r["votes"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("item_id", "label").agg(F.sum("votes").alias("votes")).collect()}
    want = src.where("item_id is not null and reader_id is not null").dropDuplicates(["item_id", "reader_id"]).withColumn("label", emotion_key(F.col("y_reader"))).where("label is not null").groupBy("item_id", "label").count().collect()
    assert got == {(r["item_id"], r["label"]): r["count"] for r in want} and got


def test_command_line(spark, data, tmp_path, capsys):
    assert cli.main(["query", "label_support", data, "--output", str(tmp_path / "a")]) == 0
    assert cli.main(["index", str(tmp_path)]) == 0
    assert '"kind": "query"' in capsys.readouterr().out
