"""Readers of the raw corpora and of split tables."""

from __future__ import annotations

import json
import shutil
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions.vocab import APPRAISALS
from sparkgauge.operators.checks import ConstraintError, exact_columns, require_columns
from sparkgauge.operators.ingest import CONVERSATIONS
from sparkgauge.sources import store

GENERATION = "round_number string, emotion string, text_id string, prolific_id string, generated_text string, hidden_emo_text string, " + ", ".join(f"{a} string" for a in APPRAISALS)
JUDGMENTS = "original_emotion string, emotion string, text_id string, prolific_id string, confidence string, " + ", ".join(f"{a} string" for a in APPRAISALS)

# The split tables and their columns.
SPLITS = {
    "crowd_full_outer": ("item_id", "group_id", "writer_id", "test_fold"),
    "crowd_full_inner": ("outer_fold", "item_id", "group_id", "writer_id", "validation_fold"),
    "crowd_reader_outer": ("item_id", "group_id", "writer_id", "test_fold"),
    "crowd_reader_inner": ("outer_fold", "item_id", "group_id", "writer_id", "validation_fold"),
    "crowd_external": ("item_id", "group_id", "writer_id", "role"),
    "crowd_external_inner": ("item_id", "group_id", "writer_id", "validation_fold"),
    "emotwics_outer": ("item_id", "group_id", "conversation_id", "test_fold"),
    "emotwics_inner": ("outer_fold", "item_id", "group_id", "conversation_id", "validation_fold"),
}
_FOLDS = ("test_fold", "outer_fold", "validation_fold")


def unzip_members(archive: str | Path, endings: Sequence[str], to: str | Path) -> list[Path]:
    """The archive's members with the given endings, streamed to ``to``; a missing or ambiguous one is an error."""
    out = []
    with zipfile.ZipFile(archive) as z:
        for e in endings:
            found = [n for n in z.namelist() if n.endswith(e) and not n.startswith("/") and ".." not in n.split("/")]
            if len(found) != 1:
                raise ConstraintError(f"{len(found)} members end with {e}")
            target = Path(to) / Path(e).name
            with z.open(found[0]) as src, open(target, "wb") as dst:
                shutil.copyfileobj(src, dst)
            out.append(target)
    return out


def read_tsv(spark: SparkSession, path: str | Path, schema: str) -> DataFrame:
    """Tab-separated text with a header; columns are matched by name, quotes and line breaks inside fields kept."""
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    raw = spark.read.csv(str(path), sep="\t", header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    require_columns(raw, fields)
    return raw.select(*fields)


def generation_rows(raw: DataFrame) -> DataFrame:
    """Raw writer rows in the names of the canonical tables."""
    return raw.select(F.col("text_id").cast("string").alias("item_id"), F.col("prolific_id").alias("writer_id"), "round_number", F.col("emotion").alias("y_writer"), "generated_text", "hidden_emo_text", *APPRAISALS)


def judgment_rows(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("text_id").cast("string").alias("item_id"),
        F.col("prolific_id").alias("reader_id"),
        F.col("emotion").alias("y_reader"),
        F.expr("try_cast(confidence as int)").alias("reader_confidence"),
        "original_emotion",
        *[F.expr(f"try_cast({a} as int)").alias(f"reader_appraisal__{a}") for a in APPRAISALS],
    )


def _work_folder(spark: SparkSession, work: str | None) -> str:
    """A folder for unzipped files: the one named, which has to be shared; in local mode a temporary one will do."""
    if work:
        return work
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ConstraintError("name a shared folder for the unzipped files")
    return tempfile.mkdtemp(prefix="corpus-")


def read_crowd(spark: SparkSession, archive: str | Path, generation: str, validation: str, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writer and reader rows of a zipped corpus. On a cluster ``work`` names a shared folder for the two files."""
    work = _work_folder(spark, work)
    g, v = unzip_members(archive, [generation, validation], work)
    return generation_rows(read_tsv(spark, g, GENERATION)), judgment_rows(read_tsv(spark, v, JUDGMENTS))


def read_conversations(spark: SparkSession, path: str | Path) -> DataFrame:
    return spark.read.json(str(path), schema=CONVERSATIONS, multiLine=True)


def read_zipped_conversations(spark: SparkSession, archive: str | Path, member: str, work: str | None = None) -> DataFrame:
    work = _work_folder(spark, work)
    return read_conversations(spark, unzip_members(archive, [member], work)[0])


def read_split(spark: SparkSession, path: str | Path, name: str) -> DataFrame:
    """A split table: exactly its columns, all text, folds then cast; a fold that is no whole number is an error."""
    df = spark.read.csv(str(path), header=True, inferSchema=False)
    exact_columns(df, SPLITS[name])
    for f in _FOLDS:
        if f in df.columns:
            bad = df.where(F.col(f).isNull() | F.expr(f"try_cast({f} as int)").isNull()).limit(3).collect()
            if bad:
                raise ConstraintError(f"{name}.{f}: {[r[f] for r in bad]}")
            df = df.withColumn(f, F.col(f).cast("int"))
    return df


def read_splits(spark: SparkSession, folder: str | Path) -> dict[str, DataFrame]:
    return {n: read_split(spark, Path(folder) / f"{n}.csv", n) for n in SPLITS}


def write_splits(tables: dict[str, DataFrame], folder: str | Path) -> None:
    """One CSV folder for each table; an existing one is an error, found before anything is written."""
    for n in tables:
        exact_columns(tables[n], SPLITS[n])
        if store.exists(tables[n].sparkSession, f"{folder}/{n}.csv"):
            raise FileExistsError(f"{folder}/{n}.csv")
    for n, df in tables.items():
        keys = [c for c in ("outer_fold", "item_id") if c in df.columns]
        df.repartitionByRange(1, *keys).sortWithinPartitions(*keys).write.mode("errorifexists").csv(f"{folder}/{n}.csv", header=True)


def read_layers(spark: SparkSession, path: str, layer: int, pooling: str, features: str = "features") -> DataFrame:
    """(item_id, features) of one layer of a store partitioned by pooling and layer; other partitions aren't read."""
    return spark.read.parquet(path).where((F.col("pooling") == pooling) & (F.col("layer") == layer)).select("item_id", features)


def load_json_rows(path: str | Path, needed: Sequence[str]) -> list[dict]:
    rows = json.loads(Path(path).read_text())
    rows = rows["rows"] if isinstance(rows, dict) else rows
    for r in rows:
        lacking = [k for k in needed if k not in r]
        if lacking:
            raise ConstraintError(f"missing fields: {lacking}")
    return rows
