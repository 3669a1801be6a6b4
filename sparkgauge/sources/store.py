"""Immutable artifacts: tables beside a metadata file, published by one rename, and indices over them."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.operators.checks import ConstraintError, require_columns
from sparkgauge.sources.digests import file_digest, sequence_digest, table_digest

METADATA = "metadata.json"


def dump_json(path: str | Path, payload: object) -> None:
    Path(path).write_text(json.dumps(payload, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


# files of any file system that Spark knows


def _file(spark: SparkSession, path: str | Path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str | Path) -> bool:
    fs, p = _file(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str | Path) -> str:
    fs, p = _file(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str | Path, text: str) -> None:
    fs, p = _file(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def publish(tables: dict[str, DataFrame], target: str | Path, metadata: dict | None = None, partition_by: dict[str, Sequence[str]] | None = None) -> dict:
    """Writes every table as zstd Parquet and the metadata with their digests below a hidden folder, then renames it to ``target``.

    ``target`` must not exist; a failed write leaves nothing behind. The folder may lie on any file system
    that all executors share and that can rename.
    """
    spark = next(iter(tables.values())).sparkSession
    target = str(target).rstrip("/")
    if exists(spark, target):
        raise FileExistsError(target)
    parent, _, name = target.rpartition("/")
    hidden = f"{parent or '.'}/.{name}-{uuid.uuid4().hex}"
    try:
        meta = {"tables": {}, **(metadata or {})}
        for t, df in tables.items():
            w = df.write.option("compression", "zstd")
            if partition_by and t in partition_by:
                w = w.partitionBy(*partition_by[t])
            w.parquet(f"{hidden}/{t}.parquet")
            got = table_digest(spark.read.parquet(f"{hidden}/{t}.parquet"), df.columns).first()
            meta["tables"][t] = {"sha256": got["digest"], "rows": got["row_count"], "columns": sorted(df.columns)}
        write_text(spark, f"{hidden}/{METADATA}", json.dumps(meta, sort_keys=True, indent=2, ensure_ascii=False) + "\n")
        fs, at = _file(spark, hidden)
        if exists(spark, target) or not fs.rename(at, _file(spark, target)[1]):
            raise FileExistsError(target)
    except BaseException:
        fs, at = _file(spark, hidden)
        fs.delete(at, True)
        raise
    return meta


def metadata(spark: SparkSession, target: str | Path) -> dict:
    return json.loads(read_text(spark, f"{target}/{METADATA}"))


def load(spark: SparkSession, target: str | Path, name: str, needed: Sequence[str] = (), verify: bool = True) -> DataFrame:
    """A table of an artifact, its columns and, unless told not to, its digest checked."""
    meta = metadata(spark, target)
    if name not in meta["tables"]:
        raise ConstraintError(f"no table {name}")
    df = spark.read.parquet(f"{target}/{name}.parquet")
    require_columns(df, needed)
    if verify:
        got = table_digest(df, meta["tables"][name]["columns"]).first()
        if got["digest"] != meta["tables"][name]["sha256"]:
            raise ConstraintError(f"{target}/{name} was changed")
    return df


def request_key(request: dict) -> str:
    return sequence_digest([json.dumps(request, sort_keys=True)])


def resume(spark: SparkSession, target: str | Path, request: dict, build) -> dict:
    """Runs ``build`` unless ``target`` already holds the answer to the same request; another request's artifact is an error."""
    key = request_key(request)
    if exists(spark, f"{target}/{METADATA}"):
        have = metadata(spark, target)
        if have.get("request_sha256") != key:
            raise ConstraintError(f"{target} answers another request")
        return have
    return publish(build(), target, {"request": request, "request_sha256": key})


def publish_json(path: str | Path, payload: object) -> bool:
    """Writes once: True if written, False if the same is there, an error if something else is."""
    text = json.dumps(payload, sort_keys=True, indent=2) + "\n"
    path = Path(path)
    tmp = path.parent / f".{path.name}-{uuid.uuid4().hex}"
    tmp.write_text(text)
    try:
        os.link(tmp, path)
        return True
    except FileExistsError:
        if path.read_text() != text:
            raise
        return False
    finally:
        tmp.unlink()


def index(root: str | Path, kind: str | None = None) -> list[dict]:
    """Every artifact below ``root``, hidden folders left out, in order of its path."""
    out = []
    for p in sorted(Path(root).rglob(METADATA)):
        rel = p.parent.relative_to(root)
        if any(x.startswith(".") for x in rel.parts):
            continue
        meta = json.loads(p.read_text())
        if kind is None or meta.get("kind") == kind:
            out.append({"path": str(rel), "kind": meta.get("kind"), "metadata_sha256": file_digest(p), "tables": meta.get("tables", {})})
    return out


def validate_index(root: str | Path, rows: list[dict]) -> None:
    have = {r["path"]: r for r in index(root)}
    for r in rows:
        if have.get(r["path"], {}).get("metadata_sha256") != r["metadata_sha256"]:
            raise ConstraintError(f"{r['path']} is missing or changed")


def lock(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) of every file below ``root``, hashed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_lock(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """Rows of ``expected`` (path, sha256) whose file is missing or different."""
    return expected.join(lock(spark, root).select("path", F.col("sha256").alias("have")), "path", "left").where("have is null or have <> sha256")


def layout(root: str, dataset: str, model: str, revision: str, mode: str, variant: str, length: int) -> str:
    """Where the embeddings of a model are kept."""
    return f"{root}/embeddings/{dataset}/{model.replace('/', '--')}/{revision}/{mode}/{variant}/maxlen-{length}"
