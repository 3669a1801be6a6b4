"""Session settings and shared scratch tables.

Iterative operators cut their lineage with Parquet tables written below the folder
in ``spark.checkpoint.dir``, which every executor can reach, so a lost executor
costs a re-read and never a lost block.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[tuple[SparkSession, str]] = set()
_own: list[str] = []


def build_session(app: str = "sparkgauge", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode with the setting unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sparkgauge-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone; a scratch table left behind is harmless
        pass


def _sweep() -> None:
    for spark, path in list(_made):
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)
        elif spark.sparkContext._jsc is not None:
            _delete(spark, path)


atexit.register(_sweep)


class Scratch:
    """Tables of one run of an operator. ``keep`` writes and reads back; ``drop`` deletes a superseded one."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/sg-{label}-{uuid.uuid4().hex[:12]}"
        self._n, self._path, self._rows = 0, {}, {}
        _made.add((spark, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._path[id(out)] = (out, path)
        return out

    def rows(self, df: DataFrame) -> int:
        """Rows of a kept table, from its files' footers."""
        if id(df) not in self._rows:
            self._rows[id(df)] = df.count()
        return self._rows[id(df)]

    def drop(self, df: DataFrame) -> None:
        found = self._path.pop(id(df), None)
        self._rows.pop(id(df), None)
        if found:
            _delete(self.spark, found[1])
