"""Encoders behind one interface, their layer store, and probes over its layers.

An encoder turns a batch of texts into hidden states of all layers with masks; pooling and
storage don't depend on which encoder it is. It is built once per Python worker.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.operators import checks, metrics, probes
from sparkgauge.operators.tasks import Matrix
from sparkgauge.session import Scratch
from sparkgauge.sources import store
from sparkgauge.sources.corpora import read_layers

SCHEMA = "layer int, pooling string, item_id string, features array<float>, truncated boolean"


@dataclass
class States:
    """hidden (layers, texts, tokens, width); attention and special 0/1 (texts, tokens); truncated (texts)."""

    hidden: np.ndarray
    attention: np.ndarray
    special: np.ndarray
    truncated: np.ndarray


@dataclass
class Encoder:
    """A function of texts, and the parameters that it must not change."""

    encode: Callable[[list[str]], States]
    parameters: dict[str, np.ndarray]

    def fingerprint(self) -> str:
        """One digest of all parameters: names, shapes, types and values."""
        h = hashlib.sha256()
        for name in sorted(self.parameters):
            a = np.ascontiguousarray(self.parameters[name])
            h.update(f"{name}|{a.shape}|{a.dtype}|".encode())
            h.update(a.tobytes())
        return h.hexdigest()

    def frozen(self, expected: str | None = None) -> Callable[[list[str]], States]:
        """``encode`` with its parameters made read-only, of the expected fingerprint, and checked after every batch to be the same."""
        mark = self.fingerprint()
        if expected is not None and mark != expected:
            raise ValueError(f"the encoder's parameters have fingerprint {mark}, not {expected}")
        for a in self.parameters.values():
            a.flags.writeable = False

        def run(texts: list[str]) -> States:
            s = self.encode(texts)
            if any(a.flags.writeable for a in self.parameters.values()):
                raise ValueError("the encoder's parameters were thawed")
            return s

        return run


def random_control(seed: int, layers: int = 13, width: int = 768, length: int = 256, buckets: int = 8192) -> Encoder:
    """A seeded control that was never trained: words fall into buckets, every layer is a random rotation of the one before and mixes
    in the mean of the text. The first and last places are special tokens."""
    rng = np.random.default_rng(seed)
    table = rng.normal(size=(buckets, width)).astype(np.float32)
    turns = rng.normal(scale=width**-0.5, size=(layers - 1, width, width)).astype(np.float32)

    def encode(texts: list[str]) -> States:
        words = [[zlib.crc32(w.encode("utf-8", "surrogatepass")) % (buckets - 2) + 2 for w in t.lower().split()] for t in texts]
        cut = np.array([len(w) > length - 2 for w in words])
        rows = [[0, *w[: length - 2], 1] for w in words]
        n = max(len(r) for r in rows)
        ids, attention, special = np.zeros((3, len(rows), n), dtype=np.int64)
        for i, r in enumerate(rows):
            ids[i, : len(r)], attention[i, : len(r)] = r, 1
            special[i, [0, len(r) - 1]] = 1
        hidden = [table[ids]]
        for turn in turns:
            h = hidden[-1]
            mean = (h * attention[:, :, None]).sum(axis=1, keepdims=True) / attention.sum(axis=1)[:, None, None]
            hidden.append(np.tanh(h @ turn + 0.1 * mean))
        return States(np.stack(hidden), attention, special, cut)

    return Encoder(encode, {"table": table, "turns": turns})


def pool(s: States) -> dict[str, np.ndarray]:
    """(layers, texts, width): the mean over content tokens and the first place. A text without content tokens is an error."""
    keep = (s.attention == 1) & (s.special == 0)
    n = keep.sum(axis=1)
    if (n == 0).any():
        raise ValueError("a text has no content token")
    mean = (s.hidden * keep[None, :, :, None]).sum(axis=2) / n[None, :, None]
    return {"mean": mean, "first": s.hidden[:, :, 0, :]}


def extract(texts: DataFrame, build: Callable[[], Callable[[list[str]], States]], item: str = "item_id", text: str = "text", batch: int = 32) -> DataFrame:
    """One row per layer, pooling and item. ``build`` makes the encoder inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = build()
        for b in batches:
            ids, ts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a in range(0, len(ids), batch):
                s = encode(ts[a : a + batch])
                rows = []
                for name, v in pool(s).items():
                    if not np.isfinite(v).all():
                        raise ValueError("an encoder gave a value that is not finite")
                    rows += [{"layer": layer, "pooling": name, "item_id": ids[a + i], "features": v[layer, i].astype(np.float32), "truncated": bool(s.truncated[i])} for layer in range(len(v)) for i in range(v.shape[1])]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("layer", pa.int32()), ("pooling", pa.string()), ("item_id", pa.string()), ("features", pa.list_(pa.float32())), ("truncated", pa.bool_())]))

    rows = texts.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string"), F.col(text))
    return rows.mapInArrow(run, SCHEMA)


def store_checks(layers: DataFrame, items: DataFrame, n_layers: int, width: int) -> DataFrame:
    """Violations of a layer store: repeated or missing keys, wrong widths, values that aren't finite."""
    every = items.select("item_id").distinct().select("item_id", F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1))).alias("layer"), F.lit("mean").alias("pooling"))
    both = every.unionByName(every.withColumn("pooling", F.lit("first")))
    odd = layers.where(checks.width("features", width).broken | checks.finite("features").broken)
    return checks.summary(
        {
            "repeated_key": checks.repeated_keys(layers, ["layer", "pooling", "item_id"]),
            "missing_key": checks.difference(both, layers, ["layer", "pooling", "item_id"]).where("side = 'missing'"),
            "unexpected_key": checks.difference(both, layers, ["layer", "pooling", "item_id"]).where("side = 'unexpected'"),
            "bad_features": odd,
        }
    )


def truncation_checks(layers: DataFrame, n_layers: int, poolings: int = 2) -> DataFrame:
    """Violations of the truncation marks: an item whose rows disagree, or that has another number of rows than layers times poolings."""
    per = layers.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("truncated").alias("k"), F.count_if(F.col("truncated").isNull()).alias("none"))
    return checks.summary({"truncation_disagrees": per.where("k <> 1 or none > 0"), "wrong_row_count": per.where(F.col("n") != n_layers * poolings)})


def layer_digests(layers: DataFrame) -> DataFrame:
    """(pooling, layer, items, sha256): a digest of each layer's vectors, whatever their order: row digests, spread by their start, hashed in order."""
    row = F.sha2(F.concat_ws("|", "item_id", F.to_json("features")), 256)
    part = layers.select("pooling", "layer", row.alias("h")).withColumn("b", F.substring("h", 1, 3))
    bucket = part.groupBy("pooling", "layer", "b").agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("d"), F.count(F.lit(1)).alias("n"))  # 1/4096 of a layer
    return bucket.groupBy("pooling", "layer").agg(F.sum("n").alias("items"), F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])), 256).alias("sha256"))


def extract_to(texts: DataFrame, target: str, build: Callable[[], Callable[[list[str]], States]], request: dict, item: str = "item_id", text: str = "text") -> dict:
    """The layer store of ``texts`` at ``target``, partitioned by pooling and layer, with each layer's digest beside it; kept if it answers the same request."""

    def make() -> dict[str, DataFrame]:
        s = Scratch(texts.sparkSession, "extract")
        got = s.keep(extract(texts, build, item, text))
        return {"layers": got, "digests": layer_digests(got)}

    if not store.exists(texts.sparkSession, target):
        key = store.request_key(request)
        return store.publish(make(), target, {"kind": "embeddings", "request": request, "request_sha256": key}, {"layers": ["pooling", "layer"]})
    return store.resume(texts.sparkSession, target, request, make)


def choose_text(df: DataFrame, variant: str) -> DataFrame:
    """(item_id, text) of one text variant: ``masked`` or ``original``."""
    column = {"masked": "hidden_emo_text", "original": "generated_text"}.get(variant)
    if column is None:
        raise ValueError(f"no text variant {variant}")
    return df.select("item_id", F.col(column).alias("text"))


def layer_points(spark: SparkSession, path: str, layer: int, pooling: str, items: DataFrame) -> DataFrame:
    """``items`` with the features of one layer; an item without any is an error. Other layers' partitions aren't read."""
    feats = read_layers(spark, path, layer, pooling).withColumnRenamed("features", "x")
    lacking = items.join(feats, "item_id", "left_anti").select("item_id").limit(3).collect()
    if lacking:
        raise checks.ConstraintError(f"no features for {[r[0] for r in lacking]}")
    return items.join(feats.withColumn("x", F.transform("x", lambda v: v.cast("double"))), "item_id")


def layer_summary(spark: SparkSession, matrices: dict[int, Matrix], classes: int, grid: Sequence[float] = probes.C_GRID) -> DataFrame:
    """Metrics of a nested probe on each layer, one row a layer."""
    rows = []
    for layer, m in sorted(matrices.items()):
        oof, _ = probes.nested_multiclass(spark, m, classes, grid)
        rows.append(metrics.multiclass(oof).select(F.lit(layer).alias("layer"), "*"))
    return reduce(DataFrame.unionByName, rows)
