"""Command line: ``python -m sparkgauge.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions.text import normalized_text
from sparkgauge.functions.vocab import CLUSTERS, EMOTIONS, cluster_column
from sparkgauge.operators import embed, folds, ingest, runs
from sparkgauge.plans import dag
from sparkgauge.plans.registry import QUERIES
from sparkgauge.session import build_session
from sparkgauge.sources import corpora, models, release, store

# Analyses that are one registered query over a folder of tables, by the name of their command.
ANALYSES = {
    "probe": "appraisal_probe",
    "tweet-probe": "cluster_probe",
    "representations": "representation_suite_of_slices",
    "sealed": "sealed_probe",
    "reader": "reader_probe",
    "conditional": "representation_gain_of_slices",
    "category-rank": "category_rank_stability",
    "rank-association": "rank_association_draws",
    "geometry": "probe_geometry",
    "ladder": "decoder_ladder",
    "ladder-contrasts": "ladder_contrasts",
    "sites": "site_placement",
    "pilot": "counterfactual_pilot",
    "regressions": "counterfactual_regressions",
    "observed": "observed_percentiles",
    "nulls": "matched_nulls",
    "suite": "q2_suite",
}


def _show(df: DataFrame, output: str | None, name: str) -> None:
    if output:
        store.publish({name: df}, output, {"kind": "query", "query": name})
    else:
        df.show(20, truncate=60)


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="sparkgauge", description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *arguments: str, **options: dict) -> None:
        p = sub.add_parser(name, help=what)
        for a in arguments:
            p.add_argument(a)
        for o, spec in options.items():
            p.add_argument("--" + o.replace("_", "-"), **spec)

    output = {"help": "folder to publish the result to; else 20 rows are shown"}
    p = sub.add_parser("query", help="run a registered query over a folder of tables")
    p.add_argument("name", choices=sorted(QUERIES))
    p.add_argument("data")
    p.add_argument("--output", **output)
    for name, query in ANALYSES.items():
        command(name, f"the query {query}", "data", output=output)
    command("crowd", "canonical crowd tables from a zipped corpus", "archive", "output", generation={"default": "generation.tsv", "help": "ending of the member with the writers' rows"}, validation={"default": "validation.tsv", "help": "ending of the member with the readers' rows"}, work={"help": "shared folder for the unzipped files"})
    command("tweets", "customer tweets from a zipped corpus of conversations", "archive", "member", "output", work={"help": "shared folder for the unzipped file"})
    command("splits", "group-disjoint outer and inner folds from canonical tables", "artifact", "output", kind={"choices": ("crowd", "tweets"), "default": "crowd"})
    command("bundle", "all eight split tables from canonical tables", "crowd", "tweets", "output")
    command("extract", "layers of the seeded random control for one text variant", "artifact", "output", variant={"choices": ("masked", "original"), "default": "masked"}, seed={"type": int, "default": 1}, layers={"type": int, "default": 13}, width={"type": int, "default": 768})
    command("validate", "check a run's digests, arithmetic and grid", "artifact")
    command("layers", "check a layer summary", "path", "number")
    command("index", "list artifacts below a folder", "root", kind={"help": "only artifacts of this kind"})
    command("verify", "check an index against its artifacts", "root", "index")
    command("lock", "digests of every file below a folder", "root", output=output)
    command("tokenizers", "bind a cache folder to fast or slow tokenizers", "cache", slow={"action": "store_true"})
    command("models", "the pinned encoders")
    command("release", "check a source tree before a release", "root", sums={"help": "list of SHA-256 sums to hold"})
    command("replicate", "run the experiments that aren't there yet", "data", "root", goal={"action": "append", "help": "only this step and what it needs"})
    return ap


def _without_spark(a: argparse.Namespace) -> bool:
    if a.command == "index":
        print(json.dumps(store.index(a.root, a.kind), indent=2, sort_keys=True))
    elif a.command == "verify":
        store.validate_index(a.root, json.loads(Path(a.index).read_text()))
    elif a.command == "tokenizers":
        models.lock_tokenizer(a.cache, not a.slow)
    elif a.command == "models":
        print(json.dumps({k: {**vars(v), "layers": v.layers} for k, v in models.ENCODERS.items()}, indent=2))
    elif a.command == "release":
        listed = subprocess.run(["git", "ls-files", "-z"], cwd=a.root, check=True, capture_output=True).stdout.decode().split("\0")
        found = release.problems(a.root, [x for x in listed if x], sums=a.sums)
        for file, problem in found:
            print(f"{file}: {problem}", file=sys.stderr)
        if found:
            raise SystemExit(1)
    else:
        return False
    return True


def _crowd(spark: SparkSession, a: argparse.Namespace) -> None:
    g, j = corpora.read_crowd(spark, a.archive, a.generation, a.validation, a.work)
    g, j = ingest.canonical_generation(g), ingest.canonical_judgments(j)
    store.publish({"generation": g, "validation_judgments": ingest.join_generation(j, g), "validation": ingest.aggregate_readers(j)}, a.output, {"kind": "crowd"})


def _splits(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.kind == "crowd":
        outer, inner = folds.writer_splits(store.load(spark, a.artifact, "generation"), normalized_text(F.col("hidden_emo_text")), EMOTIONS)
    else:
        outer, inner = folds.tweet_splits(store.load(spark, a.artifact, "tweets"), normalized_text(F.col("text")), [cluster_column(c) for c in CLUSTERS])
    store.publish({"outer": outer, "inner": inner}, a.output, {"kind": f"{a.kind}_splits"})


def _bundle(spark: SparkSession, a: argparse.Namespace) -> None:
    v = store.load(spark, a.crowd, "validation")
    t = folds.split_bundle(store.load(spark, a.crowd, "generation"), v, store.load(spark, a.tweets, "tweets"), normalized_text(F.col("hidden_emo_text")), normalized_text(F.col("text")), EMOTIONS, [cluster_column(c) for c in CLUSTERS], strict=True)
    runs.require(folds.bundle_checks(t))
    corpora.write_splits({k: df.select(*corpora.SPLITS[k]) for k, df in t.items()}, a.output)


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    texts = embed.choose_text(store.load(spark, a.artifact, "generation"), a.variant)
    request = {"encoder": "random_control", "seed": a.seed, "layers": a.layers, "width": a.width, "variant": a.variant, "artifact": a.artifact}
    seed, layers, width = a.seed, a.layers, a.width
    embed.extract_to(texts, a.output, lambda: embed.random_control(seed, layers, width).frozen(), request)


WITH_SPARK: dict[str, Callable[[SparkSession, argparse.Namespace], object]] = {
    "query": lambda spark, a: _show(QUERIES[a.name](spark, a.data), a.output, a.name),
    "crowd": _crowd,
    "tweets": lambda spark, a: store.publish({"tweets": ingest.flatten(corpora.read_zipped_conversations(spark, a.archive, a.member, a.work))}, a.output, {"kind": "tweets"}),
    "splits": _splits,
    "bundle": _bundle,
    "extract": _extract,
    "validate": lambda spark, a: print(json.dumps(runs.validate_run(spark, a.artifact), indent=2, sort_keys=True)),
    "layers": lambda spark, a: runs.read_layer_summary(spark, a.path, int(a.number)).show(100),
    "lock": lambda spark, a: _show(store.lock(spark, a.root), a.output, "lock"),
    "replicate": lambda spark, a: print("\n".join(dag.run(spark, dag.experiments(), a.root, a.data, a.goal))),
}


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if _without_spark(a):
        return 0
    spark = build_session("cli")
    if a.command in ANALYSES:
        _show(QUERIES[ANALYSES[a.command]](spark, a.data), a.output, ANALYSES[a.command])
    else:
        WITH_SPARK[a.command](spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
