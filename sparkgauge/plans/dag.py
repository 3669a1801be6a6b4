"""The experiments as a graph of artifacts: each step names what it needs and is run once, in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from sparkgauge.sources import store


@dataclass(frozen=True)
class Step:
    """``build`` (spark, folder of the artifacts, folder of the tables) -> tables; ``needs`` are steps whose artifacts it reads."""

    name: str
    build: Callable[[SparkSession, str, str], dict[str, DataFrame]]
    needs: tuple[str, ...] = ()


def order(steps: Sequence[Step], goals: Sequence[str] | None = None) -> list[Step]:
    """The steps that the goals need, each after its own needs. Unknown names and circles are errors."""
    by = {s.name: s for s in steps}
    want, todo = set(), list(goals or by)
    while todo:
        n = todo.pop()
        if n not in by:
            raise KeyError(f"no step {n}")
        if n not in want:
            want.add(n)
            todo += by[n].needs
    return [by[n] for n in TopologicalSorter({n: by[n].needs for n in sorted(want)}).static_order()]


def run(spark: SparkSession, steps: Sequence[Step], root: str, data: str, goals: Sequence[str] | None = None) -> list[str]:
    """Builds what isn't there yet and returns the names of the steps that were run. An artifact of another request is an error."""
    ran = []
    for s in order(steps, goals):
        target = f"{root}/{s.name}"
        there = store.exists(spark, target)
        store.resume(spark, target, {"step": s.name, "needs": list(s.needs), "data": data}, lambda s=s: s.build(spark, root, data))
        if not there:
            ran.append(s.name)
    return ran


def experiments() -> list[Step]:
    """The replication: split tables, probes of the representations, their analyses, geometry, ladder, pilots and nulls."""
    from sparkgauge.plans import measures, models, relational

    def of(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str, str], dict[str, DataFrame]]:
        return lambda spark, root, data: {query.__name__: query(spark, data)}

    return [
        Step("splits", lambda spark, root, data: relational._bundle(spark, data)),
        Step("readers", of(relational.reader_targets)),
        Step("primary", of(models.appraisal_probe), ("splits",)),
        Step("sealed", of(models.sealed_probe), ("splits",)),
        Step("reader", of(models.reader_probe), ("splits", "readers")),
        Step("representations", of(models.representation_suite_of_slices), ("splits",)),
        Step("conditional", of(models.representation_gain_of_slices), ("representations",)),
        Step("suite", of(measures.q2_suite), ("representations",)),
        Step("category-rank", of(measures.category_rank_stability), ("representations",)),
        Step("geometry", of(models.probe_geometry), ("primary",)),
        Step("ladder", of(models.decoder_ladder), ("splits",)),
        Step("ladder-contrasts", of(models.ladder_contrasts), ("ladder",)),
        Step("sites", of(models.site_placement), ("ladder",)),
        Step("pilots", of(models.counterfactual_pilot), ("geometry",)),
        Step("regressions", of(models.counterfactual_regressions), ("pilots",)),
        Step("observed", of(models.observed_percentiles), ("pilots",)),
        Step("nulls", of(models.matched_nulls), ("observed",)),
        Step("tweets", of(models.cluster_probe), ("splits",)),
    ]
