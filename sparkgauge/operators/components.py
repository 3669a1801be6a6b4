"""Connected components of items that share an identity or a text.

Edges are kept as rows and shrink by turns: every node links its larger neighbours to
its least neighbour, then its smaller neighbours and itself, until only stars are left.
No neighbourhood is ever held in one task, so a hub costs a partial aggregate.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkgauge.operators.skew import hot_join
from sparkgauge.session import Scratch


def _large(e: DataFrame, rows: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return hot_join(both.where("v > u"), least, "u", rows=rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame, rows: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = hot_join(down, least, "u", rows=rows)
    pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root being its component's least node. A loop declares a node."""
    s = Scratch(edges.sparkSession, "components")
    given = s.keep(edges.select("u", "v").dropna().distinct())
    live = s.keep(given.where("u <> v"))
    seen = None
    for _ in range(max_rounds):
        big = s.keep(_large(live, s.rows(live)))
        # counted while it is written: the table tells whether an edge changed, without another pass over it
        seen_now = Observation()
        after = s.keep(_small(big, s.rows(big)).observe(seen_now, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        s.drop(big)
        mark = (seen_now.get["n"], seen_now.get["h"])
        s.drop(live)
        live = after
        if seen == mark:
            break
        seen = mark
    else:
        raise RuntimeError(f"not stable after {max_rounds} rounds")
    nodes = given.select(F.col("u").alias("node")).unionByName(given.select(F.col("v").alias("node"))).distinct()
    return s.keep(nodes.join(live.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def member_digests(members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, digest): SHA-256 of each group's members in order, joined by a zero character.

    Members stream through the task that holds their group in sorted order, a batch at a time; none is kept. The digest of a whole
    group is sequential by definition, so the largest group bounds the time of one task.
    """

    def run(batches):
        current, h = None, None
        for b in batches:
            if not b.num_rows:
                continue
            groups, members = b.column(0).to_pylist(), b.column(1).to_pylist()
            starts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
            done = []
            for a, z in zip(starts, starts[1:]):
                run = "\0".join(members[a:z]).encode()
                if groups[a] != current:
                    if h is not None:
                        done.append((current, h.hexdigest()))
                    current, h = groups[a], hashlib.sha256(run)
                else:
                    h.update(b"\0" + run)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], names=["g", "digest"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.string()), pa.array([h.hexdigest()], pa.string())], names=["g", "digest"])

    rows = members.select(F.col(group).alias("g"), F.col(member).alias("m")).dropna().distinct().repartition("g").sortWithinPartitions("g", "m")
    return rows.mapInArrow(run, "g string, digest string").withColumnRenamed("g", group)


def duplicate_components(items: DataFrame, item: str, identity: str, text: Column) -> DataFrame:
    """(item, group_id): items that share an identity or a text, directly or through others.

    group_id is ``component-`` and 16 hex digits of the digest of the members. Null
    identities and texts link nothing; repeated rows count once.
    """
    tag = lambda t, c: F.concat(F.lit(t), c.cast("string"))
    rows = items.where(F.col(item).isNotNull()).select(tag("i", F.col(item)).alias("i"), tag("w", F.col(identity)).alias("w"), tag("t", text).alias("t")).distinct()
    links = rows.select(F.col("i").alias("u"), F.explode(F.array("i", "w", "t")).alias("v")).where("v is not null")
    placed = components(links).where("node like 'i%'").select(F.substring("node", 2, 1 << 30).alias(item), "root")
    s = Scratch(items.sparkSession, "named")
    named = member_digests(placed, "root", item).select("root", F.concat(F.lit("component-"), F.substring("digest", 1, 16)).alias("group_id"))
    return s.keep(hot_join(placed, named, "root").select(item, "group_id"))
