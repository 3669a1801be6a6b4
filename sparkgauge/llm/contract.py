"""Consolidating pairwise matches into groups by randomised graph contraction.

Each round gives every vertex a fresh random rank (a hash of the vertex and the
round), lets it hook to the least-ranked vertex among itself and its neighbours,
rewrites the edges to the hooks and removes loops and repeats. A constant share of
the vertices disappears each round, whatever the shape of the graph, so chains of
any length take logarithmically many rounds. The mappings of the rounds are then
composed from the last, which is the smallest, back to the first.

Nulls on either side make no link. Loops make no link, so a record linked only to
itself is in no group. Repeats and both directions count once. An empty input gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.operators.skew import hot_join, hot_keys
from sparkgauge.session import Scratch


def _rank(column: str, salt: int):
    """Fresh order of a round; the vertex itself settles equal hashes."""
    return F.struct(F.xxhash64(F.lit(salt), F.col(column)).alias("h"), F.col(column).alias("x"))


def _distinct_edges(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def contract(edges: DataFrame, seed: int = 1, max_rounds: int = 200) -> DataFrame:
    """(record, root) for every vertex of ``edges`` (u, v): root is the least vertex of its component."""
    s = Scratch(edges.sparkSession, "contract")
    live = s.keep(_distinct_edges(edges.select("u", "v").dropna()))
    maps = []
    for k in range(max_rounds):
        n = s.rows(live)
        if not n:
            break
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min(_rank("v", seed + k)).alias("best")).select("u", F.least("best", _rank("u", seed + k))["x"].alias("r"))
        hook = s.keep(hook)
        maps.append(hook)
        hot_v = hot_keys(live, "v", rows=n)
        half = hot_join(live, hook.withColumnRenamed("r", "ru"), "u", rows=n).select("v", "ru")
        full = hot_join(half, hook.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v", hot=hot_v)
        after = s.keep(_distinct_edges(full.select(F.col("ru").alias("u"), F.col("rv").alias("v"))))
        s.drop(live)
        live = after
    else:
        raise RuntimeError(f"edges left after {max_rounds} rounds")
    if not maps:
        return live.select(F.col("u").alias("record"), F.col("v").alias("root"))
    done = maps.pop()
    while maps:
        lower = maps.pop()
        upper = done.select(F.col("u").alias("r"), F.col("r").alias("top"))
        merged = s.keep(hot_join(lower, upper, "r", "left", rows=s.rows(lower)).select("u", F.coalesce("top", "r").alias("r")))
        s.drop(lower)
        s.drop(done)
        done = merged
    least = done.groupBy("r").agg(F.min("u").alias("root"))
    return s.keep(hot_join(done, least, "r", rows=s.rows(done)).select(F.col("u").alias("record"), "root"))


def group_matches(matches: DataFrame) -> DataFrame:
    """(matched_field, record_id, root_id) for the records of ``matches`` linked by rows with is_match true.

    Ids of different ``matched_field`` never meet. Rows whose is_match is false or null link nothing.
    """
    node = lambda c: F.concat_ws("\u0001", "matched_field", c)
    m = matches.where("is_match").where("matched_field is not null and left_id is not null and right_id is not null")
    got = contract(m.select(node("left_id").alias("u"), node("right_id").alias("v")))
    part = lambda c, k: F.split(c, "\u0001", 2)[k]
    return got.select(part("record", 0).alias("matched_field"), part("record", 1).alias("record_id"), part("root", 1).alias("root_id"))
