"""Splits that keep related records together.

Components come from hash-to-min: every node holds a cluster, kept as (node, member)
rows so that no cluster has to fit one task. Each round a node sends its cluster to
the cluster's minimum and the minimum to every member, until every node but the
minimum holds the minimum alone. A round is one shuffle by node, in which repeats go
and the minimum is found, and one written table; hubs are met by a broadcast of their
minima instead. Clusters at rest are set aside once few are moving. A component then takes the split with the greatest weighted rendezvous
score, so its split depends on nothing but its name: adding or removing other
components moves none. Components differ in size, so the shares of rows that come out
lie about the proportions, and ``shares`` reports them.

Null keys link nothing; a record without any key is a component of its own. Repeated
rows change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.operators.skew import hot_join, hot_keys
from sparkgauge.session import Scratch

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
_TAG = "\u0001"


def _clusters(sent: DataFrame, rows: int) -> DataFrame:
    """Distinct (u, v) with ``m``, the least member of u's cluster. ``rows``: a bound on the rows of ``sent``."""
    hot = hot_keys(sent, "u", rows=rows)
    is_hot = F.col("u").isin(hot) if hot else F.lit(False)
    cold = sent.where(~is_hot) if hot else sent
    out = cold.repartition("u").dropDuplicates(["u", "v"]).withColumn("m", F.min("v").over(Window.partitionBy("u")))
    if not hot:
        return out
    hubs = sent.where(is_hot).distinct()
    least = sent.where(is_hot).groupBy("u").agg(F.min("v").alias("m"))  # a row per hot node
    return out.unionByName(hubs.join(F.broadcast(least), "u"))


#: Clusters that have come to rest are set aside once no more than this share of the rows is unsettled.
RETIRE = 0.1


def _settled(seen: DataFrame) -> DataFrame:
    """A settled node's rows all carry its component; the least node's carry itself."""
    return seen.where("v = m").select(F.col("u").alias("node"), F.col("m").alias("component"))


def _at_rest(seen: DataFrame, moving: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows still in play, rows of clusters at rest). A cluster is in play if one of its nodes stands in a row of ``moving``.

    A row (u, v) is there with its mirror (v, u) or is moving, so nothing can reach a cluster at rest any more.
    """
    nodes = moving.select(F.explode(F.array("u", "v", "m")).alias("u")).distinct().withColumn("_n", F.lit(True))
    least = hot_join(seen, nodes, "u", rows=rows).groupBy("m").agg(F.lit(True).alias("_p"))
    flagged = hot_join(seen, least, "m", "left", rows=rows)
    return flagged.where("_p").drop("_p"), flagged.where("_p is null").drop("_p")


def hash_to_min(edges: DataFrame, max_rounds: int = 100, retire: float = RETIRE) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its least node. A loop declares a node."""
    s = Scratch(edges.sparkSession, "hashmin")
    e = s.keep(edges.select("u", "v").dropna())
    n = s.rows(e)
    seen = s.keep(_clusters(e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")), F.struct("u", F.col("u").alias("v")), F.struct(F.col("v").alias("u"), "v"))).alias("x")).select("x.u", "x.v"), 4 * n))
    done = []
    for _ in range(max_rounds):
        moving = seen.where("u <> m and v <> m")
        left, rows = moving.count(), s.rows(seen)
        if not left:
            out = _settled(seen)
            for part in done:
                out = out.unionByName(part)
            return s.keep(out) if done else out
        if left <= retire * rows:
            play, rest = _at_rest(seen, moving, rows)
            play = s.keep(play.select("u", "v", "m"))
            done.append(s.keep(_settled(rest)))
            s.drop(seen)
            seen = play
        sent = seen.select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        after = s.keep(_clusters(sent, 2 * s.rows(seen)))
        s.drop(seen)
        seen = after
    raise RuntimeError(f"not stable after {max_rounds} rounds")


def rendezvous(component: Column, proportions: Mapping[str, float] = PROPORTIONS, seed: str = "split") -> Column:
    """The split whose score -weight / ln(u) is greatest; u is uniform, from 52 bits of a SHA-256 of seed, split and component."""
    total = float(sum(proportions.values()))
    scores = []
    for name, share in sorted(proportions.items()):
        if share <= 0:
            continue
        bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|{name}|"), component), 256), 1, 13), 16, 10).cast("bigint")
        unit = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
        scores.append(F.struct((F.lit(-share / total) / F.log(unit)).alias("score"), F.lit(name).alias("split")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["split"]


def _node(field: str) -> Column:
    return F.concat(F.lit(field + _TAG), F.col(field).cast("string"))


def _edges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links the keys of a row to its first key; a row with one key declares it."""
    first = F.coalesce(*[_node(k) for k in keys])
    star = F.filter(F.array(*[_node(k) for k in keys]), lambda x: x.isNotNull())
    return rows.where(first.isNotNull()).select(first.alias("u"), F.explode(star).alias("v")).distinct()


def key_components(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(split_table, key_field, key_value, component) over all tables in one run; tables never link to each other."""
    parts = []
    for name, (df, keys) in tables.items():
        e = _edges(df, keys)
        tag = F.lit(name + _TAG)
        parts.append(e.select(F.concat(tag, "u").alias("u"), F.concat(tag, "v").alias("v")))
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    p = F.split("node", _TAG, 3)
    return hash_to_min(edges).select(p[0].alias("split_table"), p[1].alias("key_field"), p[2].alias("key_value"), "component")


def assign_splits(df: DataFrame, keys: Sequence[str], record: str, proportions: Mapping[str, float] = PROPORTIONS, seed: str = "split", name: str = "t") -> DataFrame:
    """``df`` with split_component and split: rows sharing a value of any of ``keys`` share both.

    Columns of these names in ``df`` are replaced. ``name`` is the table's and goes into its components' names.
    """
    df = df.drop("split_component", "split")
    comp = key_components({name: (df, keys)}).select(F.concat("key_field", F.lit(_TAG), "key_value").alias("_k"), F.col("component").alias("_c"))
    first = F.coalesce(*[_node(k) for k in keys])
    out = hot_join(df.withColumn("_k", first), comp, "_k", "left")
    own = F.coalesce("_c", F.concat(F.lit(f"{name}{_TAG}record{_TAG}"), F.coalesce(F.col(record).cast("string"), F.lit(""))))
    return out.withColumn("split_component", F.sha2(own, 256)).withColumn("split", rendezvous(F.col("split_component"), proportions, seed)).drop("_k", "_c")


def shares(assigned: DataFrame, proportions: Mapping[str, float] = PROPORTIONS) -> DataFrame:
    """(split, row_count, components, share, target, tolerance): how near the rows come to the proportions.

    Whole components move, so a share may be off by the largest component and by four
    standard deviations of the sum over the others: sqrt(p (1 - p) sum of squared sizes) / rows.
    """
    total = float(sum(proportions.values()))
    per = assigned.groupBy("split", "split_component").agg(F.count(F.lit(1)).alias("n"))
    by = per.groupBy("split").agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("components"), F.max("n").alias("top"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    whole = by.agg(F.sum("row_count").alias("_all"), F.max("top").alias("_top"), F.sum("squares").alias("_sq"))
    want = F.create_map(*[x for k, v in sorted(proportions.items()) for x in (F.lit(k), F.lit(v / total))])
    out = by.crossJoin(F.broadcast(whole)).withColumn("target", want[F.col("split")])  # one row
    return out.select("split", "row_count", "components", (F.col("row_count") / F.col("_all")).alias("share"), "target", ((F.col("_top") + 4 * F.sqrt(F.col("target") * (1 - F.col("target")) * F.col("_sq"))) / F.col("_all")).alias("tolerance"))


def broken_keys(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], fold: str = "test_fold") -> DataFrame:
    """(split_table, key_field, key_value): keys whose rows carry two or more different non-null folds.

    Every record gets its component, by its first key. Components whose records carry more
    than one fold are found from partial minima and maxima, and only their records' keys
    are looked into, each within its component.
    """
    comp = key_components(tables).select(F.concat_ws(_TAG, "split_table", "key_field", "key_value").alias("node"), "component")
    records = None
    for name, (df, keys) in tables.items():
        first = F.coalesce(*[_node(k) for k in keys])
        pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key_field"), F.col(k).cast("string").alias("key_value")) for k in keys]), lambda x: x["key_value"].isNotNull())
        part = df.where(first.isNotNull() & F.col(fold).isNotNull()).select(F.lit(name).alias("split_table"), F.concat(F.lit(name + _TAG), first).alias("node"), pairs.alias("pairs"), F.col(fold).alias("fold"))
        # rows that say the same count once, before anything is shuffled by component
        part = part.groupBy("split_table", "node", "pairs").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
        records = part if records is None else records.unionByName(part)
    s = Scratch(comp.sparkSession, "folds")
    records = s.keep(records)
    placed = s.keep(hot_join(records, comp, "node", rows=s.rows(records)).drop("node"))
    crossing = placed.groupBy("component").agg(F.min("lo").alias("clo"), F.max("hi").alias("chi")).where("clo < chi").select("component")
    inside = hot_join(placed, crossing, "component", rows=s.rows(placed)).select("split_table", "component", F.explode("pairs").alias("p"), "lo", "hi")
    spans = inside.groupBy("split_table", "component", "p.key_field", "p.key_value").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.where("lo < hi").select("split_table", "key_field", "key_value")
