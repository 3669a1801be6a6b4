"""Filling fixed-capacity containers with items by best-two-fit.

A bin starts with the largest unpacked document and takes, again and again, the largest
one that fits the gap. Then its smallest document is taken out if two unpacked
documents fill the gap it leaves more tightly, until no such pair is left.

The documents are spread over groups of about ``GROUP`` by a hash of their id; a group is
packed by one task and leaves at most its last few bins loose, so the loss does not grow
with the data. A document longer than a container fills whole containers alone; its rest is
packed like any other. Documents without tokens (null or empty) are in no container;
repeated rows of one id are packed once each.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.tokens import TOKENIZER, size_of
from sparkgauge.session import Scratch

CAPACITY = 2048
GROUP = 40_000


class _Stock:
    """Unpacked items by size; a bit for each size that is there finds the largest within a gap at once."""

    def __init__(self, sizes: Iterable[int]):
        self.by: dict[int, list[int]] = {}
        self.there = 0
        for i, s in enumerate(sizes):
            self.put(i, s)

    def put(self, i: int, s: int) -> None:
        self.by.setdefault(s, []).append(i)
        self.there |= 1 << s

    def take(self, s: int) -> int:
        have = self.by[s]
        i = have.pop()
        if not have:
            self.there &= ~(1 << s)
        return i

    def largest(self, gap: int) -> int:
        """Size of the largest item of at most ``gap``; 0 if there is none."""
        return (self.there & ((1 << (gap + 1)) - 1)).bit_length() - 1 if gap > 0 and self.there & ((1 << (gap + 1)) - 1) else 0

    def pair(self, gap: int, above: int) -> tuple[int, int]:
        """Sizes of the two items that fill ``gap`` best and more than ``above``; (0, 0) if no two do."""
        best, found = above, (0, 0)
        a = self.largest(gap - 1)
        while 2 * a > best and a:
            b = self.largest(min(gap - a, a))
            if b == a and len(self.by[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = self.largest(a - 1)
        return found


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of places in ``sizes``, each size from 1 to ``capacity``."""
    stock = _Stock(sizes)
    bins = []
    while stock.there:
        gap, held = capacity, []
        while s := stock.largest(gap):
            held.append((s, stock.take(s)))
            gap -= s
        while gap and held:
            small = min(held)
            a, b = stock.pair(gap + small[0], small[0])
            if not a:
                break
            held.remove(small)
            held += [(a, stock.take(a)), (b, stock.take(b))]
            stock.put(small[1], small[0])
            gap += small[0] - a - b
        bins.append([i for _, i in held])
    return bins


def containers(documents: DataFrame, doc: str, text: str, capacity: int = CAPACITY, group: int = GROUP, path: str = TOKENIZER) -> DataFrame:
    """(container, used, doc_ids, parts, starts, sizes): the documents of each container.

    ``parts``, ``starts`` and ``sizes`` say which stretch of each document's tokens the container holds: part 0, all of
    them, for a document that isn't split, else the parts from 1 in order.
    """
    s = Scratch(documents.sparkSession, "packing")
    sized = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), size_of(F.col(text), path).alias("n")).where("n > 0")
    sized = s.keep(sized)
    groups = max(1, -(-s.rows(sized) // group))
    full = F.floor(F.col("n") / capacity).cast("int")
    whole = sized.where(F.col("n") > capacity).select("doc", F.explode(F.sequence(F.lit(1), full)).alias("part"))
    whole = whole.select(
        F.concat_ws("-", F.lit("full"), "doc", "part").alias("container"), F.lit(capacity).alias("used"), F.array("doc").alias("doc_ids"), F.array("part").alias("parts"),
        F.array(((F.col("part") - 1) * capacity).cast("int")).alias("starts"), F.array(F.lit(capacity)).alias("sizes"),
    )
    split = F.col("n") > capacity
    rest = sized.select("doc", F.when(split, F.col("n") % capacity).otherwise(F.col("n")).cast("int").alias("n"), F.when(split, full + 1).otherwise(0).cast("int").alias("part"), F.when(split, full * capacity).otherwise(0).cast("int").alias("start"))
    rest = rest.where("n > 0").withColumn("g", F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int"))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc", "part", "n"])
        docs, parts, starts, sizes = (rows[c].tolist() for c in ("doc", "part", "start", "n"))
        made = pack(sizes, capacity)
        return pd.DataFrame(
            {
                "container": [f"{key[0]}-{i}" for i in range(len(made))],
                "used": [sum(sizes[x] for x in b) for b in made],
                **{name: [[of[x] for x in b] for b in made] for name, of in (("doc_ids", docs), ("parts", parts), ("starts", starts), ("sizes", sizes))},
            }
        )

    packed = rest.groupBy("g").applyInPandas(fill, "container string, used int, doc_ids array<bigint>, parts array<int>, starts array<int>, sizes array<int>")
    return packed.unionByName(whole)


def audit(documents: DataFrame, made: DataFrame, doc: str, text: str, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """One row of counts over ``made``, the containers of ``documents``, whose ids are unique.

    Documents placed; breaches: containers over capacity, of another size than their
    stretches, or empty; documents whose stretches aren't exactly their tokens, each once; split
    documents that a container would have held whole. And whether at least 98 % of the room is used, the last container apart.
    """
    boxes = made.agg(
        F.count_if(F.col("used") > capacity).alias("over_capacity"),
        F.count_if(F.col("used") != F.aggregate("sizes", F.lit(0), lambda a, x: a + x)).alias("other_size"),
        F.count_if(F.size("doc_ids") == 0).alias("empty"),
        F.coalesce(F.sum("used") >= 0.98 * capacity * (F.count(F.lit(1)) - 1), F.lit(True)).alias("well_filled"),
    )
    held = made.select(F.explode(F.arrays_zip("doc_ids", "parts", "starts", "sizes")).alias("x")).select(F.col("x.doc_ids").alias("d"), "x.parts", "x.starts", "x.sizes")
    per = held.groupBy("d").agg(F.sum("sizes").alias("total"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("top"), F.max(F.col("starts") + F.col("sizes")).alias("last"), F.countDistinct("starts").alias("places"))
    want = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("d"), size_of(F.col(text), path).alias("tokens")).where("tokens > 0")
    j = want.join(per, "d", "full_outer")
    once = (F.col("total") == F.col("tokens")) & (F.col("last") == F.col("tokens")) & (F.col("places") == F.col("n"))
    docs = j.agg(F.count("n").alias("documents"), F.count_if(~F.coalesce(once, F.lit(False))).alias("not_once"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= capacity)).alias("split_in_vain"))
    return docs.crossJoin(F.broadcast(boxes))  # one row each
