"""Evaluation texts leaking into training text.

The held-out items' runs of ``GRAM`` normalised words form a hash set that is broadcast to
every task; its size is checked first, and more items take several scans. Each document's word windows are hashed all at once and looked up; a hit is
verified word by word, so a collision costs time and never a row. The document holds a
passage if some ``LEAST`` or more consecutive words of the item stand in it with at
most a tenth of them changed, left out or put in.

A passage of 20 words with two edits keeps a run of six words, so no passage is
without a hit. A passage of 40 words or more has a half that qualifies, and of 20 to 29
words (30 to 39) any 20 (30) do, so verification looks for 20 item words with 2 edits and 30 with 3. It grows
each run of hits to both sides over the furthest points that 0 to 3 edits reach.

Words are compared by their looks and in lower case without apostrophes and hyphens; other
punctuation and line marks separate words. Null and blank texts hold nothing, items
under 20 words are in nothing, and repeated documents are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from sparkgauge.llm.canonical import skeleton

GRAM = 6
LEAST = 20
#: (item words, edits) that make a passage.
WINDOWS = ((20, 2), (30, 3))
#: Item words that go to every task at once; more items are taken in several passes.
MOST_WORDS = 400_000

_DROP = re.compile("['’‘ʼ`´‐‑–-]")
_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(r"\S+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(_DROP.sub("", skeleton(text).lower()))


def words_at(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The same words, and for each the stretch between blanks that holds it."""
    words, at = [], []
    for m in _RUN.finditer(text):
        own = words_of(m.group())
        words += own
        at += [m.span()] * len(own)
    return words, at


def furthest(a: list[str], b: list[str], i: int, j: int, step: int, k: int) -> list[tuple[int, int]]:
    """How many words of ``a`` from ``i`` in direction ``step`` match how many of ``b`` from ``j`` with 0, 1, ... k edits.

    Furthest-reaching points by diagonal. What counts ends on an equal word: edits
    beyond the last one belong to no passage.
    """

    def slide(p: int, q: int) -> int:
        n = 0
        x, y = i + step * p, j + step * q
        while 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y]:
            n += 1
            x += step
            y += step
        return n

    room = len(a) - i if step > 0 else i + 1
    far = {0: slide(0, 0)}  # diagonal q - p: furthest p
    best = [(far[0], far[0])]
    for _ in range(k):
        grown: dict[int, int] = {}
        for d, p in far.items():
            for dd, pp in ((d, p + 1), (d - 1, p + 1), (d + 1, p)):
                if pp <= room and grown.get(dd, -1) < pp:
                    grown[dd] = pp
        top = best[-1]
        for d, p in grown.items():
            n = slide(p, p + d)
            grown[d] = p + n
            if n and p + n > top[0]:
                top = (p + n, p + n + d)
        best.append(top)
        far = grown
    return best


def reach(a: list[str], b: list[str], i: int, j: int, step: int, k: int) -> list[int]:
    return [p for p, _ in furthest(a, b, i, j, step, k)]


def passages(item: list[str], text: list[str], runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(first, end) in ``text`` of each stretch that holds enough consecutive words of ``item``.

    ``runs``: hits (place in item, place in text) of GRAM equal words.
    """
    k = WINDOWS[-1][1]
    on: dict[int, list[int]] = {}
    for i, j in runs:
        on.setdefault(j - i, []).append(i)
    for d, places in on.items():
        places = sorted(set(places))
        start = places[0]
        for n, p in enumerate(places):
            if n + 1 < len(places) and places[n + 1] == p + 1:
                continue
            size = p - start + GRAM
            left = furthest(item, text, start - 1, start + d - 1, -1, k)
            right = furthest(item, text, start + size, start + size + d, 1, k)
            fits = [(left[x][1], right[e - x][1]) for least, e in WINDOWS for x in range(e + 1) if size + left[x][0] + right[e - x][0] >= least]
            if fits:
                yield start + d - max(a for a, _ in fits), start + d + size + max(b for _, b in fits)
            if n + 1 < len(places):
                start = places[n + 1]


class Index:
    def __init__(self, items: tuple[tuple[int, str], ...]):
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, list[str]]] = []
        at: dict[int, list[tuple[int, int]]] = {}
        ids = []
        for eval_id, text in items:
            w = words_of(text)
            if len(w) < LEAST:
                continue
            self.items.append((eval_id, w))
            ids.append(np.array([self.words.setdefault(x, len(self.words) + 1) for x in w], dtype=np.uint64))
        self.power = np.array([pow(int(_BASE), GRAM - 1 - i, 1 << 64) for i in range(GRAM)], dtype=np.uint64)
        for n, x in enumerate(ids):
            for p, h in enumerate(self.hashes(x).tolist()):
                at.setdefault(h, []).append((n, p))
        self.at = at
        self.keys = np.array(sorted(at), dtype=np.uint64)

    def hashes(self, x: np.ndarray) -> np.ndarray:
        n = len(x) - GRAM + 1
        h = np.zeros(max(n, 0), dtype=np.uint64)
        for i in range(GRAM):
            h += x[i : i + n] * self.power[i]
        return h

    def _runs(self, w: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Verified hits (place in item, place in text) by item."""
        if len(w) < LEAST - 2 or not len(self.keys):
            return {}
        get = self.words.get
        h = self.hashes(np.array([get(x, 0) for x in w], dtype=np.uint64))
        p = np.searchsorted(self.keys, h)
        p[p == len(self.keys)] = 0
        runs: dict[int, list[tuple[int, int]]] = {}
        for j in np.nonzero(self.keys[p] == h)[0].tolist():
            for n, i in self.at[int(h[j])]:
                if self.items[n][1][i : i + GRAM] == w[j : j + GRAM]:
                    runs.setdefault(n, []).append((i, j))
        return runs

    def find(self, text: str) -> list[int]:
        """Keys of the items that the text holds passages of."""
        w = words_of(text)
        return [self.items[n][0] for n, r in self._runs(w).items() if next(passages(self.items[n][1], w, r), None)]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(key, first character, end) of each passage, from blank to blank."""
        runs = self._runs(words_of(text))
        if not runs:
            return []
        w, at = words_at(text)
        return sorted({(self.items[n][0], at[a][0], at[z - 1][1]) for n, r in runs.items() for a, z in passages(self.items[n][1], w, r)})


def _passes(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    """An index for each part of at most about MOST_WORDS words: the size is checked before anything is collected."""
    rows = items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-chars // (MOST_WORDS * 5)))
    for i in range(parts):
        got = rows.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == i).collect()
        yield Index(tuple(sorted((r["k"], r["t"]) for r in got)))


def _udf(spark: SparkSession, ix: Index, work: Callable[[Index, str], object], kind, arrow: pa.DataType) -> Callable[[Column], Column]:
    """``work`` over a column of texts; the index goes out as one broadcast. Null stays null."""
    shared = spark.sparkContext.broadcast(ix)

    @F.arrow_udf(kind)
    def over(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else work(shared.value, t) for t in texts.to_pylist()], arrow)

    return over


def _leaks_in(spark: SparkSession, ix: Index) -> Callable[[Column], Column]:
    """The keys of the items of ``ix`` that a text leaks."""
    return _udf(spark, ix, Index.find, ArrayType(LongType()), pa.list_(pa.int64()))


def find_leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, key: str, item_text: str) -> DataFrame:
    """(doc, key): distinct documents with the items whose passages they hold. One scan for each MOST_WORDS words of items."""
    out = None
    rows = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull())
    for ix in _passes(items, key, item_text):
        got = rows.select(F.col(doc).cast("bigint").alias(doc), F.explode(_leaks_in(documents.sparkSession, ix)(F.col(text))).alias(key))
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def without_leaks(documents: DataFrame, text: str, items: DataFrame, key: str, item_text: str) -> DataFrame:
    """``documents`` but those whose text leaks, in the scan that finds them."""
    for ix in _passes(items, key, item_text):
        leaked = F.size(_leaks_in(documents.sparkSession, ix)(F.col(text)))
        documents = documents.where(F.col(text).isNull() | (leaked == 0))
    return documents


def _as_structs(ix: Index, text: str) -> list[dict]:
    return [{"k": k, "first": a, "last": z} for k, a, z in ix.spans(text)]


def _cut_out(ix: Index, text: str) -> str:
    kept, at = [], 0
    for _, a, z in sorted(ix.spans(text), key=lambda s: s[1:]):
        kept.append(text[at : max(a, at)])
        at = max(at, z)
    return "".join(kept) + text[at:]


def find_spans(documents: DataFrame, doc: str, text: str, items: DataFrame, key: str, item_text: str) -> DataFrame:
    """(doc, key, first, last): where each passage stands in the document, as characters from 0, ``last`` the first one after it."""
    out = None
    rows = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull())
    for ix in _passes(items, key, item_text):
        spans = _udf(documents.sparkSession, ix, _as_structs, "array<struct<k:bigint,first:int,last:int>>", pa.list_(pa.struct([("k", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])))
        got = rows.select(F.col(doc).cast("bigint").alias(doc), F.explode(spans(F.col(text))).alias("x")).select(doc, F.col("x.k").alias(key), "x.first", "x.last")
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def without_spans(documents: DataFrame, text: str, items: DataFrame, key: str, item_text: str) -> DataFrame:
    """``documents`` with every passage cut out of ``text``, in one scan; the rest of the text stays as it is."""
    for ix in _passes(items, key, item_text):
        documents = documents.withColumn(text, _udf(documents.sparkSession, ix, _cut_out, StringType(), pa.string())(F.col(text)))
    return documents
