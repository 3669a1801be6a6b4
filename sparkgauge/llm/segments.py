"""Splitting oversized items at natural boundaries by lexical cohesion.

A document is cut into sentences (ends of sentences and lines). At each sentence end
the words of the ``BLOCK`` sentences before it are compared with those of the ``BLOCK``
after it; where their similarity falls into a valley the topic changes, and the depth
of the valley is how far it lies below the peaks on both sides. Each piece ends at the
deepest valley within its size window, the second half of what the limit allows. Where
a window has no sentence end a piece ends between words, and within a run without
blanks between characters. The next piece starts ``overlap`` tokens before the cut, or
at the character that holds that place.

Texts within the limit come out whole, as piece 0. Null texts and ids give no piece,
empty texts none either. Every piece is under the limit when tokenized by itself.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.llm.tokens import TOKENIZER, encoding, size_of, widths

LIMIT = 2048
OVERLAP = 64
BLOCK = 8
BUCKETS = 1024
_CHUNK = 2048

_END = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|\s*\n\s*")
_WORD = re.compile(r"[^\W_]{3,}")


def sentence_ends(text: str) -> list[int]:
    """Places after which a new sentence or line starts, the end of the text excluded."""
    return [m.end() for m in _END.finditer(text) if 0 < m.end() < len(text)]


class _Buckets(dict):
    """The bucket of each word, worked out once a document."""

    def __missing__(self, word: str) -> int:
        self[word] = b = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


def similarities(sentences: list[str], block: int = BLOCK) -> np.ndarray:
    """Cosine of the words of the blocks before and after each inner boundary; words are counted in hashed buckets."""
    n = len(sentences)
    out = np.zeros(max(n - 1, 0))
    bucket = _Buckets()
    for a in range(0, n - 1, _CHUNK):
        lo, hi = max(0, a - block), min(n, a + _CHUNK + block + 1)
        words = [_WORD.findall(x.lower()) for x in sentences[lo:hi]]
        row = np.repeat(np.arange(1, hi - lo + 1), [len(w) for w in words])
        column = np.fromiter(map(bucket.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=len(row))
        counts = np.bincount(row * BUCKETS + column, minlength=(hi - lo + 1) * BUCKETS).reshape(-1, BUCKETS)
        total = np.cumsum(counts, axis=0, dtype=np.float32)
        at = np.arange(a + 1, min(n, a + _CHUNK + 1))
        left = total[at - lo] - total[np.maximum(at - block, lo) - lo]
        right = total[np.minimum(at + block, hi) - lo] - total[at - lo]
        dot = lambda x, y: np.einsum("ij,ij->i", x, y)
        norm = np.sqrt(dot(left, left) * dot(right, right))
        out[at - 1] = np.where(norm > 0, dot(left, right) / np.maximum(norm, 1e-9), 0)
    return out


def depths(s: np.ndarray) -> np.ndarray:
    """How far each boundary lies below the nearest peaks: on both sides the similarity is climbed while it doesn't fall."""
    left, right = s.copy(), s.copy()
    for i in range(1, len(s)):
        if s[i - 1] >= s[i]:
            left[i] = left[i - 1]
    for i in range(len(s) - 2, -1, -1):
        if s[i + 1] >= s[i]:
            right[i] = right[i + 1]
    return left + right - 2 * s


def _char_places(text: str, tokens: list[int], path: str) -> np.ndarray:
    """For each token boundary the character that starts there, or -1 within a character."""
    ends = np.concatenate([[0], np.cumsum(widths(path)[tokens])])
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts = (raw & 0xC0) != 0x80
    nth = np.cumsum(starts) - 1
    place = np.full(len(ends), -1, dtype=np.int64)
    inside = ends < len(raw)
    ok = np.zeros(len(ends), dtype=bool)
    ok[inside] = starts[ends[inside]]
    place[ok] = nth[ends[ok]]
    place[ends >= len(raw)] = len(text)
    return place


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> list[tuple[int, int, int]]:
    """(first character, end, tokens) of each piece."""
    if limit < 4 * overlap + 16:
        raise ValueError("the limit is too small for the overlap")
    e = encoding(path)
    tokens = e.encode_ordinary(text)
    if len(tokens) <= limit:
        return [(0, len(text), len(tokens))] if text else []
    place = _char_places(text, tokens, path)
    whole = np.nonzero(place >= 0)[0]
    chars = place[whole]
    ends = np.array(sentence_ends(text), dtype=np.int64)
    if len(ends):
        bounds = [0, *ends.tolist(), len(text)]
        depth = depths(similarities([text[a:b] for a, b in zip(bounds, bounds[1:])]))
        # a sentence end within a token belongs to the token boundary before it
        end_tok = whole[np.searchsorted(chars, ends, side="right") - 1]
    else:
        depth, end_tok = np.zeros(0), np.zeros(0, dtype=np.int64)
    out = []
    start = 0
    room = limit - 1
    while True:
        if len(tokens) - start <= room:
            n = len(e.encode_ordinary(text[place[start] :]))
            if n <= room:
                out.append((int(place[start]), len(text), n))
                return out
        most = room
        while True:
            low, high = start + max(most // 2, overlap + 1), min(start + most, len(tokens) - 1)
            near = np.arange(np.searchsorted(end_tok, low), np.searchsorted(end_tok, high, side="right"))
            if len(near):
                best = near[np.lexsort((end_tok[near], np.round(depth[near], 9)))[-1]]
                stop = int(end_tok[best])
            else:
                stop = _between_words(text, place, low, high)
            n = len(e.encode_ordinary(text[place[start] : place[stop]]))
            if n <= room:
                break
            most -= max(n - room, 1)
        out.append((int(place[start]), int(place[stop]), n))
        start = stop - overlap
        while place[start] < 0:
            start -= 1


def _between_words(text: str, place: np.ndarray, low: int, high: int) -> int:
    """The last token boundary within the window that stands before a blank, else the last at a character."""
    for t in range(high, low - 1, -1):
        if place[t] >= 0 and text[place[t] : place[t] + 1].isspace():
            return t
    for t in range(high, 0, -1):
        if place[t] >= 0:
            return t
    raise ValueError("no character boundary")


def pieces(documents: DataFrame, doc: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> DataFrame:
    """(doc, piece, first, last, tokens, text) for every document."""
    schema = f"{doc} bigint, piece int, first int, last int, tokens int, text string"
    names = [doc, "piece", "first", "last", "tokens", "text"]

    def split(batches):
        for b in batches:
            rows = [(d, k, a, z, n, t[a:z]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (a, z, n) in enumerate(cut(t, limit, overlap, path))]
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    rows = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias(doc), F.col(text).alias("text"))
    return rows.mapInArrow(split, schema)


def oversized(documents: DataFrame, doc: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> DataFrame:
    """Pieces of the documents over the limit alone. A token has a byte at least, so texts of at most ``limit`` bytes aren't looked at."""
    long = documents.where(F.octet_length(F.col(text)) > limit)
    return pieces(long, doc, text, limit, overlap, path)


def audit(documents: DataFrame, cut: DataFrame, doc: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> DataFrame:
    """One row of counts over ``cut``, the pieces of ``documents``, whose ids are unique: documents cut, and breaches of what a cut promises.

    Breaches: pieces not under the limit, pieces whose text is not that stretch of the
    document, documents that don't begin at 0 or end at their length, gaps between
    consecutive pieces, and overlaps off by more than a quarter.
    """
    whole = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("whole"))
    c = cut.select(F.col(doc).alias("d"), "piece", "first", "last", "tokens", F.col("text").alias("part"))
    w = Window.partitionBy("d").orderBy("piece")
    c = c.withColumn("before", F.lag("last").over(w)).withColumn("final", F.lead("piece").over(w).isNull())
    j = c.join(whole, "d")
    shared = size_of(F.when(F.col("before") > F.col("first"), F.expr("substring(whole, first + 1, before - first)")), path)
    j = j.withColumn("shared", shared)
    many = F.col("piece") > 0
    return j.agg(
        F.countDistinct("d").alias("documents"),
        F.count_if((F.col("tokens") > limit) | ((F.col("tokens") == limit) & (many | ~F.col("final")))).alias("over_limit"),
        F.count_if(~F.col("part").eqNullSafe(F.expr("substring(whole, first + 1, last - first)"))).alias("other_text"),
        F.count_if(~many & (F.col("first") != 0)).alias("late_starts"),
        F.count_if(F.col("final") & (F.col("last") != F.length("whole"))).alias("early_ends"),
        F.count_if(many & (F.col("first") > F.col("before"))).alias("gaps"),
        F.count_if(many & ~F.coalesce(F.abs(F.col("shared") - overlap) <= overlap // 4, F.lit(False))).alias("wrong_overlaps"),
    )
