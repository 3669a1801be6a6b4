"""One consistent form for text that looks the same.

Most text is stable: plain ASCII, or precomposed letters of one script. A quick check
over a precomputed class of unstable characters of all planes finds the rest; only the runs
between blanks that hold one are rewritten, whole, so that marks keep their base and a word
is judged by all its letters, and are spliced back into the unchanged text.

There are two forms. The published one, ``canonical``: invisible characters go (joiners
stay between emoji and inside scripts that join); full-width, half-width, no-break and
presentation forms, letters of the mathematical alphabets and ligatures become ordinary
ones; marks compose (NFC); a word in which look-alike letters of several scripts meet takes
the script of its unmistakable letters. A word of look-alikes alone that all belong to one
script stays if the text has an unmistakable word of that script; else it takes the
script of the nearest unmistakable word, and stays where there is none. So
honest Cyrillic, Greek or Armenian words, emoji, accents and punctuation stay. Every special
space becomes one ordinary space, so amounts of space are kept.

The comparison form, ``skeleton``, writes every look-alike letter of the published one as its
Latin twin: texts that look the same have equal skeletons, whatever was typed.

Null stays null and an empty text stays empty. Both forms are idempotent.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkgauge.operators.skew import hot_join, hot_keys
from sparkgauge.session import Scratch

# Letters of Cyrillic, Greek and Armenian that look like a Latin letter, in the order of their alphabets, after the Unicode list of confusables.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮӀԌԚԜаеіјорсухѕԁԛԝһүѵӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYIGQWaeijopcyxsdqwhyvl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαικνορυχϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXCJaiknopuxcj"
ARMENIAN = "ՍՏՕԼզհնոպջսցօ"
ARMENIAN_AS = "USOLqhunwgugo"
# Latin letters that look like a plain one; they count for comparison alone.
LATIN = "ıȷɑɡɩʋᴄᴏᴠᴡᴢ"
LATIN_AS = "ijagiucovwz"
# Characters that take no room.
INVISIBLE = "­͏؜᠎​‎‏‪-‮⁠-⁤⁦-⁯﻿"
JOINERS = "‌‍"

_FROM_CYRILLIC = dict(zip(CYRILLIC, CYRILLIC_AS))
_FROM_GREEK = dict(zip(GREEK, GREEK_AS))
_FROM_ARMENIAN = dict(zip(ARMENIAN, ARMENIAN_AS))
_TO_LATIN = {**_FROM_CYRILLIC, **_FROM_GREEK, **_FROM_ARMENIAN}
_SKELETON = {ord(k): v for k, v in _TO_LATIN.items()} | {ord(k): v for k, v in zip(LATIN, LATIN_AS)}


def _to(own: dict[str, str]) -> dict[str, str]:
    """Every other script's look-alikes, and the Latin letters, as the letters of one script."""
    back = {}
    for k, latin in own.items():
        back.setdefault(latin, k)
    return back | {k: back[latin] for k, latin in _TO_LATIN.items() if k not in own and latin in back}


_TO = {"c": _to(_FROM_CYRILLIC), "g": _to(_FROM_GREEK), "a": _to(_FROM_ARMENIAN), "l": _TO_LATIN}
#: Latin letters that a letter of another script looks like.
_TWINS = frozenset(_TO_LATIN.values())
# The planes that hold letters, and their last code points.
_POINTS = (range(0x80, 0xD800), range(0xE000, 0x33500), range(0xE0000, 0xE0200))
_ORDINARY = ("<wide>", "<narrow>", "<noBreak>")
_LETTERS = ("<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")


def _compat() -> dict[int, str]:
    """Ordinary forms, by rule from the character database: of wide, narrow and no-break characters, of special spaces,
    and of letters and numbers that are but other shapes of letters and numbers."""
    out = {}
    for points in _POINTS:
        for c in points:
            ch = chr(c)
            kind = unicodedata.decomposition(ch).partition(" ")[0]
            if unicodedata.category(ch) == "Zs":
                out[c] = " "
            elif kind in _ORDINARY:
                out[c] = unicodedata.normalize("NFKC", ch)
            elif kind in _LETTERS and unicodedata.category(ch)[0] in "LN" and ch not in _TO_LATIN:
                plain = unicodedata.normalize("NFKC", ch)
                if all(unicodedata.category(x)[0] in "LNM" for x in plain):
                    out[c] = plain
    out[0x2010] = out[0x2011] = "-"
    out[0xB5] = "μ"
    return out


COMPAT = _compat()
_SPACE = "".join(chr(c) for c, v in COMPAT.items() if v == " ")


def _ranges(points: list[int]) -> str:
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(re.escape(chr(points[i])) + ("-" + re.escape(chr(points[j])) if j > i else ""))
        i = j + 1
    return "".join(out)


def _points() -> list[int]:
    """Characters that may change: no quick-check pass for NFC, a compatibility form, or of a script with look-alikes."""
    points = {c for part in _POINTS for c in part if c in COMPAT or unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c))}
    return sorted(points | {c for c in range(0x370, 0x590) if chr(c).isalpha()} | set(range(0x1100, 0x1200)))


_MAY_CHANGE = _points()
# within the first plane a class is one table look-up; characters beyond it are few and looked up one by one
_LOW = re.compile("[" + _ranges([c for c in _MAY_CHANGE if c < 0x10000]) + INVISIBLE + JOINERS + "]")
_HIGH = frozenset(chr(c) for c in _MAY_CHANGE if c >= 0x10000)
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def unstable(text: str) -> bool:
    """The quick check: whether a character may change."""
    return _LOW.search(text) is not None or any(ch in _HIGH for ch in _BEYOND.findall(text))


_SPACES = re.compile(f"[{_SPACE}]")
_RUN = re.compile(r"\S+")
_GONE = re.compile(f"[{INVISIBLE}]")
_JOIN = re.compile(f"[{JOINERS}]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
#: Characters of the scripts that share look-alikes, and the Latin ones that count for comparison.
_OTHER = re.compile(f"[\u0370-\u058f{LATIN}]")


def _joins(ch: str) -> bool:
    c = ord(ch)
    return c >= 0x1F000 or 0x2190 <= c < 0x2C00 or c == 0xFE0F or 0x600 <= c < 0x780 or 0x900 <= c < 0xE00


def _joiners(run: str) -> str:
    """Drops joiners that don't stand between two characters that join."""
    out = []
    for i, ch in enumerate(run):
        if ch in JOINERS and not (out and _joins(out[-1]) and i + 1 < len(run) and _joins(run[i + 1])):
            continue
        out.append(ch)
    return "".join(out)


def _scripts(word: str) -> tuple[str, str]:
    """(scripts of its unmistakable letters, scripts of its look-alikes), each from l, c, g, a; Latin letters with a twin are look-alikes."""
    sure, alike = set(), set()
    for ch in word:
        c = ord(ch)
        if c < 0x250:
            (alike if ch in _TWINS else sure).add("l")
        elif 0x370 <= c < 0x400:
            (alike if ch in _FROM_GREEK else sure).add("g")
        elif 0x400 <= c < 0x530:
            (alike if ch in _FROM_CYRILLIC else sure).add("c")
        elif 0x530 <= c < 0x590:
            (alike if ch in _FROM_ARMENIAN else sure).add("a")
    return "".join(sorted(sure)), "".join(sorted(alike))


class _Context:
    """The unmistakable words of a text, by place."""

    def __init__(self, text: str):
        self.at: list[tuple[int, str]] = []
        for m in _WORD.finditer(text):
            sure, _ = _scripts(m.group())
            if len(sure) == 1:
                self.at.append((m.start(), sure))
        self.there = {s for _, s in self.at}

    def near(self, place: int) -> str | None:
        """The script of the nearest unmistakable word, of equals the one before."""
        i = bisect_left(self.at, (place, ""))
        best = [(abs(p - place), p, s) for p, s in self.at[max(0, i - 1) : i + 1]]
        return min(best)[2] if best else None


def _one_script(text: str) -> str:
    """Words in which scripts meet, or that look like another script's alone, in the script that they belong to."""
    context: list[_Context] = []

    def word(m: re.Match) -> str:
        w = m.group()
        if w.isascii() and not foreign:
            return w
        sure, alike = _scripts(w)
        if not alike or (len(sure) == 1 and alike in (sure, "")) or (sure and sure == alike):
            return w
        if not sure:
            context.extend([] if context else [_Context(text)])
            if len(alike) == 1 and (alike in context[0].there or not context[0].there):
                return w
            to = context[0].near(m.start()) or "l"
        else:
            to = sure if len(sure) == 1 else "l"
        return "".join([_TO[to].get(ch, ch) for ch in w])

    foreign = _OTHER.search(text) is not None
    return _WORD.sub(word, text) if foreign else text


def _run(m: re.Match) -> str:
    r = m.group()
    if r.isascii() or not unstable(r):
        return r
    r = _GONE.sub("", r)
    if _JOIN.search(r):
        r = _joiners(r)
    return unicodedata.normalize("NFC", r.translate(COMPAT))


def canonical(text: str) -> str:
    """The published form."""
    if text.isascii() or not unstable(text):
        return text
    text = _RUN.sub(_run, _SPACES.sub(" ", text))
    if _OTHER.search(text):
        text = unicodedata.normalize("NFC", _one_script(unicodedata.normalize("NFD", text)))
    return text


def skeleton(text: str) -> str:
    """The comparison form."""
    text = canonical(text)
    if not _OTHER.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_SKELETON))


def _where_changed(form: Callable[[str], str]):
    @F.arrow_udf(StringType())
    def changed(texts: pa.Array) -> pa.Array:
        """The form where it differs from the text, else null."""
        out: list[str | None] = [None] * len(texts)
        odd = pc.indices_nonzero(pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False))
        for i, t in zip(odd.to_pylist(), texts.take(odd).to_pylist()):
            c = form(t)
            if c != t:
                out[i] = c
        return pa.array(out, pa.string())

    return changed


def canonical_text(column: Column) -> Column:
    return F.coalesce(_where_changed(canonical)(column), column)


def skeleton_text(column: Column) -> Column:
    return F.coalesce(_where_changed(skeleton)(column), column)


def look_alike_classes(rows: DataFrame, source: str, record: str, text: str) -> DataFrame:
    """(source, id, class, raw): distinct records of texts that look like another, different text of their source.

    ``class`` names the look by a digest of source and skeleton, ``raw`` the very text. One of two such texts
    is no skeleton, so only the looks of changed texts are kept; hot looks are counted
    first and meet theirs by broadcast. Null texts and ids are in no class.
    """
    s = Scratch(rows.sparkSession, "alike")
    seen = rows.where(F.col(text).isNotNull() & F.col(record).isNotNull()).select(F.col(source).alias("source"), F.col(record).alias("id"), F.col(text).alias("t"), _where_changed(skeleton)(F.col(text)).alias("c"))
    digest = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 32))
    look = digest(F.concat(F.coalesce(F.col("source").cast("string"), F.lit("")), F.lit("\u0001"), F.coalesce("c", "t")))
    keys = s.keep(seen.select("source", "id", look.alias("class"), F.when(F.col("c").isNotNull(), digest(F.col("t"))).alias("raw")))
    changed = s.keep(keys.where("raw is not null").groupBy("class").agg(F.lit(True).alias("_odd")))
    met = hot_join(keys, changed, "class", rows=s.rows(keys)).drop("_odd").distinct()
    met = s.keep(met)
    # a class whose texts are all one and the same string is none
    several = met.groupBy("class").agg(F.min(F.coalesce("raw", F.lit(b""))).alias("lo"), F.max(F.coalesce("raw", F.lit(b""))).alias("hi")).where("lo < hi").select("class")
    return s.keep(hot_join(met, several, "class", rows=s.rows(met)).select("source", "id", "class", "raw"))


def look_alikes(rows: DataFrame, source: str, record: str, text: str, salts: int = 16) -> DataFrame:
    """(source, a, b), a < b: the classes' members of different texts and different ids, in pairs.

    Rows of a changed text meet their whole class; a hot class is spread over ``salts`` parts.
    """
    s = Scratch(rows.sparkSession, "pairs")
    members = s.keep(look_alike_classes(rows, source, record, text))
    hot = hot_keys(members, "class", rows=s.rows(members))
    is_hot = F.col("class").isin(hot) if hot else F.lit(False)
    left = members.where("raw is not null").select("source", "class", F.col("id").alias("x"), F.col("raw").alias("rx"), F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    right = members.select("class", F.col("id").alias("y"), F.col("raw").alias("ry"), F.when(is_hot, F.pmod(F.hash("id"), F.lit(salts))).otherwise(F.lit(0)).alias("salt"))
    pairs = left.join(right, ["class", "salt"]).where((F.col("x") != F.col("y")) & ~F.col("rx").eqNullSafe(F.col("ry")))
    return pairs.select("source", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
