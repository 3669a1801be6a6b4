"""Personal information inside free text: find it and put typed placeholders in its place.

One Aho-Corasick pass over the text (look-alike letters made plain, lower case, every
digit a 0) finds anchors: at-signs, number schemes such as ``+00`` or ``000-00-0000``,
identifier cues, street endings before a number, titles, and words that go with persons.
At each anchor a local parser looks a few dozen characters to either side, fixes the
boundaries and validates what it found: lengths, dates, areas that don't exist, and check
digits wherever a number has no cue of its own. Nothing else of the text is looked at twice.

Names are found by evidence, not by the sentences that they stand in: titles, initials, a
list of known names, and names learned from all texts of the corpus (``learn``). A word is
learned if it often stands where a name stands, beside a known given or family name, a title or an
initial, compared with all its occurrences, and mostly with a capital. After a word that
goes with persons (friend, colleague, thanks, regards) or before a verb of speech an unknown
word counts if it has a capital and is not common in the corpus.

The replaced text keeps every other character as it was, invisible ones included.
Null stays null; empty text has no case. A name within an email address is no name of
its own. Overlaps go to the kind that comes first in ``KINDS``. Bank accounts are found and
replaced too.
"""

from __future__ import annotations

import copy
import re
import unicodedata
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from sparkgauge.llm.canonical import _TO_LATIN, COMPAT, INVISIBLE, JOINERS, unstable
from sparkgauge.operators.skew import hot_join
from sparkgauge.session import Scratch

KINDS = ("email", "account", "phone", "id_number", "address", "name")
#: Names that go to every task at once; with more, each text's own are joined to it.
MOST_NAMES = 200_000
#: A word is learned as a name with so many occurrences beside names, such a share of all its occurrences, and such a share with a capital.
LEAST_BESIDE, LEAST_SHARE, LEAST_CAPITAL = 3, 0.2, 0.5
#: A word is common from this number of occurrences and share of all words, so at most 1 / COMMON_SHARE are; of these, no more than NAME_SHARE beside names.
COMMON_COUNT, COMMON_SHARE, NAME_SHARE = 20, 1e-5, 0.05
#: Different words a task counts before it hands them on.
_VOCABULARY = 200_000

# Given or family names that are also ordinary words of English or Dutch; alone they name nobody.
ORDINARY = frozenset(
    "april amber angel august autumn bishop brook brown carol chance charity christian clay cook crystal daisy dawn dean destiny drew duke earl eve faith fern ford forest "
    "frank gene ginger grace grant green harmony hazel heather holly hope hunter iris ivy jack jasmine jewel joy june king lane lily mark may melody mercy meter miles "
    "noble olive page pansy patience pearl penny pride prince robin rose ruby rusty sage sandy skip sky storm summer sunny violet wade ward will winter young "
    "bakker berg boer bos dekker groen jong kok koning lente linde meester meyer prins roos ster visser vos vrede wit zomer zwart".split()
)
PARTICLES = frozenset("van de den der ter ten te het 't von di da la le du dos el bin al".split())
# Function words of English and Dutch, and the calendar: no names after any cue.
_STOP = frozenset(
    "a an and any as at because but by could for from he her him his i if in is it its me my no nobody not of on or our she so somebody someone still that the their them then there they this to today tomorrow us was we "
    "what when where who why would yesterday you your "
    "aan al allee als alles bij daar dan dat de deze die dit een en er ge geen haar hem het hier hij hun ik in is iemand je jij jou jouw jullie kan me met mij mijn na nee niemand nog nu of om ons onze op te toch tot u uit uw "
    "van voor waar waarom was wat we wel wie wij ze zij zijn zo zou "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "januari februari maart mei juni juli augustus oktober maandag dinsdag woensdag donderdag vrijdag zaterdag zondag".split()
)
# Words and phrases of English and Dutch after which a person is named: relations, greetings, thanks, closings, and verbs that take a person.
PERSON_BEFORE = tuple(
    x.replace("_", " ") + " "
    for x in (
        "friend friends girlfriend boyfriend colleague coworker neighbour neighbor sister brother cousin uncle aunt nephew niece husband wife son daughter grandma grandpa grandmother grandfather "
        "roommate flatmate classmate teacher boss landlord landlady ask asked asking tell told telling thank thanks thanked owe owed forgave forgive forgiven i_met we_met met_with married hugged invited phoned texted "
        "spoke_to spoke_with spoken_to spoken_with talked_to talked_with signed_by written_by named called my_name_is name_is name: regards regards, sincerely sincerely, cheers, love, dear hi hello hi, hello, contact "
        "vriend vriendin collega buurman buurvrouw zus broer neef nicht oom tante man vrouw zoon dochter baas huisbaas bedankt dank dankzij dank_u dank_je dank_aan merci mvg mvg, groet groet, groeten groeten, groetjes groetjes, "
        "gegroet gegroet, beste hallo hoi hey dag sprak_met gesproken_met spreken_met op_naam_van mijn_naam_is naam_is naam: ik_heet heet genaamd vroeg_aan getekend getekend_door t.a.v. ^"
    ).split()
) + ("^",)
# Words before which a person is named: verbs of speech and the relative pronoun for persons.
PERSON_AFTER = tuple(f" {x} " for x in "who whom whose said says asked asks told tells replied answered wrote phoned called texted zei zegt vroeg vraagt vertelde antwoordde schreef belde".split())
_PHONE_CUES = ("tel", "tel.", "telefoon", "telefoonnummer", "telephone", "phone", "mobile", "mobiel", "gsm", "gsm-nummer", "call", "call me", "text", "sms", "bel", "bel me", "bereikbaar op", "bereikbaar via", "nummer", "number", "whatsapp", "fax")
# Words before a number that is a case, an order, a train, and no telephone.
_CASE_CUES = re.compile(r"(?:ticket|zaak|dossier|ref|referentie|order|bestelling|bestelnr|bestelnummer|bestelcode|case|klacht|trein|train|rit|lijn|factuur|invoice|code|nr|account|klantnr|klantnummer|pakket|parcel|track|tracking)[a-z]*\.?[ :#(]{0,3}(?:is|nr\.?|no\.?|nummer|number)?[ :#]{0,2}$", re.I)

_W = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
_TITLE = r"(?:(?:dhr|mevr|mw|mr|mrs|ms|miss|dr|prof|ir|ing|sir)\b\.?|mevrouw|meneer|heer)\s"
_TOKEN = re.compile(rf"(?:[^\W\d_]\.(?=\s?[^\W\d_]))|'t\b|{_W}")
_NEXT = re.compile(rf"(,? )((?:[^\W\d_]\.(?=\s?[^\W\d_]))|'t\b|{_W})")
_PREV = re.compile(rf"((?:(?<![^\W\d_])[^\W\d_]\.)|'t\b|{_W})(,? )$")
_TITLE_AT = re.compile(_TITLE, re.I)

_LOCAL = re.compile(r"(?:[^\W_]|[._%+-])+$")
_AT = re.compile(r"\s?(?:@|[(\[]\s?at\s?[)\]])\s?")
_DOMAIN = re.compile(r"[^\W_](?:[^\W_]|-)*(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)[^\W_](?:[^\W_]|-)*)+")

_PLUS = re.compile(r"\+\d{1,3}(?:[ .-]?\(0\)[ .-]?)?(?:[ ./-]?\(?\d{1,9}\)?)+")
_PHONE = re.compile(
    r"00[1-9]\d{9,12}|06[ -]?\d{8}|06(?: \d{2}){4}|0\d{3}/\d\d[. ]?\d\d[. ]?\d\d|0\d{2}/\d{3}[. ]?\d\d[. ]?\d\d|0\d/\d{3}[. ]?\d\d[. ]?\d\d|0\d{3} \d\d \d\d \d\d|0\d(?: \d\d){4}|0\d(?:\.\d\d){4}|0\d{1,2}-\d{7,8}|0\d{3}-\d{6}|"
    r"0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4} \d{6}|\(0?\d{2,4}\) ?\d{3,4}[ -]\d{3,4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2}-\d{3}-\d{4}"
)
_AFTER_PHONE = re.compile(r"\w|[./-]\d")
_CUE_NUMBER = re.compile(r"\D{0,14}?(\d[\d .\-/]{6,16}\d)(?![\w])")
_SSN = re.compile(r"\d{3}-\d\d-\d{4}(?![\w]|-\d)")
_NATIONAL = re.compile(r"\d\d\.\d\d\.\d\d-\d{3}\.\d\d(?![\w]|[.-]\d)")
_INSURANCE = re.compile(r"[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d](?!\w)", re.I)

_HOUSE = re.compile(r"\d{1,4}(?:[ -]?[A-Za-z](?!\w)|-\d{1,3})?(?:\s(?:bus|box)\s\w{1,4})?")
_TOWN = r"[A-ZÀ-Þ][\w'’-]*"
_TOWN_2 = re.compile(r" ([A-ZÀ-Þ][a-z'’-]+)(?![\w'’-])")
_NL_TAIL = re.compile(rf"(?:,\s\d{{4}}\s?[A-Z]{{2}}\s{_TOWN}|\ste\s\d{{4}}\s{_TOWN}|,\s\d{{4}}\s{_TOWN}|,\s{_TOWN})")
_POSTCODE = re.compile(r",?\s(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}|[A-Z]{2}\s\d{5})(?!\w)")
_EN_TOWN = re.compile(rf",\s{_TOWN}")
_EN_HEAD = re.compile(r"(?:(?:Unit|Flat|Apt\.?|Apartment|Suite)\s\w{1,4},?\s)?(?<![\w.-])\d{1,5}[A-Za-z]?,?\s(?:(?:St\.|[A-ZÀ-Þ][\w'’-]*)\s){1,4}$")
_PAGE = re.compile(r"(?:page|p\.|pp\.|bladzijde|chapter|room|kamer)\s$", re.I)
_NL_NAME = re.compile(r"(?:(?:[A-ZÀ-Þ][\w'’-]*|de|van|den|der|het)\s){0,3}[A-ZÀ-Þ][\w'’-]*$")

# Endings of street names.
NL_STREETS = ("straat", "laan", "kade", "weg", "pad", "plein", "gracht", "dreef", "markt", "hof", "singel", "dijk", "baan", "lei", "steeg", "park", "plantsoen", "wal", "kaai", "vest", "berm", "ring", "poort", "pas", "veld", "akker", "heide", "stede", "oever")
EN_STREETS = ("street", "st.", "st", "road", "rd.", "rd", "drive", "dr.", "avenue", "ave.", "ave", "lane", "ln", "close", "way", "court", "ct.", "terrace", "crescent", "square", "place", "gardens", "boulevard", "blvd", "row", "mews", "hill", "grove", "walk")
# Ways to write a telephone number, each digit written 0.
SCHEMES = ("+0", "0000000000", "0000/00", "000/000", "00/000", "0000 00 00 00", "00 00 00 00", "00.00.00.00.00", "00-0000000", "00 0000000", "000-0000000", "0000-000000", "000 0000 0000", "000 0000000", "0000 000 0000", "00000 000000", "(00", "000.000.0000", "000-000-0000")
ID_CUES = ("ssn", "social security", "bsn", "burgerservice", "rijksregister", "insz", "niss", "national insurance", "nino", "sofinummer", "passport no", "id-nummer")
TITLES = ("dhr. ", "dhr ", "mevr. ", "mevr ", "mevrouw ", "meneer ", "mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "miss ", "dr. ", "dr ", "prof. ", "prof ")
_IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", re.I)
_MONTH_DAY = re.compile(r"\d\d(\d\d)(\d\d)")


def _view(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alikes made plain and invisible characters left out, and the place of each character."""
    if text.isascii() or not unstable(text):
        return text, None
    chars: list[str] = []
    at: list[int] = []
    for i, ch in enumerate(text):
        if ch in JOINERS or (ch in "­͏؜᠎​‎‏﻿⁠⁡⁢⁣⁤") or "‪" <= ch <= "‮" or "⁦" <= ch <= "⁯":
            continue
        if chars and unicodedata.combining(ch):
            one = unicodedata.normalize("NFC", chars[-1] + ch)
            if len(one) == 1:
                chars[-1] = one
                continue
        plain = _TO_LATIN.get(ch) or COMPAT.get(ord(ch), ch)
        chars.append(plain if len(plain) == 1 else ch)
        at.append(i)
    return "".join(chars), at


_LAST = re.compile(rf"((?:(?<![^\W\d_])[^\W\d_]\.)|{_W})()$")
_WORDS = re.compile(_W)
# words that are counted: none of addresses, handles and links
_COUNTED = re.compile(r"(?<![\w@#+./-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w@])")
_ONE = (1).__eq__
_INITIAL = re.compile(r"(?<!\w)[^\W\d_a-z]\. ?[^\W\d_]")
_TITLE_WORDS = frozenset("dhr mevr mw mr mrs ms miss dr prof sir mevrouw meneer heer dhr. mevr. mr. mrs. dr. prof.".split())


def _lower(v: str) -> str:
    """Lower case, character by character where it has another length."""
    low = v.lower()
    return low if len(low) == len(v) else "".join(c.lower() if len(c.lower()) == 1 else c for c in v)


_DIGITS = re.compile("[1-9]")


class _Spans:
    """Disjoint spans in order; one that overlaps an earlier one is refused."""

    def __init__(self):
        self.rows: list[tuple[int, int, str]] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.rows, (a, a, ""))
        return not (i and self.rows[i - 1][1] > a) and not (i < len(self.rows) and self.rows[i][0] < b)

    def add(self, a: int, b: int, kind: str) -> None:
        if self.free(a, b):
            insort(self.rows, (a, b, kind))

    def masked(self, text: str) -> str:
        """The text with a zero character for each one within a span."""
        if not self.rows:
            return text
        out, last = [], 0
        for a, b, _ in self.rows:
            out += [text[last:a], chr(0) * (b - a)]
            last = b
        return "".join(out) + text[last:]


class Finder:
    """Finds spans of personal information. Built once per Python worker and lexicon.

    ``names`` are (name, kind) pairs, kind ``given`` or ``family``; ``common`` are words that are no names.
    """

    def __init__(self, names: Iterable[tuple[str, str]], common: Iterable[str] = ()):
        self.common = frozenset(common)
        self.own = False
        self._take(names)
        keys: dict[str, set[tuple[str, str]]] = {}
        add = lambda k, what: keys.setdefault(k, set()).add((what, k))
        for k in ("@", "(at)", "[at]", "( at )"):
            add(k, "email")
        for k in SCHEMES:
            add(k, "phone")
        for k in _PHONE_CUES:
            add(f"{k} 0", "called")
            add(f"{k}: 0", "called")
            add(f"{k} (0", "called")
        for k in ID_CUES:
            add(k, "cue")
        add("000-00-0000", "ssn")
        add("00.00.00-000.00", "national")
        for k in "abcdefghijklmnopqrstuvwxyz":
            add(f"{k}00", "account")
            add(f" {k}. ", "initial")
        for k in "abcd":
            add(f"000000{k}", "insurance")
            add(f"00 00 00 {k}", "insurance")
            add(f"000000 {k}", "insurance")
        for k in NL_STREETS:
            add(f"{k} 0", "nl")
        for k in EN_STREETS:
            add(f" {k}", "en")
        for k in TITLES:
            add(k, "title")
        for k in PERSON_BEFORE:
            add(k, "before")
        for k in PERSON_AFTER:
            add(k, "after")
        for k in self.names:
            add(k, "known")
        self.auto = ahocorasick.Automaton()
        for k, v in keys.items():
            self.auto.add_word(k, tuple(v))
        self.auto.make_automaton()

    def _take(self, names: Iterable[tuple[str, str]]) -> None:
        self.names: dict[str, str] = {}
        for name, kind in names:
            if name and name.strip():
                self.names[name.strip().lower()] = kind or "family"
        #: single words of the known names, to tell a known neighbour from an unknown word
        self.words = {w for n in self.names for w in n.split() if w not in PARTICLES}
        #: names by their last word, which is looked up for every word of a text
        self.last: dict[str, list[str]] = {}
        for n in self.names:
            self.last.setdefault(n.split()[-1], []).append(n)

    def knowing(self, names: Iterable[tuple[str, str]]) -> Finder:
        """The same with one text's own names too, which are looked up word by word."""
        out = copy.copy(self)
        out._take([*self.names.items(), *names])
        out.own = True
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Disjoint (start, end, kind) in ``text``, in order."""
        v, at = _view(text)
        low = _lower(v)
        hits: dict[str, list[tuple[int, str]]] = {}
        for end, found in self.auto.iter(_DIGITS.sub("0", low)):
            for what, key in found:
                hits.setdefault(what, []).append((end + 1 - len(key), key))
        if self.own:
            hits["known"] = self._known(low)
        if not hits:
            return []
        taken, reserved = _Spans(), _Spans()
        for i, _ in hits.get("email", ()):
            if s := _email(v, i):
                taken.add(*s, "email")
        for i, _ in hits.get("account", ()):
            if s := _account(v, i):
                taken.add(*s, "account")
        ids = [s for what, parse in (("cue", _cued), ("ssn", _ssn), ("national", _national), ("insurance", _insurance)) for i, k in hits.get(what, ()) if (s := parse(v, i, k))]
        for s in ids:
            reserved.add(*s, "id_number")
        for i, k in hits.get("phone", ()):
            s = _phone(v, i, k)
            if s and reserved.free(*s):
                taken.add(*s, "phone")
        for i, k in hits.get("called", ()):
            s = _called(v, i, k)
            if s and reserved.free(*s):
                taken.add(*s, "phone")
        for s in ids:
            taken.add(*s, "id_number")
        homes = [s for i, k in hits.get("nl", ()) if (s := _dutch(v, i, k, self._stays))] + [s for i, k in hits.get("en", ()) if v[i + 1].isupper() and (s := _english(v, i, k, self._stays))]
        for s in homes:
            taken.add(*s, "address")
        if any(w in hits for w in ("title", "before", "after", "known", "initial")):
            for s in self._people(taken.masked(v), hits):
                taken.add(*s, "name")
        if at is None:
            return taken.rows
        return [(at[a], at[b - 1] + 1 if b == len(at) else at[b], k) for a, b, k in taken.rows]

    # names

    def _known(self, low: str) -> list[tuple[int, str]]:
        out = []
        for m in _WORDS.finditer(low):
            for n in self.last.get(m.group(), ()):
                a = m.end() - len(n)
                if a >= 0 and low[a : m.end()] == n:
                    out.append((a, n))
        return out

    def _is_name(self, w: str) -> bool:
        return w.lower() in self.words

    def _stays(self, w: str) -> bool:
        """Whether a word goes on with a new sentence or a name, and not with the name of a town."""
        return w.lower() in _STOP or w.lower() in self.words or w.lower() in self.common

    def _nobody(self, w: str) -> bool:
        """No part of a name whatever stands beside it."""
        lw = w.lower()
        return lw in _STOP or (lw in self.common and lw not in self.words)

    def _forward(self, v: str, i: int) -> tuple[int, int, bool] | None:
        """The name that starts at ``i``: (start, end, whether it ends in more than particles)."""
        m = _TITLE_AT.match(v, i)
        j = m.end() if m else i
        m = _TOKEN.match(v, j)
        if not m:
            return None
        end, n, body = i, 0, False
        start = j
        while m and n < 6:
            w = m.group(m.lastindex or 0)
            lw = w.lower()
            if lw in PARTICLES and (n or w[0].isupper() or self._rest(v, m.end())):
                pass
            elif len(w) == 2 and w[1] == "." and w[0].isupper():
                pass
            elif self._is_name(w) or (w[0].isupper() and not self._nobody(w)):
                body, end = True, m.end()
            else:
                break
            n += 1
            nxt = _NEXT.match(v, m.end())
            if nxt and nxt.group(1) == ", " and not (body and self._comma(v, start, m.end(), nxt)):
                break
            m = nxt
        return (i, end, body) if body else None

    def _rest(self, v: str, i: int) -> bool:
        """Whether a name goes on after a particle in lower case."""
        m = _NEXT.match(v, i)
        for _ in range(3):
            if not m:
                return False
            w = m.group(2)
            if w.lower() not in PARTICLES:
                return (w[0].isupper() and not self._nobody(w)) or self._is_name(w)
            m = _NEXT.match(v, m.end())
        return False

    def _comma(self, v: str, a: int, b: int, nxt: re.Match) -> bool:
        """Family, Given."""
        given, family = nxt.group(2).lower(), self.names.get(v[a:b].lower().split()[-1], self.names.get(v[a:b].lower()))
        return self.names.get(given) == "given" or (family == "family" and nxt.group(2)[0].isupper() and not self._nobody(given))

    def _people(self, v: str, hits: dict) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for i, k in hits.get("title", ()):
            if i and (v[i - 1].isalnum() or v[i - 1] in "@#_"):
                continue
            got = self._forward(v, i + len(k))
            if got and got[2]:
                out.append((i, self._clip(v, i + len(k), got[1])))
        for i, k in hits.get("before", ()):
            if i and k[0] != "^" and (v[i - 1].isalnum() or v[i - 1] in "@#_-"):
                continue
            a = i + len(k)
            got = self._forward(v, a)
            if got and got[2] and self._credible(v, a, got[1]):
                out.append((a, self._clip(v, a, got[1])))
        for i, k in hits.get("after", ()):
            s = self._backward(v, i)
            if s and (self._free_before(v, s[0]) or len(s) > 2) and self._credible(v, *s):
                out.append(s)
        for i, k in hits.get("known", ()):
            j = i + len(k)
            if (i and (v[i - 1].isalnum() or v[i - 1] in "@#_/+.-'’" and not (v[i - 1] == "." and i > 1))) or (j < len(v) and (v[j].isalnum() or v[j] in "@_" or (v[j] in "'’-" and j + 1 < len(v) and v[j + 1].isalnum() and v[j : j + 2].lower() not in ("'s", "’s")))):
                continue
            if chr(0) in v[i:j] or (i and v[i - 1] == "." and not v[i - 2].isalpha()):
                continue
            s = self._around(v, i, j)
            if k in ORDINARY and not self._person(v, i, j, s, k):
                continue
            out.append(s)
        for i, k in hits.get("initial", ()):
            a = i + 1
            m = _NEXT.match(v, i + 3)
            if v[a].isupper() and m and m.group(2)[0].isupper() and (not self._nobody(m.group(2)) or m.group(2).lower() in PARTICLES):
                got = self._forward(v, a)
                if got and got[2] and got[1] - m.start(2) > 2:
                    out.append((a, self._clip(v, a, got[1], 1)))
        out.sort(key=lambda s: (s[0], -s[1]))
        merged: list[tuple[int, int]] = []
        for a, b in out:
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def _credible(self, v: str, a: int, b: int) -> bool:
        """Whether unknown words beside a person's cue look like a name: no abbreviation, no word in capitals before a number."""
        words = [m.group() for m in _TOKEN.finditer(v, a, b) if m.group().lower() not in PARTICLES and not m.group().endswith(".")]
        if any(self._is_name(w) and w.lower() not in ORDINARY for w in words):
            return True
        words = [w for w in words if not self._nobody(w)]
        return bool(words) and all(len(w) > 1 and not (w.isupper() and len(w) < 4) for w in words) and not re.match(r"[ -]?\d", v[b : b + 2])

    def _clip(self, v: str, a: int, b: int, most: int = 2) -> int:
        """A phrase without an end takes at most a given and a family name: words after a known family name belong to the next sentence."""
        end, seen = b, 0
        for m in _TOKEN.finditer(v, a, b):
            w = m.group().lower()
            if w in PARTICLES or m.group().endswith("."):
                continue
            seen += 1
            end = m.end()
            if seen == most or (self.names.get(w) == "family" and not v[m.end() : m.end() + 2] == ", "):
                break
        return end

    def _backward(self, v: str, i: int) -> tuple[int, int] | None:
        """The name that ends at ``i``."""
        a, n, body = i, 0, False
        while n < 5:
            m = _PREV.search(v, max(0, a - 40), a) if a != i else _LAST.search(v, max(0, i - 40), i)
            if not m:
                break
            w = m.group(1)
            lw = w.lower()
            if m.group(2).startswith(","):
                break
            if self._nobody(w) and lw not in PARTICLES:
                break
            if lw in PARTICLES:
                if not body:
                    break
            elif not (w[0].isupper() or self._is_name(w)):
                break
            else:
                body = True
            a = m.start()
            n += 1
        while True:  # a particle in lower case doesn't start a name unless it belongs to a known one
            m = _TOKEN.match(v, a)
            if m and m.end() < i and m.group().lower() in PARTICLES and m.group()[0].islower() and not any(v[a:i].lower().startswith(x) for x in self.names):
                a = m.end() + 1
            else:
                break
        return (a, i) if body and a < i else None

    def _around(self, v: str, i: int, j: int) -> tuple[int, int]:
        """A known name with its title, initial and the name before or after it."""
        a, b = i, j
        kind = self.names[v[i:j].lower()]
        for _ in range(3):
            m = _PREV.search(v, max(0, a - 30), a)
            if not m:
                break
            w, sep = m.group(1), m.group(2)
            lw = w.lower()
            if sep != " " or (kind == "given" and not self._is_name(w)):
                break
            beside = kind == "family" and w[0].isupper() and not self._nobody(w) and len(w) > 2 and not w.isupper() and v[i].isupper() and self._free_before(v, m.start())
            if (len(w) == 2 and w[1] == "." and w[0].isupper()) or (self.names.get(lw) == "given" and kind == "family") or (lw in PARTICLES and w[0].isupper() and kind == "family") or beside:
                a = m.start()
            else:
                break
            if self.names.get(lw) == "given":
                break
        m = _NEXT.match(v, b)
        if m and kind == "family" and m.group(1) == ", " and self.names.get(m.group(2).lower()) == "given":
            return a, m.end()
        if m and kind == "given" and m.group(1) == " ":
            got = self._forward(v, m.start(2))
            if got and got[2]:
                first = _TOKEN.match(v, m.start(2)).group()
                if self._is_name(first) or first.lower() in PARTICLES or (first[0].isupper() and not self._nobody(first) and not v[i:j].isupper()):
                    b = self._clip(v, m.start(2), got[1], 1)
        return a, b

    def _free_before(self, v: str, a: int) -> bool:
        """Whether a capital at ``a`` is not just that of a sentence's first word."""
        return a > 1 and v[a - 1] == " " and v[a - 2] not in ".!?…:"

    def _person(self, v: str, i: int, j: int, s: tuple[int, int], k: str) -> bool:
        """Whether an ordinary word is a name here: with a capital, and beside another name or an initial."""
        if not v[i].isupper() or (v[i:j].isupper() and j - i > 1 and not v[s[0] : s[1]].isupper()):
            return False
        other = (v[s[0] : i] + " " + v[j : s[1]]).split()
        for w in other:
            w = w.strip(",").lower()
            if (w in self.words and (w not in ORDINARY or self.names.get(w) != self.names.get(k))) or (len(w) == 2 and w[1] == "."):
                return True
        return False


# learning names from the corpus


def beside_names(v: str, low: str, given: frozenset[str], family: frozenset[str], titles: bool = True) -> Iterator[tuple[str, int, int]]:
    """(word, 1 if it stands where a given name stands, 1 where a family name does) of the words of ``v`` that stand so.

    A family name stands after a given one, a title or an initial, over particles; a given name before a family name, or after
    one and a comma. Words of addresses, handles and links are left out.
    """
    found = [(m.start(), m.end()) for m in _TOKEN.finditer(v)]
    words = [low[a:b] for a, b in found]
    n = len(found)
    place: dict[int, tuple[int, int]] = {}

    def gap(i: int) -> str:
        return v[found[i][1] : found[i + 1][0]] if 0 <= i < n - 1 else ""

    def after(i: int) -> int | None:
        """The next word over particles and single blanks."""
        while i < n - 1 and gap(i) == " ":
            i += 1
            if words[i] not in PARTICLES:
                return i
        return None

    for i, w in enumerate(words):
        title = titles and w in _TITLE_WORDS
        if w in given or (titles and w.endswith(".") and v[found[i][0]].isupper()) or title:
            j = after(i) if not (title and gap(i) == ". ") else i + 1
            if title and j is not None and words[j] in PARTICLES:
                j = after(j)
            if j is not None:
                place[j] = (0, 1)
        if w in given and i and gap(i - 1) == ", ":
            place.setdefault(i - 1, (0, 1))
        if w in family:
            j = i - 1
            while j >= 0 and gap(j) == " " and words[j] in PARTICLES:
                j -= 1
            if j >= 0 and gap(j) == " " and not words[j].endswith("."):
                place.setdefault(j, (1, 0))
            if gap(i) == ", ":
                place.setdefault(i + 1, (1, 0))
    for i, of in place.items():
        a, b = found[i]
        if not ((a and v[a - 1] in "@#+._/-") or (b < len(v) and v[b] in "@_") or words[i].endswith(".")):
            yield words[i], *of


def word_statistics(rows: DataFrame, text: str, names: Iterable[tuple[str, str]], first: bool = True) -> DataFrame:
    """(word, n, capitals, as_given, as_family) over all texts; counts are added up within a task before they are shuffled.

    Of several parts of a list of names, the ``first`` counts words, titles and initials too, the others only what stands beside their names.
    """
    seeds = [(x.strip().lower().split()[-1], k) for x, k in names if x and x.strip() and x.strip().lower() not in ORDINARY]
    given, family = frozenset(w for w, k in seeds if k == "given"), frozenset(w for w, k in seeds if k != "given")
    anchors = given | family | (_TITLE_WORDS if first else frozenset())

    def table(seen: Counter, beside: dict[str, list[int]]) -> pa.RecordBatch:
        """Words as they were written become words in lower case; titles and particles are no names."""
        rows: dict[str, list[int]] = {}
        for w, n in seen.items():
            r = rows.setdefault(_lower(w), [0, 0, 0, 0])
            r[0] += n
            r[1] += n if w[0].isupper() else 0
        for w, of in beside.items():
            r = rows.setdefault(w, [0, 0, 0, 0])
            r[2] += of[0]
            r[3] += of[1]
        for w in PARTICLES | _TITLE_WORDS:
            rows.pop(w, None)
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *[pa.array([r[k] for r in rows.values()], pa.int64()) for k in range(4)]], names=["word", "n", "capitals", "as_given", "as_family"])

    def count(batches):
        seen, beside = Counter(), {}
        for b in batches:
            for t in b.column(0).to_pylist():
                v, _ = _view(t)
                words = _COUNTED.findall(v)
                if first:
                    seen.update(words)
                if not anchors.isdisjoint(map(str.lower, words)) or (first and any(map(_ONE, map(len, words))) and _INITIAL.search(v)):
                    for w, g, f in beside_names(v, _lower(v), given, family, first):
                        of = beside.setdefault(w, [0, 0])
                        of[0] += g
                        of[1] += f
            if len(seen) + len(beside) > _VOCABULARY:
                yield table(seen, beside)
                seen, beside = Counter(), {}
        yield table(seen, beside)

    got = rows.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "word string, n bigint, capitals bigint, as_given bigint, as_family bigint")
    return got.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "capitals", "as_given", "as_family")])


@dataclass(frozen=True)
class Lexicon:
    """Names and common words for every task, and the table of learned names where they are too many for that."""

    names: tuple[tuple[str, str], ...]
    common: tuple[str, ...] = ()
    table: DataFrame | None = None


def load_names(names: DataFrame, most: int | None = None) -> tuple[tuple[str, str], ...] | None:
    """The (name, kind) rows of a list; None if there are more than ``most``."""
    most = MOST_NAMES if most is None else most
    rows = names.where("name is not null").select("name", "name_type").distinct().limit(most + 1).collect()
    return tuple(sorted((r[0], r[1] or "family") for r in rows)) if len(rows) <= most else None


def learn(rows: DataFrame, text: str, names: DataFrame) -> Lexicon:
    """The known names with those that all texts of ``rows`` teach, and the corpus's common words.

    A list of known names beyond ``MOST_NAMES`` teaches in parts, one pass over the texts for each, and then joins the learned ones.
    """
    s = Scratch(rows.sparkSession, "names")
    known = load_names(names)
    if known is not None:
        stats = s.keep(word_statistics(rows, text, known))
    else:
        parts = -(-names.count() // MOST_NAMES) + 1  # by hash, so a part holds fewer than the bound but for a rare excess
        stats = None
        for i in range(parts):
            some = [tuple(r) for r in names.where("name is not null").where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i).select("name", "name_type").distinct().collect()]
            part = s.keep(word_statistics(rows, text, some, i == 0))
            stats = part if stats is None else stats.unionByName(part)
        stats = s.keep(stats.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "capitals", "as_given", "as_family")]))
    beside = F.col("as_given") + F.col("as_family")
    good = (beside >= LEAST_BESIDE) & (beside >= F.lit(LEAST_SHARE) * F.col("n")) & (F.col("capitals") >= F.lit(LEAST_CAPITAL) * F.col("n")) & (F.length("word") > 1)
    learned = stats.where(good & ~F.col("word").isin(*_STOP)).select(F.col("word").alias("name"), F.when(F.col("as_given") > F.col("as_family"), "given").otherwise("family").alias("name_type"))
    total = stats.agg(F.sum("n")).first()[0] or 0
    common = stats.where((F.col("n") >= max(COMMON_COUNT, COMMON_SHARE * total)) & (beside <= F.lit(NAME_SHARE) * F.col("n"))).select("word")
    common = tuple(sorted(r[0] for r in common.collect()))  # at most 1 / COMMON_SHARE words
    if known is not None:
        mine = {x.strip().lower() for x, _ in known}
        words = {w for x in mine for w in x.split()}
        common = tuple(w for w in common if w not in words)
        more = load_names(learned, MOST_NAMES - len(known))
        if more is not None:
            return Lexicon(tuple(sorted({*known, *((w, k) for w, k in more if w not in mine)})), common)
    both = names.where("name is not null").select(F.lower(F.trim("name")).alias("name"), F.coalesce("name_type", F.lit("family")).alias("name_type"), F.lit(0).alias("o")).unionByName(learned.withColumn("o", F.lit(1)))
    one = both.groupBy("name").agg(F.min(F.struct("o", "name_type"))["name_type"].alias("name_type"))
    return Lexicon((), common, s.keep(one.withColumn("last", F.element_at(F.split("name", " "), -1))))


def _with_own_names(rows: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """``rows`` with ``_own``, the names of the lexicon's table whose last word the text holds, met by word in one shuffle."""

    @F.arrow_udf(ArrayType(StringType()))
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else sorted(set(_WORDS.findall(_lower(_view(t)[0])))) for t in texts.to_pylist()], pa.list_(pa.string()))

    s = Scratch(rows.sparkSession, "own")
    kept = s.keep(rows.withColumn("_row", F.monotonically_increasing_id()))
    by = lexicon.table.groupBy("last").agg(F.collect_list(F.struct("name", "name_type")).alias("found"))  # the names that end in one word
    each = kept.select("_row", F.explode(words(F.col(text))).alias("last"))
    met = hot_join(each, by, "last").groupBy("_row").agg(F.flatten(F.collect_list("found")).alias("_own"))
    return kept.join(met, "_row", "left").drop("_row")


def _email(v: str, i: int) -> tuple[int, int] | None:
    a = i - 1 if i and v[i - 1] == " " and v[i] != "@" else i
    m = _AT.match(v, a)
    local = _LOCAL.search(v, max(0, a - 64), a)
    if not m or not local:
        return None
    d = _DOMAIN.match(v, m.end())
    if not d or (v[i] == "@" and m.group() != "@"):
        return None
    top = re.split(r"\.|[)\]]\s?", d.group())[-1].strip()
    if len(top) < 2 or not top.isalpha() or not any(c.isalnum() for c in local.group()):
        return None
    a = local.start()
    while v[a] in "._%+-":
        a += 1
    return a, d.end()


def _phone(v: str, i: int, k: str) -> tuple[int, int] | None:
    if k == "+0":
        if i and v[i - 1].isalnum():
            return None
        m = _PLUS.match(v, i)
        if not m:
            return None
        n, end = 0, i
        for part in re.finditer(r"\(0\)|\d+", m.group()):
            if part.group() != "(0)":
                n += sum(c.isdigit() for c in part.group())
            if n > 13:
                break
            if n >= 9:
                end = i + part.end()
        return (i, end) if end > i and not (end < len(v) and v[end].isalnum()) else None
    for a in range(i, max(-1, i - 3), -1):
        if a and (v[a - 1].isalnum() or v[a - 1] in "+/" or (v[a - 1] in ".-" and a > 1 and v[a - 2].isdigit())):
            continue
        m = _PHONE.match(v, a)
        if m and not _AFTER_PHONE.match(v, m.end()):
            bare = m.group().isdigit() and v.startswith("06", a)
            return None if bare and _CASE_CUES.search(v, max(0, a - 32), a) else (a, m.end())
    return None


def _called(v: str, i: int, k: str) -> tuple[int, int] | None:
    """A number after a word for telephones: nine to eleven digits from 0, however they are grouped."""
    if i and v[i - 1].isalnum():
        return None
    a = i + len(k) - (2 if k.endswith("(0") else 1)
    m = re.compile(r"\(?0\d{0,4}\)?(?:[ ./-]{0,3}\d{1,10})*").match(v, a)
    if not m:
        return None
    digits, end = 0, None
    for p in range(a, m.end()):
        if v[p].isdigit():
            digits += 1
            if 9 <= digits <= 11 and (p + 1 == len(v) or not v[p + 1].isdigit()):
                end = p + 1
    return (a, end) if end and not (end < len(v) and v[end].isalnum()) else None


def _account(v: str, i: int) -> tuple[int, int] | None:
    """An international bank account number: country, check digits, and a remainder of 1 modulo 97."""
    a = i - 1
    if a < 0 or not v[a].isalpha() or (a and v[a - 1].isalnum()):
        return None
    m = _IBAN.match(v, a)
    while m:
        bare = re.sub(r"\s", "", m.group()).upper()
        if 15 <= len(bare) <= 34 and bare.isascii() and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
            return a, m.end()
        cut = m.group().rfind(" ")
        m = _IBAN.fullmatch(v, a, a + cut) if cut > 0 else None
    return None


def _real_date(digits: str) -> bool:
    """Whether six digits are year, month and day, the month raised by 20 or 40 at will."""
    m = _MONTH_DAY.match(digits)
    return bool(m) and 1 <= int(m.group(1)) % 20 <= 12 and 1 <= int(m.group(2)) <= 31


def _cued(v: str, i: int, k: str) -> tuple[int, int] | None:
    if i and v[i - 1].isalnum():
        return None
    a = i + len(k)
    if a < len(v) and len(k) <= 4 and v[a].isalpha():
        if not v[a:].lower().startswith(("nr", "num", "-num")):
            return None
    m = re.compile(r"[a-z]{0,8}\.?(?: (?:number|nummer|nr|no|is|was)\.?)*[ :=#-]{0,3}", re.I).match(v, a)
    n = re.compile(r"\d(?:[ .\-/]?\d){7,12}").match(v, m.end() if m else a)
    if not n:
        return None
    digits, end = 0, n.start()
    stops = []
    for p in range(n.start(), n.end()):
        if v[p].isdigit():
            digits += 1
            if digits in (8, 9, 11) and (p + 1 == len(v) or not v[p + 1].isdigit()):
                stops.append((digits, p + 1))
    best = [e for d, e in stops if d in (9, 11)] or [e for _, e in stops]
    if not best:
        return None
    want = 11 if k in ("rijksregister", "insz", "niss") else 9
    exact = [e for d, e in stops if d == want]
    end = exact[0] if exact else best[0]
    return (i, end) if set(re.sub(r"\D", "", v[n.start() : end])) != {"0"} else None


def _ssn(v: str, i: int, k: str) -> tuple[int, int] | None:
    m = _SSN.match(v, i)
    if not m or (i and (v[i - 1].isalnum() or v[i - 1] in "-/.")):
        return None
    area, group, serial = m.group().split("-")
    return (i, m.end()) if area not in ("000", "666") and group != "00" and serial != "0000" else None


def _national(v: str, i: int, k: str) -> tuple[int, int] | None:
    m = _NATIONAL.match(v, i)
    ok = m and not (i and (v[i - 1].isalnum() or v[i - 1] in "-/.")) and _real_date(re.sub(r"\D", "", m.group()))
    return (i, m.end()) if ok else None


def _insurance(v: str, i: int, k: str) -> tuple[int, int] | None:
    for a in (i - 2, i - 3):
        if a >= 0 and not (a and (v[a - 1].isalnum() or v[a - 1] in "-/.")):
            m = _INSURANCE.match(v, a)
            if m:
                return a, m.end()
    return None


def _dutch(v: str, i: int, k: str, stays: Callable[[str], bool]) -> tuple[int, int] | None:
    j = i + len(k) - 1
    m = _NL_NAME.search(v, max(0, i - 48), j - 1)
    if not m:
        return None
    a = m.start()
    first = v[a : j - 1].split()
    while len(first) > 1 and (first[0].lower() in _STOP or len(first) > 2 or first[0].lower() not in ("oude", "nieuwe", "lange", "korte", "grote", "kleine", "hoge", "lage", "sint", "st.", "eerste", "tweede", "noorder", "zuider", "ooster", "wester", "oud", "nieuw", "brede", "smalle", "groene", "witte")):
        a += len(first[0]) + 1
        first = first[1:]
    if len(first) == 1 and len(first[0]) <= len(k) - 2:
        return None
    h = _HOUSE.match(v, j)
    if not h:
        return None
    e = h.end()
    if e < len(v) and (v[e].isalnum() or v[e] in ":%"):
        return None
    t = _NL_TAIL.match(v, e)
    return a, _second(v, t.end(), stays) if t else e


def _second(v: str, e: int, stays: Callable[[str], bool]) -> int:
    """The end of a town's name whose first word ends at ``e``: a second word, unless a sentence or a name starts there."""
    m = _TOWN_2.match(v, e)
    if not m or stays(m.group(1)):
        return e
    return m.end()


def _english(v: str, i: int, k: str, stays: Callable[[str], bool]) -> tuple[int, int] | None:
    e = i + len(k)
    if e < len(v) and v[e].isalnum():
        return None
    m = _EN_HEAD.search(v, max(0, i - 70), i + 1)
    if not m or _PAGE.search(v, max(0, m.start() - 12), m.start()):
        return None
    t = _EN_TOWN.match(v, e)
    e = _second(v, t.end(), stays) if t else e
    t = _POSTCODE.match(v, e)
    return m.start(), t.end() if t else e


@lru_cache(maxsize=4)
def finder(names: tuple[tuple[str, str], ...], common: tuple[str, ...] = ()) -> Finder:
    return Finder(names, common)


def _ready(rows: DataFrame, text: str, lexicon: Lexicon) -> tuple[DataFrame, Callable]:
    """``rows``, with ``_own`` where texts meet their own names, and a maker of the column of a function of a text and a Finder."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon.names, lexicon.common))  # at most MOST_NAMES and 1 / COMMON_SHARE words
    own = lexicon.table is not None
    if own:
        rows = _with_own_names(rows, text, lexicon)

    def over(work: Callable[[str, Finder], object], kind, arrow: pa.DataType) -> Column:
        @F.arrow_udf(kind)
        def plain(texts: pa.Array) -> pa.Array:
            f = finder(*shared.value)
            return pa.array([None if t is None else work(t, f) for t in texts.to_pylist()], arrow)

        @F.arrow_udf(kind)
        def knowing(texts: pa.Array, names: pa.Array) -> pa.Array:
            f = finder(*shared.value)
            return pa.array([None if t is None else work(t, f.knowing((x["name"], x["name_type"]) for x in mine or ())) for t, mine in zip(texts.to_pylist(), names.to_pylist())], arrow)

        return knowing(F.col(text), F.col("_own")) if own else plain(F.col(text))

    return rows, over


def _bits(text: str, f: Finder) -> int:
    bits = 0
    for _, _, k in f.spans(text):
        bits |= 1 << KINDS.index(k)
    return bits


def replace(text: str, f: Finder) -> str:
    out, last = [], 0
    for a, b, k in f.spans(text):
        out += [text[last:a], f"[{k.upper()}]"]
        last = b
    return "".join(out) + text[last:] if out else text


def redacted(rows: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """``rows`` with typed placeholders in the column ``text``."""
    ready, over = _ready(rows, text, lexicon)
    ready = ready.withColumn(text, over(replace, StringType(), pa.string()))
    return ready.drop("_own") if lexicon.table is not None else ready


def found(rows: DataFrame, keys: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """Distinct ``keys`` with pii_kind, one row for each kind that the text holds."""
    ready, over = _ready(rows.select(*keys, F.col(text).alias("_text")), "_text", lexicon)
    bits = ready.select(*keys, over(_bits, IntegerType(), pa.int32()).alias("_bits")).where("_bits > 0")
    each = F.array(*[F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(KINDS)])
    return bits.select(*keys, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("pii_kind")).distinct()
