"""Text operators: brute force, exact round trips and cases by hand."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgauge.llm import canonical as can
from sparkgauge.llm import leaks, packing, pii, segments
from sparkgauge.llm.queries import QUERIES
from sparkgauge.llm.tokens import TOKENIZER, encoding, size_of
from sparkgauge.operators import skew

NAMES = (("Elowen", "given"), ("Joy", "given"), ("Winter", "family"), ("May", "given"), ("Ockerdale", "family"), ("van den Zilverberg", "family"), ("Rose", "given"))


@pytest.mark.parametrize(
    "raw,form",
    [
        ("Ｂｅｓｔｅ， ｎｏｏｉｔ", "Beste, nooit"),
        ("I wаѕ rеаѕѕurеd", "I was reassured"),
        ("нет, нeт καλημέρα", "нет, нет καλημέρα"),
        ("pur⁠e­​", "pure"),
        ("résumé", "résumé"),
        ("a‍́b", "áb"),
        ("👩‍🔧 h‌et ❤️", "👩‍🔧 het ❤️"),
        ("two  spaces\tand «quotes»", "two  spaces\tand «quotes»"),
        ("a  b", "a  b"),
        ("", ""),
    ],
)
def test_canonical(raw, form):
    assert can.canonical(raw) == form == can.canonical(form)


@pytest.mark.parametrize("a,b,same", [("хор", "xop", True), ("ırak", "irak", True), ("нос", "hoc", False), ("Ⅳ", "IV", True), ("é", "e", False), ("Aa", "aa", False), ("a b", "a  b", False), ("օս", "ou", True), ("𝐇ello", "Неllо", True)])
def test_skeletons(a, b, same):
    assert (can.skeleton(a) == can.skeleton(b)) == same


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aeoрсухвαρνкиեօ\u0301\u200b\ufb01 𝐇"))))
def test_canonical_is_idempotent_and_keeps_ascii(t):
    c, k = can.canonical(t), can.skeleton(t)
    assert can.canonical(c) == c and can.skeleton(k) == k == can.skeleton(c)
    if t.isascii():
        assert c == t


def test_look_alikes_equal_brute_force(spark, monkeypatch):
    r = random.Random(4)
    base = [f"text number {i} with an old café table" for i in range(8)]
    def disguise(t):
        return r.choice([t, t, t.replace("o", "ο"), t.replace(" ", " "), unicodedata.normalize("NFD", t), t[:4] + "​" + t[4:], t.upper(), t.replace("é", "e"), t.replace(" ", "  ", 1)])
    rows = [("s" if i % 3 else "q", f"i{i % 110:03d}" if i > 100 else f"i{i:03d}", disguise(r.choice(base)), 1) for i in range(160)] + [("s", None, "x", 1), ("s", "i1", None, 1)]
    df = spark.createDataFrame(rows, "src string, id string, text string, key int")
    want = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and None not in (a[1], b[1], a[2], b[2]) and a[1] != b[1] and a[2] != b[2] and can.skeleton(a[2]) == can.skeleton(b[2])}
    assert {tuple(x) for x in can.look_alikes(df, "src", "id", "text").collect()} == want
    assert can.look_alikes(df.limit(0), "src", "id", "text").count() == 0
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (1 / 500, 3, None))
    assert {tuple(x) for x in can.look_alikes(df, "src", "id", "text").collect()} == want


CASES = [
    ("Mail me at joy.w+x@mail.example.com or zephyr (at) example (dot) org.", ["email", "email"]),
    ("app v21.6.66@ios, @railnova, we met @ 21.25", []),
    ("tel 0400/34.66.59 and +32 400 85 31 68 or 06 00 98 20 74.", ["phone", "phone", "phone"]),
    ("(212) 555-0198 212.555.0198 +1-646-555-0131 0032400155363 07700 900979 020 7946 0424 06-00951192", ["phone"] * 7),
    ("ticket 22700065937 zaak 4644-0046608 ref 6348.0095.207 code 0873 0873 0873 Order 4471-0063-18 bestelling 871227135678910", []),
    ("SSN 932-27-8346, QQ 29 33 34 C, 55.02.24-000.61, rijksregisternr 57070800036, BSN 002860888", ["id_number"] * 5),
    ("burgerservicenummer 0046.398.16 and social security number 930 22 3417", ["id_number"] * 2),
    ("Ik woon Unit 4B, 149 Tannery Avenue, Sint-Odulf QX1 1ZZ. Kerkpad 209A, Oostvelderdam", ["address"] * 2),
    ("Lange Gracht 171-2, 0048 XZ Brackwell Could you", ["address"]),
    ("Page 22 High Street Stories was torn. Main Hall, room 94. perron 152 te Wexbury onderweg 5 minuten", []),
    ("Ask M. Tolbrane about it. op naam van dhr. Ockerdale", ["name", "name"]),
    ("collega Tolbrane, Jelte zou terugbellen; bedankt voor de snelle hulp", ["name"]),
    ("IBAN NL91ABNA0417164300 and NL92ABNA0417164300, BE68 5390 0754 7034.", ["account", "account"]),
    ("ssn 000-00-0000, BSN 000000000, 99.99.24-000.61", []),
    ("call 0612345678 or 06 12345678, tel: 0471 23 45 67", ["phone"] * 3),
    ("order 0612345678", []),
    ("Joy, plain Joy, in May. Rose and May are my favourite words. The Winter coat", []),
    ("because Joy Winter praised it", ["name"]),
    ("elowen van den zilverberg belde", ["name"]),
    ("write to elowen@example.com", ["email"]),
    ("", []),
]


@pytest.mark.parametrize("text,kinds", CASES)
def test_pii(text, kinds):
    f = pii.Finder(NAMES)
    got = f.spans(text)
    assert [k for _, _, k in got] == kinds
    assert all(a < b for a, b, _ in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_pii_replacement_keeps_the_rest():
    f = pii.Finder(NAMES)
    t = "Βel​ mij: tel 0400/34.66.59, of ｅｌｏｗｅｎ@example.com! Groet"
    assert pii.replace(t, f) == "Βel​ mij: tel [PHONE], of [EMAIL]! Groet"
    assert pii.replace("nothing here", f) == "nothing here"
    long = "x y z " * 20000 + "mail a@b.example now " * 2000
    assert pii.replace(long, f).count("[EMAIL]") == 2000


def test_pii_columns(spark):
    df = spark.createDataFrame([("a", "call 06-00951192"), ("b", None), ("c", ""), ("a", "BSN 002860888")], "id string, text string").withColumn("_own", F.lit(1)).withColumn("_text", F.lit("x"))
    lexicon = pii.Lexicon(NAMES)
    assert {tuple(r) for r in pii.found(df, ["id"], "text", lexicon).collect()} == {("a", "phone"), ("a", "id_number")}
    assert [r["text"] for r in pii.redacted(df, "text", lexicon).collect()] == ["call [PHONE]", None, "", "[ID_NUMBER]"]
    assert pii.found(df.limit(0), ["id"], "text", lexicon).count() == 0


TAUGHT = [f"{w} {x} {y}." for x, y in (("Elowen Vossendaal", "kept the key"), ("elowen vossendaal", "left"), ("Tjalling Ockerdale", "rang twice"), ("Ockerdale, Tjalling", "wrote")) for w in ("Then", "Later", "Again")] + ["The Tjalling bridge", "Only Vossendaal knew"]


def test_names_are_learned_from_the_corpus(spark, monkeypatch):
    texts = TAUGHT + ["after elowen left the house"] * 30 + ["i left"] * 40 + ["Tjalling was here", "nothing of vossendaal remained", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    known = spark.createDataFrame([*NAMES, (None, "given")], "name string, name_type string")
    lexicon = pii.learn(df, "text", known)
    learned = set(lexicon.names) - {(n, k) for n, k in NAMES}
    assert learned == {("vossendaal", "family"), ("tjalling", "given")} and "house" in lexicon.common and "elowen" not in lexicon.common
    want = {tuple(r) for r in pii.found(df, ["id"], "text", lexicon).collect()}
    assert {i for i, k in want if k == "name"} >= {texts.index("Tjalling was here"), texts.index("nothing of vossendaal remained")}
    # too many names for every task: each text meets its own, with the same result
    monkeypatch.setattr(pii, "MOST_NAMES", len(NAMES))
    own = pii.learn(df, "text", known)
    assert own.table is not None and own.names == ()
    assert {tuple(r) for r in pii.found(df, ["id"], "text", own).collect()} == want
    # a list that is itself too long teaches in parts
    monkeypatch.setattr(pii, "MOST_NAMES", 3)
    parts = pii.learn(df, "text", known)
    assert {tuple(r) for r in parts.table.select("name", "name_type").collect()} == {tuple(r) for r in own.table.select("name", "name_type").collect()}
    assert {tuple(r) for r in pii.found(df, ["id"], "text", parts).collect()} == want
    monkeypatch.setattr(pii, "MOST_NAMES", 100)
    empty = pii.learn(df.limit(0), "text", known)
    assert pii.found(df.limit(0), ["id"], "text", empty).count() == 0


# sentences of our own, with what they hold; none shares its wording with the test tables
INDEPENDENT = [
    ("I met Karen Johnson yesterday at the fair.", ["Karen Johnson"]),
    ("My colleague Priya said the lift was out.", ["Priya"]),
    ("Dear Ms. Okafor, your parcel has arrived.", ["Ms. Okafor"]),
    ("Reach me on 0612345678 after six.", ["0612345678"]),
    ("Her mobile is 06 12345678.", ["06 12345678"]),
    ("Please wire it to NL91ABNA0417164300 today.", ["NL91ABNA0417164300"]),
    ("Rekening BE68 5390 0754 7034, dank.", ["BE68 5390 0754 7034"]),
    ("Mijn BSN is 111222333.", ["BSN is 111222333"]),
    ("Tel. 0471 23 45 67 is nu van Piet.", ["0471 23 45 67"]),
    ("ik sprak met Fatima El Amrani over de borg", ["Fatima El Amrani"]),
    ("Groetjes, Sanne", ["Sanne"]),
    ("Mijn broer Joost woont in Leiden.", ["Joost"]),
    ("We sent it to 12 Baker Street, London.", ["12 Baker Street, London"]),
    ("Hij woont op Kerkstraat 14, Utrecht", ["Kerkstraat 14, Utrecht"]),
    ("Write to jan.de.vries+post@example.org please", ["jan.de.vries+post@example.org"]),
    ("a.person (at) example (dot) com works too", ["a.person (at) example (dot) com"]),
    ("National insurance number QQ 12 34 56 C", ["QQ 12 34 56 C"]),
    ("Her SSN is 219-09-9999, or so she says", ["219-09-9999"]),
    ("Call +44 20 7946 0958 before noon.", ["+44 20 7946 0958"]),
    ("Prof. Lindqvist opened the session.", ["Prof. Lindqvist"]),
    ("Yesterday J. Abernathy resigned.", ["J. Abernathy"]),
    ("My neighbour Tom Brandt fixed the fence.", ["Tom Brandt"]),
    ("I never thanked Ingeborg for the soup.", ["Ingeborg"]),
    ("Zijn vrouw Marieke belde gisteren.", ["Marieke"]),
    ("The train from Leiden was late again.", []),
    ("Order 0612345678 was shipped on Monday.", []),
    ("I bought a Samsung phone in Antwerp.", []),
    ("Case 2024-001-778 is closed.", []),
    ("We hope for a mild winter in May.", []),
    ("Meet at platform 12 at 10.45.", []),
    ("IBAN NL92ABNA0417164300 was refused.", []),
    ("The ssn 000-00-0000 is a dummy.", []),
    ("Invoice 20230415 lists 14 items at 19.99.", []),
    ("He reads the New York Times on Sunday.", []),
    ("Version 10.0.19041 of Windows fails.", []),
    ("Ask about the discount in the shop.", []),
    ("Thanks to the crew of flight 714!", []),
    ("Bedankt voor niets, hoor.", []),
]


def test_pii_on_independent_sentences():
    """Precision and recall over what was found anywhere, with a list of names that holds none of them."""
    f = pii.Finder(NAMES)
    hit = said = held = 0
    for text, want in INDEPENDENT:
        got = [text[a:b] for a, b, _ in f.spans(text)]
        hit += sum(any(w in g or g in w for g in got) for w in want)
        said, held = said + len(got), held + len(want)
    print(f"independent sentences: recall {hit}/{held}, precision {hit}/{said}")
    assert hit >= 0.9 * held and hit >= 0.9 * said


def edits(a, b):
    """Least word edits of all of ``a`` within ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(50))) for i in range(6)]
    docs = []
    for d in range(160):
        words = [r.choice(vocab) for _ in range(60)]
        i, src = r.choice(items)
        n = r.choice([0, 12, 16, 22, 26, 32, 45])
        s = r.randrange(0, 51 - n)
        part = src.split()[s : s + n]
        for _ in range(r.choice([0, 1, 2, 3])):
            if len(part) > 8:
                k = r.randrange(3, len(part) - 3)
                what = r.choice("cid")
                part[k : k + (what != "i")] = [] if what == "d" else [r.choice(vocab)]
        at = r.randrange(60)
        docs.append((d, " ".join(words[:at] + [p.upper() if d % 2 else p + "," for p in part] + words[at:])))
    docs += [(900, None), (901, ""), (902, "   "), (903, docs[5][1])]
    got = {tuple(x) for x in leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame([*items, (77, None), (78, "too short")], "eval_id bigint, text string"), "eval_id", "text").collect()}
    must, may = set(), set()
    for d, t in docs:
        w = leaks.words_of(t or "")
        for e, x in items:
            iw = leaks.words_of(x)
            fit = lambda n, k: any(iw[s] in w and iw[s + n - 1] in w and edits(iw[s : s + n], w) <= k for s in range(len(iw) - n + 1))
            if fit(20, 2) or fit(30, 3):
                may.add((d, e))
            if fit(24, 2):
                must.add((d, e))
    assert must <= got <= may and len(got) > 20


def test_spans_are_cut_out(spark):
    item = " ".join(f"held{i}" for i in range(30))
    inside = item.replace("held4 ", "held4, \u200b").replace("held9", "HELD9").replace("held15", "other")
    texts = [(1, f"Before it.\u00a0{inside}. After it."), (2, "nothing here at all"), (3, None), (4, ""), (5, f"{inside} and {item}"), (6, " ".join(item.split()[:12]))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("key", F.lit(1))
    items = spark.createDataFrame([(7, item), (8, "too short")], "eval_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in leaks.without_spans(docs, "text", items, "eval_id", "text").collect()}
    assert got == {1: "Before it.\u00a0 After it.", 2: "nothing here at all", 3: None, 4: "", 5: " and ", 6: texts[5][1]}
    at = [r for r in leaks.find_spans(docs, "doc_id", "text", items, "eval_id", "text").collect() if r["doc_id"] == 1]
    assert [(r["eval_id"], texts[0][1][r["first"] : r["last"]]) for r in at] == [(7, inside + ".")]
    assert {r["doc_id"] for r in leaks.without_leaks(docs, "text", items, "eval_id", "text").collect()} == {2, 3, 4, 6}
    assert leaks.find_spans(docs.limit(0), "doc_id", "text", items, "eval_id", "text").count() == 0


def test_reach_equals_edit_distance():
    r = random.Random(10)
    for _ in range(200):
        a = [r.choice("abcd") for _ in range(12)]
        b = a[:]
        for _ in range(r.randrange(3)):
            b[r.randrange(len(b))] = r.choice("abcdx")
        best = leaks.reach(a, b, 0, 0, 1, 2)
        def dist(p):
            row = list(range(len(b) + 1))
            for i in range(1, p + 1):
                new = [i]
                for j in range(1, len(b) + 1):
                    new.append(min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1))
                row = new
            return row
        for e in range(3):
            ends = [p for p in range(len(a) + 1) if min(dist(p)) <= e]
            assert best[e] <= max(ends)
        assert best[0] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_packing(sizes):
    bins = packing.pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(b and sum(sizes[i] for i in b) <= 100 for b in bins)
    full = [sum(sizes[i] for i in b) for b in bins]
    assert sum(1 for x in full if x <= 50) <= 1


def test_containers(spark):
    docs = [(i, "word " * n) for i, n in enumerate([5, 60, 300, 1000, 30, 30, 99])] + [(50, None), (51, ""), (1, "word " * 60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("doc", F.lit("x"))
    got = packing.containers(df, "doc_id", "text", capacity=100).collect()
    n = {r[0]: r[1] for r in df.where("text <> ''").groupBy("doc_id").agg(F.sum(size_of(F.col("text")))).collect()}
    n_tokens = n.get
    assert sum(r["used"] for r in got) == sum(n.values()) and all(r["used"] <= 100 for r in got)
    placed = [d for r in got for d in r["doc_ids"]]
    assert placed.count(1) == 2 and placed.count(3) >= 10 and 50 not in placed and 51 not in placed
    assert packing.containers(df.limit(0), "doc_id", "text").count() == 0
    one = df.dropDuplicates(["doc_id"])
    r = packing.audit(one, packing.containers(one, "doc_id", "text", capacity=100), "doc_id", "text", capacity=100).first()
    assert r["documents"] == 7 and not any(r[c] for c in ("not_once", "split_in_vain", "over_capacity", "other_size", "empty"))
    # an oversized document can be put together from its stretches
    held = sorted((st, z) for r in packing.containers(one, "doc_id", "text", capacity=100).collect() for d, st, z in zip(r["doc_ids"], r["starts"], r["sizes"]) if d == 3)
    assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) == n_tokens(3)


def paragraph(words, r):
    return " ".join(" ".join(r.choice(words) for _ in range(9)).capitalize() + "." for _ in range(12))


def test_depths_climb_to_the_nearest_peaks():
    s = np.array([0.9, 0.2, 0.3, 0.25, 0.3, 0.1, 0.15])
    assert np.allclose(segments.depths(s), [0, 0.8, 0, 0.1, 0, 0.25, 0])
    # a plateau is crossed, a slope has no far side, and one high peak at the start rules no later depth
    assert np.allclose(segments.depths(np.array([1.0, 0.5, 0.5, 0.4, 0.5, 0.2, 0.3])), [0, 0.5, 0.5, 0.7, 0, 0.4, 0])
    assert len(segments.depths(np.zeros(0))) == 0


def test_unequal_peaks_decide_the_cut():
    """The lowest similarity of the window lies on the slope of a shallow dip; the deepest valley lies elsewhere."""
    s = np.array([0.95, 0.6, 0.9, 0.5, 0.55, 0.3, 0.35])
    d = segments.depths(s)
    assert s.argmin() == 5 and d.argmax() == 1
    running = np.maximum.accumulate(s) + np.maximum.accumulate(s[::-1])[::-1] - 2 * s
    assert running.argmax() == 5  # peaks taken from the whole document would cut at the lowest similarity


def test_cut_at_topic_change():
    r = random.Random(3)
    sea, law = ["harbour", "anchor", "tide", "sailor", "vessel"], ["judge", "court", "verdict", "appeal", "lawyer"]
    parts = [paragraph(sea, r), paragraph(law, r), paragraph(sea, r), paragraph(law, r)]
    text = "\n".join(parts)
    e = encoding(TOKENIZER)
    limit = int(1.5 * len(e.encode_ordinary(parts[0])))
    ends = [z for _, z, _ in segments.cut(text, limit, 10)][:-1]
    borders = [sum(len(p) + 1 for p in parts[: k + 1]) for k in range(3)]
    assert len(ends) == 3 and all(min(abs(z - b) for b in borders) < 200 for z in ends)


@pytest.mark.parametrize("text", ["word " * 3000, "a" * 9000, "é" * 4000, "👩‍🔧" * 1500, "\n" * 5000, "One two three. " * 900, "х" * 5000 + " y" * 2000])
def test_pieces_cover_and_overlap(text):
    e = encoding(TOKENIZER)
    got = segments.cut(text, 400, 64)
    assert got[0][0] == 0 and got[-1][1] == len(text) and len(got) > 1
    for a, z, n in got:
        assert n == len(e.encode_ordinary(text[a:z])) < 400
    for (_, z, _), (a, _, _) in zip(got, got[1:]):
        assert a < z and 55 <= len(e.encode_ordinary(text[a:z])) <= 80


def test_pieces_columns(spark):
    df = spark.createDataFrame([(1, "short text"), (2, None), (3, ""), (4, "Some words here. " * 900)], "doc_id bigint, text string").withColumn("piece", F.lit(9))
    got = segments.pieces(df, "doc_id", "text").collect()
    assert {r["doc_id"] for r in got} == {1, 4} and [r["text"] for r in got if r["doc_id"] == 1] == ["short text"]
    assert {r["doc_id"] for r in segments.oversized(df, "doc_id", "text").where("piece = 1").collect()} == {4}


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_containers", "p8_found", "p9_found"])
def test_queries_run(spark, data, name):
    df = QUERIES[name](spark, data)
    n = df.count()
    assert n > 0 and df.distinct().count() == n
