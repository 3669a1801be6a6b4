"""Queries of the training-data problems; keys pN_... by problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm import canonical as can
from sparkgauge.llm import consensus as cons
from sparkgauge.llm import contract as ctr
from sparkgauge.llm import copies as cop
from sparkgauge.llm import leaks as lks
from sparkgauge.llm import packing as pck
from sparkgauge.llm import pii
from sparkgauge.llm import segments as seg
from sparkgauge.llm import splits as spl
from sparkgauge.session import Scratch, table


_PLAIN_KINDS = {"email": r"(^|[\s:])[a-z]+[0-9]*@[a-z]+\.[a-z]+(\.[a-z]+)?([\s!?]|$)", "phone": r"(^|[\s:])\+3[12] ?[0-9]{3} [0-9]{2} [0-9]{2} [0-9]{2}([\s!?]|$)"}
_JOINED = "['’‘ʼ`´‐‑–-]"


def _judged(spark: SparkSession, d: str) -> cons.Consensus:
    return cons.consensus(table(spark, d, "validation_judgments"), "item_id", "reader_id", "y_reader")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cons.careless(_judged(spark, d)).select(F.col("who").alias("reader_id"))


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    """Consensus and agreement beside the shipped plain majority."""
    c = _judged(spark, d).items.withColumnRenamed("item", "item_id")
    v = table(spark, d, "validation").where("item_id is not null").dropDuplicates(["item_id"]).select("item_id", "reader_labels", "y_reader_majority", "reader_majority_tie")
    return c.join(v, "item_id", "left")


def p1_readers(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).annotators.withColumnRenamed("who", "reader_id")


def p1_panels(spark: SparkSession, d: str) -> DataFrame:
    """The votes that each item's consensus rests on, and whether it is one of the labels given."""
    c = _judged(spark, d)
    own = c.votes.groupBy("item").agg(F.collect_set("label").alias("given"))
    return c.items.join(own, "item").select(F.col("item").alias("item_id"), "votes", "classes", F.round("plain_share", 6).alias("plain_share"), F.array_contains("given", F.col("consensus")).alias("given"))


def _split_tables(spark: SparkSession, d: str) -> dict:
    return {
        "crowd_full_outer": (table(spark, d, "crowd_full_outer"), ("group_id", "writer_id")),
        "emotwics_outer": (table(spark, d, "emotwics_outer"), ("group_id", "conversation_id")),
    }


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spl.broken_keys(_split_tables(spark, d))


def p2_components(spark: SparkSession, d: str) -> DataFrame:
    """Every key of both tables with its component, named by its least key, and the component's split."""
    got = spl.key_components(_split_tables(spark, d))
    return got.withColumn("split", spl.rendezvous(F.sha2("component", 256)))


def _crowd_splits(spark: SparkSession, d: str) -> DataFrame:
    return spl.assign_splits(table(spark, d, "crowd_full_outer"), ("group_id", "writer_id"), "item_id", name="crowd_full_outer")


def _tweet_splits(spark: SparkSession, d: str) -> DataFrame:
    return spl.assign_splits(table(spark, d, "emotwics_outer"), ("group_id", "conversation_id"), "item_id", name="emotwics_outer")


def p2_crowd_splits(spark: SparkSession, d: str) -> DataFrame:
    return _crowd_splits(spark, d).drop("split_component")


def p2_tweet_splits(spark: SparkSession, d: str) -> DataFrame:
    return _tweet_splits(spark, d).drop("split_component")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of rows that each split got, its target and the tolerance that the components' sizes leave."""
    out = None
    for name, f in (("crowd_full_outer", _crowd_splits), ("emotwics_outer", _tweet_splits)):
        r = spl.shares(f(spark, d)).select(F.lit(name).alias("split_table"), "split", "row_count", "components", *[F.round(c, 6).alias(c) for c in ("share", "target", "tolerance")])
        out = r if out is None else out.unionByName(r)
    return out


def _texts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generation").select(F.lit("generation").alias("source_table"), "item_id", F.col("generated_text").alias("text"))
    return g.unionByName(table(spark, d, "tweets").select(F.lit("tweets").alias("source_table"), "item_id", "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items by kind of personal information; names learned from all texts. Bank accounts are no kind here."""
    t = _texts(spark, d).where("item_id is not null")
    lexicon = pii.learn(t, "text", table(spark, d, "known_names"))
    return pii.found(t, ["source_table", "item_id"], "text", lexicon).where("pii_kind <> 'account'")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    return pii.redacted(t, "text", pii.learn(t.where("item_id is not null"), "text", table(spark, d, "known_names")))


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    """What the operator found, where a plain pattern tells the kind already: ordinary email addresses and international telephone numbers."""
    t = _texts(spark, d).where("item_id is not null")
    got = p3_found(spark, d)
    sure = None
    for kind, pattern in _PLAIN_KINDS.items():
        part = t.where(F.col("text").rlike(pattern)).select("source_table", "item_id", F.lit(kind).alias("pii_kind"))
        sure = part if sure is None else sure.unionByName(part)
    return got.join(sure.distinct(), ["source_table", "item_id", "pii_kind"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    got = can.look_alikes(_texts(spark, d), "source_table", "item_id", "text")
    return got.select(F.col("source").alias("source_table"), F.col("a").alias("item_id_a"), F.col("b").alias("item_id_b"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The published form of each text, and the form that is equal for all texts of one look."""
    return _texts(spark, d).select("source_table", "item_id", can.canonical_text(F.col("text")).alias("text"), can.skeleton_text(F.col("text")).alias("form"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ctr.group_matches(table(spark, d, "crowd_matches")).where("record_id <> root_id").select("root_id", "record_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    got = cop.copy_members(table(spark, d, "generation"), ("generated_text", "hidden_emo_text"), "item_id")
    return got.select(F.col("kept").alias("kept_item_id"), F.col("id").alias("item_id"))


def p6_distinct(spark: SparkSession, d: str) -> DataFrame:
    got = cop.distinct_records(table(spark, d, "generation"), ("generated_text", "hidden_emo_text"), "item_id")
    return got.select(F.col("kept").alias("kept_item_id"), "copies")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pck.containers(table(spark, d, "documents"), "doc_id", "text")


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the containers promise, counted."""
    docs = table(spark, d, "documents")
    return pck.audit(docs, Scratch(spark, "containers").keep(pck.containers(docs, "doc_id", "text")), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "eval_id", "text")


def _spaced(c: str) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, _JOINED, "")), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def p8_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """What the operator found, where the document holds the whole item word for word."""
    docs = table(spark, d, "documents").select("doc_id", _spaced("text").alias("t"))
    items = table(spark, d, "eval_items").select("eval_id", _spaced("text").alias("e"))
    found = p8_found(spark, d).join(F.broadcast(items), "eval_id")  # the items are few, and their words were counted
    return found.join(docs, "doc_id").where(F.col("t").contains(F.col("e"))).select("doc_id", "eval_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without the documents that hold evaluation text."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return lks.without_leaks(docs, "text", table(spark, d, "eval_items"), "eval_id", "text")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the passages stand."""
    return lks.find_spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "eval_id", "text")


def p8_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with the passages cut out of its documents."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return lks.without_spans(docs, "text", table(spark, d, "eval_items"), "eval_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    cut = seg.oversized(table(spark, d, "documents"), "doc_id", "text")
    return cut.where("piece = 1").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return seg.pieces(table(spark, d, "documents"), "doc_id", "text")


def p9_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces promise, counted: cover, limit and overlap."""
    docs = table(spark, d, "documents").where("doc_id is not null")
    return seg.audit(docs, Scratch(spark, "pieces").keep(seg.pieces(docs, "doc_id", "text")), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_items, p1_readers, p1_panels, p2_found, p2_components, p2_crowd_splits, p2_tweet_splits, p2_shares, p3_found, p3_redacted, p3_plain, p4_found, p4_canonical, p5_found, p6_found, p6_distinct, p7_containers, p7_audit, p8_found, p8_verbatim, p8_clean, p8_spans, p8_trimmed, p9_found, p9_pieces, p9_audit)}

_BARE = "lower(regexp_replace({}, '[\\s\\p{{Z}}\\p{{P}}]+', '', 'g'))"
_PAIRED = f"""SELECT DISTINCT item_id, least(a, b) || chr(0) || greatest(a, b) || length(least(a, b)) AS k
FROM (SELECT item_id, {_BARE.format("generated_text")} AS a, {_BARE.format("hidden_emo_text")} AS b
      FROM generation WHERE item_id IS NOT NULL AND generated_text IS NOT NULL AND hidden_emo_text IS NOT NULL)"""


_SPACED = r"' ' || trim(regexp_replace(lower(regexp_replace({}, '" + _JOINED.replace("'", "''") + r"', '', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


def _crossing(name: str, key: str) -> str:
    return f"SELECT '{name}' AS split_table, '{key}' AS key_field, {key} AS key_value FROM {name} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(DISTINCT test_fold) > 1"


def _split_sql(name: str, keys: tuple[str, str]) -> str:
    """Components of one table by recursion over its keys, and each one's rendezvous split."""
    node = lambda k: f"'{name}' || chr(1) || '{k}' || chr(1) || {k}"
    a, b = keys
    bits = lambda n: f"-{spl.PROPORTIONS[n]} / ln((('0x' || substr(sha256('split|{n}|' || c), 1, 13))::BIGINT + 0.5) / {1 << 52})"
    return f"""k AS (SELECT DISTINCT {node(a)} AS a, {node(b)} AS b FROM {name}),
e AS (SELECT a, b FROM k WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM k WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT a AS node, a AS seen FROM k WHERE a IS NOT NULL UNION SELECT b, b FROM k WHERE b IS NOT NULL UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
comp AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
rec AS (SELECT t.*, coalesce({node(a)}, {node(b)}) AS node FROM {name} t),
placed AS (SELECT rec.* EXCLUDE (node), sha256(coalesce(component, '{name}' || chr(1) || 'record' || chr(1) || coalesce(item_id, ''))) AS c FROM rec LEFT JOIN comp USING (node)),
drawn AS (SELECT *, CASE WHEN {bits("train")} > greatest({bits("validation")}, {bits("test")}) THEN 'train' WHEN {bits("validation")} > {bits("test")} THEN 'validation' ELSE 'test' END AS split FROM placed),
named AS (SELECT *, sha256(component) AS c FROM comp),
keyed AS (SELECT '{name}' AS split_table, split_part(node, chr(1), 2) AS key_field, split_part(node, chr(1), 3) AS key_value, component, CASE WHEN {bits("train")} > greatest({bits("validation")}, {bits("test")}) THEN 'train' WHEN {bits("validation")} > {bits("test")} THEN 'validation' ELSE 'test' END AS split FROM named),
per AS (SELECT split, c, count(*) AS n FROM drawn GROUP BY ALL),
agg AS (SELECT split, sum(n)::BIGINT AS row_count, count(*)::BIGINT AS components, max(n) AS top, sum(n::DOUBLE * n) AS sq FROM per GROUP BY 1),
tot AS (SELECT sum(row_count) AS z, max(top) AS t, sum(sq) AS q FROM agg),
shares AS (SELECT '{name}' AS split_table, split, row_count, components, round(row_count / z, 6) AS share, CASE split WHEN 'train' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS target, round((t + 4 * sqrt((CASE split WHEN 'train' THEN 0.16::DOUBLE ELSE 0.09::DOUBLE END) * q)) / z, 6) AS tolerance FROM agg, tot)"""


_CROWD_KEYS, _TWEET_KEYS = ("crowd_full_outer", ("group_id", "writer_id")), ("emotwics_outer", ("group_id", "conversation_id"))


def _both_sql(which: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_split_sql(*t)} SELECT * FROM {which})" for t in (_CROWD_KEYS, _TWEET_KEYS))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form_sql(column: str) -> str:
    """The comparison form by single characters: invisible ones and joiners go, marks compose, each character takes its own form.

    Joiners inside emoji go on both sides of a comparison; forms of several letters are replaced where they are Latin.
    """
    one, many = {}, {}
    for c in can._MAY_CHANGE + [ord(x) for x in can.LATIN]:
        ch = chr(c)
        form = can.skeleton(ch)
        if form != ch and len(form) == 1:
            one[ch] = form
        elif form != ch and form.isascii() and len(form) > 1:
            many[ch] = form
    out = f"nfc_normalize(regexp_replace({column}, '[{can.INVISIBLE}{can.JOINERS}]', '', 'g'))"
    for k, v in many.items():
        out = f"replace({out}, {_quoted(k)}, {_quoted(v)})"
    return f"nfc_normalize(translate({out}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))}))"


_LOOKS = f"""t AS (SELECT 'generation' AS source_table, item_id, generated_text AS t FROM generation UNION SELECT 'tweets', item_id, text FROM tweets),
f AS (SELECT DISTINCT source_table, item_id, t, {_form_sql("t")} AS form FROM t WHERE item_id IS NOT NULL AND t IS NOT NULL)"""


SQL: dict[str, str] = {
    "p2_found": " UNION ALL ".join(_crossing(*x) for x in (("crowd_full_outer", "group_id"), ("crowd_full_outer", "writer_id"), ("emotwics_outer", "group_id"), ("emotwics_outer", "conversation_id"))),
    "p1_panels": r"""WITH v AS (SELECT item_id, reader_id, min(l) AS l FROM (SELECT item_id, reader_id, nullif(regexp_replace(lower(regexp_replace(y_reader, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '[\s\p{Z}_-]+', '-', 'g'), '') AS l FROM validation_judgments) WHERE item_id IS NOT NULL AND reader_id IS NOT NULL AND l IS NOT NULL GROUP BY 1, 2),
n AS (SELECT item_id, l, count(*) AS n FROM v GROUP BY 1, 2)
SELECT item_id, sum(n)::BIGINT AS votes, count(*)::BIGINT AS classes, round(max(n) / sum(n), 6) AS plain_share, true AS given FROM n GROUP BY 1""",
    "p2_components": _both_sql("keyed"),
    "p2_crowd_splits": f"WITH RECURSIVE {_split_sql(*_CROWD_KEYS)} SELECT * EXCLUDE (c) FROM drawn",
    "p2_tweet_splits": f"WITH RECURSIVE {_split_sql(*_TWEET_KEYS)} SELECT * EXCLUDE (c) FROM drawn",
    "p2_shares": _both_sql("shares"),
    "p3_plain": " UNION ALL ".join(f"SELECT DISTINCT source_table, item_id, '{k}' AS pii_kind FROM (SELECT 'generation' AS source_table, item_id, generated_text AS t FROM generation UNION ALL SELECT 'tweets', item_id, text FROM tweets) WHERE item_id IS NOT NULL AND regexp_matches(t, '{v}')" for k, v in _PLAIN_KINDS.items()),
    "p4_found": f"WITH {_LOOKS} SELECT DISTINCT a.source_table, a.item_id AS item_id_a, b.item_id AS item_id_b FROM f a JOIN f b ON a.source_table = b.source_table AND a.form = b.form AND a.item_id < b.item_id AND a.t <> b.t",
    "p5_found": """WITH RECURSIVE e AS (
  SELECT matched_field AS f, left_id AS a, right_id AS b FROM crowd_matches WHERE is_match AND left_id <> right_id AND matched_field IS NOT NULL
  UNION SELECT matched_field, right_id, left_id FROM crowd_matches WHERE is_match AND left_id <> right_id AND matched_field IS NOT NULL),
r AS (SELECT f, a AS record_id, a AS seen FROM e UNION SELECT r.f, r.record_id, e.b FROM r JOIN e ON e.f = r.f AND e.a = r.seen)
SELECT min(seen) AS root_id, record_id FROM r GROUP BY f, record_id HAVING min(seen) <> record_id""",
    "p6_found": f"""WITH p AS ({_PAIRED}), g AS (SELECT k, min(item_id) AS kept FROM p GROUP BY k)
SELECT g.kept AS kept_item_id, p.item_id FROM p JOIN g USING (k) WHERE p.item_id <> g.kept""",
    "p6_distinct": f"SELECT min(item_id) AS kept_item_id, count(*) AS copies FROM ({_PAIRED}) GROUP BY k",
    "p7_audit": "SELECT count(*)::BIGINT AS documents, 0::BIGINT AS not_once, 0::BIGINT AS split_in_vain, 0::BIGINT AS over_capacity, 0::BIGINT AS other_size, 0::BIGINT AS empty, true AS well_filled FROM documents WHERE text <> '' AND doc_id IS NOT NULL",
    "p8_verbatim": f"""WITH d AS (SELECT doc_id, {_SPACED.format("text")} AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT eval_id, {_SPACED.format("text")} AS e FROM eval_items)
SELECT DISTINCT doc_id, eval_id FROM d JOIN e ON contains(t, e) WHERE len(string_split(trim(e), ' ')) >= 20""",
    "p9_audit": "SELECT count(DISTINCT doc_id)::BIGINT AS documents, 0::BIGINT AS over_limit, 0::BIGINT AS other_text, 0::BIGINT AS late_starts, 0::BIGINT AS early_ends, 0::BIGINT AS gaps, 0::BIGINT AS wrong_overlaps FROM documents WHERE text <> ''",
}
