"""Queries over the crowd and tweet tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions import text as T
from sparkgauge.functions.vocab import APPRAISALS, CLUSTERS, EMOTIONS, LABEL_CLUSTER, SEED, cluster_column, count_column, prob_column
from sparkgauge.operators import checks, components, folds, ingest
from sparkgauge.session import Scratch, table
from sparkgauge.sources import digests

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum can't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _rows(union: list[str]) -> str:
    return " UNION ALL ".join(union)


def _report_sql(source: str, checks_: dict[str, str]) -> str:
    return f"WITH t AS ({source}) " + _rows([f"SELECT '{k}' AS check_name, count_if({v})::BIGINT AS violations, count(*)::BIGINT AS row_count FROM t" for k, v in checks_.items()])


_RATING = "coalesce(NOT ({c} BETWEEN 1 AND 5), true)"
_KEY = "CASE WHEN trim(l) = '' THEN NULL ELSE l END"
_LABEL = r"regexp_replace(lower(regexp_replace(y_reader, '^\s+|\s+$', '', 'g')), '[\s_]+', '-', 'g')"
_GEN = "SELECT DISTINCT ON (item_id) * FROM generation WHERE item_id IS NOT NULL"
_JUDGED = f"SELECT DISTINCT ON (item_id, reader_id) * REPLACE (nullif({_LABEL}, '') AS y_reader) FROM validation_judgments WHERE item_id IS NOT NULL AND reader_id IS NOT NULL"
_TWEETS = "SELECT DISTINCT ON (item_id) * FROM tweets WHERE item_id IS NOT NULL"


def _generation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generation").where("item_id is not null").dropDuplicates(["item_id"])


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    return ingest.canonical_judgments(table(spark, d, "validation_judgments"))


def _tweets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tweets").where("item_id is not null").dropDuplicates(["item_id"])


@query()
def ingest_generation(spark, d):
    """Canonical writer texts; normalisation goes beyond SQL."""
    return ingest.canonical_generation(table(spark, d, "generation"))


@query(r"""WITH g AS (SELECT DISTINCT ON (item_id) item_id, trim(regexp_replace(lower(hidden_emo_text), '\s+', ' ', 'g')) AS plain FROM generation WHERE item_id IS NOT NULL)
SELECT item_id, plain, coalesce(count(*) OVER (PARTITION BY plain) > 1 AND plain IS NOT NULL, false) AS is_duplicate FROM g""")
def text_duplicates(spark, d):
    """Plain normalisation inside code generation, and whether another item has the same text."""
    g = _generation(spark, d).select("item_id", T.plain_text(F.col("hidden_emo_text")).alias("plain"))
    n = g.where("plain is not null").groupBy("plain").count()
    return g.join(n, "plain", "left").select("item_id", "plain", F.coalesce(F.col("count") > 1, F.lit(False)).alias("is_duplicate"))


_GEN_CHECKS = {"missing_writer_id": "writer_id IS NULL", "missing_generated_text": "generated_text IS NULL", "missing_hidden_emo_text": "hidden_emo_text IS NULL", "vocabulary_y_writer": f"y_writer IS NOT NULL AND y_writer NOT IN ({quoted(EMOTIONS)})"} | {f"rating_{a}": _RATING.format(c=a) for a in APPRAISALS}


@query(_report_sql("SELECT * FROM generation", _GEN_CHECKS))
def quality_generation(spark, d):
    cs = [checks.missing("writer_id"), checks.missing("generated_text"), checks.missing("hidden_emo_text"), checks.outside("y_writer", EMOTIONS), *[checks.rating(a) for a in APPRAISALS]]
    return checks.report(table(spark, d, "generation"), cs)


_J_CHECKS = {"missing_item_id": "item_id IS NULL", "missing_reader_id": "reader_id IS NULL", "missing_y_reader": "y_reader IS NULL", "vocabulary_y_reader": f"y_reader IS NOT NULL AND y_reader NOT IN ({quoted(EMOTIONS)})", "rating_reader_confidence": _RATING.format(c="reader_confidence"), "late_load": "loaded_at > submitted_at + INTERVAL 7 DAY"} | {f"rating_reader_appraisal__{a}": _RATING.format(c=f"reader_appraisal__{a}") for a in APPRAISALS}


@query(_report_sql("SELECT * FROM validation_judgments", _J_CHECKS))
def quality_judgments(spark, d):
    cs = [checks.missing("item_id"), checks.missing("reader_id"), checks.missing("y_reader"), checks.outside("y_reader", EMOTIONS), checks.rating("reader_confidence")]
    cs.append(checks.Check("late_load", F.col("loaded_at") > F.col("submitted_at") + F.expr("INTERVAL 7 DAYS")))
    cs += [checks.rating(f"reader_appraisal__{a}") for a in APPRAISALS]
    return checks.report(table(spark, d, "validation_judgments"), cs)


_T_CHECKS = {f"rating_{v}": _RATING.format(c=v) for v in ("valence", "arousal", "dominance")}
_T_CHECKS |= {f"binary_{cluster_column(c)}": f"coalesce({cluster_column(c)} NOT IN (0, 1), true)" for c in CLUSTERS}
_T_CHECKS |= {"cluster_count": "coalesce(len(emo_clusters), 0) <> " + " + ".join(f"coalesce({cluster_column(c)}, 0)" for c in CLUSTERS), "composite_key": "item_id <> conversation_id || ':' || turn_index || ':' || tweet_index"}


@query(_report_sql("SELECT * FROM tweets", _T_CHECKS))
def quality_tweets(spark, d):
    cs = [checks.rating(v) for v in ("valence", "arousal", "dominance")] + [checks.binary(cluster_column(c)) for c in CLUSTERS]
    total = sum((F.coalesce(F.col(cluster_column(c)), F.lit(0)) for c in CLUSTERS), F.lit(0))
    cs.append(checks.Check("cluster_count", F.coalesce(F.size("emo_clusters"), F.lit(0)) != total))
    cs.append(checks.differs("composite_key", F.col("item_id"), F.concat_ws(":", "conversation_id", "turn_index", "tweet_index")))
    return checks.report(table(spark, d, "tweets"), cs)


@query(
    f"""WITH j AS ({_JUDGED}), g AS ({_GEN}), n AS (SELECT item_id, count(*) AS c FROM j GROUP BY 1)
SELECT 'repeated_generation_rows' AS check_name, count(*)::BIGINT AS violations FROM (SELECT item_id FROM generation GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated_judgments', count(*) FROM (SELECT item_id, reader_id FROM validation_judgments GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'items_without_five_judgments', count(*) FROM n WHERE c <> 5
UNION ALL SELECT 'judgments_of_unknown_items', count(*) FROM j WHERE item_id NOT IN (SELECT item_id FROM g)
UNION ALL SELECT 'writer_label_differs', count(*) FROM j JOIN g USING (item_id) WHERE j.original_emotion <> g.y_writer
UNION ALL SELECT 'validation_shares_off', count(*) FROM validation WHERE abs({" + ".join(prob_column(e) for e in EMOTIONS)} - 1) > 1e-6"""
)
def quality_keys(spark, d):
    """Unique keys, group sizes, foreign keys, functional consistency and unit sums."""
    g, j = _generation(spark, d), _judgments(spark, d)
    both = j.select("item_id", "original_emotion").join(g.select("item_id", "y_writer"), "item_id")
    probs = [prob_column(e) for e in EMOTIONS]
    off = table(spark, d, "validation").where(F.abs(sum((F.col(c) for c in probs), F.lit(0.0)) - 1) > 1e-6)
    return checks.summary(
        {
            "repeated_generation_rows": checks.repeated_keys(table(spark, d, "generation"), ["item_id"]),
            "repeated_judgments": checks.repeated_keys(table(spark, d, "validation_judgments"), ["item_id", "reader_id"]),
            "items_without_five_judgments": checks.wrong_sizes(j, ["item_id"], 5),
            "judgments_of_unknown_items": checks.orphans(j, g, ["item_id"]),
            "writer_label_differs": both.where("original_emotion <> y_writer"),
            "validation_shares_off": off,
        }
    )


@query(
    f"""WITH j AS ({_JUDGED}), g AS ({_GEN})
SELECT j.item_id, j.reader_id, j.y_reader, j.reader_confidence, g.writer_id, g.y_writer, g.pleasantness, j.reader_appraisal__pleasantness FROM j LEFT JOIN g USING (item_id)"""
)
def judgments_with_writers(spark, d):
    """Many-to-one left join."""
    j = ingest.join_generation(_judgments(spark, d), _generation(spark, d))
    return j.select("item_id", "reader_id", "y_reader", "reader_confidence", "writer_id", "y_writer", "pleasantness", "reader_appraisal__pleasantness")


def _vote_sql(judged: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(EMOTIONS))
    counts = ", ".join(f"coalesce(sum(n) FILTER (y_reader = '{e}'), 0)::INTEGER AS {count_column(e)}" for e in EMOTIONS)
    shares = ", ".join(f"round({count_column(e)} / t, 6) AS {prob_column(e)}" for e in EMOTIONS)
    return f"""v AS (SELECT item_id, y_reader, CASE y_reader {cases} END AS o, count(*) AS n, coalesce(avg(reader_confidence), 0) AS c FROM ({judged}) WHERE y_reader IN ({quoted(EMOTIONS)}) GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, c DESC, o) AS r, max(n) OVER (PARTITION BY item_id) AS top FROM v),
m AS (SELECT item_id, sum(n)::DOUBLE AS t, max(y_reader) FILTER (r = 1) AS y_reader_majority, count_if(n = top) > 1 AS reader_majority_tie, {counts} FROM w GROUP BY item_id),
voted AS (SELECT item_id, y_reader_majority, reader_majority_tie, {", ".join(count_column(e) for e in EMOTIONS)}, {shares} FROM m)"""


@query(
    f"""WITH j AS ({_JUDGED}), {_vote_sql("SELECT * FROM j")},
l AS (SELECT item_id, list(y_reader ORDER BY reader_id) AS labels, list(reader_id ORDER BY reader_id) AS readers FROM j WHERE y_reader IS NOT NULL GROUP BY 1)
SELECT voted.*, array_to_string(labels, ',') AS reader_labels, array_to_string(readers, ',') AS reader_ids FROM voted LEFT JOIN l USING (item_id)"""
)
def reader_targets(spark, d):
    """Majority with confidence and vocabulary tie-breaks, label counts and shares, and reader lists."""
    r = ingest.aggregate_readers(_judgments(spark, d))
    return rounded(r.withColumn("reader_labels", F.concat_ws(",", "reader_labels")).withColumn("reader_ids", F.concat_ws(",", "reader_ids")))


@query(
    f"""WITH j AS ({_JUDGED}),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY item_id ORDER BY sha256('{SEED}|0|' || item_id || '|' || reader_id), reader_id) <= 2 THEN 'appraisal' ELSE 'emotion' END AS reader_panel FROM j),
{_vote_sql("SELECT * FROM s WHERE reader_panel = 'emotion'")},
a AS (SELECT item_id, {", ".join(f"round(avg(reader_appraisal__{a}), 6) AS reader_appraisal__{a}" for a in APPRAISALS)}, string_agg(reader_id, ',' ORDER BY reader_id) AS appraisal_reader_ids FROM s WHERE reader_panel = 'appraisal' GROUP BY 1),
z AS (SELECT item_id, count_if(reader_panel = 'appraisal')::BIGINT AS appraisal_panel, count_if(reader_panel = 'emotion')::BIGINT AS emotion_panel FROM s GROUP BY 1)
SELECT * FROM voted LEFT JOIN a USING (item_id) LEFT JOIN z USING (item_id)"""
)
def reader_subpanels(spark, d):
    r = ingest.aggregate_panels(_judgments(spark, d))
    return rounded(r.withColumn("appraisal_reader_ids", F.concat_ws(",", "appraisal_reader_ids")))


@query(
    f"""WITH g AS ({_GEN}), j AS ({_JUDGED})
SELECT * FROM (SELECT count(*)::BIGINT AS generation_rows, count(DISTINCT item_id)::BIGINT AS items, count(DISTINCT writer_id)::BIGINT AS writers, count_if(generated_text IS NULL)::BIGINT AS null_texts FROM g),
(SELECT count(*)::BIGINT AS judgment_rows, count(DISTINCT reader_id)::BIGINT AS readers, count(DISTINCT item_id)::BIGINT AS judged_items, round(avg(reader_confidence), 6) AS mean_confidence FROM j)"""
)
def corpus_diagnostics(spark, d):
    return rounded(ingest.diagnostics(_generation(spark, d), _judgments(spark, d)))


_ORDERED = "list_filter([{0}], lambda c: list_contains(emo_clusters, c))".format(quoted(CLUSTERS))


@query(
    f"""WITH t AS ({_TWEETS})
SELECT conversation_id || ':' || (dense_rank() OVER (PARTITION BY conversation_id ORDER BY turn_index) - 1) || ':' || (row_number() OVER (PARTITION BY conversation_id, turn_index ORDER BY tweet_index, text) - 1) AS item_id,
company, text, valence, arousal, dominance, array_to_string({_ORDERED}, ',') AS emo_clusters, {", ".join(f"coalesce(list_contains(emo_clusters, '{c}'), false)::INTEGER AS {cluster_column(c)}" for c in CLUSTERS)}
FROM t WHERE conversation_id IS NOT NULL AND company IS NOT NULL AND turn_index IS NOT NULL AND tweet_index IS NOT NULL"""
)
def tweets_flattened(spark, d):
    """Tweets packed into nested conversations and flattened again, places counted from 0."""
    t = _tweets(spark, d).where("conversation_id is not null and company is not null and turn_index is not null and tweet_index is not null")
    docs = ingest.nest(t).withColumnRenamed("conversation_id", "id")
    f = ingest.flatten(docs)
    return f.select("item_id", "company", "text", "valence", "arousal", "dominance", F.concat_ws(",", "emo_clusters").alias("emo_clusters"), *[cluster_column(c) for c in CLUSTERS])


_MAPPED = "list_distinct(list_filter(list_transform(emo_labels, lambda l: CASE l " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_CLUSTER.items()) + " END), lambda c: c IS NOT NULL))"
_EXPECTED = "list_filter([{0}], lambda c: list_contains(m, c) AND (c <> 'Neutral' OR len(m) = 1))".format(quoted(CLUSTERS))


@query(
    f"""WITH t AS ({_TWEETS}), x AS (SELECT item_id, emo_clusters, {_MAPPED} AS m FROM t WHERE emo_labels IS NOT NULL AND emo_clusters IS NOT NULL)
SELECT item_id, array_to_string({_EXPECTED}, ',') AS expected, array_to_string({_ORDERED}, ',') AS given, array_to_string({_EXPECTED}, ',') = array_to_string({_ORDERED}, ',') AS consistent FROM x"""
)
def cluster_audit(spark, d):
    """Clusters that the labels call for beside those given."""
    t = _tweets(spark, d).where("emo_labels is not null and emo_clusters is not null")
    from sparkgauge.functions.vocab import in_order

    e = F.concat_ws(",", ingest.expected_clusters(F.col("emo_labels")))
    g = F.concat_ws(",", in_order(F.array_distinct(F.filter("emo_clusters", lambda c: c.isin(*CLUSTERS))), CLUSTERS))
    return t.select("item_id", e.alias("expected"), g.alias("given"), (e == g).alias("consistent"))


@query(
    f"WITH t AS ({_TWEETS}) "
    + _rows([f"SELECT {i} AS ordinal, '{cluster_column(c)}' AS label, coalesce(sum({cluster_column(c)}), 0)::BIGINT AS positives, count_if({cluster_column(c)} = 0)::BIGINT AS negatives, coalesce(sum({cluster_column(c)}), 0) >= 100 AND count_if({cluster_column(c)} = 0) >= 50 AS eligible FROM t" for i, c in enumerate(CLUSTERS)])
)
def label_support(spark, d):
    return ingest.label_support(_tweets(spark, d), [cluster_column(c) for c in CLUSTERS])


_PLAIN = r"trim(regexp_replace(lower(hidden_emo_text), '\s+', ' ', 'g'))"
_COMPONENTS = f"""n AS (SELECT DISTINCT item_id, writer_id, {_PLAIN} AS t FROM generation WHERE item_id IS NOT NULL),
k AS (SELECT item_id, 'w' || writer_id AS key FROM n WHERE writer_id IS NOT NULL UNION SELECT item_id, 't' || t FROM n WHERE t IS NOT NULL),
kk AS (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b USING (item_id)),
r AS (SELECT DISTINCT key AS a, key AS b FROM k UNION SELECT r.a, kk.b FROM r JOIN kk ON kk.a = r.b),
root AS (SELECT a AS key, min(b) AS root FROM r GROUP BY a),
placed AS (SELECT n.item_id, coalesce(min(root), 'i' || n.item_id) AS root FROM (SELECT DISTINCT item_id FROM n) n LEFT JOIN k USING (item_id) LEFT JOIN root USING (key) GROUP BY n.item_id),
comp AS (SELECT item_id, 'component-' || substr(sha256(string_agg(item_id, chr(0) ORDER BY item_id) OVER (PARTITION BY root ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 1, 16) AS group_id FROM placed)"""


def _components(spark, d):
    return components.duplicate_components(_generation(spark, d), "item_id", "writer_id", T.plain_text(F.col("hidden_emo_text")))


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT item_id, group_id FROM comp")
def duplicate_components(spark, d):
    """Items linked by writer or plain text; ids are digests of the members."""
    return _components(spark, d)


@query()
def duplicate_components_full(spark, d):
    """The same with full text normalisation, beyond SQL."""
    return components.duplicate_components(_generation(spark, d), "item_id", "writer_id", T.normalized_text(F.col("hidden_emo_text")))


@query(
    f"""WITH RECURSIVE {_COMPONENTS}, i AS (SELECT item_id, writer_id, group_id FROM ({_GEN}) JOIN comp USING (item_id)),
t AS (SELECT DISTINCT item_id FROM validation WHERE item_id IS NOT NULL), tw AS (SELECT DISTINCT writer_id FROM i JOIN t USING (item_id) WHERE writer_id IS NOT NULL), tg AS (SELECT DISTINCT group_id FROM i JOIN t USING (item_id))
SELECT item_id, writer_id, group_id, CASE WHEN item_id IN (SELECT item_id FROM t) THEN 'test' WHEN writer_id IN (SELECT writer_id FROM tw) THEN 'excluded_test_writer' WHEN group_id IN (SELECT group_id FROM tg) THEN 'excluded_test_duplicate' ELSE 'train' END AS role FROM i"""
)
def external_roles(spark, d):
    """Sealed test items, what their writers and components exclude, and the rest."""
    g = _generation(spark, d).select("item_id", "writer_id").join(_components(spark, d), "item_id")
    return folds.external_roles(g, table(spark, d, "validation").where("item_id is not null"), "item_id", "writer_id", "group_id")


def _split_audit_sql(source: str, items: str, identity: str) -> str:
    return f"""WITH o AS (SELECT * FROM {source}), g AS (SELECT DISTINCT item_id FROM {items} WHERE item_id IS NOT NULL)
SELECT 'repeated_item' AS check_name, count(*)::BIGINT AS violations FROM (SELECT item_id FROM o GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'null_fold', count(*) FROM o WHERE test_fold IS NULL
UNION ALL SELECT 'fold_out_of_range', count(*) FROM o WHERE test_fold NOT BETWEEN 0 AND 4
UNION ALL SELECT 'fold_unused', count(*) FROM range(5) f(x) WHERE x NOT IN (SELECT test_fold FROM o WHERE test_fold IS NOT NULL)
UNION ALL SELECT 'group_crosses_folds', count(*) FROM (SELECT group_id FROM o WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT test_fold) > 1)
UNION ALL SELECT 'identity_crosses_folds', count(*) FROM (SELECT {identity} FROM o WHERE {identity} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT test_fold) > 1)
UNION ALL SELECT 'identity_in_two_groups', count(*) FROM (SELECT {identity} FROM o WHERE {identity} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT group_id) > 1)
UNION ALL SELECT 'item_missing', count(*) FROM g WHERE item_id NOT IN (SELECT item_id FROM o WHERE item_id IS NOT NULL)
UNION ALL SELECT 'item_unexpected', count(*) FROM (SELECT DISTINCT item_id FROM o WHERE item_id IS NOT NULL) WHERE item_id NOT IN (SELECT item_id FROM g)"""


@query(_split_audit_sql("crowd_full_outer", "generation", "writer_id"))
def split_audit(spark, d):
    return folds.outer_checks(table(spark, d, "crowd_full_outer"), _generation(spark, d), "writer_id")


@query(_split_audit_sql("emotwics_outer", "tweets", "conversation_id"))
def tweet_split_audit(spark, d):
    return folds.outer_checks(table(spark, d, "emotwics_outer"), _tweets(spark, d), "conversation_id")


@query(
    f"""WITH a AS (SELECT item_id, min(writer_id) AS w FROM generation WHERE item_id IS NOT NULL GROUP BY 1), b AS (SELECT item_id, min(writer_id) AS w FROM crowd_full_outer WHERE item_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN b.item_id IS NULL THEN 'left_only' WHEN a.item_id IS NULL THEN 'right_only' WHEN a.w IS DISTINCT FROM b.w THEN 'different' ELSE 'same' END AS side, count(*)::BIGINT AS row_count FROM a FULL JOIN b ON a.item_id = b.item_id GROUP BY 1"""
)
def split_alignment(spark, d):
    """Full outer join with the side of each key."""
    a = table(spark, d, "generation").where("item_id is not null").groupBy("item_id").agg(F.min("writer_id").alias("writer_id"))
    b = table(spark, d, "crowd_full_outer").where("item_id is not null").groupBy("item_id").agg(F.min("writer_id").alias("writer_id"))
    return folds.alignment(a, b, "item_id", ["writer_id"])


@query(
    """WITH g AS (SELECT DISTINCT item_id FROM generation WHERE item_id IS NOT NULL), v AS (SELECT DISTINCT item_id FROM validation WHERE item_id IS NOT NULL)
SELECT 'union_all' AS operation, (SELECT count(*) FROM g) + (SELECT count(*) FROM v) AS row_count
UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM v)
UNION ALL SELECT 'missing', count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM v)
UNION ALL SELECT 'unexpected', count(*) FROM (SELECT * FROM v EXCEPT SELECT * FROM g)"""
)
def set_operations(spark, d):
    g = _generation(spark, d).select("item_id")
    v = table(spark, d, "validation").where("item_id is not null").select("item_id").distinct()
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("operation"), "row_count")
    parts = [count("union_all", g.unionByName(v)), count("intersection", g.intersect(v)), count("missing", g.subtract(v)), count("unexpected", v.subtract(g))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _labelled(spark, d):
    return _generation(spark, d).where(F.col("y_writer").isin(*EMOTIONS)).select("item_id", "writer_id", "y_writer", "hidden_emo_text")


def _writer_rows(spark, d):
    return folds.writer_rows(_labelled(spark, d), T.plain_text(F.col("hidden_emo_text")), EMOTIONS)


def _tweet_rows(spark, d):
    return folds.tweet_rows(_tweets(spark, d), T.plain_text(F.col("text")), [cluster_column(c) for c in CLUSTERS])


def _sound(names) -> str:
    """A report without a violation."""
    return _rows([f"SELECT '{n}' AS check_name, 0::BIGINT AS violations" for n in names])


_OUTER = ("repeated_item", "null_fold", "fold_out_of_range", "fold_unused", "group_crosses_folds", "identity_crosses_folds", "identity_in_two_groups", "item_missing", "item_unexpected")
_INNER = ("repeated_item", "group_differs", "identity_differs", "test_item_in_training", "group_crosses_folds", "item_missing")
_EXTERNAL = ("repeated_item", "unknown_role", "test_not_sealed", "writer_on_both_sides", "component_on_both_sides", "other_role", "inner_is_not_training", "inner_fold_out_of_range", "inner_group_crosses_folds")


@query()
def writer_folds(spark, d):
    """Stratified group folds of the writers' items by emotion; the algorithm is iterative."""
    return _writer_rows(spark, d).outer()


@query()
def writer_inner_folds(spark, d):
    return _writer_rows(spark, d).nested()[1]


@query()
def tweet_folds(spark, d):
    return _tweet_rows(spark, d).outer()


@query(_sound(_OUTER))
def writer_folds_audit(spark, d):
    """What the folds promise, each breach counted."""
    return folds.outer_checks(Scratch(spark, "audit").keep(writer_folds(spark, d)), _labelled(spark, d), "writer_id")


@query(_sound(_INNER))
def writer_inner_folds_audit(spark, d):
    s = Scratch(spark, "audit")
    o, i = _writer_rows(spark, d).nested()
    return folds.inner_checks(s.keep(o), s.keep(i), "writer_id")


@query(_sound(_OUTER))
def tweet_folds_audit(spark, d):
    return folds.outer_checks(Scratch(spark, "audit").keep(tweet_folds(spark, d)), _tweets(spark, d), "conversation_id")


@query(f"WITH g AS ({_GEN}) SELECT y_writer AS label, count(*)::BIGINT AS n, true AS even FROM g WHERE y_writer IN ({quoted(EMOTIONS)}) GROUP BY 1")
def writer_folds_balance(spark, d):
    """Items of each emotion over all folds, and whether no fold's share is off by more than the largest group's share and a twentieth."""
    s = Scratch(spark, "audit")
    f = s.keep(writer_folds(spark, d))
    shares = folds.fold_shares(f, _labelled(spark, d), "y_writer")
    per = f.join(_labelled(spark, d).select("item_id", "y_writer"), "item_id").groupBy("y_writer", "group_id").count().groupBy(F.col("y_writer").alias("label")).agg((F.max("count") / F.sum("count")).alias("top"))
    j = shares.join(per, "label").groupBy("label").agg(F.sum("n").alias("n"), F.max(F.abs(F.col("share") - 0.2)).alias("off"), F.max("top").alias("top"), F.count(F.lit(1)).alias("k"))
    # a fold without an item of the label has no row and a share of 0
    off = F.when(F.col("k") < 5, F.greatest("off", F.lit(0.2))).otherwise(F.col("off"))
    return j.select("label", "n", (off <= F.col("top") + 0.05).alias("even"))


def _bundle(spark, d) -> dict:
    v = table(spark, d, "validation").where(F.col("y_reader_majority").isin(*EMOTIONS)).select("item_id", "y_reader_majority")
    g = _labelled(spark, d)
    v = v.join(g.select("item_id"), "item_id", "left_semi")  # the shipped table holds items that were never delivered
    b = folds.split_bundle(g, v, _tweets(spark, d), T.plain_text(F.col("hidden_emo_text")), T.plain_text(F.col("text")), EMOTIONS, [cluster_column(c) for c in CLUSTERS])
    s = Scratch(spark, "eight")
    return {k: s.keep(t) for k, t in b.items()}


@query(
    _rows([f"SELECT '{n}' AS check_name, 0::BIGINT AS violations" for n in ("full_external", "reader_external_test")] + [f"SELECT '{t}.{n}' AS check_name, 0::BIGINT AS violations" for t in ("crowd_full", "crowd_reader", "emotwics") for n in _INNER] + [f"SELECT 'external.{n}' AS check_name, 0::BIGINT AS violations" for n in _EXTERNAL])
)
def split_bundle_audit(spark, d):
    """The eight split tables against each other."""
    b = _bundle(spark, d)
    e = folds.external_checks(b["crowd_external"], b["crowd_external_inner"], b["crowd_reader_outer"].select("item_id"))
    return folds.bundle_checks(b).unionByName(e.withColumn("check_name", F.concat_ws(".", F.lit("external"), "check_name")))


def _digest_sql(source: str, columns: tuple[str, ...]) -> str:
    line = " || ',' || ".join(f"""'"{c}":' || coalesce('"' || {c} || '"', 'null')""" for c in sorted(columns))
    return f"""WITH r AS (SELECT sha256('{{' || {line} || '}}') AS h FROM {source}), b AS (SELECT substr(h, 1, 3) AS bucket, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM r GROUP BY 1)
SELECT sha256(string_agg(bucket || digest, '' ORDER BY bucket)) AS digest, (SELECT count(*) FROM r)::BIGINT AS row_count FROM b"""


_CROWD_SPLIT, _TWEET_SPLIT = ("item_id", "group_id", "writer_id", "test_fold"), ("item_id", "group_id", "conversation_id", "test_fold")


@query(_digest_sql("crowd_full_outer", _CROWD_SPLIT))
def table_digest(spark, d):
    """Order-insensitive digest of a split table."""
    return digests.table_digest(table(spark, d, "crowd_full_outer"), _CROWD_SPLIT)


@query(_digest_sql("emotwics_outer", _TWEET_SPLIT))
def tweet_table_digest(spark, d):
    return digests.table_digest(table(spark, d, "emotwics_outer"), _TWEET_SPLIT)


_KNOWN = quoted(LABEL_CLUSTER)


@query(
    f"""WITH t AS ({_TWEETS}), l AS (SELECT item_id, unnest(emo_labels) AS l FROM t)
SELECT (SELECT count_if(emo_labels IS NULL) FROM t)::BIGINT AS missing_labels, (SELECT count_if(emo_clusters IS NULL) FROM t)::BIGINT AS missing_clusters,
(SELECT count_if(len(emo_labels) <> len(list_distinct(emo_labels))) FROM t)::BIGINT AS repeated_labels, (SELECT count_if(len(emo_clusters) <> len(list_distinct(emo_clusters))) FROM t)::BIGINT AS repeated_clusters,
(SELECT count_if(l NOT IN ({_KNOWN})) FROM l)::BIGINT AS unknown_labels, (SELECT {len(LABEL_CLUSTER)} - count(DISTINCT l) FILTER (l IN ({_KNOWN})) FROM l)::BIGINT AS unobserved_labels,
(SELECT count_if(len(emo_labels) > 0 AND emo_clusters IS NOT NULL AND len(emo_clusters) = 0) FROM t)::BIGINT AS labels_without_cluster"""
)
def label_structure_audit(spark, d):
    """Counters over the nested labels: missing, repeated, unknown, never observed, and labels that lead to no cluster."""
    return checks.label_structure(_tweets(spark, d), "emo_labels", "emo_clusters", tuple(LABEL_CLUSTER))


@query(
    f"""WITH j AS ({_JUDGED}), n AS (SELECT item_id, count(*) AS n FROM j GROUP BY 1)
SELECT 'appraisal_panel_not_two' AS check_name, count_if(n < 2)::BIGINT AS violations FROM n UNION ALL SELECT 'emotion_panel_not_three', count_if(greatest(n - 2, 0) <> 3) FROM n UNION ALL SELECT 'reader_in_both_panels', 0"""
)
def panel_audit(spark, d):
    """Items whose appraisal panel isn't two readers or whose emotion panel isn't three, and readers in both."""
    return ingest.panel_checks(ingest.panels(_judgments(spark, d)))


@query(
    f"""WITH g AS ({_GEN}), a AS (SELECT * FROM g WHERE regexp_full_match(hidden_emo_text, '[\\x00-\\x7F]*') AND NOT contains(hidden_emo_text, '&'))
SELECT (SELECT count(*) FROM g)::BIGINT AS items, (SELECT count(*) FROM a)::BIGINT AS plain_items, 0::BIGINT AS plain_items_differing, (SELECT count_if(hidden_emo_text IS NULL) FROM g)::BIGINT AS without_text"""
)
def ingest_audit(spark, d):
    """Canonical texts against the plain form, which is the same for ASCII texts without entities."""
    g = _generation(spark, d).select("item_id", "hidden_emo_text", T.normalized_text(F.col("hidden_emo_text")).alias("n"), T.plain_text(F.col("hidden_emo_text")).alias("p"))
    plain = F.col("hidden_emo_text").rlike(r"^[\x00-\x7F]*$") & ~F.col("hidden_emo_text").contains("&")
    return g.agg(F.count(F.lit(1)).alias("items"), F.count_if(plain).alias("plain_items"), F.count_if(plain & ~F.col("n").eqNullSafe(F.col("p"))).alias("plain_items_differing"), F.count_if(F.col("n").isNull()).alias("without_text"))


@query(_sound(("text_in_two_groups", "writer_in_two_groups", "item_missing", "repeated_item")))
def duplicate_components_audit(spark, d):
    """Breaches of what the components of fully normalised texts promise."""
    g = Scratch(spark, "audit").keep(_generation(spark, d).select("item_id", "writer_id", T.normalized_text(F.col("hidden_emo_text")).alias("t")))
    c = duplicate_components_full(spark, d)
    j = g.join(c, "item_id")
    return checks.summary({"text_in_two_groups": checks.crossing_groups(j, "t", "group_id"), "writer_in_two_groups": checks.crossing_groups(j, "writer_id", "group_id"), "item_missing": checks.difference(g, c, ["item_id"]), "repeated_item": checks.repeated_keys(c, ["item_id"])})
