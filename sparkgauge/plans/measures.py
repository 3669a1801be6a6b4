"""Queries of metrics, geometry and resampling over nearest-centroid out-of-fold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions import arrays as A
from sparkgauge.functions.vocab import CLUSTERS, SEED, cluster_column
from sparkgauge.operators import bootstrap as B
from sparkgauge.operators import geometry as G
from sparkgauge.operators import metrics as M
from sparkgauge.operators import runs as R
from sparkgauge.plans import oof
from sparkgauge.plans.relational import rounded
from sparkgauge.session import Scratch, table

QUERIES = {}
SQL = {}
GAMMA, GAMMA_B = 1.0, 10.0


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _points(spark: SparkSession, d: str) -> DataFrame:
    return oof.embedding_points(table(spark, d, "embeddings"))


def _oof(spark: SparkSession, d: str, gamma: float = GAMMA) -> DataFrame:
    return oof.nearest_centroid(_points(spark, d), gamma)


_BASE = """e AS (SELECT vec_id AS item_id, label, vec_id % 97 % 5 AS fold, vec_id % 97 AS group_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
s AS (SELECT fold, label, pos, sum(v) AS s, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT f.f, label, pos, sum(s) / sum(n) AS m FROM s JOIN range(5) f(f) ON fold <> f.f GROUP BY ALL),
d AS (SELECT item_id, e.label AS truth, group_id, fold, c.label AS k, sum((v - m) * (v - m)) AS d2 FROM e JOIN c ON c.f = e.fold AND c.pos = e.pos GROUP BY ALL)"""


def _p(gamma: float, name: str = "p") -> str:
    return f"""{name}x AS (SELECT *, exp(-{gamma} * d2 - max(-{gamma} * d2) OVER (PARTITION BY item_id)) AS x FROM d),
{name} AS (SELECT item_id, truth, group_id, fold, k, x / sum(x) OVER (PARTITION BY item_id) AS p FROM {name}x)"""


def _items(name: str = "p", out: str = "i") -> str:
    return f"""{out} AS (SELECT item_id, truth, group_id, arg_min(k, (-p, k)) AS predicted, max(p) AS confidence, max(p) FILTER (k = truth) AS pt, max(p) FILTER (k = truth) - max(p) FILTER (k <> truth) AS true_gap,
list_sort(list(p), 'DESC')[1] - list_sort(list(p), 'DESC')[2] AS top_margin, -log2(greatest(max(p) FILTER (k = truth), 1e-15)) AS loss_bits, sum((p - (k = truth)::INTEGER) ** 2) AS brier FROM {name} GROUP BY ALL)"""


_EDGES = ", ".join(repr(e) for e in M.EDGES)
_BIN = "(1 + len(list_filter([{e}], lambda z: z < {c})))::INTEGER - 1"
_ROUND = "round({0}, 6) AS {0}"


@query(f"WITH {_BASE}, {_p(GAMMA)}, {_items()} SELECT item_id, truth, predicted, (predicted = truth)::INTEGER AS correct, {', '.join(_ROUND.format(c) for c in ('confidence', 'true_gap', 'top_margin', 'loss_bits', 'brier'))} FROM i")
def m3_items(spark, d):
    """Per item: prediction, confidence, gaps, loss, Brier score."""
    return rounded(M.items(_oof(spark, d)).select("item_id", "truth", "predicted", "correct", "confidence", "true_gap", "top_margin", "loss_bits", "brier"))


_RELIABILITY = "r AS (SELECT {bin} AS bin, count(*) AS n, avg({c}) AS mean_confidence, avg({y}) AS accuracy FROM {t} GROUP BY 1)"


@query(f"WITH {_BASE}, {_p(GAMMA)}, {_items()}, " + _RELIABILITY.format(bin=_BIN.format(e=_EDGES, c="confidence"), c="confidence", y="(predicted = truth)::INTEGER", t="i") + " SELECT bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy, round(accuracy - mean_confidence, 6) AS gap, round(n / sum(n) OVER (), 6) AS weight FROM r")
def m1_reliability(spark, d):
    i = M.items(_oof(spark, d))
    return rounded(M.reliability(i, F.col("confidence"), F.col("correct")))


_CLASSWISE = """b AS (SELECT item_id, k, p AS s, (k = truth)::INTEGER AS y, (k = hat)::INTEGER AS hat FROM (SELECT *, arg_min(k, (-p, k)) OVER (PARTITION BY item_id) AS hat FROM p)),
cw AS (SELECT k AS class, sum(y)::BIGINT AS support, coalesce(sum(y * hat) / nullif(sum(hat), 0), 0) AS "precision", coalesce(sum(y * hat) / nullif(sum(y), 0), 0) AS recall, coalesce(2 * sum(y * hat) / nullif(sum(y) + sum(hat), 0), 0) AS f1,
avg(-(y * log2(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - y) * log2(1 - least(greatest(s, 1e-15), 1 - 1e-15)))) AS loss_bits, avg((s - y) ** 2) AS brier FROM b GROUP BY k),
st AS (SELECT k, s, sum(y) AS tp, count(*) AS n FROM b GROUP BY ALL),
cu AS (SELECT k, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY k) AS pos FROM st WINDOW w AS (PARTITION BY k ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT k AS class, coalesce(sum(tp / nullif(pos, 0) * ctp / cn), 0) AS average_precision FROM cu GROUP BY k),
eb AS (SELECT k, {bin} AS bin, count(*) AS n, sum(s) AS cs, sum(y) AS ys FROM b GROUP BY ALL), ec AS (SELECT k AS class, sum(abs(ys - cs)) / sum(n) AS ece FROM eb GROUP BY k)""".format(bin=_BIN.format(e=_EDGES, c="s"))


@query(f"WITH {_BASE}, {_p(GAMMA)}, {_CLASSWISE} SELECT class, support, {', '.join(_ROUND.format(c) for c in ('f1', 'recall', 'loss_bits', 'brier', 'average_precision', 'ece'))}, round(\"precision\", 6) AS \"precision\" FROM cw JOIN ap USING (class) JOIN ec USING (class)")
def m3_classwise(spark, d):
    return rounded(M.classwise(_oof(spark, d)))


_ECE = _RELIABILITY.format(bin=_BIN.format(e=_EDGES, c="confidence"), c="confidence", y="(predicted = truth)::INTEGER", t="i")


@query(
    f"""WITH {_BASE}, {_p(GAMMA)}, {_items()}, {_CLASSWISE}, {_ECE}
SELECT count(*)::BIGINT AS n, round(avg((predicted = truth)::INTEGER), 6) AS accuracy, round(avg(loss_bits), 6) AS log_loss_bits, round(avg(brier), 6) AS brier,
(SELECT round(avg(f1), 6) FROM cw) AS macro_f1, (SELECT round(avg(average_precision), 6) FROM ap) AS macro_ap, (SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) FROM r) AS ece FROM i"""
)
def m3_multiclass_metrics(spark, d):
    """The flagship: training centroids, out-of-fold probabilities, then all multiclass metrics."""
    return rounded(M.multiclass(_oof(spark, d)))


@query(
    """WITH n AS (SELECT f.f, label, count(*) AS n FROM embeddings JOIN range(5) f(f) ON vec_id % 97 % 5 <> f.f WHERE embedding IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
g AS (SELECT f.f, k.k, coalesce(n, 0) AS n FROM range(5) f(f) CROSS JOIN range(10) k(k) LEFT JOIN n ON n.f = f.f AND n.label = k.k), c AS (SELECT f, k, greatest(n / sum(n) OVER (PARTITION BY f), 1e-12) AS p FROM g),
p AS (SELECT f, k, p / sum(p) OVER (PARTITION BY f) AS p FROM c), e AS (SELECT vec_id, label, vec_id % 97 % 5 AS f FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)
SELECT e.f::INTEGER AS outer_fold, count(*)::BIGINT AS n, round(avg(-log2(p)), 6) AS log_loss_bits FROM e JOIN p ON p.f = e.f AND p.k = e.label GROUP BY 1"""
)
def prior_decoder(spark, d):
    o = M.items(oof.prior(_points(spark, d)))
    return rounded(o.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n"), F.avg("loss_bits").alias("log_loss_bits")))


_CLUSTER_COLS = [cluster_column(c) for c in CLUSTERS]


def _tweet_oof(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, y, p): each cluster's smoothed share among tweets of the same valence in the other conversations' folds."""
    ok = " and ".join(f"{c} in (0, 1)" for c in _CLUSTER_COLS)
    t = table(spark, d, "tweets").where("item_id is not null and conversation_id is not null and valence between 1 and 5").where(ok).dropDuplicates(["item_id"])
    t = t.select("item_id", "valence", (F.conv(F.substring(F.sha2("conversation_id", 256), 1, 6), 16, 10).cast("bigint") % 5).cast("int").alias("fold"), *_CLUSTER_COLS)
    sums = t.groupBy("fold", "valence").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in _CLUSTER_COLS])
    others = sums.withColumn("test", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("fold"))))
    share = others.groupBy("test", "valence").agg(F.array(*[(F.sum(c) + 1) / (F.sum("n") + 2) for c in _CLUSTER_COLS]).alias("p")).withColumnRenamed("test", "fold")
    return t.join(F.broadcast(share), ["fold", "valence"], "left").where("p is not null").select("item_id", F.array(*_CLUSTER_COLS).alias("y"), "p")  # 25 rows of shares


_TWEET_P = f"""t AS (SELECT DISTINCT ON (item_id) item_id, valence, ('0x' || substr(sha256(conversation_id), 1, 6))::BIGINT % 5 AS fold, {", ".join(_CLUSTER_COLS)} FROM tweets WHERE item_id IS NOT NULL AND conversation_id IS NOT NULL AND valence BETWEEN 1 AND 5 AND {" AND ".join(f"{c} IN (0, 1)" for c in _CLUSTER_COLS)}),
l AS (UNPIVOT t ON {", ".join(_CLUSTER_COLS)} INTO NAME cn VALUE y), a AS (SELECT f.f, valence, cn, (sum(y) + 1) / (count(*) + 2) AS p FROM l JOIN range(5) f(f) ON fold <> f.f GROUP BY ALL),
q AS (SELECT item_id, list_position([{", ".join(f"'{c}'" for c in _CLUSTER_COLS)}], l.cn) - 1 AS k, y, p AS s, (p >= 0.25)::INTEGER AS hat FROM l JOIN a ON a.f = l.fold AND a.valence = l.valence AND a.cn = l.cn)"""
_ML_CLASSWISE = _CLASSWISE[_CLASSWISE.index("cw AS") :].replace("FROM b", "FROM q")


@query(
    f"""WITH {_TWEET_P}, {_ML_CLASSWISE}, i AS (SELECT item_id, min((y = hat)::INTEGER) AS em, avg((y = hat)::INTEGER) AS ha, avg(-(y * log2(s) + (1 - y) * log2(1 - s))) AS ll, avg((y - s) ** 2) AS br FROM q GROUP BY 1),
r AS (SELECT {_BIN.format(e=_EDGES, c="s")} AS bin, count(*) AS n, avg(s) AS c, avg(y) AS a FROM q GROUP BY 1)
SELECT count(*)::BIGINT AS n, round(avg(em), 6) AS exact_match, round(avg(ha), 6) AS hamming_accuracy, round(avg(ll), 6) AS log_loss_bits, round(avg(br), 6) AS brier,
(SELECT round(avg(f1), 6) FROM cw) AS macro_f1, (SELECT round(avg(average_precision), 6) FROM ap) AS macro_ap, (SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM r) AS ece FROM i"""
)
def m4_multilabel_metrics(spark, d):
    return rounded(M.multilabel(_tweet_oof(spark, d), F.lit(0.25)))


@query(f"WITH {_TWEET_P}, {_ML_CLASSWISE} SELECT class::INTEGER AS class, support, {', '.join(_ROUND.format(c) for c in ('f1', 'recall', 'loss_bits', 'brier', 'average_precision', 'ece'))}, round(\"precision\", 6) AS \"precision\" FROM cw JOIN ap USING (class) JOIN ec USING (class)")
def m4_classwise(spark, d):
    return rounded(M.multilabel_classwise(_tweet_oof(spark, d), F.lit(0.25)))


_CENTROIDS = """pts AS (SELECT vec_id AS item_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
site AS (SELECT label AS site, pos, avg(v) AS m FROM pts GROUP BY ALL)"""
_CELLS = "dist AS (SELECT item_id, label, site, sum((v - m) * (v - m)) AS d2 FROM pts JOIN site USING (pos) GROUP BY ALL), cell AS (SELECT item_id, label, arg_min(site, (d2, site)) AS cell, min(d2) AS d2 FROM dist GROUP BY ALL)"


def _sites(spark, d):
    p = _points(spark, d)
    return p, G.centroids(p, "label").select("site", "x")


@query(f"WITH {_CENTROIDS}, {_CELLS} SELECT item_id, cell, round(d2, 6) AS cell_distance FROM cell")
def voronoi_cells(spark, d):
    p, s = _sites(spark, d)
    return rounded(G.assign(p, s).select("item_id", "cell", "cell_distance"))


@query(
    f"""WITH {_CENTROIDS}, {_CELLS}, pd AS (SELECT a.site, b.site AS t, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM site a JOIN site b ON a.pos = b.pos AND a.site < b.site GROUP BY ALL),
cc AS (SELECT cell AS site, pos, avg(v) AS c FROM cell JOIN pts USING (item_id) GROUP BY ALL), rd AS (SELECT site, sqrt(sum((m - c) * (m - c))) AS d FROM site LEFT JOIN cc USING (site, pos) GROUP BY site)
SELECT (SELECT round(sum(d), 6) FROM pd) AS contrast_sum, (SELECT round(avg(d), 6) FROM pd) AS contrast_mean, CASE WHEN count_if(d IS NULL) = 0 THEN round(sum(d), 6) END AS representation_sum, CASE WHEN count_if(d IS NULL) = 0 THEN round(avg(d), 6) END AS representation_mean, count_if(d IS NULL)::BIGINT AS empty_cells FROM rd"""
)
def design_scores(spark, d):
    p, s = _sites(spark, d)
    return rounded(G.scores(p, s))


@query(
    f"""WITH {_CENTROIDS}, w AS (SELECT site, pos, 2 * m AS w FROM site), b AS (SELECT site, -sum(m * m) + 0.1 * site AS b FROM site GROUP BY site),
gw AS (SELECT site, pos, w - avg(w) OVER (PARTITION BY pos) AS w FROM w), gb AS (SELECT site, b - avg(b) OVER () AS b FROM b), ps AS (SELECT site, pos, w / 2 AS m FROM gw), pw AS (SELECT site, b + q / 4 AS weight FROM gb JOIN (SELECT site, sum(w * w) AS q FROM gw GROUP BY site) USING (site)),
dist AS (SELECT item_id, p.site, sum((v - m) * (v - m)) - any_value(weight) AS d2 FROM pts JOIN ps p USING (pos) JOIN pw ON pw.site = p.site GROUP BY ALL)
SELECT item_id, arg_min(site, (d2, site)) AS cell FROM dist GROUP BY item_id"""
)
def power_cells(spark, d):
    """Linear scores as a power diagram; weights favour later sites a little."""
    p, s = _sites(spark, d)
    linear = s.select("site", F.transform("x", lambda v: 2 * v).alias("w"), (-A.dot(F.col("x"), F.col("x")) + 0.1 * F.col("site")).alias("b"))
    return G.assign(p, G.power_diagram(linear), weight="weight").select("item_id", "cell")


@query(
    f"""WITH {_CENTROIDS}, {_CELLS}, t AS (SELECT label AS a, cell AS b, count(*)::DOUBLE AS n FROM cell GROUP BY ALL), ra AS (SELECT a, sum(n) AS ra FROM t GROUP BY a), cb AS (SELECT b, sum(n) AS cb FROM t GROUP BY b), z AS (SELECT sum(n) AS z FROM t),
ha AS (SELECT -sum(ra / z * ln(ra / z)) AS h, sum(ra * (ra - 1) / 2) AS p FROM ra, z), hb AS (SELECT -sum(cb / z * ln(cb / z)) AS h, sum(cb * (cb - 1) / 2) AS p FROM cb, z),
j AS (SELECT sum(n / z * ln(z * n / (ra * cb))) AS mi, sum(n * (n - 1) / 2) AS ij, sum(CASE WHEN a = b THEN 2 * n / (ra + cb) ELSE 0 END) / 10 AS f1, sum(CASE WHEN a = b THEN n ELSE 0 END) / any_value(z) AS acc, any_value(z) AS z FROM t JOIN ra USING (a) JOIN cb USING (b), z)
SELECT round(mi, 6) AS mi, round(mi / ((ha.h + hb.h) / 2), 6) AS nmi, round((ij - ha.p * hb.p / (z * (z - 1) / 2)) / ((ha.p + hb.p) / 2 - ha.p * hb.p / (z * (z - 1) / 2)), 6) AS ari, round(f1, 6) AS macro_f1, round(acc, 6) AS accuracy FROM j, ha, hb"""
)
def partition_metrics(spark, d):
    p, s = _sites(spark, d)
    return rounded(M.partition_agreement(G.assign(p, s), "label", "cell", 10))


@query(
    """WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), v AS (SELECT vec_id, vec_id % 97 % 5 AS fold, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM e),
d AS (SELECT a.vec_id AS i, b.vec_id AS j, b.label, sum((a.v - b.v) * (a.v - b.v)) AS d2 FROM v a JOIN v b ON a.pos = b.pos AND a.fold <> b.fold GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS r FROM d), n AS (SELECT *, min(d2) OVER (PARTITION BY i) AS least FROM k WHERE r <= 5),
w AS (SELECT i, label, sum(CASE WHEN least <= 1e-24 THEN (d2 <= 1e-24)::INTEGER ELSE 1 / d2 END) AS w FROM n GROUP BY ALL)
SELECT i AS test_id, arg_min(label, (-w, label)) AS predicted FROM w GROUP BY i"""
)
def nearest_neighbours(spark, d):
    """Five nearest rows of the other folds for every row, voting by inverse squared distance."""
    p = _points(spark, d)
    test, train = p.select(F.col("item_id").alias("test_id"), "x", "outer_fold"), p.select(F.col("item_id").alias("train_id"), "x", "outer_fold")
    near = G.nearest(test, train, 5, apart="outer_fold")
    return G.vote_inverse_distance(near, p.select(F.col("item_id").alias("train_id"), "label"))


DRAWS = 2000
_PAIRED = f"{_BASE}, {_p(GAMMA, 'pa')}, {_p(GAMMA_B, 'pb')}, pr AS (SELECT a.item_id, a.group_id, -log2(greatest(a.p, 1e-15)) AS la, -log2(greatest(b.p, 1e-15)) AS lb FROM pa a JOIN pb b USING (item_id, k) WHERE k = a.truth)"
_DRAWS = f"""g AS (SELECT group_id, min(item_id) AS first, count(*) AS n, sum(la) AS sa, sum(lb) AS sb FROM pr GROUP BY 1), gk AS (SELECT *, row_number() OVER (ORDER BY first, group_id) - 1 AS k FROM g), gn AS (SELECT count(*) AS gn FROM g),
pick AS (SELECT draw.draw, ('0x' || substr(sha256('{SEED}|' || draw.draw || '|' || j.j), 1, 7))::BIGINT % gn AS k FROM range({DRAWS}) draw(draw), gn, range((SELECT gn FROM gn)) j(j)),
dr AS (SELECT draw, (sum(sa) - sum(sb)) / sum(n) AS delta FROM pick JOIN gk USING (k) GROUP BY draw)"""


def _paired(spark, d):
    p = _points(spark, d)
    a = M.items(oof.nearest_centroid(p, GAMMA)).select("item_id", "group_id", F.col("loss_bits").alias("la"))
    b = M.items(oof.nearest_centroid(p, GAMMA_B)).select("item_id", F.col("loss_bits").alias("lb"))
    return a.join(b, "item_id")


@query(f"WITH {_PAIRED}, {_DRAWS} SELECT draw, round(delta, 6) AS delta FROM dr")
def bootstrap_draws(spark, d):
    return rounded(B.paired_draws(_paired(spark, d), "group_id", "la", "lb", DRAWS))


@query(
    f"""WITH {_PAIRED}, {_DRAWS}
SELECT (SELECT round(avg(la) - avg(lb), 6) FROM pr) AS observed, round(quantile_cont(delta, 0.025), 6) AS ci_low, round(quantile_cont(delta, 0.975), 6) AS ci_high, round(stddev_samp(delta), 6) AS se, count(*)::BIGINT AS draws, (SELECT count(*)::BIGINT FROM pr) AS n_items FROM dr"""
)
def conditional_gain(spark, d):
    """Paired group bootstrap of the difference of two decoders' losses."""
    p = _paired(spark, d)
    return rounded(B.summarise(B.paired_draws(p, "group_id", "la", "lb", DRAWS), p, "la", "lb"))


@query(f"WITH {_PAIRED}, {_DRAWS}, o AS (SELECT avg(la) - avg(lb) AS o FROM pr) SELECT round((1 + count_if(delta >= o)) / (1 + count(*)), 6) AS p_upper, round((1 + count_if(delta <= 0)) / (1 + count(*)), 6) AS p_zero FROM dr, o")
def monte_carlo_p(spark, d):
    p = _paired(spark, d)
    o = p.agg((F.avg("la") - F.avg("lb")).alias("o"))
    draws = B.paired_draws(p, "group_id", "la", "lb", DRAWS).crossJoin(F.broadcast(o))  # one row
    return rounded(draws.agg(B.plus_one(F.col("delta") >= F.col("o")).alias("p_upper"), B.plus_one(F.col("delta") <= 0).alias("p_zero")))


@query()
def bootstrap_numpy(spark, d):
    """The same draws by NumPy's generator."""
    return rounded(B.paired_draws(_paired(spark, d), "group_id", "la", "lb", DRAWS, mode="numpy"))


_RANKED = """x AS (SELECT a.class, round(a.f1, 9) AS fa, round(b.loss, 9) AS fb FROM (SELECT class, f1 FROM cw) a JOIN (SELECT k AS class, avg(-(y * log2(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - y) * log2(1 - least(greatest(s, 1e-15), 1 - 1e-15)))) AS loss FROM b GROUP BY k) b USING (class)),
rk AS (SELECT class, fa, fb, rank() OVER (ORDER BY fa DESC) + (count(*) OVER (PARTITION BY fa) - 1) / 2 AS rank_f1, rank() OVER (ORDER BY fb) + (count(*) OVER (PARTITION BY fb) - 1) / 2 AS rank_loss FROM x)"""


@query(f"WITH {_BASE}, {_p(GAMMA)}, {_CLASSWISE}, {_RANKED} SELECT class, rank_f1, rank_loss FROM rk")
def category_ranks(spark, d):
    """Average ranks of the classes by two diagnostics."""
    c = M.classwise(_oof(spark, d)).select("class", F.round("f1", 9).alias("fa"), F.round("loss_bits", 9).alias("fb"))
    return B.with_rank(B.with_rank(c, "fa", descending=True, out="rank_f1"), "fb", out="rank_loss").select("class", "rank_f1", "rank_loss")


@query(
    f"""WITH {_BASE}, {_p(GAMMA)}, {_CLASSWISE}, {_RANKED}, pairs AS (SELECT sign(a.rank_f1 - b.rank_f1) AS s, sign(a.rank_loss - b.rank_loss) AS t FROM rk a JOIN rk b ON a.class < b.class)
SELECT (SELECT round(corr(rank_f1, rank_loss), 6) FROM rk) AS spearman, round(sum(s * t) / sqrt(sum(abs(s)) * sum(abs(t))), 6) AS kendall FROM pairs"""
)
def rank_association(spark, d):
    r = category_ranks(spark, d)
    return rounded(B.rank_correlations(r, "rank_f1", "rank_loss"))


@query(
    "WITH g AS (SELECT item_id, any_value(pleasantness)::DOUBLE AS y, any_value(unpleasantness)::DOUBLE AS x, any_value(goal_support)::DOUBLE AS z, any_value(round_number) AS r FROM generation WHERE item_id IS NOT NULL GROUP BY 1), "
    "c AS (SELECT r AS round_number, count(*)::BIGINT AS n, corr(y, x) AS a, corr(y, z) AS b, corr(x, z) AS c FROM g WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL GROUP BY 1) "
    "SELECT round_number, n, 3 AS matrix_rank, round((a - b * c) / (1 - c * c), 6) AS beta_unpleasantness, round((b - a * c) / (1 - c * c), 6) AS beta_goal_support, round((a * (a - b * c) + b * (b - a * c)) / (1 - c * c), 6) AS r_squared, 'ok' AS status FROM c"
)
def standardized_regressions(spark, d):
    g = table(spark, d, "generation").where("item_id is not null").dropDuplicates(["item_id"])
    return rounded(B.standardized_regressions(g, "pleasantness", ["unpleasantness", "goal_support"], ["round_number"]))


@query(
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
SELECT round(-sum(n / t * log2(n / t)), 6) AS entropy_bits, round(-sum(n / t * log2(n / t)) / log2(count(*)), 6) AS normalized FROM c, t"""
)
def support_entropy(spark, d):
    c = table(spark, d, "embeddings").where("label is not null").groupBy("label").count().agg(F.collect_list("count").alias("n"))
    return rounded(c.select(A.entropy_bits(F.col("n")).alias("entropy_bits"), (A.entropy_bits(F.col("n")) / F.log2(F.size("n"))).alias("normalized")))


# two representations of the same items: the same centroids at two sharpnesses


def _totals_sql(p: str, name: str) -> str:
    x = "least(greatest(p, 1e-15), 1 - 1e-15)"
    return f"""SELECT '{name}' AS representation, group_id, k, count(*) AS n, sum(y) AS sup, sum(h) AS said, sum(y * h) AS tp, sum(-(y * log2({x}) + (1 - y) * log2(1 - {x}))) AS l, sum((p - y) ** 2) AS q
FROM (SELECT *, (k = truth)::INTEGER AS y, (k = arg_min(k, (-p, k)) OVER (PARTITION BY item_id))::INTEGER AS h FROM {p}) GROUP BY ALL"""


_RANK_DRAWS = f"""{_BASE}, {_p(GAMMA, "pa")}, {_p(GAMMA_B, "pb")}, ct AS ({_totals_sql("pa", "A")} UNION ALL {_totals_sql("pb", "H")}),
gk AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS g FROM (SELECT DISTINCT group_id FROM ct)), gn AS (SELECT count(*) AS gn FROM gk),
pick AS (SELECT draw.draw, ('0x' || substr(sha256('{SEED}|' || draw.draw || '|' || j.j), 1, 7))::BIGINT % gn AS g FROM range({DRAWS}) draw(draw), gn, range((SELECT gn FROM gn)) j(j)),
mm AS (SELECT draw, group_id, count(*) AS m FROM pick JOIN gk USING (g) GROUP BY ALL),
cv AS (SELECT representation, draw, k, sum(m * n) AS n, sum(m * sup) AS sup, sum(m * said) AS said, sum(m * tp) AS tp, sum(m * l) AS l, sum(m * q) AS q FROM ct JOIN mm USING (group_id) GROUP BY ALL),
dv AS (SELECT representation, draw, k, 'f1' AS diagnostic, round(-CASE WHEN sup + said > 0 THEN 2 * tp / (sup + said) ELSE 0 END, 9) AS v FROM cv UNION ALL SELECT representation, draw, k, 'loss_bits', round(l / n, 9) FROM cv UNION ALL SELECT representation, draw, k, 'brier', round(q / n, 9) FROM cv),
rd AS (SELECT *, rank() OVER (PARTITION BY representation, draw, diagnostic ORDER BY v) + (count(*) OVER (PARTITION BY representation, draw, diagnostic, v) - 1) / 2 AS r FROM dv)"""


def _rank_draws(spark, d) -> DataFrame:
    """(representation, draw, class, diagnostic, rank); both representations take the same groups in a draw."""
    s = Scratch(spark, "ranks")
    p = _points(spark, d)
    both = None
    for name, gamma in (("A", GAMMA), ("H", GAMMA_B)):
        o = oof.nearest_centroid(p, gamma).select(F.lit(name).alias("representation"), "group_id", "truth", "p")
        both = o if both is None else both.unionByName(o)
    totals = s.keep(B.class_totals(both, ["representation"]))
    groups = B.numbered(totals.select("g").distinct(), ["g"])
    m = B.hash_multiplicities(spark, groups.count(), DRAWS, SEED).join(F.broadcast(groups), "k").select("draw", "g", "m")  # 97 groups
    return s.keep(B.diagnostic_ranks(B.class_draws(totals, m, ["representation"]), ["representation", "draw"]))


@query(f"WITH {_RANK_DRAWS} SELECT representation, diagnostic, k AS class, round(avg(r), 6) AS mean_rank, round(var_samp(r), 6) AS rank_variance, round(quantile_cont(r, 0.025), 6) AS ci_low, round(quantile_cont(r, 0.975), 6) AS ci_high, round(1 - var_samp(r) / (99 / 12), 6) AS stability FROM rd GROUP BY ALL")
def category_rank_stability(spark, d):
    """Ranks of the classes by each diagnostic over bootstrap draws of groups: mean, variance, interval, stability."""
    return rounded(B.rank_stability(_rank_draws(spark, d), ["representation", "diagnostic", "class"], classes=10))


@query(
    f"""WITH {_RANK_DRAWS}, jj AS (SELECT a.draw, a.diagnostic, a.k, a.r AS ra, b.r AS rb FROM rd a JOIN rd b ON a.draw = b.draw AND a.diagnostic = b.diagnostic AND a.k = b.k WHERE a.representation = 'A' AND b.representation = 'H'),
sp AS (SELECT draw, diagnostic, corr(ra, rb) AS spearman FROM jj GROUP BY ALL), kp AS (SELECT x.draw, x.diagnostic, sum(sign(x.ra - y.ra) * sign(x.rb - y.rb)) / sqrt(sum(abs(sign(x.ra - y.ra))) * sum(abs(sign(x.rb - y.rb)))) AS kendall FROM jj x JOIN jj y ON x.draw = y.draw AND x.diagnostic = y.diagnostic AND x.k < y.k GROUP BY ALL)
SELECT draw::BIGINT AS draw, diagnostic, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall FROM sp JOIN kp USING (draw, diagnostic)"""
)
def rank_association_draws(spark, d):
    """Spearman and Kendall association of the two representations' class ranks by each diagnostic in every draw."""
    r = _rank_draws(spark, d)
    side = lambda n, x: r.where(F.col("representation") == n).select("draw", "diagnostic", "class", F.col("rank").alias(x))
    j = side("A", "ra").join(side("H", "rb"), ["draw", "diagnostic", "class"])
    return rounded(B.rank_correlations(j, "ra", "rb", ["draw", "diagnostic"]))


_RUNS = (("1", None, "H", "h1", "a"), ("1", None, "AH", "ah1", "b"), (None, "8", "H", "h2", "b"), (None, "8", "AH", "ah2", "a"), (None, None, "A", "a3", "a"))


def _suite_runs(spark, d) -> DataFrame:
    """Five runs under three key groups, keys null in places; one group has no pair."""
    s = Scratch(spark, "runs")
    tables = {"a": s.keep(_oof(spark, d)), "b": s.keep(_oof(spark, d, GAMMA_B))}
    out = None
    for layer, pca, representation, path, which in _RUNS:
        keys = {"target_scale": "full", "model_key": "m", "layer": layer, "pooling": None, "rater_role": None, "pca_dimension": pca}
        cols = [F.lit(v).cast("string").alias(k) for k, v in keys.items()]
        t = tables[which].select(F.lit(path).alias("run_path"), F.lit(representation).alias("representation"), *cols, "item_id", "outer_fold", "group_id", "truth", "p")
        out = t if out is None else out.unionByName(t)
    return out


_SUITE = f"""{_PAIRED}, {_DRAWS}, iv AS (SELECT (SELECT avg(la) - avg(lb) FROM pr) AS o, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi, stddev_samp(delta) AS se, count(*) AS draws, (SELECT count(*) FROM pr) AS n FROM dr)"""


@query(
    f"""WITH {_SUITE} SELECT 'full' AS target_scale, 'm' AS model_key, '1' AS layer, NULL::VARCHAR AS pooling, NULL::VARCHAR AS rater_role, NULL::VARCHAR AS pca_dimension, 'h1' AS path_a, 'ah1' AS path_b, round(o, 6) AS observed, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(se, 6) AS se, draws::BIGINT AS draws, n::BIGINT AS n_items FROM iv
UNION ALL SELECT 'full', 'm', NULL, NULL, NULL, '8', 'h2', 'ah2', round(-o, 6), round(-hi, 6), round(-lo, 6), round(se, 6), draws, n FROM iv"""
)
def q2_contrasts(spark, d):
    """Every paired contrast of a suite of runs, by key group with nulls."""
    return rounded(R.suite_contrasts(_suite_runs(spark, d), DRAWS))


@query(
    f"""WITH {_SUITE}, la AS (SELECT avg(la) AS a, avg(lb) AS b FROM pr) SELECT * FROM (VALUES {", ".join(f"('{p}', '{r}', {'NULL' if not l else repr(l)}, {'NULL' if not c else repr(c)}, '{w}')" for l, c, r, p, w in _RUNS)}) t(run_path, representation, layer, pca_dimension, which)
JOIN (SELECT 'a' AS which, round(a, 6) AS log_loss_bits FROM la UNION ALL SELECT 'b', round(b, 6) FROM la) USING (which)
LEFT JOIN (SELECT '1' AS l2, NULL AS c2, round(o, 6) AS observed FROM iv UNION ALL SELECT NULL, '8', round(-o, 6) FROM iv) ON l2 IS NOT DISTINCT FROM layer AND c2 IS NOT DISTINCT FROM pca_dimension""".replace("SELECT * FROM (VALUES", "SELECT run_path, representation, layer, pca_dimension, log_loss_bits, observed FROM (VALUES")
)
def q2_suite(spark, d):
    """Each run's loss with the contrast of its key group, null keys matched to null keys."""
    return rounded(R.suite(_suite_runs(spark, d), DRAWS).select("run_path", "representation", "layer", "pca_dimension", "log_loss_bits", "observed"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS check_name, 0::BIGINT AS violations" for n in ("repeated_draw", "draw_not_finite", "ci_low_differs", "ci_high_differs", "se_differs", "draws_differ", "interval_reversed")))
def bootstrap_audit(spark, d):
    """A stored bootstrap against its own draws."""
    s = Scratch(spark, "audit")
    p = s.keep(_paired(spark, d))
    draws = s.keep(B.paired_draws(p, "group_id", "la", "lb", DRAWS))
    return R.draw_checks(draws, s.keep(B.summarise(draws, p, "la", "lb")))
