"""Metrics, policies, preparation and backtests."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import backtest, metrics, prepare
from chronofold.plans.base import SCORED, day, register, scored, table
from chronofold.staging import written

QUERIES: list = []
query = register(QUERIES)

_CURVE = f"""WITH {SCORED}, g AS (SELECT p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM s GROUP BY p),
c AS (SELECT p AS score, pos, neg, sum(pos) OVER z AS tp, sum(neg) OVER z AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM g WINDOW z AS (ORDER BY p DESC)),
k AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(ap, 0) AS recall FROM c)"""


def _points(spark, sf_dir):
    return metrics.curve(scored(spark, sf_dir), p="p", y="y", w="w")


@query(f"WITH {SCORED} SELECT sum(w) FILTER (p >= 0.2 AND y = 1) AS tp, sum(w) FILTER (p >= 0.2 AND y = 0) AS fp, sum(w) FILTER (p < 0.2 AND y = 1) AS fn, sum(w) FILTER (p < 0.2 AND y = 0) AS tn FROM s")
def met_confusion(spark, sf_dir):
    return scored(spark, sf_dir).agg(*[c.alias(n) for n, c in metrics.confusion(F.col("p"), F.col("y"), F.col("w"), 0.2).items()])


@query(f"WITH {SCORED} SELECT round(sum(w * (p - y) * (p - y)) / sum(w), 8) AS brier FROM s")
def met_brier(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.round(metrics.brier(F.col("p"), F.col("y"), F.col("w")), 8).alias("brier"))


@query(f"WITH {SCORED}, q AS (SELECT *, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS c FROM s) SELECT round(-sum(w * (y * ln(c) + (1 - y) * ln(1 - c))) / sum(w), 6) AS log_loss FROM q")
def met_logloss(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.round(metrics.log_loss(F.col("p"), F.col("y"), F.col("w")), 6).alias("log_loss"))


@query(f"{_CURVE} SELECT round(sum(pos / ap * precision), 8) AS average_precision FROM k")
def met_ap(spark, sf_dir):
    return metrics.areas(_points(spark, sf_dir)).select(F.round("average_precision", 8).alias("average_precision"))


@query(f"{_CURVE} SELECT round(sum(neg * (tp - pos / 2) / (ap * an)), 8) AS roc_auc FROM k")
def met_roc_auc(spark, sf_dir):
    return metrics.areas(_points(spark, sf_dir)).select(F.round("roc_auc", 8).alias("roc_auc"))


@query(f"{_CURVE} SELECT score, round(precision, 8) AS precision, round(recall, 8) AS recall FROM k")
def win_stateful_pr_curve(spark, sf_dir):
    return _points(spark, sf_dir).select("score", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query(f"WITH {SCORED} SELECT count(*) AS n, round(count(*) FILTER (p >= 0.2 AND y = 1) / nullif(count(*) FILTER (p >= 0.2), 0), 8) AS precision, round(count(*) FILTER (p >= 0.2 AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 8) AS recall FROM s")
def met_basic(spark, sf_dir):
    c = metrics.confusion(F.col("p"), F.col("y"), F.lit(1.0), 0.2)
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.try_divide(c["tp"], c["tp"] + c["fp"]), 8).alias("precision"), F.round(F.try_divide(c["tp"], c["tp"] + c["fn"]), 8).alias("recall"))


@query(f"{_CURVE} SELECT round(max(ap / (ap + an)), 8) AS prevalence, sum(pos / ap * precision) > max(ap / (ap + an)) AS beats FROM k")
def met_naive(spark, sf_dir):
    p = _points(spark, sf_dir)
    base = p.agg(F.max(F.try_divide(F.col("all_pos"), F.col("all_pos") + F.col("all_neg"))).alias("b"))
    return metrics.areas(p).join(base).select(F.round("b", 8).alias("prevalence"), (F.col("average_precision") > F.col("b")).alias("beats"))


def _bins_sql(edges):
    cases = " ".join(f"WHEN p >= {a} AND p {'<=' if i == len(edges) - 2 else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return f"WITH {SCORED}, b AS (SELECT *, CASE {cases} END AS bin FROM s) SELECT bin, count(*) AS n, sum(w) AS weight, round(sum(w * p) / sum(w), 8) AS mean_score, round(sum(w * y) / sum(w), 8) AS rate FROM b WHERE bin IS NOT NULL GROUP BY bin"


#: Edges of the two reliability tables.
RELIABILITY = [0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1]
CALIBRATION = [0, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1]


def _bins(spark, sf_dir, edges):
    out = metrics.bins(scored(spark, sf_dir), edges, p="p", y="y", w="w")
    return out.select("bin", "n", "weight", F.round("mean_score", 8).alias("mean_score"), F.round("rate", 8).alias("rate"))


@query(_bins_sql(RELIABILITY))
def met_reliability(spark, sf_dir):
    return _bins(spark, sf_dir, RELIABILITY)


@query(_bins_sql(CALIBRATION))
def met_calibration_bins(spark, sf_dir):
    return _bins(spark, sf_dir, CALIBRATION)


@query(f"{_CURVE} SELECT round(max(recall) FILTER (precision >= 0.13), 8) AS recall_at_precision, round(max(precision) FILTER (recall >= 0.5), 8) AS precision_at_recall FROM k")
def met_operating_limits(spark, sf_dir):
    return _points(spark, sf_dir).agg(F.round(F.max(F.when(F.col("precision") >= 0.13, F.col("recall"))), 8).alias("recall_at_precision"), F.round(F.max(F.when(F.col("recall") >= 0.5, F.col("precision"))), 8).alias("precision_at_recall"))


@query(f"{_CURVE} SELECT arg_max(score, (recall, precision, score)) FILTER (precision >= 0.1 AND recall >= 0.1) AS threshold FROM k")
def pol_threshold_recall(spark, sf_dir):
    return metrics.balanced_threshold(_points(spark, sf_dir), floor=0.1)


@query(f"{_CURVE} SELECT arg_max(score, (round(5 * precision * recall / nullif(4 * precision + recall, 0), 12), precision, score)) FILTER (precision >= 0.1 AND recall >= 0.1 AND score > 0 AND score < 1) AS threshold FROM k")
def pol_threshold_f2(spark, sf_dir):
    return metrics.f2_threshold(_points(spark, sf_dir), floor=0.1)


@query(f"{_CURVE} SELECT coalesce(arg_max(score, (recall, score)) FILTER (precision >= 0.99), 0.5) AS threshold FROM k")
def pol_threshold_fallback(spark, sf_dir):
    best = metrics.best_threshold(_points(spark, sf_dir), feasible=F.col("precision") >= 0.99, rank=[F.col("recall"), F.col("score")])
    return best.select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"))


_HELD = f"""WITH {SCORED}, f AS (SELECT DISTINCT fold AS held FROM s), g AS (SELECT held, p, sum(CASE WHEN quality = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN quality = 0 THEN w ELSE 0 END) AS neg FROM s JOIN f ON fold <> held GROUP BY ALL),
c AS (SELECT held, p AS score, sum(pos) OVER z AS tp, sum(neg) OVER z AS fp, sum(pos) OVER (PARTITION BY held) AS ap FROM g WINDOW z AS (PARTITION BY held ORDER BY p DESC)),
t AS (SELECT held, arg_max(score, (tp / ap, tp / (tp + fp), score)) FILTER (tp / (tp + fp) >= 0.5 AND tp / ap >= 0.5) AS threshold FROM c GROUP BY held),
h AS (SELECT s.*, threshold, CASE WHEN threshold IS NOT NULL THEN CAST(p >= threshold AS INTEGER) END AS alert FROM s LEFT JOIN t ON fold = held)"""


def _held(spark, sf_dir):
    return metrics.held_out_policy(scored(spark, sf_dir), fold="fold", p="p", y="quality", w="w")


@query(f"{_HELD} SELECT unit, fold, threshold, alert FROM h")
def pol_held_out(spark, sf_dir):
    return _held(spark, sf_dir).select("unit", "fold", "threshold", "alert")


@query(f"""{_HELD} SELECT round(sum(w) FILTER (alert IS NOT NULL) / sum(w), 8) AS coverage, round(sum(w) FILTER (alert = 1 AND quality = 1) / nullif(sum(w) FILTER (alert = 1), 0), 8) AS precision,
 round(sum(w) FILTER (alert = 1 AND quality = 1) / nullif(sum(w) FILTER (alert IS NOT NULL AND quality = 1), 0), 8) AS recall, coalesce(sum(w) FILTER (alert IS NULL AND quality = 1), 0) AS abstained_positive FROM h""")
def pol_summary(spark, sf_dir):
    s = metrics.policy_summary(_held(spark, sf_dir), y="quality", w="w")
    return s.select(*[F.round(c, 8).alias(c) for c in ("coverage", "precision", "recall")], "abstained_positive")


@query(f"WITH {SCORED} SELECT lang, round(sum(w * (p - y) * (p - y)) / sum(w), 8) AS brier, count(*) AS n FROM s GROUP BY lang")
def agg_segment_metrics(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("lang").agg(F.round(metrics.brier(F.col("p"), F.col("y"), F.col("w")), 8).alias("brier"), F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT y, round(sum(w) * sum(w) / sum(w * w), 6) AS effective, round(max(w) / sum(w), 8) AS largest_share FROM s GROUP BY y")
def agg_kish(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("y").agg(F.round(metrics.kish(F.col("w")), 6).alias("effective"), F.round(F.max("w") / F.sum("w"), 8).alias("largest_share"))


@query(f"WITH {SCORED} SELECT round(sum(w * p) / sum(w), 8) AS mean_score, round(sum(w * y) / sum(w), 8) AS prevalence FROM s")
def agg_weighted_mean(spark, sf_dir):
    w = F.col("w")
    return scored(spark, sf_dir).agg(F.round(F.sum(w * F.col("p")) / F.sum(w), 8).alias("mean_score"), F.round(F.sum(w * F.col("y")) / F.sum(w), 8).alias("prevalence"))


@query(f"WITH {SCORED}, f AS (SELECT fold, sum(w * y) AS a, sum(w) AS b FROM s GROUP BY fold) SELECT unit, round(((SELECT sum(a) FROM f) - a) / ((SELECT sum(b) FROM f) - b), 8) AS baseline FROM s JOIN f USING (fold)")
def agg_crossfit_mean(spark, sf_dir):
    return metrics.crossfit_mean(scored(spark, sf_dir), fold="fold", y="y", w="w").select("unit", F.round("baseline", 8).alias("baseline"))


@query(f"WITH {SCORED} SELECT unit, p, 'missed' AS list FROM s WHERE y = 1 AND p < 0.2 UNION ALL SELECT unit, p, 'false_alert' FROM s WHERE y = 0 AND p >= 0.2")
def ranked_lists(spark, sf_dir):
    s = scored(spark, sf_dir)
    missed = s.where("y = 1 AND p < 0.2").select("unit", "p", F.lit("missed").alias("list")).orderBy("p", "unit")
    return missed.unionByName(s.where("y = 0 AND p >= 0.2").select("unit", "p", F.lit("false_alert").alias("list")).orderBy(F.desc("p"), "unit"))


@query("""WITH v AS (SELECT o_orderkey, o_totalprice AS x, o_orderkey % 2 = 0 AS tr FROM orders), q AS (SELECT quantile_cont(x, 0.5) FILTER (tr) AS m0, quantile_cont(x, 0.75) FILTER (tr) - quantile_cont(x, 0.25) FILTER (tr) AS iqr, quantile_cont(x, 0.5) FILTER (NOT tr) AS m1 FROM v)
SELECT round(m0, 4) AS median_fit, round(m1, 4) AS median_new, round((m1 - m0) / iqr, 6) AS shift FROM q""")
def drift_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    tr = F.col("o_orderkey") % 2 == 0
    q = o.agg(F.percentile(F.when(tr, F.col("x")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("a"), F.percentile(F.when(~tr, F.col("x")), 0.5).alias("b"))
    return q.select(F.round(F.col("a")[1], 4).alias("median_fit"), F.round("b", 4).alias("median_new"), F.round((F.col("b") - F.col("a")[1]) / (F.col("a")[2] - F.col("a")[0]), 6).alias("shift"))


def _cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("x"), (F.col("o_orderkey") % 2 == 0).alias("tr"))
    return rows, rows.where("tr")


_CELLS = "v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS x, o_orderkey % 2 = 0 AS tr FROM orders)"


@query(f"WITH {_CELLS} SELECT k, CAST(x IS NULL AS INTEGER) AS x_missing, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM v WHERE tr)), 4) AS x FROM v")
def ml_impute_median(spark, sf_dir):
    rows, train = _cells(spark, sf_dir)
    return prepare.impute_median(rows, train, ["x"]).select("k", "x_missing", F.round("x", 4).alias("x"))


@query(f"WITH {_CELLS} SELECT k, CASE WHEN x IS NOT NULL THEN round(least(greatest(x, (SELECT quantile_cont(x, 0.01) FROM v WHERE tr)), (SELECT quantile_cont(x, 0.99) FROM v WHERE tr)), 4) END AS x FROM v")
def ml_clip_quantile(spark, sf_dir):
    rows, train = _cells(spark, sf_dir)
    return prepare.clip_quantiles(rows, train, ["x"]).select("k", F.round("x", 4).alias("x"))


@query(f"WITH {_CELLS}, q AS (SELECT quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS i, avg(x) AS a, stddev_pop(x) AS s FROM v WHERE tr) SELECT k, round((x - m) / i, 6) AS robust, round((x - a) / s, 6) AS standard FROM v, q")
def ml_scale(spark, sf_dir):
    rows, train = _cells(spark, sf_dir)
    a = prepare.scale_robust(rows, train, ["x"]).select("k", F.round("x", 6).alias("robust"))
    return a.join(prepare.scale_standard(rows, train, ["x"]).select("k", F.round("x", 6).alias("standard")), "k")


def _weights(mode, expr, extra=""):
    return f"WITH {SCORED}, e AS (SELECT *, unit % 50 AS cik FROM s){extra}, r AS (SELECT unit, {expr} AS v FROM {'x' if extra else 'e'}) SELECT unit, '{mode}' AS mode, round(v / (SELECT avg(v) FROM r), 6) AS loss_weight FROM r"


@query(
    " UNION ALL ".join(
        f"FROM ({q})"
        for q in (
            _weights("design", "w"),
            _weights("sqrt", "sqrt(w)"),
            _weights("balanced", "w * sum(w) OVER () / (2 * sum(w) OVER (PARTITION BY y))"),
            _weights("company_balanced", "b * sum(b) OVER () / (2 * sum(b) OVER (PARTITION BY y))", ", x AS (SELECT *, w / count(*) OVER (PARTITION BY cik) AS b FROM e)"),
        )
    )
)
def ml_weights_modes(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("cik", F.col("unit") % 50)
    out = None
    for mode in ("design", "sqrt", "balanced", "company_balanced"):
        one = prepare.loss_weights(s, mode, y="y", w="w", entity="cik").select("unit", F.lit(mode).alias("mode"), F.round("loss_weight", 6).alias("loss_weight"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SCORED} SELECT round(sum(w) / (2 * sum(w) FILTER (y = 1)), 6) AS w_pos, round(sum(w) / (2 * sum(w) FILTER (y = 0)), 6) AS w_neg, round(count(*) FILTER (y = 0) / nullif(count(*) FILTER (y = 1), 0), 6) AS scale_pos FROM s")
def ml_weights_balance(spark, sf_dir):
    w, y = F.col("w"), F.col("y")
    return scored(spark, sf_dir).agg(F.round(F.sum("w") / (2 * F.sum(F.when(y == 1, w))), 6).alias("w_pos"), F.round(F.sum("w") / (2 * F.sum(F.when(y == 0, w))), 6).alias("w_neg"), F.round(F.try_divide(F.count_if(y == 0), F.count_if(y == 1)), 6).alias("scale_pos"))


@query(f"WITH {SCORED} SELECT unit, round((p + 0.5 * p) / 2, 6) AS vote FROM s WHERE p BETWEEN 0 AND 1")
def ml_ensemble_vote(spark, sf_dir):
    models = [F.col("p"), 0.5 * F.col("p")]
    ok = models[0].between(0, 1) & models[1].between(0, 1)
    return scored(spark, sf_dir).where(ok).select("unit", F.round((models[0] + models[1]) / 2, 6).alias("vote"))


@query(f"WITH {SCORED}, h AS (SELECT unit, y, CASE WHEN y = 0 AND p >= 0.2 THEN w * 3 ELSE w END AS v FROM s) SELECT unit, round(CASE WHEN y = 1 THEN v * (SELECT sum(v) FILTER (y = 0) / sum(v) FILTER (y = 1) FROM h) ELSE v END, 6) AS w FROM h")
def ml_hard_negative(spark, sf_dir):
    """Hard negatives weigh three times as much; positives are brought to the same total."""
    s = scored(spark, sf_dir).withColumn("v", F.when((F.col("y") == 0) & (F.col("p") >= 0.2), F.col("w") * 3).otherwise(F.col("w")))
    r = s.agg(F.try_divide(F.sum(F.when(F.col("y") == 0, F.col("v"))), F.sum(F.when(F.col("y") == 1, F.col("v")))).alias("r"))
    return s.join(F.broadcast(r)).select("unit", F.round(F.when(F.col("y") == 1, F.col("v") * F.col("r")).otherwise(F.col("v")), 6).alias("w"))


@query(f"""WITH RECURSIVE {SCORED}, c AS (SELECT round(p, 6) AS p, count(*) AS n, sum(y) AS s FROM s WHERE p IS NOT NULL GROUP BY 1),
l AS (SELECT list(ln(least(greatest(p, 1e-7), 1 - 1e-7) / (1 - least(greatest(p, 1e-7), 1 - 1e-7))) ORDER BY p) AS zs, list(n ORDER BY p) AS ns, sum(n) AS total, (sum(s) + 0.5) / (sum(n) + 1) AS target FROM c),
b(i, lo, hi) AS (SELECT 0, CAST(-20 AS DOUBLE), CAST(20 AS DOUBLE) UNION ALL
 SELECT i + 1, CASE WHEN m <= target THEN mid ELSE lo END, CASE WHEN m <= target THEN hi ELSE mid END FROM
 (SELECT i, lo, hi, (lo + hi) / 2 AS mid, target, list_sum(list_transform(range(1, len(zs) + 1), lambda k: ns[k] / (1 + exp(-(zs[k] + (lo + hi) / 2))))) / total AS m FROM b, l WHERE i < 60))
SELECT unit, round(1 / (1 + exp(-(ln(least(greatest(p, 1e-7), 1 - 1e-7) / (1 - least(greatest(p, 1e-7), 1 - 1e-7))) + (SELECT arg_max(lo, i) FROM b)))), 4) AS calibrated FROM s""")
def ml_calibrate_intercept(spark, sf_dir):
    s = scored(spark, sf_dir)
    offset = prepare.calibrate_intercept(s, p="p", y="y")
    from chronofold.functions.scalar import expit, logit_clip

    return s.select("unit", F.round(expit(logit_clip(F.col("p")) + offset), 4).alias("calibrated"))


_POISSON = ", ".join(repr(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(9))


@query(f"""WITH {SCORED}, e AS (SELECT unit % 50 AS cik, sum(w * y) AS s, sum(w) AS w FROM s GROUP BY 1),
d AS (SELECT replicate, s, w, CAST(concat('0x', substr(md5(concat(cik, ':', replicate, ':7')), 1, 10)) AS BIGINT) / 1099511627776.0 AS u FROM e, range(200) r(replicate)),
m AS (SELECT replicate, sum(k * s) / nullif(sum(k * w), 0) AS mean FROM (SELECT *, list_sum(list_transform([{_POISSON}], lambda x: CASE WHEN u >= CAST(x AS DOUBLE) THEN 1 ELSE 0 END)) AS k FROM d) GROUP BY 1)
SELECT round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high FROM m""")
def sample_bootstrap_cluster(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("cik", F.col("unit") % 50)
    b = prepare.bootstrap_clusters(s, entity="cik", value="y", w="w", replicates=200)
    return b.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.round(F.col("q")[0], 8).alias("low"), F.round(F.col("q")[1], 8).alias("high"))


@query(f"""WITH {SCORED}, x AS (SELECT replicate, p, quality, w * (CAST(concat('0x', substr(md5(concat(unit, ':', replicate)), 1, 8)) AS BIGINT) % 3) AS w FROM s, range(20) r(replicate)),
g AS (SELECT replicate, p, sum(CASE WHEN quality = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN quality = 0 THEN w ELSE 0 END) AS neg FROM x WHERE w > 0 GROUP BY ALL),
c AS (SELECT replicate, p AS score, sum(pos) OVER z AS tp, sum(neg) OVER z AS fp, sum(pos) OVER (PARTITION BY replicate) AS ap FROM g WINDOW z AS (PARTITION BY replicate ORDER BY p DESC)),
t AS (SELECT replicate, arg_max(score, (tp / ap, tp / (tp + fp), score)) FILTER (tp / (tp + fp) >= 0.5 AND tp / ap >= 0.5) AS threshold FROM c GROUP BY replicate)
SELECT round(quantile_cont(threshold, 0.5), 8) AS threshold, avg(CASE WHEN threshold IS NULL THEN 0.0 ELSE 1.0 END) AS feasible FROM t""")
def pol_bootstrap_consensus(spark, sf_dir):
    """Share of bootstrap replicates in which the balanced policy is feasible."""
    from chronofold.operators import metrics as m

    s = scored(spark, sf_dir).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(19))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("unit").cast("string"), F.col("replicate").cast("string"))), 1, 8), 16, 10).cast("long") % 3
    s = s.withColumn("w", F.col("w") * drawn).where("w > 0")
    t = m.balanced_threshold(m.curve(s, p="p", y="quality", w="w", by=["replicate"]), by=["replicate"])
    return t.agg(F.round(F.percentile("threshold", 0.5), 8).alias("threshold"), F.avg(F.col("threshold").isNotNull().cast("double")).alias("feasible"))


def _model_frame(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler

    s = scored(spark, sf_dir).withColumn("x", F.log1p(F.col("unit") % 97).cast("double"))
    return VectorAssembler(inputCols=["p", "x"], outputCol="features").transform(s.where("quality IS NOT NULL"))


@query()
def ml_classifiers(spark, sf_dir):
    """Held-out scores of a weighted logistic regression, trees, boosting and layers (unweighted); fold 0 is held out."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    rows = _model_frame(spark, sf_dir)
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    out = None
    for name, model in (("logistic", LogisticRegression(weightCol="w", labelCol="quality", maxIter=20)), ("forest", RandomForestClassifier(weightCol="w", labelCol="quality", numTrees=10, seed=7)), ("boosted", GBTClassifier(weightCol="w", labelCol="quality", maxIter=5, seed=7)), ("layers", MultilayerPerceptronClassifier(labelCol="quality", layers=[2, 8, 2], maxIter=30, seed=7))):
        one = model.fit(train).transform(test).select("unit", F.lit(name).alias("model"), vector_to_array("probability")[1].alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def ml_tree_families(spark, sf_dir):
    """Held-out scores of extra trees, of second-order boosting by levels, and of one by leaves; a feature is missing in places, and fold 0 is held out."""
    from chronofold.operators import trees

    rows = scored(spark, sf_dir).where("quality IS NOT NULL").select("unit", "fold", "w", F.col("quality").cast("int").alias("quality"), "p", F.log1p(F.col("unit") % 97).cast("double").alias("x"), F.when(F.col("unit") % 3 > 0, (F.col("unit") % 11).cast("double")).alias("z"))
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    fill = {"z": 5.0}
    extra = trees.extra_trees(train.fillna(fill), ["p", "x", "z"], label="quality", weight="w", trees=10, depth=4, seed=7)
    models = {"extra_trees": trees.average(extra)}
    for name, how in (("levels", trees.Boosting(rounds=4, depth=2, l2=10, l1=1, least_curvature=5)), ("leaves", trees.Boosting(rounds=2, leaves=5, l2=10, least_rows=15))):
        models[name] = trees.boost(train, ["p", "x", "z"], label="quality", weight="w", how=how).score()
    one = test.fillna(fill).select("unit", F.lit("extra_trees").alias("model"), models["extra_trees"].alias("score"))
    for name in ("levels", "leaves"):
        one = one.unionByName(test.select("unit", F.lit(name).alias("model"), models[name].alias("score")))
    return one


@query()
def ml_crossfit(spark, sf_dir):
    """Each row scored by a model that has not seen its fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows, out = _model_frame(spark, sf_dir), None
    for fold in range(4):
        model = LogisticRegression(weightCol="w", labelCol="quality", maxIter=10).fit(rows.where(F.col("fold") != fold))
        one = model.transform(rows.where(F.col("fold") == fold)).select("unit", "fold", vector_to_array("probability")[1].alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def ml_calibrate_sigmoid(spark, sf_dir):
    """A weighted logistic fit on the logit of the score."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from chronofold.functions.scalar import logit_clip

    s = scored(spark, sf_dir).where("quality IS NOT NULL").withColumn("z", logit_clip(F.col("p")))
    rows = VectorAssembler(inputCols=["z"], outputCol="features").transform(s)
    return LogisticRegression(weightCol="w", labelCol="quality", maxIter=20).fit(rows).transform(rows).select("unit", vector_to_array("probability")[1].alias("calibrated"))


#: Candidates of the inner folds, and what is taken where an inner fit has one outcome only.
STRENGTHS, FALLBACK = (0.001, 0.1), 0.1


@query()
def ml_nested_calibration(spark, sf_dir):
    """Each fold is scored by a model whose regularisation was chosen by the log loss over all inner folds together."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows, out = written(_model_frame(spark, sf_dir), "model-frame"), None
    seen = {tuple(r) for r in rows.select("fold", "quality").distinct().collect()}
    folds = sorted({f for f, _ in seen})
    both = lambda *without: len({y for f, y in seen if f not in without}) == 2
    fit = lambda strength, *without: LogisticRegression(weightCol="w", labelCol="quality", regParam=strength, maxIter=10).fit(rows.where(~F.col("fold").isin(*without)))
    score = vector_to_array("probability")[1]
    for held in folds:
        if not both(held):
            raise ValueError("an outer fit needs both outcomes")
        best, inner = [], [f for f in folds if f != held]
        for strength in STRENGTHS if all(both(held, f) for f in inner) else ():
            scores = None
            for f in inner:
                one = fit(strength, held, f).transform(rows.where(F.col("fold") == f)).select(score.alias("s"), "quality", "w")
                scores = one if scores is None else scores.unionByName(one)
            best.append((scores.agg(metrics.log_loss(F.col("s"), F.col("quality"), F.col("w"))).first()[0], strength))
        chosen = min(best)[1] if best else FALLBACK
        one = fit(chosen, held).transform(rows.where(F.col("fold") == held)).select("unit", F.lit(chosen).alias("strength"), score.alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


_CAND = f"""{SCORED}, q AS (SELECT *, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS e FROM s),
c AS (SELECT lang AS name, round(-sum(w * (y * ln(e) + (1 - y) * ln(1 - e))) / sum(w), 4) AS loss, round(sum(w * (p - y) * (p - y)) / sum(w), 4) AS brier, count(*) % 2 = 0 AS feasible FROM q GROUP BY lang)"""


def _candidates(spark, sf_dir):
    """Scores of each language as those of a model of its own."""
    p, y, w = (F.col(c) for c in ("p", "y", "w"))
    return scored(spark, sf_dir).groupBy(F.col("lang").alias("name")).agg(F.round(metrics.log_loss(p, y, w), 4).alias("loss"), F.round(metrics.brier(p, y, w), 4).alias("brier"), (F.count("*") % 2 == 0).alias("feasible"))


@query(f"WITH {_CAND} SELECT arg_min(name, (loss, brier, name)) AS name FROM c")
def pol_select_model(spark, sf_dir):
    return _candidates(spark, sf_dir).agg(F.min_by("name", F.struct("loss", "brier", "name")).alias("name"))


@query(f"WITH {_CAND} SELECT arg_min(name, (NOT feasible, loss, brier, name)) AS name FROM c")
def pol_select_feasible(spark, sf_dir):
    return _candidates(spark, sf_dir).agg(F.min_by("name", F.struct(~F.col("feasible"), F.col("loss"), F.col("brier"), F.col("name"))).alias("name"))


@query(f"WITH {SCORED} SELECT list_filter([CASE WHEN count(*) < 100000 THEN 'few_rows' END, CASE WHEN avg(y) < 0.01 THEN 'few_positives' END], lambda x: x IS NOT NULL) AS failed FROM s")
def met_gates(spark, sf_dir):
    from chronofold.functions.scalar import failures

    return scored(spark, sf_dir).agg(F.count("*").alias("n"), F.avg("y").alias("r")).select(failures({"few_rows": F.col("n") < 100000, "few_positives": F.col("r") < 0.01}).alias("failed"))


# ------------------------------------------------------------ backtest on a panel: event types by day

_PANEL = """p AS (SELECT CAST(ts AS DATE) AS d, event_type AS ticker, (avg(value) - 50) / 1000 AS r, CASE WHEN count(*) % 2 = 0 THEN 1.0 ELSE 0.0 END AS pos FROM events GROUP BY ALL)"""


def _panel(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(day("ts").alias("d"), F.col("event_type").alias("ticker")).agg(((F.avg("value") - 50) / 1000).alias("r"), F.when(F.count("*") % 2 == 0, 1.0).otherwise(0.0).alias("pos"))


@query(f"""WITH {_PANEL}, w AS (SELECT *, coalesce(pos / nullif(sum(pos) OVER (PARTITION BY d), 0), 0) AS w FROM p), g AS (SELECT *, sum(w * r) OVER (PARTITION BY d) AS gross FROM w),
t AS (SELECT *, abs(w - coalesce(lag(w) OVER z * (1 + lag(r) OVER z) / (1 + lag(gross) OVER z), 0)) AS turn FROM g WINDOW z AS (PARTITION BY ticker ORDER BY d)),
n AS (SELECT d, any_value(gross) AS gross, sum(turn) AS turnover, any_value(gross) - sum(turn) * 10 / 10000 AS net FROM t GROUP BY d), e AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY d)) AS equity FROM n)
SELECT d, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(net, 6) AS net, round(equity, 6) AS equity, round(equity / max(equity) OVER (ORDER BY d) - 1, 6) AS drawdown FROM e""")
def bt_strategy(spark, sf_dir):
    out = backtest.strategy(_panel(spark, sf_dir), period="d", ticker="ticker", position="pos", ret="r")
    return out.select("d", *[F.round(c, 6).alias(c) for c in ("gross", "turnover", "net", "equity", "drawdown")])


@query(f"""WITH {_PANEL}, c AS (SELECT *, coalesce(exp(sum(ln(1 + r)) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS g FROM p) SELECT d, round(sum(g * r) / sum(g), 6) AS gross FROM c GROUP BY d""")
def bt_buy_hold(spark, sf_dir):
    return backtest.buy_and_hold(_panel(spark, sf_dir), period="d", ticker="ticker", ret="r").select("d", F.round("gross", 6).alias("gross"))


@query("SELECT event_id, CASE WHEN value / 1000 < 0.1 AND user_id % 2 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS position FROM events")
def bt_mechanical(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", backtest.mechanical(F.col("value") / 1000, F.col("user_id") % 2).alias("position"))


@query(f"WITH {_PANEL}, q AS (SELECT d, count(*) AS n, count(DISTINCT ticker) AS t FROM p GROUP BY d) SELECT CAST(sum(n - t) AS BIGINT) AS duplicates, count(*) FILTER (t < (SELECT count(DISTINCT ticker) FROM p)) AS incomplete, 0::BIGINT AS late FROM q")
def bt_panel_guard(spark, sf_dir):
    p = _panel(spark, sf_dir).withColumn("available", F.col("d"))
    return backtest.panel_faults(p, period="d", ticker="ticker", available="available")
