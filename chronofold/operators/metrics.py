"""Weighted evaluation of scores, and policies on thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators import scan

EPSILON = 2.220446049250313e-16


def confusion(p: Column, y: Column, w: Column, threshold: Column | float) -> dict[str, Column]:
    """Aggregates tp, fp, fn, tn."""
    alert = p >= threshold
    return {
        "tp": F.sum(F.when(alert & (y == 1), w).otherwise(0.0)),
        "fp": F.sum(F.when(alert & (y == 0), w).otherwise(0.0)),
        "fn": F.sum(F.when(~alert & (y == 1), w).otherwise(0.0)),
        "tn": F.sum(F.when(~alert & (y == 0), w).otherwise(0.0)),
    }


def brier(p: Column, y: Column, w: Column) -> Column:
    return F.sum(w * (p - y) * (p - y)) / F.sum(w)


def log_loss(p: Column, y: Column, w: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -F.sum(w * (y * F.ln(q) + (1 - y) * F.ln(1 - q))) / F.sum(w)


def curve(df: DataFrame, *, p: str, y: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for each distinct score with weights of alerts at it: tp, fp, precision, recall.

    Equal scores are summed first, so ties count as one step and the ordered
    part sees each score once.  That part is ``scan.running_sums``: without
    ``by`` the scores are cut into stretches, so no task holds all of them.
    """
    steps = df.groupBy(*by, F.col(p).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 0, F.col(w)).otherwise(0.0)).alias("neg")
    )
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*by)
        out = steps.select(*by, "score", "pos", "neg", F.sum("pos").over(order).alias("tp"), F.sum("neg").over(order).alias("fp"), F.sum("pos").over(whole).alias("all_pos"), F.sum("neg").over(whole).alias("all_neg"))
    else:
        totals = steps.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
        out = scan.running_sums(steps, by=(), order="score", sums={"tp": "pos", "fp": "neg"}).join(F.broadcast(totals))
    return out.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "all_pos")})


def areas(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision and area under the ROC curve (ties count half) from ``curve``."""
    return points.groupBy(*by).agg(
        F.sum(F.try_divide("pos", "all_pos") * F.col("precision")).alias("average_precision"),
        F.sum(F.try_divide(F.col("neg") * (F.col("tp") - F.col("pos") / 2), F.col("all_pos") * F.col("all_neg"))).alias("roc_auc"),
    )


def best_threshold(points: DataFrame, *, feasible: Column, rank: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The feasible point with the largest rank; null where none is."""
    key = F.struct(*[r.alias(f"k{i}") for i, r in enumerate(rank)])
    return points.groupBy(*by).agg(F.max_by(F.when(feasible, F.col("score")), F.when(feasible, key)).alias("threshold"))


def balanced_threshold(points: DataFrame, by: Sequence[str] = (), floor: float = 0.5) -> DataFrame:
    """Largest recall, then precision, then threshold, where both are at least ``floor``."""
    ok = (F.col("precision") >= floor) & (F.col("recall") >= floor)
    return best_threshold(points, feasible=ok, rank=[F.col("recall"), F.col("precision"), F.col("score")], by=by)


def f2_threshold(points: DataFrame, by: Sequence[str] = (), floor: float = 0.5) -> DataFrame:
    """Largest F2, then precision, then threshold, strictly between 0 and 1."""
    p, r = F.col("precision"), F.col("recall")
    f2 = F.try_divide(5 * p * r, 4 * p + r)
    ok = (p >= floor) & (r >= floor) & (F.col("score") > 0) & (F.col("score") < 1)
    return best_threshold(points, feasible=ok, rank=[f2, p, F.col("score")], by=by)


def held_out_policy(df: DataFrame, *, fold: str, p: str, y: str, w: str) -> DataFrame:
    """Alerts of each row by a threshold from the other folds; null where they give none (abstention).

    Folds are few; each row is copied once for each other fold before scores
    are summed, which shrinks them to distinct scores at once.
    """
    folds = F.broadcast(df.select(F.col(fold).alias("held")).distinct())
    fit = df.join(folds, F.col(fold) != F.col("held"))
    chosen = balanced_threshold(curve(fit, p=p, y=y, w=w, by=["held"]), by=["held"])
    return df.join(F.broadcast(chosen), F.col(fold) == F.col("held"), "left").drop("held").withColumn("alert", F.when(F.col("threshold").isNotNull(), (F.col(p) >= F.col("threshold")).cast("int")))


def policy_summary(df: DataFrame, *, y: str, w: str) -> DataFrame:
    """Coverage, precision and recall among covered rows, and abstained positive weight."""
    a, t, x = F.col("alert"), F.col(y), F.col(w)
    tp = F.sum(F.when((a == 1) & (t == 1), x).otherwise(0.0))
    return df.agg(
        (F.sum(F.when(a.isNotNull(), x).otherwise(0.0)) / F.sum(x)).alias("coverage"),
        F.try_divide(tp, F.sum(F.when(a == 1, x).otherwise(0.0))).alias("precision"),
        F.try_divide(tp, F.sum(F.when(a.isNotNull() & (t == 1), x).otherwise(0.0))).alias("recall"),
        F.sum(F.when(a.isNull() & (t == 1), x).otherwise(0.0)).alias("abstained_positive"),
    )


def bins(df: DataFrame, edges: Sequence[float], *, p: str, y: str, w: str) -> DataFrame:
    """Weighted mean score and rate in left-closed bins; the last is closed on both sides."""
    b = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        upper = F.col(p) <= edges[i + 1] if i == len(edges) - 2 else F.col(p) < edges[i + 1]
        b = F.when((F.col(p) >= edges[i]) & upper, i).otherwise(b)
    return df.withColumn("bin", b).where("bin IS NOT NULL").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum(w).alias("weight"), (F.sum(F.col(w) * F.col(p)) / F.sum(w)).alias("mean_score"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("rate")
    )


def kish(w: Column) -> Column:
    """Effective sample size."""
    return F.sum(w) * F.sum(w) / F.sum(w * w)


def crossfit_mean(df: DataFrame, *, fold: str, y: str, w: str) -> DataFrame:
    """Each row with the weighted mean of the other folds."""
    per = df.groupBy(fold).agg(F.sum(F.col(w) * F.col(y)).alias("_s"), F.sum(w).alias("_w"))
    total = per.agg(F.sum("_s").alias("_all_s"), F.sum("_w").alias("_all_w"))
    out = per.join(F.broadcast(total)).select(fold, F.try_divide(F.col("_all_s") - F.col("_s"), F.col("_all_w") - F.col("_w")).alias("baseline"))
    return df.join(F.broadcast(out), fold)
