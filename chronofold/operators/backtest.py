"""Strategies on a complete panel of decisions, without iteration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mechanical(risk: Column, news: Column, max_risk: float = 0.1) -> Column:
    """Hold where risk is below the limit and news is positive."""
    return F.when((risk < max_risk) & (news > 0), 1.0).otherwise(0.0)


def strategy(panel: DataFrame, *, period: str, ticker: str, position: str, ret: str, cost_bps: float = 10) -> DataFrame:
    """Per period: gross return, turnover, net return, equity and drawdown of equal weights on open positions.

    Turnover compares the weights with those of the period before, drifted by
    its returns; the first period starts from cash.  Equity is a product, so a
    single loss of everything ends it.
    """
    by_period = Window.partitionBy(period)
    own = Window.partitionBy(ticker).orderBy(period)
    n = F.sum(position).over(by_period)
    rows = panel.withColumn("w", F.coalesce(F.try_divide(F.col(position), n), F.lit(0.0)))
    rows = rows.withColumn("gross", F.sum(F.col("w") * F.col(ret)).over(by_period))
    before = 1 + F.lag("gross").over(own)
    drifted = F.when(before <= 0, 0.0).otherwise(F.try_divide(F.lag("w").over(own) * (1 + F.lag(ret).over(own)), before))
    rows = rows.withColumn("turn", F.abs(F.col("w") - F.coalesce(drifted, F.lit(0.0))))
    daily = rows.groupBy(period).agg(F.first("gross").alias("gross"), F.sum("turn").alias("turnover"))
    daily = daily.withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 10000)
    # one row a period is left, so its running product is small
    run = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("equity", F.exp(F.sum(F.when(F.col("net") > -1, F.ln(1 + F.col("net")))).over(run)) * F.min(F.when(F.col("net") > -1, 1.0).otherwise(0.0)).over(run))
    # a loss of everything in the first period leaves no peak to compare with
    return daily.withColumn("drawdown", F.coalesce(F.try_divide("equity", F.max("equity").over(run)), F.lit(0.0)) - 1)


def buy_and_hold(panel: DataFrame, *, period: str, ticker: str, ret: str) -> DataFrame:
    """Weights that start equal and drift: each one's cumulative product over the sum of all."""
    own = Window.partitionBy(ticker).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    grown = panel.withColumn("growth", F.coalesce(F.exp(F.sum(F.ln(1 + F.col(ret))).over(own)), F.lit(1.0)))
    return grown.withColumn("weight", F.col("growth") / F.sum("growth").over(Window.partitionBy(period))).groupBy(period).agg(F.sum(F.col("weight") * F.col(ret)).alias("gross"))


def panel_faults(panel: DataFrame, *, period: str, ticker: str, available: str) -> DataFrame:
    """Counts of duplicate decisions, incomplete periods and inputs later than the decision."""
    per = panel.groupBy(period).agg(F.count("*").alias("n"), F.count_distinct(ticker).alias("n_tickers"), F.count_if(F.col(available) > F.col(period)).alias("late"))
    whole = panel.agg(F.count_distinct(ticker).alias("all"))
    return per.join(F.broadcast(whole)).agg(F.sum(F.col("n") - F.col("n_tickers")).alias("duplicates"), F.count_if(F.col("n_tickers") < F.col("all")).alias("incomplete"), F.sum("late").alias("late"))
