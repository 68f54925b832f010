"""Draws and splits by hashes: the same for any order or layout of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """SHA-256 hex of the parts joined by colons; strings are literals."""
    return F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def hash_mod(hexdigest: Column, n: int) -> Column:
    """The digest as a big integer, modulo n, by folding seven hex digits at a time."""
    out = F.lit(0).cast("long")
    for i in range(0, 64, 7):
        part = F.substring(hexdigest, i + 1, 7)
        width = min(7, 64 - i)
        out = (out * pow(16, width, n) + F.conv(part, 16, 10).cast("long")) % n
    return out.cast("int")


def hash_uniform(hexdigest: Column) -> Column:
    """A number in [0, 1) from the digest's first thirteen digits."""
    return F.conv(F.substring(hexdigest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rank_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n keys with the least digests."""
    return df.select(key).distinct().withColumn("digest", digest(seed, F.col(key))).orderBy("digest").limit(n)


def inclusion_union(first: Column, second: Column) -> Column:
    """Probability to be in either of two independent draws."""
    return first + (1 - first) * second


def walk_forward(df: DataFrame, period: Column, least: int) -> DataFrame:
    """(split, role, ...): each period after the first ``least`` is tested on all before it."""
    ranked = df.withColumn("_period", period)
    # periods are few (one row each), so their numbering in one task is small whatever the data
    numbered = ranked.select("_period").distinct().withColumn("_no", F.row_number().over(Window.orderBy("_period")) - 1)
    rows = ranked.join(F.broadcast(numbered), "_period")
    splits = F.broadcast(numbered.where(F.col("_no") >= least).select(F.col("_no").alias("split")))
    out = rows.join(splits, F.col("_no") <= F.col("split"))
    return out.withColumn("role", F.when(F.col("_no") == F.col("split"), "test").otherwise("train")).drop("_period", "_no")


def cohorts(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, cohort): keys dealt out by the order of their digests."""
    keys = df.select(key).distinct().withColumn("_d", F.sha2(F.col(key).cast("string"), 256)).withColumn("_p", F.substring("_d", 1, 4))
    # digests are numbered within their first four digits, and these (65,536 at most) among each other
    sizes = keys.groupBy("_p").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")
    number = F.row_number().over(Window.partitionBy("_p").orderBy("_d")) - 1 + F.col("_before")
    return keys.join(F.broadcast(before), "_p").select(key, (number % n).cast("int").alias("cohort"))


def head_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
