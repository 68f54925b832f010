"""Ordered passes over keys that are too large for one task.

An ordered window gives a key, or a whole table, to one task.  Here a key's rows
are cut into stretches by quantiles of the order: each stretch is a task's, what
the stretches before it hold is summed up in a row for each stretch, and each
stretch goes on from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches that a large key, or a table without keys, is cut into.
STRETCHES = 64
#: A key is large if it has more rows than this, and more than a thousandth of all: there are at most a thousand such keys.
LARGE_ROWS, LARGE_SHARE = 1_000_000, 1000


def as_number(c: Column, kind: str) -> Column:
    """A number in the order of a date, a time or a number."""
    if kind == "date":
        return F.unix_date(c).cast("long")
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c


def _stretch(order: Column, cuts: Column) -> Column:
    """How many cuts lie below; rows of equal order share a stretch."""
    return F.coalesce(F.size(F.filter(cuts, lambda x: x < order)), F.lit(0))


def _quantiles(order: str, stretches: int) -> Column:
    return F.array_distinct(F.percentile_approx(order, [i / stretches for i in range(1, stretches)], 20 * stretches))


def large_keys(df: DataFrame, by: str, more_than: int = LARGE_ROWS) -> DataFrame:
    """Keys with more than ``more_than`` rows and more than a thousandth of all; null is one."""
    counts = df.groupBy(by).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_all"))
    return counts.join(F.broadcast(total)).where((F.col("_rows") > more_than) & (F.col("_rows") * LARGE_SHARE > F.col("_all"))).select(by)


def in_stretches(df: DataFrame, *, by: str, order: Column, into: str, more_than: int = LARGE_ROWS, stretches: int = STRETCHES) -> DataFrame:
    """``df`` with the number of each row's stretch of its key's ``order``; -1 for keys that are not large.

    What is broadcast is a row for each large key, a thousand at most, with its
    quantiles.
    """
    numbered = df.withColumn("_order", order)
    key = F.col(by)
    hot = large_keys(numbered, by, more_than).select(key.alias("_key"))
    cuts = numbered.join(F.broadcast(hot), key.eqNullSafe(F.col("_key"))).groupBy("_key").agg(_quantiles("_order", stretches).alias("_cuts"), F.lit(True).alias("_large"))
    placed = numbered.join(F.broadcast(cuts), key.eqNullSafe(F.col("_key")), "left")
    return placed.withColumn(into, F.when(F.col("_large"), _stretch(F.col("_order"), F.col("_cuts"))).otherwise(-1)).drop("_order", "_key", "_cuts", "_large")


def last_before(df: DataFrame, *, by: str, stretch: str, order: Sequence[str], value: str, into: str, stretches: int = STRETCHES) -> DataFrame:
    """The last non-null ``value`` up to each row, in the order of its key, over all of the key's stretches.

    ``value`` is a struct.  The last one of each stretch is carried into those
    after it, up to the next that has one: a row for each stretch of a large key
    is broadcast, 64,000 at most.
    """
    local = F.last(value, ignorenulls=True).over(Window.partitionBy(by, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = df.where((F.col(stretch) >= 0) & F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(stretch).alias("_from")).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    upto = F.coalesce(F.lead("_from").over(Window.partitionBy("_by").orderBy("_from")), F.lit(stretches))
    carried = ends.withColumn("_upto", upto).select("_by", F.explode(F.sequence(F.col("_from") + 1, "_upto")).alias("_into"), "_end")
    met = F.col(by).eqNullSafe(F.col("_by")) & (F.col(stretch) == F.col("_into"))
    return df.withColumn(into, local).join(F.broadcast(carried), met, "left").withColumn(into, F.coalesce(into, "_end")).drop("_by", "_into", "_end")


def running_sums(df: DataFrame, *, by: Sequence[str], order: str, sums: dict[str, str], more_than: int = LARGE_ROWS, stretches: int = STRETCHES) -> DataFrame:
    """Sums of columns from the largest ``order`` down to each row, in each group; ``sums`` maps new names to columns.

    Rows of one group have different ``order``.  Two passes: sums of each
    stretch, of which each stretch starts from those of the higher ones, and a
    window within each stretch.  Without groups the whole table is cut into
    stretches, however small it is.
    """
    grouped = df.withColumn("_g", F.struct(*by) if by else F.lit(0))
    placed = in_stretches(grouped, by="_g", order=F.col(order), into="_s", more_than=more_than if by else 0, stretches=stretches)
    higher = Window.partitionBy("_g").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.where("_s >= 0").groupBy(F.col("_g").alias("_g"), F.col("_s").alias("_s")).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    starts = totals.select(F.col("_g").alias("_h"), F.col("_s").alias("_r"), *[F.coalesce(F.sum(f"_t_{n}").over(higher), F.lit(0.0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy("_g", "_s").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()])
    joined = local.join(F.broadcast(starts), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_s") == F.col("_r")), "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(f"_o_{n}", F.lit(0.0)) for n in sums}).drop("_g", "_s", "_h", "_r", *[f"_o_{n}" for n in sums])
