"""Joins on time: what was known when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators import scan
from chronofold.operators.guards import require_columns
from chronofold.staging import estimated_bytes

#: Bytes, as Spark expects them, from which on keys are looked at for their sizes.
SPREAD_BYTES = 1 << 30


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    by: str,
    left_time: str,
    right_time: str,
    values: Sequence[str],
    tiebreak: str | None = None,
    strict: bool = True,
    tolerance_days: int | None = None,
    spread: bool | None = None,
    large: int = scan.LARGE_ROWS,
) -> DataFrame:
    """Each left row with the latest right row before it (or at it, unless ``strict``) of the same key.

    Both sides go through one shuffle on the key and one ordered window, so cost
    is linear in the rows of a key.  With ``spread`` keys of more than ``large``
    rows are cut into stretches of time, each a task's, and the last fact of a
    stretch is carried into those after it; None decides by the size that Spark
    expects: where both sides together may hold no large key, it is left out.
    The rows are the same.  Of right rows at the same time the largest
    ``tiebreak`` wins.  With a tolerance, older matches give nulls; the freshest
    match is the only one that can pass, so it is checked after the fact.
    Matched columns keep their names; the match's time is ``matched_time``.
    """
    require_columns(left, [by, left_time])
    require_columns(right, [by, right_time, *values])
    found = F.struct(F.col(right_time).alias("_at"), *[F.col(v) for v in values])
    tie = F.col(tiebreak) if tiebreak else F.lit(0)
    kind = dict(right.withColumn("_f", found).dtypes)["_f"]
    rows = left.withColumns({"_side": F.lit(0 if strict else 1), "_t": F.col(left_time), "_tie": F.lit(None).cast(dict(right.withColumn("_x", tie).dtypes)["_x"]), "_found": F.lit(None).cast(kind)})
    facts = right.select(F.col(by), F.lit(1 if strict else 0).alias("_side"), F.col(right_time).alias("_t"), tie.alias("_tie"), found.alias("_found"))
    order = Window.partitionBy(by).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn("_left", F.lit(True)).unionByName(facts.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    if spread is None:
        spread = estimated_bytes(both) > SPREAD_BYTES
    if spread:
        cut = scan.in_stretches(both, by=by, order=scan.as_number(F.col("_t"), dict(both.dtypes)["_t"]), into="_stretch", more_than=large)
        out = scan.last_before(cut, by=by, stretch="_stretch", order=["_t", "_side", "_tie"], value="_found", into="_match").where("_left")
    else:
        out = both.withColumn("_match", F.last("_found", ignorenulls=True).over(order)).where("_left")
    if tolerance_days is not None:
        out = out.withColumn("_match", F.when(F.datediff(left_time, F.col("_match._at")) <= tolerance_days, F.col("_match")))
    keep = [c for c in left.columns if c not in values]
    return out.select(*keep, F.col("_match._at").alias("matched_time"), *[F.col(f"_match.{v}").alias(v) for v in values])


def latest_must_be_unique(left: DataFrame, right: DataFrame, *, by: str, left_time: str, right_time: str) -> DataFrame:
    """Latest right rows at or before each left row, with how many tie there; a tie is for the caller to refuse."""
    ties = right.groupBy(by, right_time).agg(F.count("*").alias("n_ties"))
    out = asof_backward(left.select(by, left_time).distinct(), ties, by=by, left_time=left_time, right_time=right_time, values=["n_ties"], strict=False)
    return out.where("matched_time IS NOT NULL").select(by, F.col("matched_time").alias("latest"), left_time, "n_ties")


def prior_band(df: DataFrame, *, by: str, period: str, filed: str, values: Sequence[str], days: tuple[int, int], latest_filed: bool = False) -> DataFrame:
    """Each row with the latest earlier period of its key that lies ``days`` back and was filed no later.

    Of rows for that period the earliest filed counts, or the latest with
    ``latest_filed``.  Columns come back with the prefix ``prior_``.

    Rows meet by key and stretch of time, each stretch as long as the band
    reaches back, so a row is compared with two stretches of its key only.
    """
    width = max(1, days[1])
    old = df.select(F.col(by), F.floor(F.unix_date(period) / width).alias("_s"), F.col(period).alias("_p"), F.col(filed).alias("_f"), F.struct(F.col(period).alias("period"), *values).alias("_v"))
    stretch = lambda back: F.floor((F.unix_date(F.col(period)) - back) / width)
    asked = df.select(by, period, filed).distinct().withColumn("_s", F.explode(F.array_distinct(F.array(stretch(days[1]), stretch(days[0])))))
    gap = F.datediff(F.col(period), F.col("_p"))
    joined = asked.join(old, [by, "_s"]).where((gap >= days[0]) & (gap <= days[1]) & (F.col("_f") <= F.col(filed)))
    rank = F.struct("_p", F.col("_f") if latest_filed else -F.unix_date("_f"))
    best = joined.groupBy(by, period, filed).agg(F.max_by("_v", rank).alias("_b"))
    return df.join(best, [by, period, filed], "left").select(*df.columns, F.col("_b.period").alias("prior_period"), *[F.col(f"_b.{v}").alias(f"prior_{v}") for v in values])


def window_counts(anchors: DataFrame, events: DataFrame, *, by: str, anchor: str, time: str, days: int, counts: dict[str, Column], complete: Column | None = None, exact: Sequence[str] = ()) -> DataFrame:
    """Counts of events in [anchor - days, anchor) for each anchor.

    Where ``complete`` is false for any event of the window, counts not named
    in ``exact`` are unknown (null).  Anchors without events count zero.
    """
    bad = F.lit(0) if complete is None else F.sum((~F.coalesce(complete, F.lit(False))).cast("long"))
    per_day = events.groupBy(F.col(by), F.unix_date(F.to_date(time)).alias("_u")).agg(bad.cast("long").alias("_bad"), *[F.count_if(c).alias(f"_n_{name}") for name, c in counts.items()])
    rows = anchors.distinct().withColumns({"_u": F.unix_date(anchor), "_asks": F.lit(True)}).unionByName(per_day.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    # one ordered pass over the days of a key, whatever the length of the window
    w = Window.partitionBy(by).orderBy("_u").rangeBetween(-days, -1)
    known = F.coalesce(F.sum("_bad").over(w), F.lit(0)) == 0
    made = []
    for name in counts:
        n = F.coalesce(F.sum(f"_n_{name}").over(w), F.lit(0))
        made.append((n if name in exact else F.when(known, n)).alias(name))
    return rows.select("_asks", *anchors.columns, *made).where("_asks").drop("_asks")


def interval_stab(intervals: DataFrame, at: Column, *, start: str, end: str) -> DataFrame:
    """Rows whose half-open interval [start, end) holds ``at``; no end is open, no start never matches."""
    return intervals.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))


def prior_year_exact(df: DataFrame, *, by: str, period: str, filed: str, values: Sequence[str]) -> DataFrame:
    """Each row with the last filing for the period one calendar year before, filed earlier; left join."""
    old = df.select(F.col(by), F.col(period).alias("_p"), F.col(filed).alias("_f"), F.struct(*values).alias("_v"))
    pairs = df.join(old, by).where((F.col("_p") == F.add_months(period, -12)) & (F.col("_f") < F.col(filed)))
    best = pairs.groupBy(by, period, filed).agg(F.max_by("_v", "_f").alias("_b"))
    return df.join(best, [by, period, filed], "left").select(*df.columns, *[F.col(f"_b.{v}").alias(f"prior_{v}") for v in values])
