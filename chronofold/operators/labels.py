"""Three-valued outcomes: 1, 0 or unknown."""

from __future__ import annotations

from pyspark.sql import Window, Column, DataFrame
from pyspark.sql import functions as F


def three_valued(anchor: Column, event: Column, *, years: int, observed_through: Column, coverage_start: Column | None = None, removed: Column | None = None, reviewed: Column | None = None) -> Column:
    """1 if an observed event follows within the horizon, 0 if review covers all of it without one, else null.

    The horizon ends ``years`` calendar years after the anchor, inclusive; an
    event on the anchor day or before ends the life of the row (null).  A
    removal inside the horizon makes a 0 unknown.
    """
    none = F.lit(None).cast("date")
    removed = none if removed is None else removed
    reviewed = F.lit(True) if reviewed is None else F.coalesce(reviewed, F.lit(False))
    start = anchor if coverage_start is None else coverage_start
    end = F.add_months(anchor, 12 * years)
    alive = (removed.isNull() | (anchor <= removed)) & (event.isNull() | (anchor < event))
    one = alive & (event <= end) & (event <= observed_through)
    zero = alive & reviewed & (start <= anchor) & (end <= observed_through) & (removed.isNull() | (end <= removed)) & (event.isNull() | (event > end))
    return F.when(one, 1).when(zero, 0)


def available_date(anchor: Column, event: Column, label: Column, *, years: int) -> Column:
    """When the label could first be known: the event, or the end of the horizon."""
    return F.when(label == 1, event).when(label == 0, F.add_months(anchor, 12 * years))


def event_within_days(df: DataFrame, events: DataFrame, *, by: str, anchor: str, event: str, days: int, strict: bool, name: str) -> DataFrame:
    """Flag 1/0: an event of the key lies 0 (1 if strict) to ``days`` days after the anchor; absence counts as 0."""
    gap = F.datediff(F.col(event), F.col(anchor))
    hits = df.join(events, by).where((gap >= int(strict)) & (gap <= days)).select(by, anchor).distinct().withColumn(name, F.lit(1))
    return df.join(hits, [by, anchor], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def decide(prior_event: Column, in_window: Column, unresolved: Column, followed: Column) -> tuple[Column, Column]:
    """Label and reason by priority: prior event, event in the window, unresolved, no follow-up, else 0."""
    label = F.when(prior_event, None).when(in_window, 1).when(unresolved, None).when(~followed, None).otherwise(0).cast("int")
    reason = F.when(prior_event, "prior_event").when(in_window, "event_in_window").when(unresolved, "unresolved").when(~followed, "no_follow_up").otherwise("followed_without_event")
    return label, reason


def earliest_event(df: DataFrame, events: DataFrame, *, by: str, anchor: str, event: str, source: str, years: int, observed_through: Column) -> DataFrame:
    """Positive (1) with the source of the earliest event in (anchor, anchor + years]; never 0, as silence proves nothing."""
    e = events.select(F.col(by).alias("_by"), F.col(event).alias("_e"), F.col(source).alias("_s"))
    inside = (F.col("_by") == F.col(by)) & (F.col("_e") > F.col(anchor)) & (F.col("_e") <= F.add_months(anchor, 12 * years)) & (F.col("_e") <= observed_through)
    first = F.min_by("_s", F.struct("_e", "_s"))
    return df.join(e, inside, "left").groupBy(*df.columns).agg(F.max(F.when(F.col("_e").isNotNull(), 1)).alias("target"), first.alias("source"))


def review_coverage(df: DataFrame, filings: DataFrame, *, by: str, anchor: str, filed: str, years: int, least: int) -> DataFrame:
    """Whether a row's horizon is reviewed: an earlier filing within three years, and at least ``least`` filings inside."""
    f = filings.select(F.col(by).alias("_by"), F.col(filed).alias("_f"))
    rows = df.join(f, F.col("_by") == F.col(by), "left").groupBy(*df.columns).agg(
        F.coalesce(F.bool_or((F.col("_f") < F.col(anchor)) & (F.col("_f") >= F.add_months(anchor, -36))), F.lit(False)).alias("has_prior"),
        F.count_if((F.col("_f") > F.col(anchor)) & (F.col("_f") <= F.add_months(anchor, 12 * years))).alias("n_inside"),
    )
    return rows.withColumn("reviewed", F.col("has_prior") & (F.col("n_inside") >= least))


def amend(labels_: DataFrame, corrections: DataFrame, *, key: str) -> tuple[DataFrame, DataFrame]:
    """(labels, log): a correction (key, new) replaces the label, null included; the log has what changed."""
    c = corrections.select(key, F.col("new").alias("_new"), F.lit(True).alias("_c"))
    rows = labels_.join(c, key, "left").withColumn("amended", F.when(F.col("_c"), F.col("_new")).otherwise(F.col("label")))
    log = rows.where(~F.col("label").eqNullSafe(F.col("amended"))).select(key, F.col("label").alias("old"), F.col("amended").alias("new"))
    return rows.select(key, F.col("amended").alias("label")), log


def assess_reviews(responses: DataFrame, *, unit: str, reviewer: str, verdict: str) -> DataFrame:
    """Per unit: approved by two distinct reviewers, else correction or uncertain as any says, else pending."""
    g = responses.groupBy(unit).agg(F.count_distinct(F.when(F.col(verdict) == "approve", F.col(reviewer))).alias("n"), F.collect_set(verdict).alias("v"))
    state = F.when(F.array_contains("v", "correct"), "correction").when(F.array_contains("v", "unsure"), "uncertain").when(F.col("n") >= 2, "approved").otherwise("pending")
    return g.select(unit, F.col("n").alias("n_reviewers"), state.alias("state"))


def followup_complete(history: DataFrame, anchors: DataFrame, *, by: str, filed: str, period: str, days: int = 180, least: int = 4) -> DataFrame:
    """Whether reporting after each anchor goes on without a gap until it covers the anchor's horizon.

    ``anchors``: by, baseline, anchor, horizon, cutoff.  Counted are reports
    filed after the anchor and up to the cutoff; they must cover at least
    ``least`` periods and reach the horizon.  From the baseline to the first
    report that covers the horizon no two filing days may be more than ``days``
    apart; reports after that one no longer matter.  A company without any
    report is not complete.
    """
    one = [by, "anchor"]
    rows = anchors.join(history.select(by, F.col(filed).alias("_f"), F.col(period).alias("_p")), by).where((F.col("_f") > F.col("anchor")) & (F.col("_f") <= F.col("cutoff")))
    reach = rows.groupBy(*one).agg(F.count_distinct("_p").alias("periods"), F.min(F.when(F.col("_p") >= F.col("horizon"), F.col("_f"))).alias("_end"))
    seen = rows.select(*one, "_f").unionByName(anchors.select(*one, F.col("baseline").alias("_f"))).distinct().join(reach, one).where(F.col("_f") <= F.col("_end"))
    gap = F.datediff("_f", F.lag("_f").over(Window.partitionBy(*one).orderBy("_f")))
    gaps = seen.withColumn("_g", gap).groupBy(*one).agg(F.max("_g").alias("longest"))
    out = anchors.select(*one).join(reach.select(*one, "periods"), one, "left").join(gaps, one, "left")
    return out.select(*one, F.coalesce("periods", F.lit(0)).alias("periods"), F.coalesce((F.col("periods") >= least) & (F.col("longest") <= days), F.lit(False)).alias("complete"))
