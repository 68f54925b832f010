"""As-of, interval and window queries; labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import asof, labels
from chronofold.plans.base import ORDERS, day, orders, register, table

QUERIES: list = []
query = register(QUERIES)


def _anchors(spark, sf_dir):
    """31 January of 1996 to 2000 for each customer."""
    years = F.explode(F.array(*[F.lit(f"{y}-01-31").cast("date") for y in range(1996, 2001)]))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), years.alias("anchor"))


ANCHORS = f"""WITH {ORDERS}, a AS (SELECT c_custkey AS cik, CAST(y AS DATE) AS anchor FROM customer,
 (VALUES ('1996-01-31'), ('1997-01-31'), ('1998-01-31'), ('1999-01-31'), ('2000-01-31')) AS v(y))"""


@query(f"""{ANCHORS}, m AS (SELECT a.cik, a.anchor, max(struct_pack(f := filed, k := accession)) AS b FROM a JOIN o ON o.cik = a.cik AND filed < anchor GROUP BY ALL),
e AS (SELECT a.cik, a.anchor, min(filed) FILTER (status = 'F' AND filed > a.anchor) AS ev FROM a LEFT JOIN o ON o.cik = a.cik GROUP BY ALL)
SELECT m.cik, m.anchor, b.f AS matched_time, b.k AS accession, CAST(m.anchor - b.f AS INTEGER) AS age_days,
 CASE WHEN ev <= m.anchor + INTERVAL 1 YEAR AND ev <= DATE '2000-12-31' THEN 1 WHEN m.anchor + INTERVAL 1 YEAR <= DATE '2000-12-31' AND (ev IS NULL OR ev > m.anchor + INTERVAL 1 YEAR) THEN 0 END AS target
FROM m JOIN e USING (cik, anchor)""")
def pit_snapshot_outcome(spark, sf_dir):
    """The latest order strictly before each anchor, its age, and whether a finished order follows within a year."""
    o = orders(spark, sf_dir)
    rows = asof.asof_backward(_anchors(spark, sf_dir), o, by="cik", left_time="anchor", right_time="filed", values=["accession"], tiebreak="accession")
    rows = rows.where("matched_time IS NOT NULL")
    later = rows.join(o.where("status = 'F'").select("cik", "filed"), "cik", "left").groupBy("cik", "anchor").agg(F.min(F.when(F.col("filed") > F.col("anchor"), F.col("filed"))).alias("event"))
    out = rows.join(later, ["cik", "anchor"])
    target = labels.three_valued(F.col("anchor"), F.col("event"), years=1, observed_through=F.lit("2000-12-31").cast("date"))
    return out.select("cik", "anchor", "matched_time", "accession", F.datediff("anchor", "matched_time").alias("age_days"), target.alias("target"))


@query(f"""{ANCHORS} SELECT a.cik, a.anchor, max(struct_pack(f := filed, k := accession)).f AS matched_time, max(struct_pack(f := filed, k := accession)).k AS accession
FROM a LEFT JOIN o ON o.cik = a.cik AND filed < anchor GROUP BY ALL""")
def join_asof_strict(spark, sf_dir):
    return asof.asof_backward(_anchors(spark, sf_dir), orders(spark, sf_dir), by="cik", left_time="anchor", right_time="filed", values=["accession"], tiebreak="accession")


@query(f"""WITH {ORDERS}, l AS (SELECT cik, filed, max(cents) AS cents FROM o WHERE status = 'F' GROUP BY ALL)
SELECT o.accession, o.cik, o.filed, l.filed AS matched_time, l.cents FROM o ASOF LEFT JOIN l ON o.cik = l.cik AND o.filed >= l.filed""")
def join_asof_backward(spark, sf_dir):
    o = orders(spark, sf_dir)
    finished = o.where("status = 'F'").groupBy("cik", "filed").agg(F.max("cents").alias("cents"))
    return asof.asof_backward(o.select("accession", "cik", "filed"), finished, by="cik", left_time="filed", right_time="filed", values=["cents"], strict=False)


@query(f"""WITH {ORDERS}, m AS (SELECT a.accession, a.cik, a.filed, max(struct_pack(f := b.filed, k := b.accession)) AS b FROM o a LEFT JOIN o b ON a.cik = b.cik AND b.filed < a.filed
 AND a.filed - b.filed <= 550 GROUP BY ALL) SELECT accession, cik, filed, b.f AS matched_time, b.k AS previous FROM m""")
def join_asof_tolerance(spark, sf_dir):
    o = orders(spark, sf_dir)
    return asof.asof_backward(o.select("accession", "cik", "filed"), o.select("cik", "filed", F.col("accession").alias("previous")), by="cik", left_time="filed", right_time="filed", values=["previous"], tiebreak="previous", tolerance_days=550)


@query(f"""{ANCHORS}, m AS (SELECT a.cik, anchor, max(filed) AS latest FROM a JOIN o ON a.cik = o.cik AND filed <= anchor GROUP BY ALL)
SELECT m.cik, anchor, latest, count(*) AS n_ties FROM m JOIN o ON o.cik = m.cik AND filed = latest GROUP BY ALL""")
def join_asof_unique(spark, sf_dir):
    return asof.latest_must_be_unique(_anchors(spark, sf_dir), orders(spark, sf_dir), by="cik", left_time="anchor", right_time="filed")


@query("""WITH q AS (SELECT o_custkey AS cik, last_day(CAST(o_orderdate AS DATE)) AS period, max(CAST(o_orderdate AS DATE)) AS filed, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM orders GROUP BY ALL)
SELECT a.*, b.cents AS prior_cents FROM q a LEFT JOIN q b ON a.cik = b.cik AND b.period = CAST(a.period - INTERVAL 12 MONTH AS DATE) AND b.filed < a.filed""")
def join_prior_year_exact(spark, sf_dir):
    return asof.prior_year_exact(_months(spark, sf_dir), by="cik", period="period", filed="filed", values=["cents"])


def _months(spark, sf_dir):
    o = orders(spark, sf_dir)
    return o.groupBy("cik", F.last_day("filed").alias("period")).agg(F.max("filed").alias("filed"), F.sum("cents").alias("cents"))


_BAND = """WITH q AS (SELECT o_custkey AS cik, last_day(CAST(o_orderdate AS DATE)) AS period, max(CAST(o_orderdate AS DATE)) AS filed, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM orders GROUP BY ALL),
b AS (SELECT a.cik, a.period, max(struct_pack(p := b.period, c := b.cents)) AS m FROM q a JOIN q b ON a.cik = b.cik AND a.period - b.period BETWEEN {0} AND {1} AND b.filed <= a.filed GROUP BY ALL)
SELECT q.*, m.p AS prior_period, m.c AS prior_cents{2} FROM q LEFT JOIN b USING (cik, period)"""


@query(_BAND.format(350, 380, ""))
def join_prior_band(spark, sf_dir):
    return asof.prior_band(_months(spark, sf_dir), by="cik", period="period", filed="filed", values=["cents"], days=(350, 380))


@query(_BAND.format(60, 130, ""))
def join_prior_quarter(spark, sf_dir):
    return asof.prior_band(_months(spark, sf_dir), by="cik", period="period", filed="filed", values=["cents"], days=(60, 130), latest_filed=True)


@query(_BAND.format(350, 380, ", round(CAST(q.cents - m.c AS DOUBLE) / nullif(m.c, 0), 6) AS growth"))
def win_yoy(spark, sf_dir):
    rows = asof.prior_band(_months(spark, sf_dir), by="cik", period="period", filed="filed", values=["cents"], days=(350, 380))
    return rows.withColumn("growth", F.round(F.try_divide((F.col("cents") - F.col("prior_cents")).cast("double"), F.col("prior_cents")), 6))


@query(f"""WITH {ORDERS}, d AS (SELECT DISTINCT cik, form, filed FROM o) SELECT cik, form, filed, lag(filed) OVER (PARTITION BY cik, form ORDER BY filed) AS previous FROM d""")
def join_prev_same_form(spark, sf_dir):
    d = orders(spark, sf_dir).select("cik", "form", "filed").distinct()
    return d.withColumn("previous", F.lag("filed").over(Window.partitionBy("cik", "form").orderBy("filed")))


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, lead(turn) OVER w AS next_turn, lead(length(text)) OVER w AS next_n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, CAST(n AS INTEGER) AS n, next_turn, CAST(next_n AS INTEGER) AS next_n FROM t WHERE next_turn IS NOT NULL""")
def join_pairwise_adjacent(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return c.withColumns({"next_turn": F.lead("turn").over(w), "next_n": F.lead("n").over(w)}).where("next_turn IS NOT NULL")


_MEMBERS = "m AS (SELECT o_custkey AS cik, min(CAST(o_orderdate AS DATE)) AS added, CASE WHEN count(*) % 3 = 0 THEN max(CAST(o_orderdate AS DATE)) END AS removed FROM orders GROUP BY ALL)"


@query(f"WITH {_MEMBERS} SELECT DISTINCT cik FROM m WHERE added <= DATE '1998-06-30' AND (removed IS NULL OR removed > DATE '1998-06-30')")
def interval_stab(spark, sf_dir):
    m = orders(spark, sf_dir).groupBy("cik").agg(F.min("filed").alias("added"), F.when(F.count("*") % 3 == 0, F.max("filed")).alias("removed"))
    return asof.interval_stab(m, F.lit("1998-06-30").cast("date"), start="added", end="removed").select("cik").distinct()


_EVENTS = "e AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, value, event_id FROM events), a AS (SELECT DISTINCT user_id, d AS anchor FROM e)"


@query(f"""WITH {_EVENTS} SELECT a.user_id, anchor, count(e.d) AS n_reports,
 CASE WHEN coalesce(bool_and(value >= 1), true) THEN count(*) FILTER (event_type = 'click') END AS n_clicks
FROM a LEFT JOIN e ON a.user_id = e.user_id AND d < anchor AND d >= anchor - 7 GROUP BY ALL""")
def win_window_counts(spark, sf_dir):
    """Event counts in the week before each anchor; clicks are unknown if any event of the week lacks its item (value under 1)."""
    e = table(spark, sf_dir, "events").select("user_id", day("ts").alias("d"), "event_type", "value")
    anchors = e.select("user_id", F.col("d").alias("anchor")).distinct()
    return asof.window_counts(anchors, e, by="user_id", anchor="anchor", time="d", days=7, counts={"n_reports": F.lit(True), "n_clicks": F.col("event_type") == "click"}, complete=F.col("value") >= 1, exact=["n_reports"])


@query(f"""WITH {_EVENTS} SELECT a.user_id, anchor, CAST(a.anchor - max(d) FILTER (event_type = 'purchase') AS INTEGER) AS days_since
FROM a LEFT JOIN e ON a.user_id = e.user_id AND d < anchor GROUP BY a.user_id, a.anchor""")
def win_days_since(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", day("ts").alias("d"), "event_type")
    anchors = e.select("user_id", F.col("d").alias("anchor")).distinct()
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "d").agg(F.lit(1).alias("x"))
    out = asof.asof_backward(anchors, buys, by="user_id", left_time="anchor", right_time="d", values=["x"])
    return out.select("user_id", "anchor", F.datediff("anchor", "matched_time").alias("days_since"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS position FROM events""")
def win_hold_last_action(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") != "view", F.col("event_type")), ignorenulls=True).over(w).alias("position"))


@query("""WITH r AS (SELECT user_id, event_id, ts, ln(1 + (value - 50) / 1000) AS g FROM events),
c AS (SELECT *, exp(sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS equity FROM r)
SELECT event_id, user_id, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM c""")
def win_cumprod(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (1 + (F.col("value") - 50) / 1000).alias("g"))
    # a product of any signs: of a factor of zero nothing is left, and each negative one turns the sign
    size = F.exp(F.sum(F.when(F.col("g") != 0, F.ln(F.abs("g")))).over(w))
    sign = F.when(F.max((F.col("g") == 0).cast("int")).over(w) == 1, 0).when(F.sum((F.col("g") < 0).cast("int")).over(w) % 2 == 1, -1).otherwise(1)
    e = e.withColumn("equity", F.coalesce(size, F.lit(1.0)) * sign)
    return e.select("event_id", "user_id", F.round("equity", 6).alias("equity"), F.round(F.col("equity") / F.max("equity").over(w) - 1, 6).alias("drawdown"))


@query(f"""WITH {ORDERS}, h AS (SELECT cik, filed, filed - 30 AS period FROM o), a AS (SELECT cik, min(filed) AS anchor, min(filed) + 700 AS horizon FROM h GROUP BY cik),
f AS (SELECT a.*, filed, period FROM a JOIN h USING (cik) WHERE filed > anchor AND filed <= DATE '2001-06-30'),
e AS (SELECT cik, count(DISTINCT period) AS periods, min(CASE WHEN period >= horizon THEN filed END) AS last FROM f GROUP BY cik),
g AS (SELECT cik, filed - lag(filed) OVER (PARTITION BY cik ORDER BY filed) AS gap FROM (SELECT cik, filed FROM f UNION SELECT cik, anchor FROM a) JOIN e USING (cik) WHERE filed <= last)
SELECT a.cik, a.anchor, coalesce(periods, 0) AS periods, coalesce(periods >= 4 AND (SELECT max(gap) FROM g WHERE g.cik = a.cik) <= 180, false) AS complete FROM a LEFT JOIN e ON e.cik = a.cik""")
def win_gap_check(spark, sf_dir):
    """Reports from each company's first filing until one covers a horizon of 700 days."""
    h = orders(spark, sf_dir).select("cik", "filed", F.date_sub("filed", 30).alias("period"))
    first = h.groupBy("cik").agg(F.min("filed").alias("anchor"))
    anchors = first.select("cik", "anchor", F.col("anchor").alias("baseline"), F.date_add("anchor", 700).alias("horizon"), F.lit("2001-06-30").cast("date").alias("cutoff"))
    return labels.followup_complete(h, anchors, by="cik", filed="filed", period="period")


@query(f"""WITH {ORDERS} SELECT cik, accession, filed FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession DESC) AS n FROM o) WHERE n <= 2""")
def win_topn_last(spark, sf_dir):
    from chronofold.operators.sampling import head_per_group

    return head_per_group(orders(spark, sf_dir), ["cik"], [F.desc("filed"), F.desc("accession")], 2).select("cik", "accession", "filed")


@query(f"""WITH {ORDERS} SELECT cik, min(filed) AS first_event FROM o WHERE status = 'F' GROUP BY cik""")
def agg_min_by_key(spark, sf_dir):
    return orders(spark, sf_dir).where("status = 'F'").groupBy("cik").agg(F.min("filed").alias("first_event"))


@query(f"""WITH {ORDERS}, q AS (SELECT cik, filed, year(filed) AS fy, cents FROM o), d AS (SELECT cik, fy, quarter(filed) AS fq, CAST(sum(cents) AS BIGINT) AS flow FROM q GROUP BY ALL),
y AS (SELECT cik, fy, fq, CAST(sum(flow) OVER (PARTITION BY cik, fy ORDER BY fq) AS BIGINT) AS ytd FROM d)
SELECT cik, fy, fq, ytd, CASE WHEN fq = 1 THEN ytd WHEN lag(fq) OVER (PARTITION BY cik, fy ORDER BY fq) = fq - 1 THEN ytd - lag(ytd) OVER (PARTITION BY cik, fy ORDER BY fq) END AS quarter FROM y""")
def win_ytd_to_quarter(spark, sf_dir):
    from chronofold.operators.history import ytd_to_quarter

    return ytd_to_quarter(_ytd(spark, sf_dir), by="cik", year="fy", quarter="fq", value="ytd")


def _ytd(spark, sf_dir):
    o = orders(spark, sf_dir)
    flow = o.groupBy("cik", F.year("filed").alias("fy"), F.quarter("filed").alias("fq")).agg(F.sum("cents").alias("flow"))
    return flow.select("cik", "fy", "fq", F.sum("flow").over(Window.partitionBy("cik", "fy").orderBy("fq")).alias("ytd"))


@query(f"""WITH {ORDERS}, d AS (SELECT cik, 4 * year(filed) + quarter(filed) AS n, CAST(sum(cents) AS BIGINT) AS flow FROM o GROUP BY ALL),
w AS (SELECT *, lag(n, 3) OVER x AS n3, CAST(sum(flow) OVER (x ROWS 3 PRECEDING) AS BIGINT) AS s FROM d WINDOW x AS (PARTITION BY cik ORDER BY n))
SELECT cik, n, flow, CASE WHEN n3 = n - 3 THEN s END AS ttm FROM w""")
def win_ttm(spark, sf_dir):
    from chronofold.operators.history import trailing_sum

    d = orders(spark, sf_dir).groupBy("cik", (4 * F.year("filed") + F.quarter("filed")).alias("n")).agg(F.sum("cents").alias("flow"))
    return trailing_sum(d, by="cik", number="n", value="flow", periods=4, name="ttm")


_UNIVERSE = f"""WITH {ORDERS}, u AS (SELECT cik, min(filed) AS anchor, count(*) % 2 = 0 AS reviewed, CASE WHEN count(*) % 5 = 0 THEN max(filed) END AS removed FROM o GROUP BY cik),
e AS (SELECT cik, min(filed) AS ev FROM o WHERE status = 'F' AND accession % 3 = 0 GROUP BY cik), j AS (SELECT u.*, ev FROM u LEFT JOIN e USING (cik)),
l AS (SELECT *, (removed IS NULL OR anchor <= removed) AND (ev IS NULL OR anchor < ev) AS alive, CAST(anchor + INTERVAL 2 YEAR AS DATE) AS horizon FROM j)"""


@query(f"""{_UNIVERSE}, t AS (SELECT *, CASE WHEN alive AND ev <= horizon AND ev <= DATE '2000-12-31' THEN 1
 WHEN alive AND reviewed AND horizon <= DATE '2000-12-31' AND (removed IS NULL OR horizon <= removed) AND (ev IS NULL OR ev > horizon) THEN 0 END AS target FROM l)
SELECT cik, anchor, target, CASE WHEN target = 1 THEN ev WHEN target = 0 THEN horizon END AS available FROM t""")
def label_three_valued(spark, sf_dir):
    u = _universe(spark, sf_dir)
    target = labels.three_valued(F.col("anchor"), F.col("event"), years=2, observed_through=F.lit("2000-12-31").cast("date"), removed=F.col("removed"), reviewed=F.col("reviewed"))
    u = u.withColumn("target", target)
    return u.select("cik", "anchor", "target", labels.available_date(F.col("anchor"), F.col("event"), F.col("target"), years=2).alias("available"))


def _universe(spark, sf_dir):
    o = orders(spark, sf_dir)
    u = o.groupBy("cik").agg(F.min("filed").alias("anchor"), (F.count("*") % 2 == 0).alias("reviewed"), F.when(F.count("*") % 5 == 0, F.max("filed")).alias("removed"))
    e = o.where("status = 'F' AND accession % 3 = 0").groupBy("cik").agg(F.min("filed").alias("event"))
    return u.join(e, "cik", "left")


@query(f"""WITH {ORDERS}, e AS (SELECT DISTINCT cik, filed AS ev FROM o WHERE status = 'F')
SELECT accession, cik, filed, CAST(max(CASE WHEN ev >= filed AND ev - filed <= 365 THEN 1 ELSE 0 END) AS INTEGER) AS flag FROM o LEFT JOIN e USING (cik) GROUP BY ALL""")
def join_event_window_days(spark, sf_dir):
    o = orders(spark, sf_dir)
    e = o.where("status = 'F'").select("cik", F.col("filed").alias("ev")).distinct()
    return labels.event_within_days(o.select("accession", "cik", "filed"), e, by="cik", anchor="filed", event="ev", days=365, strict=False, name="flag")


@query(f"""WITH {ORDERS}, e AS (SELECT DISTINCT cik, filed AS ev FROM o WHERE status = 'F')
SELECT accession, cik, filed, CAST(max(CASE WHEN ev > filed AND ev - filed <= 365 THEN 1 ELSE 0 END) AS INTEGER) AS flag FROM o LEFT JOIN e USING (cik) GROUP BY ALL""")
def join_event_window_365(spark, sf_dir):
    o = orders(spark, sf_dir)
    e = o.where("status = 'F'").select("cik", F.col("filed").alias("ev")).distinct()
    return labels.event_within_days(o.select("accession", "cik", "filed"), e, by="cik", anchor="filed", event="ev", days=365, strict=True, name="flag")


@query(f"""{_UNIVERSE} SELECT cik, anchor, CAST(coalesce(anchor < ev AND ev <= horizon, false) AS INTEGER) AS flag FROM l""")
def join_event_horizon(spark, sf_dir):
    return _universe(spark, sf_dir).select("cik", "anchor", F.coalesce((F.col("anchor") < F.col("event")) & (F.col("event") <= F.add_months("anchor", 24)), F.lit(False)).cast("int").alias("flag"))


@query(f"""{ANCHORS} SELECT a.cik, anchor, coalesce(bool_or(status = 'F' AND filed <= anchor AND accession % 7 = 0), false) AS prior_event,
 count(*) FILTER (status = 'F' AND filed > anchor AND filed <= anchor + INTERVAL 1 YEAR) AS n_positive FROM a LEFT JOIN o ON a.cik = o.cik GROUP BY ALL""")
def join_nested_loop_theta(spark, sf_dir):
    o = orders(spark, sf_dir)
    f = F.col("status") == "F"
    return _anchors(spark, sf_dir).join(o, "cik", "left").groupBy("cik", "anchor").agg(
        F.coalesce(F.bool_or(f & (F.col("filed") <= F.col("anchor")) & (F.col("accession") % 7 == 0)), F.lit(False)).alias("prior_event"),
        F.count_if(f & (F.col("filed") > F.col("anchor")) & (F.col("filed") <= F.add_months("anchor", 12))).alias("n_positive"),
    )


@query(f"""{ANCHORS}, g AS (SELECT a.cik, anchor, coalesce(bool_or(status = 'F' AND filed <= anchor AND accession % 7 = 0), false) AS prior,
 coalesce(bool_or(status = 'F' AND filed > anchor AND filed <= anchor + INTERVAL 1 YEAR AND accession % 3 = 0), false) AS inside,
 coalesce(bool_or(status = 'P' AND filed > anchor), false) AS unresolved, coalesce(max(filed) >= anchor + INTERVAL 1 YEAR, false) AS followed FROM a LEFT JOIN o ON a.cik = o.cik GROUP BY a.cik, a.anchor)
SELECT cik, anchor, CASE WHEN prior THEN NULL WHEN inside THEN 1 WHEN unresolved THEN NULL WHEN NOT followed THEN NULL ELSE 0 END AS label,
 CASE WHEN prior THEN 'prior_event' WHEN inside THEN 'event_in_window' WHEN unresolved THEN 'unresolved' WHEN NOT followed THEN 'no_follow_up' ELSE 'followed_without_event' END AS reason FROM g""")
def label_decide(spark, sf_dir):
    f, at, d, k = F.col("status") == "F", F.col("anchor"), F.col("filed"), F.col("accession")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = _anchors(spark, sf_dir).join(orders(spark, sf_dir), "cik", "left").groupBy("cik", "anchor").agg(
        any_(f & (d <= at) & (k % 7 == 0)).alias("prior"), any_(f & (d > at) & (d <= F.add_months(at, 12)) & (k % 3 == 0)).alias("inside"),
        any_((F.col("status") == "P") & (d > at)).alias("unresolved"), F.coalesce(F.max(d) >= F.add_months(at, 12), F.lit(False)).alias("followed"),
    )
    label, reason = labels.decide(*[F.col(c) for c in ("prior", "inside", "unresolved", "followed")])
    return g.select("cik", "anchor", label.alias("label"), reason.alias("reason"))


@query("""SELECT event_id, event_type, ts, m.f AS matched_time, m.k AS latest_large FROM (SELECT a.event_id, a.event_type, a.ts,
 max(CASE WHEN value > 100 THEN struct_pack(f := ts, k := event_id) END) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS m FROM events a)""")
def join_asof_hot_key(spark, sf_dir):
    """The latest large value of its type strictly before each event: five keys, each of which is cut into stretches of time."""
    e = table(spark, sf_dir, "events")
    large = e.where("value > 100").select("event_type", "ts", F.col("event_id").alias("latest_large"))
    return asof.asof_backward(e.select("event_id", "event_type", "ts"), large, by="event_type", left_time="ts", right_time="ts", values=["latest_large"], tiebreak="latest_large", spread=True, large=1)
