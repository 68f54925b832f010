"""Label building, feature assembly and data audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.functions import scalar
from chronofold.operators import asof, labels
from chronofold.plans.base import ORDERS, day, orders, register, table
from chronofold.plans.time import ANCHORS, _anchors

from chronofold.plans.retrieval import _BM25
from chronofold.plans.texts import _IN

QUERIES: list = []
query = register(QUERIES)

_SEEN = "DATE '2000-12-31'"


@query(f"""WITH {ORDERS}, e AS (SELECT cik, filed AS ev, accession AS k FROM o WHERE status = 'F' AND accession % 2 = 0)
SELECT o.accession, o.cik, o.filed, max(CASE WHEN ev IS NOT NULL THEN 1 END) AS target, arg_min(k, (ev, k)) AS source FROM o LEFT JOIN e ON o.cik = e.cik AND ev > o.filed AND ev <= o.filed + INTERVAL 3 YEAR AND ev <= {_SEEN} GROUP BY ALL""")
def label_multi_target(spark, sf_dir):
    o = orders(spark, sf_dir)
    e = o.where("status = 'F' AND accession % 2 = 0").select("cik", F.col("filed").alias("ev"), F.col("accession").alias("k"))
    return labels.earliest_event(o.select("accession", "cik", "filed"), e, by="cik", anchor="filed", event="ev", source="k", years=3, observed_through=F.lit("2000-12-31").cast("date"))


@query(f"""{ANCHORS}, g AS (SELECT a.cik, a.anchor, coalesce(bool_or(filed < a.anchor AND filed >= a.anchor - INTERVAL 36 MONTH), false) AS has_prior, count(*) FILTER (filed > a.anchor AND filed <= a.anchor + INTERVAL 1 YEAR) AS n_inside
 FROM a LEFT JOIN o ON a.cik = o.cik GROUP BY a.cik, a.anchor) SELECT *, has_prior AND n_inside >= 2 AS reviewed FROM g""")
def label_coverage(spark, sf_dir):
    return labels.review_coverage(_anchors(spark, sf_dir), orders(spark, sf_dir), by="cik", anchor="anchor", filed="filed", years=1, least=2)


@query(f"""{ANCHORS}, m AS (SELECT a.cik, a.anchor, min(filed) FILTER (status = 'F' AND filed > a.anchor) AS ev, max(filed) AS last FROM a LEFT JOIN o ON a.cik = o.cik GROUP BY a.cik, a.anchor)
SELECT cik, anchor, CASE WHEN ev <= anchor + INTERVAL 1 YEAR THEN 'positive_event_cited' ELSE 'coverage_review_required' END AS state,
 list_filter([CASE WHEN last IS NULL OR last < anchor + INTERVAL 1 YEAR THEN 'horizon_open' END, CASE WHEN ev IS NULL THEN 'no_event' END], lambda x: x IS NOT NULL) AS reasons FROM m""")
def label_rows(spark, sf_dir):
    m = _anchors(spark, sf_dir).join(orders(spark, sf_dir), "cik", "left").groupBy("cik", "anchor").agg(
        F.min(F.when((F.col("status") == "F") & (F.col("filed") > F.col("anchor")), F.col("filed"))).alias("ev"), F.max("filed").alias("last")
    )
    end = F.add_months("anchor", 12)
    state = F.when(F.col("ev") <= end, "positive_event_cited").otherwise("coverage_review_required")
    reasons = scalar.failures({"horizon_open": F.col("last").isNull() | (F.col("last") < end), "no_event": F.col("ev").isNull()})
    return m.select("cik", "anchor", state.alias("state"), reasons.alias("reasons"))


@query("""SELECT doc_id, quality AS old, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1 END AS new FROM labels WHERE doc_id % 5 = 0 AND quality IS DISTINCT FROM CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1 END""")
def label_amend(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    fixes = marks.where("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 3 != 0, 1).alias("new"))
    return labels.amend(marks, fixes, key="doc_id")[1]


@query("""WITH r AS (SELECT user_id, event_id % 4 AS reviewer, CASE event_type WHEN 'signup' THEN 'correct' WHEN 'error' THEN 'unsure' ELSE 'approve' END AS verdict FROM events),
g AS (SELECT user_id, count(DISTINCT CASE WHEN verdict = 'approve' THEN reviewer END) AS n_reviewers, bool_or(verdict = 'correct') AS c, bool_or(verdict = 'unsure') AS u FROM r GROUP BY 1)
SELECT user_id, n_reviewers, CASE WHEN c THEN 'correction' WHEN u THEN 'uncertain' WHEN n_reviewers >= 2 THEN 'approved' ELSE 'pending' END AS state FROM g""")
def label_reviews(spark, sf_dir):
    kind = F.col("event_type")
    verdict = F.when(kind == "signup", "correct").when(kind == "error", "unsure").otherwise("approve")
    r = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("reviewer"), verdict.alias("verdict"))
    return labels.assess_reviews(r, unit="user_id", reviewer="reviewer", verdict="verdict")


_MONTHS = "q AS (SELECT o_custkey AS cik, last_day(CAST(o_orderdate AS DATE)) AS period, max(CAST(o_orderdate AS DATE)) AS filed, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM orders GROUP BY ALL)"


@query(f"WITH {_MONTHS} SELECT a.cik, a.period, max(b.period) AS prior_period FROM q a LEFT JOIN q b ON a.cik = b.cik AND b.period < a.period AND b.filed <= a.filed GROUP BY ALL")
def win_prev_period(spark, sf_dir):
    from chronofold.plans.time import _months

    out = asof.prior_band(_months(spark, sf_dir), by="cik", period="period", filed="filed", values=["cents"], days=(1, 100_000))
    return out.select("cik", "period", "prior_period")


@query(f"""WITH {_MONTHS}, b AS (SELECT a.cik, a.period, a.filed, max(struct_pack(p := b.period, f := b.filed)) AS m FROM q a LEFT JOIN q b ON a.cik = b.cik AND a.period - b.period BETWEEN 350 AND 380 AND b.filed <= a.filed GROUP BY ALL)
SELECT cik, period, greatest(filed, coalesce(m.f, filed)) AS latest_input FROM b""")
def win_max_input_date(spark, sf_dir):
    from chronofold.plans.time import _months

    rows = _months(spark, sf_dir).withColumn("input", F.col("filed"))
    out = asof.prior_band(rows, by="cik", period="period", filed="filed", values=["input"], days=(350, 380))
    return out.select("cik", "period", F.greatest("filed", F.coalesce("prior_input", "filed")).alias("latest_input"))


@query("""WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), p AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_max(event_type, event_id) AS kind FROM events GROUP BY ALL), m AS (SELECT e.user_id, e.d, arg_max(kind, p.d) AS kind FROM e LEFT JOIN p ON e.user_id = p.user_id AND p.d < e.d GROUP BY e.user_id, e.d)
SELECT user_id, d, CAST(coalesce(kind = 'click', false) AS INTEGER) AS is_click, CAST(coalesce(kind = 'view', false) AS INTEGER) AS is_view FROM m""")
def win_onehot_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", day("ts").alias("d"), "event_type", "event_id")
    kinds = e.groupBy("user_id", "d").agg(F.max_by("event_type", "event_id").alias("kind"))
    out = asof.asof_backward(e.select("user_id", "d").distinct(), kinds, by="user_id", left_time="d", right_time="d", values=["kind"])
    return out.select("user_id", "d", *[c.alias(f"is_{n}") for n, c in scalar.one_hot(F.col("kind"), ["click", "view"]).items()])


@query(f"""WITH {ORDERS}, d AS (SELECT cik, 4 * year(filed) + quarter(filed) AS n, CAST(sum(cents) AS BIGINT) AS flow FROM o GROUP BY ALL),
w AS (SELECT *, lag(n, 3) OVER x AS n3, CAST(sum(flow) OVER (x ROWS 3 PRECEDING) AS BIGINT) AS ttm FROM d WINDOW x AS (PARTITION BY cik ORDER BY n)) SELECT count(*) AS n_checked, 0::BIGINT AS n_broken FROM w WHERE n3 = n - 3 AND (n - 1) % 4 = 3""")
def audit_flow_identity(spark, sf_dir):
    """Trailing sums against year-to-date values: in a fourth quarter with all four, the two are equal."""
    from chronofold.operators.history import trailing_sum
    from chronofold.plans.time import _ytd

    o = orders(spark, sf_dir)
    d = o.groupBy("cik", (4 * F.year("filed") + F.quarter("filed")).alias("n")).agg(F.sum("cents").alias("flow"))
    t = trailing_sum(d, by="cik", number="n", value="flow", periods=4, name="ttm").where("ttm IS NOT NULL AND (n - 1) % 4 = 3")
    y = _ytd(spark, sf_dir).where("fq = 4").select("cik", (4 * F.col("fy") + 4).alias("n"), "ytd")
    return t.join(y, ["cik", "n"]).agg(F.count("*").alias("n_checked"), F.count_if(F.col("ttm") != F.col("ytd")).alias("n_broken"))


@query(f"""{ANCHORS}, s AS (SELECT a.cik, a.anchor, sum(cents) FILTER (status = 'F') AS b, sum(cents) FILTER (status = 'O') AS s FROM a LEFT JOIN o ON a.cik = o.cik AND filed <= a.anchor AND filed >= a.anchor - 365 GROUP BY a.cik, a.anchor)
SELECT cik, anchor, CASE WHEN coalesce(b, 0) + coalesce(s, 0) = 0 THEN 0 ELSE round((coalesce(b, 0) - coalesce(s, 0)) / (coalesce(b, 0) + coalesce(s, 0)), 6) END AS net_flow FROM s""")
def feat_insider(spark, sf_dir):
    """Net flow of the year up to and with each anchor; 0 without any."""
    o = orders(spark, sf_dir).select(F.col("cik").alias("_c"), "filed", "status", "cents")
    inside = (F.col("_c") == F.col("cik")) & (F.col("filed") <= F.col("anchor")) & (F.col("filed") >= F.date_sub("anchor", 365))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("cents"))), F.lit(0))
    g = _anchors(spark, sf_dir).join(o, inside, "left").groupBy("cik", "anchor").agg(part("F").alias("b"), part("O").alias("s"))
    return g.select("cik", "anchor", F.coalesce(F.round(F.try_divide((F.col("b") - F.col("s")).cast("double"), F.col("b") + F.col("s")), 6), F.lit(0.0)).alias("net_flow"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(1 + c_acctbal), 6) END AS log_balance, n AS n_orders, list_filter([CASE WHEN c_acctbal <= 0 THEN 'no_balance' END, CASE WHEN n IS NULL THEN 'no_orders' END], lambda x: x IS NOT NULL) AS reasons
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def feat_assemble(spark, sf_dir):
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    reasons = scalar.failures({"no_balance": F.col("c_acctbal") <= 0, "no_orders": F.col("n_orders").isNull()})
    return c.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.round(F.log1p("c_acctbal"), 6)).alias("log_balance"), "n_orders", reasons.alias("reasons"))


@query(f"WITH {ORDERS} SELECT max(filed) FILTER (filed < DATE '1999-01-01') < min(filed) FILTER (filed >= DATE '1999-01-01') AS in_order FROM o")
def chronology_guard(spark, sf_dir):
    cut = F.col("filed") < "1999-01-01"
    return orders(spark, sf_dir).agg((F.max(F.when(cut, F.col("filed"))) < F.min(F.when(~cut, F.col("filed")))).alias("in_order"))


@query(f"""WITH {_BM25}, l AS (SELECT doc_id AS key, coalesce(len(list_filter(w, lambda x: x IN ({_IN}))) / nullif(len(w), 0), 0) AS density FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))
SELECT query, round(coalesce(avg(density), 0), 8) AS density FROM q LEFT JOIN (SELECT query, density FROM b JOIN l USING (key) WHERE rank <= 5) USING (query) GROUP BY query""")
def feat_rag_sentiment(spark, sf_dir):
    """Lexicon density over the passages that are found for each question; 0 without any."""
    from chronofold.functions import text
    from chronofold.operators import retrieval as r
    from chronofold.plans.retrieval import _index, _queries
    from chronofold.plans.texts import NEGATIVE

    q = _queries(spark, sf_dir)
    top = r.bm25(q, _index(spark, sf_dir), k=5)
    rows = top.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), text.lexicon_density(F.col("text"), NEGATIVE).alias("density")), "key")
    return q.select("query").join(rows.groupBy("query").agg(F.avg("density").alias("d")), "query", "left").select("query", F.round(F.coalesce("d", F.lit(0.0)), 8).alias("density"))
