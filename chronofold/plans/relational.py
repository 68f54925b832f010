"""Filters, projections, joins, aggregates, set operations, samples and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.functions import scalar
from chronofold.operators import fanout, guards, history, sampling
from chronofold.plans.base import ORDERS, day, orders, register, table

QUERIES: list = []
query = register(QUERIES)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


# ------------------------------------------------------------ filters and projections


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND l_quantity >= 10""")
def filter_fact_scope(spark, sf_dir):
    """A conjunction of fact filters; each is applied only if its column exists, decided from the schema."""
    df = _lines(spark, sf_dir)
    for column, condition in (("l_returnflag", F.col("l_returnflag").isin("A", "R")), ("l_linestatus", F.col("l_linestatus") == "F"), ("l_shipdate", day("l_shipdate") >= "1996-01-01"), ("l_quantity", F.col("l_quantity") >= 10), ("l_segment", F.lit(True))):
        if column in df.columns:
            df = df.where(condition)
    return df.select("l_orderkey", "l_linenumber", "l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9, 14, 19, 23, 36, 45, 49)")
def filter_tag_set(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size").isin(1, 5, 9, 14, 19, 23, 36, 45, 49)).select("p_partkey", "p_brand")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE TRY_CAST(substr(c_name, -4) AS INTEGER) IS NOT NULL AND TRY_CAST(substr(c_name, -4) AS INTEGER) NOT BETWEEN 600 AND 699")
def filter_industry(spark, sf_dir):
    code = F.expr("try_cast(substr(c_name, -4) AS int)")
    return table(spark, sf_dir, "customer").where(code.isNotNull() & ~code.between(600, 699)).select("c_custkey", "c_nationkey")


@query(f"WITH {ORDERS} SELECT accession, filed FROM o WHERE filed >= DATE '1997-01-01' AND filed < DATE '1998-01-01'")
def filter_between_left(spark, sf_dir):
    return orders(spark, sf_dir).where("filed >= DATE'1997-01-01' AND filed < DATE'1998-01-01'").select("accession", "filed")


_ROLE = "CASE accession % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'final' END"


@query(f"WITH {ORDERS}, r AS (SELECT accession, {_ROLE} AS role, CAST(cents AS VARCHAR) AS outcome FROM o) SELECT accession, role, TRY_CAST(outcome AS BIGINT) AS outcome FROM r WHERE role <> 'final'")
def filter_before_cast(spark, sf_dir):
    """Outcomes stay text until the rows that may be read are chosen."""
    rows = orders(spark, sf_dir).select("accession", F.expr(_ROLE).alias("role"), F.col("cents").cast("string").alias("outcome"))
    return rows.where("role <> 'final'").withColumn("outcome", F.expr("try_cast(outcome AS bigint)"))


@query(f"WITH {ORDERS} SELECT accession, filed, CAST(DATE '1998-06-30' - filed AS INTEGER) AS age_days FROM o WHERE filed <= DATE '1998-06-30' AND DATE '1998-06-30' - filed <= 180")
def staleness_filter(spark, sf_dir):
    age = F.datediff(F.lit("1998-06-30").cast("date"), "filed")
    return orders(spark, sf_dir).select("accession", "filed", age.alias("age_days")).where("age_days BETWEEN 0 AND 180")


@query(f"WITH {ORDERS} SELECT accession, coalesce(least(CASE WHEN status <> 'O' THEN filed END, DATE '1998-12-31'), DATE '1998-12-31') AS observed FROM o")
def clip_upper_date(spark, sf_dir):
    end = F.lit("1998-12-31").cast("date")
    return orders(spark, sf_dir).select("accession", F.coalesce(F.least(F.when(F.col("status") != "O", F.col("filed")), end), end).alias("observed"))


_FIN = """f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS assets, l_extendedprice * l_discount AS retained, l_quantity * 100 AS ebit,
 l_extendedprice * l_tax AS liabilities, CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.5 END AS current_a, l_extendedprice * 0.3 AS current_b, l_quantity AS sales FROM lineitem)"""


def _financials(spark, sf_dir):
    p = F.col("l_extendedprice")
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), p.alias("assets"), (p * F.col("l_discount")).alias("retained"), (F.col("l_quantity") * 100).alias("ebit"),
        (p * F.col("l_tax")).alias("liabilities"), F.when(F.col("l_returnflag") == "R", p * 0.5).alias("current_a"), (p * 0.3).alias("current_b"), F.col("l_quantity").alias("sales"),
    )


@query(f"""WITH {_FIN} SELECT k, n, round((coalesce(current_a, current_b) - liabilities) / nullif(assets, 0), 6) AS x1, round(retained / nullif(assets, 0), 6) AS x2, round(ebit / nullif(assets, 0), 6) AS x3,
 round((assets - liabilities) / nullif(liabilities, 0), 6) AS x4, round(sales / nullif(assets, 0), 6) AS x5 FROM f""")
def project_altman(spark, sf_dir):
    f = _financials(spark, sf_dir).withColumns({"current": F.coalesce("current_a", "current_b"), "equity": F.col("assets") - F.col("liabilities")})
    out = history.altman_components(f, current_assets="current", current_liabilities="liabilities", assets="assets", retained=["retained"], ebit=["ebit"], equity="equity", liabilities="liabilities", sales=["sales"])
    return out.select("k", "n", *[F.round(f"x{i}", 6).alias(f"x{i}") for i in range(1, 6)])


@query(f"""WITH {_FIN} SELECT k, n, CASE WHEN assets > 0 AND liabilities > 0 THEN round(6.56 * (current_b - liabilities) / assets + 3.26 * retained / assets + 6.72 * ebit / assets + 1.05 * (assets - liabilities) / liabilities, 5) END AS z FROM f""")
def project_altman_z2(spark, sf_dir):
    f = _financials(spark, sf_dir)
    z = history.altman_z2(F.col("current_b") - F.col("liabilities"), F.col("retained"), F.col("ebit"), F.col("assets"), F.col("liabilities"))
    return f.select("k", "n", F.round(z, 5).alias("z"))


@query(f"""WITH {_FIN} SELECT k, n, round(current_b / nullif(liabilities, 0), 6) AS current_ratio, round(liabilities / nullif(assets, 0), 6) AS leverage,
 CASE WHEN sales > 20 THEN round(ebit / sales, 6) END AS coverage, CASE WHEN current_a IS NOT NULL THEN 'reported' ELSE 'proxy' END AS method FROM f""")
def project_ratios(spark, sf_dir):
    return _financials(spark, sf_dir).select(
        "k", "n", F.round(F.try_divide("current_b", "liabilities"), 6).alias("current_ratio"), F.round(F.try_divide("liabilities", "assets"), 6).alias("leverage"),
        F.when(F.col("sales") > 20, F.round(F.col("ebit") / F.col("sales"), 6)).alias("coverage"), F.when(F.col("current_a").isNotNull(), "reported").otherwise("proxy").alias("method"),
    )


@query(f"""WITH {_FIN} SELECT k, n, CASE WHEN assets > 0 THEN round((ebit - sales) / assets, 6) END AS accruals, CASE WHEN assets > 0 THEN round((liabilities - retained) / assets, 6) END AS net_debt,
 CASE WHEN retained > 0 THEN round(greatest(-(ebit - assets), 0) / retained, 6) END AS burn FROM f""")
def project_derived3(spark, sf_dir):
    a, r = F.col("assets"), F.col("retained")
    return _financials(spark, sf_dir).select(
        "k", "n", F.when(a > 0, F.round((F.col("ebit") - F.col("sales")) / a, 6)).alias("accruals"), F.when(a > 0, F.round((F.col("liabilities") - r) / a, 6)).alias("net_debt"),
        F.when(r > 0, F.round(F.greatest(-(F.col("ebit") - a), F.lit(0.0)) / r, 6)).alias("burn"),
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(ln(1 + c_acctbal), 6) END AS log_from_zero, CASE WHEN c_acctbal > 0 THEN round(ln(1 + c_acctbal), 6) END AS log_above_zero FROM customer")
def project_log1p(spark, sf_dir):
    a = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(a >= 0, F.round(F.log1p(a), 6)).alias("log_from_zero"), F.when(a > 0, F.round(F.log1p(a), 6)).alias("log_above_zero"))


@query("""SELECT k, round((CASE WHEN a IS NULL THEN 1 ELSE 0 END + CASE WHEN b IS NULL THEN 1 ELSE 0 END + CASE WHEN c IS NULL THEN 1 ELSE 0 END + CASE WHEN d IS NULL THEN 1 ELSE 0 END) / 4.0, 6) AS missing
FROM (SELECT event_id AS k, CASE WHEN value > 50 THEN value END AS a, CASE WHEN event_type = 'view' THEN 1 END AS b, CASE WHEN user_id % 3 = 0 THEN 1 END AS c, ts AS d FROM events)""")
def missing_fraction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.when(F.col("value") > 50, F.col("value")).alias("a"), F.when(F.col("event_type") == "view", 1).alias("b"), F.when(F.col("user_id") % 3 == 0, 1).alias("c"), F.col("ts").alias("d"))
    return e.select("k", F.round(scalar.missing_fraction(["a", "b", "c", "d"]), 6).alias("missing"))


@query("SELECT event_id, user_id, value FROM events")
def schema_project_ordered(spark, sf_dir):
    return guards.require_columns(table(spark, sf_dir, "events"), ["event_id", "user_id", "value"]).select("event_id", "user_id", "value")


@query("SELECT name, missing FROM (VALUES ('nation', NULL), ('orders', 'missing columns: n_name, n_nationkey'), ('region', 'missing columns: n_name, n_nationkey')) t(name, missing)")
def guard_required(spark, sf_dir):
    """What is missing of the same required columns in three tables; a table that has them all passes."""

    def missing(name):
        try:
            guards.require_columns(table(spark, sf_dir, name), ["n_nationkey", "n_name"])
        except ValueError as e:
            return str(e)
        return None

    return spark.createDataFrame([(n, missing(n)) for n in ("nation", "orders", "region")], "name string, missing string")


@query("""SELECT 'positive_price' AS rule, count(*) FILTER (NOT coalesce(l_extendedprice > 0, false)) AS n_bad FROM lineitem UNION ALL SELECT 'discount_domain', count(*) FILTER (NOT coalesce(l_discount BETWEEN 0 AND 0.05, false)) FROM lineitem
UNION ALL SELECT 'dated', count(*) FILTER (l_shipdate IS NULL) FROM lineitem""")
def audit_rules(spark, sf_dir):
    return guards.violations(_lines(spark, sf_dir), {"positive_price": F.col("l_extendedprice") > 0, "discount_domain": F.col("l_discount").between(0, 0.05), "dated": F.col("l_shipdate").isNotNull()})


guard_domain = audit_rules


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def guard_unique(spark, sf_dir):
    return guards.duplicated_keys(_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@query("SELECT 'ts' AS rule, count(*) FILTER (TRY_CAST(left(CAST(ts AS VARCHAR), 10) AS DATE) IS NULL) AS n_bad FROM events")
def guard_dates(spark, sf_dir):
    return guards.violations(table(spark, sf_dir, "events"), {"ts": F.expr("try_cast(left(cast(ts AS string), 10) AS date) IS NOT NULL")})


@query("SELECT event_type, list_filter([CASE WHEN n < 2050 THEN 'too_few' END, CASE WHEN m < 49 THEN 'low_mean' END], lambda x: x IS NOT NULL) AS failures FROM (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL)")
def policy_gate(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return g.select("event_type", scalar.failures({"too_few": F.col("n") < 2050, "low_mean": F.col("m") < 49}).alias("failures"))


# ------------------------------------------------------------ joins


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def join_inner(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_left_m1(spark, sf_dir):
    """Many to one; the one side is checked before the join."""
    c = guards.assert_unique(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def join_11(spark, sf_dir):
    d = guards.assert_unique(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"])
    return d.join(guards.assert_unique(table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"]), "doc_id")


@query("SELECT c_custkey, o_orderkey, s_suppkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' LEFT JOIN supplier ON s_nationkey = c_nationkey")
def join_left_fanout(spark, sf_dir):
    """Rows multiply over both partners, and stay so."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    both = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return fanout.left_fanout(both, s, left_key="c_nationkey", right_key="s_nationkey").select("c_custkey", "o_orderkey", "s_suppkey")


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AS present, coalesce(d.doc_id % 2, -1) IS NOT DISTINCT FROM l.quality AS same FROM documents d LEFT JOIN labels l USING (doc_id)""")
def join_outer_indicator(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("_m"))
    return d.join(marks, "doc_id", "left").select("doc_id", F.col("_m").isNotNull().alias("present"), (F.col("doc_id") % 2).eqNullSafe(F.col("quality")).alias("same"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, f AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_map_lookup(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(day("o_orderdate")).alias("first_order"))
    return table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "first_order")


@query("""SELECT o_orderkey, count(DISTINCT l_quantity) = 1 AND min(l_quantity) = 10 AS matches FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1""")
def join_cell_recon(spark, sf_dir):
    facts = _lines(spark, sf_dir).where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set("l_quantity").alias("v"))
    return table(spark, sf_dir, "orders").join(facts, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", (F.col("v") == F.array(F.lit(10.0))).alias("matches"))


@query(f"""WITH {ORDERS} SELECT count(*) AS n_rows, count(*) FILTER (c_custkey IS NULL) AS n_missing, count(*) FILTER (c_nationkey <> cik % 25) AS n_mismatch FROM o LEFT JOIN customer ON c_custkey = cik""")
def join_exact_document(spark, sf_dir):
    j = orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("cik") == F.col("c_custkey"), "left")
    return j.agg(F.count("*").alias("n_rows"), F.count_if(F.col("c_custkey").isNull()).alias("n_missing"), F.count_if(F.col("c_nationkey") != F.col("cik") % 25).alias("n_mismatch"))


@query(f"""WITH {ORDERS}, e AS (SELECT cik, min(filed) AS d, arg_min(accession, (filed, accession)) AS k FROM o WHERE status = 'F' GROUP BY cik), c AS (SELECT cik, min(filed) AS listed FROM o GROUP BY cik)
SELECT cik, CASE WHEN d IS NULL THEN listed ELSE d END AS event_date, CASE WHEN d IS NULL THEN 'listed_only' WHEN d <> listed THEN 'conflict' ELSE 'agree' END AS state, k AS source FROM c LEFT JOIN e USING (cik)""")
def join_reconcile_date(spark, sf_dir):
    o = orders(spark, sf_dir)
    e = o.where("status = 'F'").groupBy("cik").agg(F.min("filed").alias("d"), F.min_by("accession", F.struct("filed", "accession")).alias("source"))
    c = o.groupBy("cik").agg(F.min("filed").alias("listed"))
    state = F.when(F.col("d").isNull(), "listed_only").when(F.col("d") != F.col("listed"), "conflict").otherwise("agree")
    return c.join(e, "cik", "left").select("cik", F.coalesce("d", "listed").alias("event_date"), state.alias("state"), "source")


# ------------------------------------------------------------ aggregates


@query(f"WITH {ORDERS} SELECT cik, arg_min(accession, (filed, accession)) AS accession FROM o GROUP BY cik")
def agg_first_record(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("cik").agg(F.min_by("accession", F.struct("filed", "accession")).alias("accession"))


@query(f"WITH {ORDERS} SELECT cik, arg_max(accession, (filed, accession)) AS accession FROM o GROUP BY cik")
def agg_last_record(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("cik").agg(F.max_by("accession", F.struct("filed", "accession")).alias("accession"))


@query("""SELECT l_orderkey, arg_min(l_quantity, l_linenumber) FILTER (l_returnflag = 'A') AS A, arg_min(l_quantity, l_linenumber) FILTER (l_returnflag = 'N') AS N, arg_min(l_quantity, l_linenumber) FILTER (l_returnflag = 'R') AS R
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY 1""")
def pivot_first(spark, sf_dir):
    rows = _lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.max("l_quantity").alias("l_quantity"))
    return rows.groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.min_by("l_quantity", "l_linenumber"))


_CENTS = "x AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"


@query(f"WITH {_CENTS} SELECT l_orderkey, l_linenumber, min(cents) AS cents FROM x GROUP BY ALL HAVING min(cents) = max(cents)")
def agg_conflict_quarantine(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return history.quarantine(rows, ["l_orderkey", "l_linenumber"], "cents")[0]


@query("""WITH g AS (SELECT l_orderkey, count(DISTINCT l_quantity) FILTER (l_returnflag = 'A') AS na, min(l_quantity) FILTER (l_returnflag = 'A') AS va, count(DISTINCT l_quantity) FILTER (l_returnflag = 'N') AS nn, min(l_quantity) FILTER (l_returnflag = 'N') AS vn FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN na > 1 THEN NULL WHEN na = 1 THEN va WHEN nn > 1 THEN NULL WHEN nn = 1 THEN vn END AS value FROM g""")
def agg_set_conflict(spark, sf_dir):
    """The first tag by priority with a single value; a conflicting tag ends the search."""
    of = lambda f: F.when(F.col("l_returnflag") == f, F.col("l_quantity"))
    g = _lines(spark, sf_dir).groupBy("l_orderkey").agg(*[x for f in "AN" for x in (F.size(F.collect_set(of(f))).alias(f"n{f}"), F.min(of(f)).alias(f"v{f}"))])
    return g.select("l_orderkey", history.first_unconflicted([(F.col("nA"), F.col("vA")), (F.col("nN"), F.col("vN"))]).alias("value"))


@query("SELECT o_orderkey, round(1.0 / count(*) OVER (PARTITION BY o_custkey), 6) AS weight FROM orders")
def agg_group_size_weight(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return o.join(n, "o_custkey").select("o_orderkey", F.round(1.0 / F.col("n"), 6).alias("weight"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS companies, count(*) FILTER (o_orderstatus = 'F') AS positives, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS positive_companies FROM orders")
def agg_conditional_counts(spark, sf_dir):
    pos = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("companies"), F.count_if(pos).alias("positives"), F.count_distinct(F.when(pos, F.col("o_custkey"))).alias("positive_companies"))


@query("SELECT o_orderpriority AS role, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS positive, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS negative, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS unknown FROM orders GROUP BY 1")
def agg_role_counts(spark, sf_dir):
    s, c = F.col("o_orderstatus"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role")).agg(F.count_distinct(F.when(s == "F", c)).alias("positive"), F.count_distinct(F.when(s == "O", c)).alias("negative"), F.count_if(~s.isin("F", "O")).alias("unknown"))


@query("SELECT c_mktsegment AS stratum, c_nationkey AS role, count(*) AS requested, count(n) AS with_snapshots, count(*) FILTER (n >= 10) AS eligible FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY ALL")
def agg_attrition(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy(F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("role")).agg(F.count("*").alias("requested"), F.count("n").alias("with_snapshots"), F.count_if(F.col("n") >= 10).alias("eligible"))


@query("SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS detected, count(*) AS n FROM (SELECT user_id, bool_or(value > 200) AS hit FROM events WHERE event_type = 'purchase' GROUP BY 1)")
def agg_any_by_entity(spark, sf_dir):
    g = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.bool_or(F.col("value") > 200).alias("hit"))
    return g.agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("detected"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type IN ('purchase', 'signup')) AS b, sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'click') AS s FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1)
SELECT user_id, CASE WHEN coalesce(b, 0) + coalesce(s, 0) = 0 THEN 0 ELSE round((coalesce(b, 0) - coalesce(s, 0)) / (coalesce(b, 0) + coalesce(s, 0)), 6) END AS net_flow FROM s""")
def agg_net_flow(spark, sf_dir):
    cents, kind = F.round(F.col("value") * 100).cast("long"), F.col("event_type")
    e = table(spark, sf_dir, "events").where(day("ts").between("2024-01-10", "2024-01-20"))
    g = e.groupBy("user_id").agg(F.coalesce(F.sum(F.when(kind.isin("purchase", "signup"), cents)), F.lit(0)).alias("b"), F.coalesce(F.sum(F.when(kind == "click", cents)), F.lit(0)).alias("s"))
    return g.select("user_id", F.coalesce(F.round(F.try_divide((F.col("b") - F.col("s")).cast("double"), F.col("b") + F.col("s")), 6), F.lit(0.0)).alias("net_flow"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY 1")
def agg_quantiles(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("q"))
    q = lambda i: F.col("q")[i]
    return g.select("event_type", F.round(q(0), 6).alias("q25"), F.round(q(1), 6).alias("q50"), F.round(q(2), 6).alias("q75"), F.round(q(2) - q(0), 6).alias("iqr"))


@query("SELECT round(avg(CASE WHEN value <= 50 THEN 1.0 ELSE 0.0 END), 6) AS low_value, round(avg(CASE WHEN event_type <> 'view' THEN 1.0 ELSE 0.0 END), 6) AS not_view FROM events")
def agg_missing_fraction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("value") > 50, 1).alias("low_value"), F.when(F.col("event_type") == "view", 1).alias("not_view"))
    return e.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in e.columns])


@query("SELECT user_id AS path, count(DISTINCT event_type) AS n_hashes FROM events WHERE value > 300 GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def agg_proof_conflict(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 300").groupBy(F.col("user_id").alias("path")).agg(F.count_distinct("event_type").alias("n_hashes")).where("n_hashes > 1")


@query("SELECT CAST(o_orderdate AS DATE) AS document, list_sort(list(DISTINCT o_custkey)) AS affected FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def agg_queue_affected(spark, sf_dir):
    """A day's filings are a document, so a list is as long as a day has customers."""
    p = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return p.groupBy(day("o_orderdate").alias("document")).agg(F.array_sort(F.collect_set("o_custkey")).alias("affected"))


@query(f"WITH {ORDERS} SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, count(DISTINCT cik) AS companies, max(filed) AS latest FROM o")
def agg_totals(spark, sf_dir):
    return orders(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.count_distinct("cik").alias("companies"), F.max("filed").alias("latest"))


# ------------------------------------------------------------ sorts and sets


@query(f"WITH {ORDERS} SELECT accession, filed FROM o ORDER BY filed, accession")
def sort_multi(spark, sf_dir):
    return orders(spark, sf_dir).select("accession", "filed").orderBy("filed", "accession")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def topk_stable(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(50)


@query("SELECT user_id, arg_max(event_id, (value, event_id)) AS best FROM events GROUP BY 1")
def topk_argbest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def limit_recent_notifications(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(100)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 2000")
def limit_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id").orderBy("event_id").limit(2000)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, sf_dir):
    return set_union_all(spark, sf_dir).dropDuplicates(["k"])


@query("SELECT count(*) AS n_overlap FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_intersect_guard(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'P'").select("o_custkey")).agg(F.count("*").alias("n_overlap"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT count(*) = 0 AS is_subset FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_subset_guard(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id", "left_anti").agg((F.count("*") == 0).alias("is_subset"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1")
def set_drop_all_duplicates(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n = 1").drop("n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def set_reconcile_ledgers(spark, sf_dir):
    marks = table(spark, sf_dir, "labels")
    reviewed = marks.where("quality = 1").select("doc_id").unionByName(marks.where("toxic = 1").select("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(reviewed, "doc_id", "left_anti")


# ------------------------------------------------------------ hashes, samples, splits

_MOD = "list_reduce(list_transform(string_split({0}, ''), lambda d: CAST(strpos('0123456789abcdef', d) - 1 AS BIGINT)), lambda a, d: (a * 16 + d) % {1})"
_HASH = "sha256(concat('7:', {0}, ':', c_custkey))"


@query(f"SELECT c_custkey, CAST({_MOD.format(_HASH.format(repr('fold')), 5)} AS INTEGER) AS fold FROM customer")
def hash_fold(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sampling.hash_mod(sampling.digest("7", "fold", F.col("c_custkey")), 5).alias("fold"))


@query(f"SELECT c_custkey, CASE CAST({_MOD.format(_HASH.format(repr('role')), 3)} AS INTEGER) WHEN 0 THEN 'train' WHEN 1 THEN 'calibrate' ELSE 'final' END AS role FROM customer")
def hash_role(spark, sf_dir):
    m = sampling.hash_mod(sampling.digest("7", "role", F.col("c_custkey")), 3)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(m == 0, "train").when(m == 1, "calibrate").otherwise("final").alias("role"))


_UNI = "CAST(CAST(concat('0x', substr({0}, 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496"


@query(f"SELECT c_custkey, round({_UNI.format(_HASH.format(repr('u')))}, 9) AS u FROM customer")
def hash_uniform(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(sampling.hash_uniform(sampling.digest("7", "u", F.col("c_custkey"))), 9).alias("u"))


@query(f"""SELECT c_custkey, pi, round(1 / pi, 6) AS weight FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE CAST(0.2 AS DOUBLE) END AS pi, {_UNI.format(_HASH.format(repr('u')))} AS u FROM customer) WHERE u < pi""")
def sample_bernoulli(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.2).alias("pi"), sampling.hash_uniform(sampling.digest("7", "u", F.col("c_custkey"))).alias("u"))
    return c.where("u < pi").select("c_custkey", "pi", F.round(1 / F.col("pi"), 6).alias("weight"))


@query("SELECT c_custkey, round(CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE CAST(0.1 AS DOUBLE) END + (1 - CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE 0.1 END) * 0.3, 6) AS pi FROM customer")
def sample_union_prob(spark, sf_dir):
    p = F.when(F.col("c_mktsegment") == "BUILDING", 0.5).otherwise(0.1)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(sampling.inclusion_union(p, F.lit(0.3)), 6).alias("pi"))


@query("""WITH a AS (SELECT c_custkey AS k, CAST(0.2 AS DOUBLE) AS p, 1 AS phase FROM customer WHERE c_custkey % 5 = 0), b AS (SELECT c_custkey AS k, CAST(0.1 AS DOUBLE) AS p, 2 AS phase FROM customer WHERE c_custkey % 10 = 3)
SELECT k, phase, round(1 / (0.2 + 0.8 * 0.1), 6) AS weight FROM (FROM a UNION ALL FROM b)""")
def sample_reweight_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    both = c.where("k % 5 = 0").withColumn("phase", F.lit(1)).unionByName(c.where("k % 10 = 3").withColumn("phase", F.lit(2)))
    guards.assert_unique(both, ["k"])
    return both.withColumn("weight", F.round(1 / sampling.inclusion_union(F.lit(0.2), F.lit(0.1)), 6))


@query("SELECT c_custkey, d AS digest FROM (SELECT c_custkey, sha256(concat('7:', c_custkey)) AS d FROM customer) ORDER BY d LIMIT 40")
def win_rank_hash(spark, sf_dir):
    return sampling.rank_sample(table(spark, sf_dir, "customer"), "c_custkey", "7", 40)


@query("SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(concat('7:', c_custkey))) AS n FROM customer) WHERE n <= 6")
def sample_case_head(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return sampling.head_per_group(c, ["c_mktsegment"], [sampling.digest("7", F.col("c_custkey"))], 6)


@query("SELECT c_custkey FROM (SELECT c_custkey, sha256(concat('9:', c_custkey)) AS d FROM customer) ORDER BY d LIMIT (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) FROM customer)")
def split_commit_holdout(spark, sf_dir):
    import math

    c = table(spark, sf_dir, "customer")
    return sampling.rank_sample(c, "c_custkey", "9", math.ceil(c.count() * 0.2)).select("c_custkey")


@query(f"""WITH {ORDERS}, p AS (SELECT accession, year(filed) AS y, dense_rank() OVER (ORDER BY year(filed)) - 1 AS n FROM o), s AS (SELECT DISTINCT n FROM p WHERE n >= 4)
SELECT s.n AS split, CASE WHEN p.n = s.n THEN 'test' ELSE 'train' END AS role, count(*) AS n_rows FROM p JOIN s ON p.n <= s.n GROUP BY ALL""")
def split_walk_forward(spark, sf_dir):
    out = sampling.walk_forward(orders(spark, sf_dir), F.year("filed"), 4)
    return out.groupBy(F.col("split").cast("long").alias("split"), "role").agg(F.count("*").alias("n_rows"))


@query(f"""WITH {ORDERS}, h AS (SELECT cik, (row_number() OVER (ORDER BY sha256(CAST(cik AS VARCHAR))) - 1) % 3 AS cohort FROM (SELECT DISTINCT cik FROM o)), c AS (SELECT DISTINCT cohort FROM h),
x AS (SELECT y, make_date(y, 1, 1) AS cutoff FROM (VALUES (1999), (2000)) AS v(y)), j AS (SELECT o.*, h.cohort, filed + INTERVAL 1 YEAR AS available FROM o JOIN h USING (cik))
SELECT x.y AS test_year, c.cohort AS held, count(*) FILTER (j.cohort <> c.cohort AND filed < cutoff AND available < cutoff) AS n_train, count(*) FILTER (j.cohort = c.cohort AND year(filed) = x.y) AS n_test FROM j, x, c GROUP BY ALL""")
def split_company_walk_forward(spark, sf_dir):
    """Held cohorts by year: training rows are of other companies, filed and labelled before the year."""
    o = orders(spark, sf_dir)
    rows = o.join(sampling.cohorts(o, "cik", 3), "cik").withColumn("available", F.add_months("filed", 12))
    splits = F.explode(F.array(*[F.struct(F.lit(y).alias("test_year"), F.lit(c).alias("held")) for y in (1999, 2000) for c in range(3)]))
    rows = rows.withColumn("s", splits).select("*", F.col("s.test_year"), F.col("s.held"), F.make_date("s.test_year", F.lit(1), F.lit(1)).alias("cutoff"))
    train = (F.col("cohort") != F.col("held")) & (F.col("filed") < F.col("cutoff")) & (F.col("available") < F.col("cutoff"))
    test = (F.col("cohort") == F.col("held")) & (F.year("filed") == F.col("test_year"))
    return rows.groupBy("test_year", F.col("held").cast("long").alias("held")).agg(F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"))


@query(f"""SELECT c_custkey, CASE WHEN m = 3 THEN 'final' WHEN c_acctbal < 0 THEN 'unused' WHEN m = 2 THEN 'calibrate' ELSE 'fit' END AS role FROM (SELECT *, CAST({_MOD.format(_HASH.format(repr('part')), 4)} AS INTEGER) AS m FROM customer)""")
def split_roles_time(spark, sf_dir):
    m = sampling.hash_mod(sampling.digest("7", "part", F.col("c_custkey")), 4)
    role = F.when(m == 3, "final").when(F.col("c_acctbal") < 0, "unused").when(m == 2, "calibrate").otherwise("fit")
    return table(spark, sf_dir, "customer").select("c_custkey", role.alias("role"))


@query("""WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(concat('7:', c_custkey))) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS t FROM customer)
SELECT c_custkey, CASE WHEN n <= t * 0.6 THEN 'train' WHEN n <= t * 0.8 THEN 'validate' ELSE 'test' END AS role FROM r""")
def split_stratified(spark, sf_dir):
    """60/20/20 within each class by hash order."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    w = Window.partitionBy("c_mktsegment")
    c = c.withColumns({"n": F.row_number().over(w.orderBy(sampling.digest("7", F.col("c_custkey")))), "t": F.count("*").over(w)})
    return c.select("c_custkey", F.when(F.col("n") <= F.col("t") * 0.6, "train").when(F.col("n") <= F.col("t") * 0.8, "validate").otherwise("test").alias("role"))


# ------------------------------------------------------------ scalar functions


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer")
def fn_zfill(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.zfill(F.col("c_custkey").cast("string"), 10).alias("cik"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik FROM customer")
def fn_norm_cik(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.lit("0.0")).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")))
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.normalize_cik(raw).alias("cik"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE replace(upper(p_brand), '#', '-') END AS ticker FROM part")
def fn_norm_ticker(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit("no ticker!")).otherwise(F.concat(F.lit(" "), F.lower(F.replace("p_brand", F.lit("#"), F.lit("."))), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.normalize_ticker(raw).alias("ticker"))


@query("SELECT c_custkey, concat('customer ', lpad(CAST(c_custkey AS VARCHAR), 9, '0'), ' corp co') AS name FROM customer")
def fn_legal_name(spark, sf_dir):
    raw = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(" CORPORATION,  Company /DE/"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.legal_name(raw).alias("name"))


@query(f"WITH {ORDERS} SELECT accession, concat(year(filed), 'Q', quarter(filed)) AS quarter, CAST(date_trunc('quarter', filed) - INTERVAL 1 MONTH AS DATE) AS last_completed FROM o")
def fn_quarter_label(spark, sf_dir):
    return orders(spark, sf_dir).select("accession", scalar.quarter_label(F.col("filed")).alias("quarter"), scalar.last_completed_quarter(F.col("filed")).alias("last_completed"))


@query("""SELECT event_id, CASE WHEN value > 0 AND value <= 25 THEN 0 WHEN value > 25 AND value <= 100 THEN 1 WHEN value > 100 AND value <= 500 THEN 2 END AS right_closed,
 CASE WHEN value >= 0 AND value < 25 THEN 0 WHEN value >= 25 AND value < 100 THEN 1 WHEN value >= 100 AND value <= 500 THEN 2 END AS left_closed FROM events""")
def fn_bins(spark, sf_dir):
    edges = [0, 25, 100, 500]
    return table(spark, sf_dir, "events").select("event_id", scalar.bin_right_closed(F.col("value"), edges).alias("right_closed"), scalar.bin_left_closed(F.col("value"), edges).alias("left_closed"))


@query("SELECT user_id, event_id, CAST(event_type = 'click' AS INTEGER) AS is_click, CAST(event_type = 'view' AS INTEGER) AS is_view FROM events")
def fn_onehot(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", *[c.alias(f"is_{n}") for n, c in scalar.one_hot(F.col("event_type"), ["click", "view"]).items()])


@query("SELECT doc_id, sha256(concat(doc_id, ':', lang)) AS sha_id, md5(concat(doc_id, '_', lang)) AS md5_id FROM documents")
def fn_sha_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalar.sha_id(F.col("doc_id"), F.col("lang")).alias("sha_id"), scalar.md5_id(F.col("doc_id"), F.col("lang")).alias("md5_id"))


@query("SELECT event_id, round(ln(p / (1 - p)), 6) AS logit, round(p, 6) AS back, round(0.5 + atan(-value) / pi(), 6) AS bounded FROM (SELECT event_id, value, greatest(least(value / 500, 1 - 1e-7), 1e-7) AS p FROM events)")
def fn_logit_clip(spark, sf_dir):
    p = F.col("value") / 500
    return table(spark, sf_dir, "events").select("event_id", F.round(scalar.logit_clip(p), 6).alias("logit"), F.round(scalar.expit(scalar.logit_clip(p)), 6).alias("back"), F.round(scalar.bounded_score(F.col("value")), 6).alias("bounded"))


@query("SELECT o_orderkey, round(pow(2, -((SELECT max(year(o_orderdate)) FROM orders) - year(o_orderdate)) / 3.0), 6) AS w FROM orders")
def fn_decay_weight(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return o.join(F.broadcast(o.agg(F.max("y").alias("m")))).select("o_orderkey", F.round(scalar.decay_weight(F.col("m") - F.col("y"), 3), 6).alias("w"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, url LIKE 'https://%' AND length(regexp_extract(url, '^https?://([^/]+)', 1)) > 0 AS valid FROM pages")
def fn_url_check(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr("coalesce(try_parse_url(url, 'HOST'), '')").alias("host"), scalar.url_ok(F.col("url")).alias("valid"))


@query("SELECT c_custkey, concat('https://example.org/data/', c_custkey, '/', replace('0000000001-98-000123', '-', ''), '/doc.htm') AS url FROM customer")
def fn_url_build(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.archive_url("https://example.org/data", F.col("c_custkey"), F.lit("0000000001-98-000123"), F.lit("doc.htm")).alias("url"))


@query("SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '-1') AS BIGINT) AS k FROM events")
def fn_json_get(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("-1")).cast("long").alias("k"))


@query("""SELECT event_id, list_distinct(x) AS items FROM (SELECT event_id, [concat(a, '.', b), concat(c, '.', b)] AS x FROM
 (SELECT event_id, CAST(user_id % 9 + 1 AS VARCHAR) AS a, lpad(CAST(event_id % 7 AS VARCHAR), 2, '0') AS b, CAST(event_id % 4 + 1 AS VARCHAR) AS c FROM events)) ORDER BY event_id""".replace("list_distinct(x)", "CASE WHEN x[1] = x[2] THEN x[1:1] ELSE x END"))
def fn_items_set(spark, sf_dir):
    """Every event's items as a comma string with repeats and noise."""
    code = lambda n: F.concat(n.cast("string"), F.lit("."), F.lpad((F.col("event_id") % 7).cast("string"), 2, "0"))
    a, c = code(F.col("user_id") % 9 + 1), code(F.col("event_id") % 4 + 1)
    return table(spark, sf_dir, "events").select("event_id", scalar.item_codes(F.concat_ws(", ", a, c, a, F.lit("x"), c)).alias("items"))


@query("SELECT event_id, coalesce(CASE WHEN value > 400 THEN value END, CASE WHEN event_type = 'view' THEN -1.0 END, 0.0) AS v FROM events")
def fn_first_finite(spark, sf_dir):
    nan = F.lit(float("nan"))
    a = F.when(F.col("value") > 400, F.col("value")).otherwise(nan)
    b = F.when(F.col("event_type") == "view", -1.0).otherwise(F.lit(float("inf")))
    return table(spark, sf_dir, "events").select("event_id", scalar.first_finite(a, b, F.lit(0.0)).alias("v"))


@query("SELECT event_id, round(value / nullif(user_id % 3, 0), 6) AS ratio FROM events")
def fn_divide(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(scalar.divide(F.col("value"), F.col("user_id") % 3), 6).alias("ratio"))


#: A period's statement values, in SQL that both engines read.
_STATEMENT = {
    "sales": "l_quantity * 100", "receivables": "l_extendedprice * l_tax", "cogs": "l_quantity * (60 + l_linenumber)", "current_assets": "l_extendedprice * 0.3", "ppe": "l_extendedprice * l_discount", "assets": "l_extendedprice",
    "depreciation": "l_quantity * l_discount * 10", "sga": "l_quantity * (l_tax + 1) * 5", "current_liabilities": "l_extendedprice * 0.1", "debt": "l_extendedprice * l_tax", "income": "l_quantity * 20", "cash_flow": "l_quantity * 15",
}
_LAG = "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_BENEISH = f"""i AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _STATEMENT.items())} FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, receivables / nullif(sales, 0) AS rec, (sales - cogs) / nullif(sales, 0) AS mar, 1 - (current_assets + ppe) / nullif(assets, 0) AS qua, sales, depreciation / nullif(depreciation + ppe, 0) AS dep,
 sga / nullif(sales, 0) AS sg, (current_liabilities + debt) / nullif(assets, 0) AS lev, (income - cash_flow) / nullif(assets, 0) AS acc FROM i),
p AS (SELECT *, lag(rec) {_LAG} AS rec0, lag(mar) {_LAG} AS mar0, lag(qua) {_LAG} AS qua0, lag(sales) {_LAG} AS sales0, lag(dep) {_LAG} AS dep0, lag(sg) {_LAG} AS sg0, lag(lev) {_LAG} AS lev0 FROM r),
x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, rec / nullif(rec0, 0) AS dsri, mar0 / nullif(mar, 0) AS gmi, qua / nullif(qua0, 0) AS aqi, sales / nullif(sales0, 0) AS sgi, dep0 / nullif(dep, 0) AS depi, sg / nullif(sg0, 0) AS sgai, lev / nullif(lev0, 0) AS lvgi, acc AS tata FROM p)"""


@query(f"WITH {_BENEISH} SELECT k, n, part, {', '.join(f'round({c}, 5) AS {c}' for c in ('dsri', 'gmi', 'aqi', 'sgi', 'depi', 'sgai', 'tata', 'lvgi'))}, round(-4.84 + 0.92 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi, 4) AS m FROM x")
def fn_beneish(spark, sf_dir):
    """All eight indices of each line of an order against the line before it, as periods of one company."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumns({k: F.expr(v) for k, v in _STATEMENT.items()})
    lines = lines.withColumns({f"{k}_before": F.lag(k).over(w) for k in _STATEMENT})
    indices = history.beneish_indices({k: F.col(k) for k in _STATEMENT}, {k: F.col(f"{k}_before") for k in _STATEMENT})
    out = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), *[v.alias(k) for k, v in indices.items()])
    return out.select("k", "n", "part", *[F.round(c, 5).alias(c) for c in indices], F.round(history.beneish({c: F.col(c) for c in indices}), 4).alias("m"))
