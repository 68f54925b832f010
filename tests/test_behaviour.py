"""Small hand-made cases: arithmetic, ties, leakage guards, invariances, streams."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from chronofold.functions import scalar, text
from chronofold.operators import asof, backtest, guards, history, labels, metrics, prepare, sampling
from chronofold.sources import filings, origin, readers, sinks
from chronofold.streaming import monitor

D = dt.date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_interval_stab(spark):
    m = spark.createDataFrame([("A", D(2000, 1, 1), D(2010, 1, 1)), ("A", D(2015, 1, 1), None), ("B", D(2020, 1, 1), None), ("C", None, None)], "ticker string, added date, removed date")
    at = lambda d: [r.ticker for r in asof.interval_stab(m, F.lit(d).cast("date"), start="added", end="removed").collect()]
    assert at("2012-01-01") == [] and at("2016-01-01") == ["A"] and at("2010-01-01") == [] and at("2000-01-01") == ["A"]


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, D(2018, 12, 31)), (2, D(2018, 12, 31)), (3, D(2018, 12, 31))], "k int, t date")
    right = spark.createDataFrame([(1, D(2018, 11, 1), 10, 1), (1, D(2018, 12, 31), 20, 1), (1, D(2019, 1, 2), 30, 1), (2, D(2018, 12, 30), 1, 5), (2, D(2018, 12, 30), 2, 4)], "k int, at date, v int, tie int")
    return left, right


def test_asof(sides):
    left, right = sides
    run = lambda **k: {r.k: r.v for r in asof.asof_backward(left, right, by="k", left_time="t", right_time="at", values=["v"], tiebreak="tie", **k).collect()}
    assert run() == {1: 10, 2: 1, 3: None}
    assert run(strict=False) == {1: 20, 2: 1, 3: None}
    assert run(tolerance_days=30) == {1: None, 2: 1, 3: None}


def test_asof_ignores_the_future_and_the_layout(spark, sides):
    left, right = sides
    base = rows(asof.asof_backward(left, right, by="k", left_time="t", right_time="at", values=["v"], tiebreak="tie"))
    more = right.unionByName(spark.createDataFrame([(1, D(2030, 1, 1), 99, 9)], right.schema))
    for parts in (1, 7):
        assert rows(asof.asof_backward(left.repartition(parts), more.repartition(parts), by="k", left_time="t", right_time="at", values=["v"], tiebreak="tie")) == base


def test_trailing_sums(spark):
    ytd = spark.createDataFrame([("A", 2020, q, v) for q, v in ((1, 1), (2, 3), (3, 6), (4, 10))] + [("A", 2021, 1, 2), ("B", 2020, 1, 5), ("B", 2020, 3, 9)], "k string, y int, q int, ytd long")
    quarters = history.ytd_to_quarter(ytd, by="k", year="y", quarter="q", value="ytd")
    assert [r.quarter for r in quarters.orderBy("k", "y", "q").collect()] == [1, 2, 3, 4, 2, 5, None]
    numbered = quarters.where("k = 'A'").withColumn("n", F.expr("4 * y + q"))
    assert [r.ttm for r in history.trailing_sum(numbered, by="k", number="n", value="quarter", periods=4, name="ttm").orderBy("n").collect()] == [None, None, None, 10, 11]


def test_quarantine_and_fallback(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 1), (2, 3), (3, None)], "k int, v int")
    clean, bad = history.quarantine(df, ["k"], "v")
    assert rows(clean.where("v IS NOT NULL")) == [(1, 5)] and [r.k for r in bad.collect()] == [2]
    t = spark.createDataFrame([(0, None, 1, 7), (2, 3, 1, 7), (1, 4, 2, 9)], "n1 int, v1 int, n2 int, v2 int")
    pick = history.first_unconflicted([(F.col("n1"), F.col("v1")), (F.col("n2"), F.col("v2"))])
    assert [r[0] for r in t.select(pick).collect()] == [7, None, 4]


def test_labels(spark):
    seen = F.lit("2010-01-01").cast("date")
    cases = [
        (D(2004, 2, 29), D(2005, 2, 28), True, None, 1),  # the horizon day counts, leap days clamp
        (D(2004, 2, 29), D(2005, 3, 1), True, None, 0),
        (D(2004, 3, 1), D(2004, 3, 1), True, None, None),  # an event on the anchor day
        (D(2004, 3, 1), None, True, None, 0),
        (D(2004, 3, 1), None, False, None, None),
        (D(2004, 3, 1), None, True, D(2004, 6, 1), None),  # removed inside the horizon
        (D(2009, 6, 1), None, True, None, None),  # not yet observed
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "a date, e date, reviewed boolean, removed date")
    got = df.select(labels.three_valued(F.col("a"), F.col("e"), years=1, observed_through=seen, removed=F.col("removed"), reviewed=F.col("reviewed"))).collect()
    assert [r[0] for r in got] == [c[4] for c in cases]


def test_hashes_are_big_integers(spark):
    import hashlib

    df = spark.range(50).select(F.col("id"), sampling.hash_mod(sampling.digest("s", "fold", F.col("id")), 7).alias("m"), sampling.hash_uniform(sampling.digest("s", F.col("id"))).alias("u"))
    for r in df.collect():
        assert r.m == int(hashlib.sha256(f"s:fold:{r.id}".encode()).hexdigest(), 16) % 7
        assert abs(r.u - int(hashlib.sha256(f"s:{r.id}".encode()).hexdigest(), 16) / 2**256) < 1e-12


def test_sample_ignores_order(spark):
    df = spark.range(200).withColumn("k", F.col("id").cast("string"))
    assert rows(sampling.rank_sample(df, "k", "x", 9)) == rows(sampling.rank_sample(df.orderBy(F.desc("id")).repartition(5), "k", "x", 9))
    cohort = sampling.cohorts(df, "k", 3)
    assert sorted(r["count"] for r in cohort.groupBy("cohort").count().collect()) == [66, 67, 67]


@pytest.fixture
def panel(spark):
    return spark.createDataFrame([(1, 0.8, 1.0, 0), (0, 0.7, 10.0, 1), (0, 0.1, 10.0, 0)], "y int, p double, w double, fold int")


def test_weighted_metrics(spark, panel):
    c = panel.agg(*[x.alias(n) for n, x in metrics.confusion(F.col("p"), F.col("y"), F.col("w"), 0.5).items()]).first()
    assert c.tp / (c.tp + c.fp) == pytest.approx(1 / 11) and c.tp / (c.tp + c.fn) == 1
    points = metrics.curve(panel, p="p", y="y", w="w")
    assert metrics.balanced_threshold(points).first()[0] == 0.8
    wide = panel.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).withColumn("w", F.lit(1.0))
    assert metrics.areas(points).first() == metrics.areas(metrics.curve(wide, p="p", y="y", w="w")).first()


def test_held_out_labels_do_not_move_their_own_threshold(spark):
    df = spark.createDataFrame([(i, i % 2, (i + 1) / 9, 1.0, i // 4) for i in range(8)], "i int, y int, p double, w double, fold int")
    a = metrics.held_out_policy(df, fold="fold", p="p", y="y", w="w")
    b = metrics.held_out_policy(df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y"))), fold="fold", p="p", y="y", w="w")
    pick = lambda d: rows(d.where("fold = 0").select("i", "threshold", "alert"))
    assert pick(a) == pick(b)


def test_reliability_edges(spark):
    df = spark.createDataFrame([(0.0, 0, 1.0), (1.0, 1, 1.0), (0.05, 1, 1.0)], "p double, y int, w double")
    assert [(r.bin, r.n) for r in metrics.bins(df, [0, 0.05, 1], p="p", y="y", w="w").orderBy("bin").collect()] == [(0, 1), (1, 2)]


def test_backtest(spark):
    p = spark.createDataFrame([(1, "a", 1.0, 0.1), (1, "b", 0.0, -0.2), (2, "a", 1.0, 0.05), (2, "b", 0.0, -0.1)], "d int, t string, pos double, r double")
    out = backtest.strategy(p, period="d", ticker="t", position="pos", ret="r", cost_bps=0).orderBy("d").collect()
    assert out[-1].equity == pytest.approx(1.155)
    assert [r.gross for r in backtest.buy_and_hold(p, period="d", ticker="t", ret="r").orderBy("d").collect()] == pytest.approx([-0.05, (1.1 * 0.05 - 0.8 * 0.1) / 1.9])
    late = p.withColumn("available", F.col("d") + F.when(F.col("t") == "b", 1).otherwise(0))
    assert tuple(backtest.panel_faults(late, period="d", ticker="t", available="available").first()) == (0, 0, 2)
    broke = spark.createDataFrame([(1, "a", 1.0, -1.0), (2, "a", 1.0, 0.5)], p.schema)
    assert [r.equity for r in backtest.strategy(broke, period="d", ticker="t", position="pos", ret="r", cost_bps=0).orderBy("d").collect()][-1] == 0


def test_guards(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 2.0)], "k int, p double")
    with pytest.raises(ValueError, match="missing"):
        guards.require_columns(df, ["k", "z"])
    with pytest.raises(ValueError, match="duplicate"):
        guards.assert_unique(df, ["k"])
    with pytest.raises(ValueError, match="range: 1"):
        guards.assert_rules(df, {"range": F.col("p") <= 1})
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r.x for r in guards.clean_doubles(bad).collect()] == [None, None, 1.0]


def test_window_counts_unknown_is_not_zero(spark):
    a = spark.createDataFrame([("x", D(2020, 1, 10)), ("y", D(2020, 1, 10))], "k string, a date")
    e = spark.createDataFrame([("x", D(2020, 1, 9), "1.01"), ("x", D(2020, 1, 8), None), ("x", D(2020, 1, 10), "1.01"), ("x", D(2019, 1, 1), "1.01")], "k string, d date, items string")
    out = asof.window_counts(a, e, by="k", anchor="a", time="d", days=5, counts={"n": F.lit(True), "items": F.col("items") == "1.01"}, complete=F.col("items").isNotNull(), exact=["n"])
    assert {r.k: (r.n, r["items"]) for r in out.collect()} == {"x": (2, None), "y": (0, 0)}


def test_prepare_uses_training_rows_only(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None), (4, 1000.0)], "k int, x double")
    out = prepare.impute_median(df, df.where("k < 3"), ["x"]).orderBy("k").collect()
    assert [(r.x, r.x_missing) for r in out] == [(1.0, 0), (3.0, 0), (2.0, 1), (1000.0, 0)]
    assert [r.x for r in prepare.clip_quantiles(df, df.where("k < 3"), ["x"], 0, 1).orderBy("k").collect()] == [1.0, 3.0, None, 3.0]


def test_ragged_arrays_are_refused(spark):
    df = spark.sql("SELECT 'c' AS cik, named_struct('a', array('1', '2'), 'b', array('x')) AS recent")
    with pytest.raises(Exception, match="different lengths"):
        readers.soa_rows(df, "recent", ["a", "b"], ["cik"]).collect()


def test_visible_text():
    page = "<html><head><title>t</title></head><body>a<script>x</script><p style='display: none'>h</p><div hidden>g</div><b>b</b></body></html>"
    assert text.visible(page) == "a\nb" and text.visible(None) is None and text.visible("") == ""
    assert text.visible("<p>one\n two</p>three<br>four <i>five</i><table><tr><td>6</td></tr></table>") == "one two\nthree\nfour five\n6"
    # hidden elements end at their own end tag, or at that of an element around them, whatever is left open inside
    assert text.visible("<div><div hidden>x<div>y</div>z</div>seen</div>") == "seen"
    assert text.visible("<div><p hidden>x<b>y</div>seen") == "seen"
    assert text.visible("<p hidden>x<br>y</i></p>seen</p> on") == "seen\non"
    assert text.visible("<span style='visibility : HIDDEN'>x</span>a<ix:hidden>1<p>2</p></ix:hidden>b &amp; c") == "a b & c"


def test_sections(spark):
    words = "word " * 20
    cases = {
        "both": ("10-K", f"Item 1A. Risk Factors\nItem 2. X\nPART I Item 1A - Risk Factors\n{words}\nItem 2. X\nItem 7. Management's Discussion\n{words}more\nItem 8. Y", {"risk_factors", "management_discussion"}),
        "no end": ("10-K", f"Item 1A. Risk Factors\n{words}", set()),
        "other title": ("10-K", f"Item 1A. Nothing of the kind\n{words * 20}\nItem 2. X", set()),
        "title on the next line": ("10-q", f"Item 1A\n\nRISK FACTORS\n{words}\nItem 2. X", {"risk_factors"}),
        "item of the other form": ("10-Q", f"Item 7. Management's Discussion\n{words}\nItem 8. Y", set()),
        "short": ("10-K", "Item 1A. Risk Factors\nfew words\nItem 2. X", set()),
        "none": ("10-K", None, set()),
        "other form": ("8-K", f"Item 1A. Risk Factors\n{words}\nItem 2. X", set()),
    }
    df = spark.createDataFrame([(k, form, t) for k, (form, t, _) in cases.items()], "k string, form string, t string")
    got = {r.k: r.m for r in df.select("k", text.section_bodies(F.col("t"), F.col("form")).alias("m")).collect()}
    assert {k: set(m or {}) for k, m in got.items()} == {k: want for k, (_, _, want) in cases.items()}
    assert got["both"]["risk_factors"].startswith("PART I Item 1A - Risk Factors\nword") and got["both"]["risk_factors"].endswith("word")


def test_petitions(spark):
    from chronofold.plans.texts import PETITIONS

    rows = [(i, said, filed, ["Acme, Incorporated"]) for i, (said, filed, _) in enumerate(PETITIONS)]
    rows += [(20, "On March 1, 2020, Acme Inc. filed a voluntary petition under chapter 11.", "2020-03-15", None), (21, None, "2020-03-15", []), (22, "on march 2 2020 the registrant, with others, " + "x " * 200 + "filed petitions" + " y" * 20 + " chapter 7", "2020-03-15", [])]
    df = spark.createDataFrame(rows, "i long, t string, filed string, names array<string>").withColumn("filed", F.to_date("filed"))
    got = {}
    for r in text.petitions(df, text="t", filed="filed", names="names").orderBy("start").collect():
        got.setdefault(r.i, []).append((str(r.petition_date), r.chapter, r.issuer_included))
    want = {i: [x] for i, (_, _, x) in enumerate(PETITIONS) if x} | {20: [("2020-03-01", "11", False)], 22: [("2020-03-02", "7", True)]}
    want[8] = [*want[8], ("2022-06-10", "7", False)]
    assert got == want


def test_chunks_are_linear(spark):
    """Twice the words take about twice the time; each chunk used to split the whole text again."""
    import time

    df = spark.createDataFrame([(1,)], "i int")
    took = []
    for n in (2_000, 100_000, 200_000):
        began = time.perf_counter()
        assert df.select(F.size(text.chunk_text(F.repeat(F.lit("word "), F.lit(n) + F.col("i") - 1))).alias("n")).first().n == -(-(n - 50) // 450)
        took.append(time.perf_counter() - began)
    assert took[2] < 3.5 * took[1] + 0.5


def test_text(spark):
    assert text.context_counts("There is no default here. A default came. As part of an audit, a default.", "a default|no default") == {"plain": 1, "negated": 1, "boilerplate": 1}
    df = spark.createDataFrame([("The cat is on the mat the",)], "t string")
    assert df.select(text.phrase_count(F.col("t"), "the")).first()[0] == 3
    assert spark.range(1).select(scalar.normalize_cik(F.lit("320193.0")), scalar.normalize_cik(F.lit("0")), scalar.normalize_cik(F.lit("x"))).first()[:] == ("0000320193", None, None)


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    path = f"file://{tmp_path}/t"
    sinks.write_new(df, path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_new(df, path)
    sinks.append_new(spark.range(3, 8), path, ["id"])
    assert rows(spark.read.parquet(path)) == [(i,) for i in range(8)]
    assert not sinks.same_rows(df, df.union(df))
    with pytest.raises(ValueError, match="empty"):
        sinks.publish(spark, df.where("id < 0"), f"file://{tmp_path}/p")


def test_stream_dedupes_across_restarts(spark, tmp_path):
    base = f"{tmp_path}/s"

    def batch(name, items):
        spark.createDataFrame([(k, i) for k, i in items], "k string, i string").coalesce(1).write.parquet(f"{base}/in/{name}")

    def run():
        stream = spark.readStream.schema("k string, i string").parquet(f"{base}/in/*")
        q = monitor.new_items(stream, keys=["k", "i"]).writeStream.option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start(path=f"{base}/out", format="parquet")
        q.awaitTermination()
        return rows(spark.read.parquet(f"{base}/out"))

    batch("1", [("a", "1"), ("a", "1"), ("a", "2")])
    assert run() == [("a", "1"), ("a", "2")]
    batch("2", [("a", "0"), ("a", "2"), ("b", "2")])  # late, seen, new
    assert run() == [("a", "0"), ("a", "1"), ("a", "2"), ("b", "2")]


def test_stream_baseline(spark, tmp_path):
    base = f"{tmp_path}/b"
    seen = []

    def run(name, items):
        spark.createDataFrame(items, "cik string, acc string, form string, d string").coalesce(1).write.parquet(f"{base}/in/{name}")
        stream = spark.readStream.schema("cik string, acc string, form string, d string").parquet(f"{base}/in/*")
        out = monitor.baseline_then_new(stream, key="cik", item="acc", group="form", order="d")
        seen.clear()
        monitor.write_once(out, lambda df, _: seen.extend(tuple(r) for r in df.collect()), f"{base}/c").awaitTermination()
        return sorted(seen)

    assert run("1", [("x", "1", "10-K", "2020-01-01"), ("x", "2", "10-K", "2021-01-01"), ("x", "3", "10-Q", "2020-05-01")]) == [("x", "2", "10-K", "first"), ("x", "3", "10-Q", "first")]
    assert run("2", [("x", "0", "10-K", "2019-01-01"), ("x", "2", "10-K", "2021-01-01")]) == [("x", "0", "10-K", "new")]


def test_cooldown(spark):
    df = spark.createDataFrame([("a", f"2024-01-01 0{h}:{m:02d}:00") for h, m in ((0, 0), (0, 30), (1, 0), (1, 59), (2, 1))], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    sent = [r.sent_at % 86400 // 60 for r in monitor.cooldown(df, key="k", time="t", seconds=3600).orderBy("sent_at").collect()]
    assert sent == [0, 60, 121]


def test_nested_calibration_scores_every_fold(spark):
    from chronofold.plans import evaluation

    sf = "/root/testdata/sf0.001"
    want = sorted(r.unit for r in evaluation._model_frame(spark, sf).select("unit").collect())
    assert sorted(r.unit for r in evaluation.ml_nested_calibration(spark, sf).select("unit").collect()) == want


def test_latent_vectors_see_whole_texts(spark, tmp_path):
    """Two documents that agree only after their first hundred words find each other."""
    from chronofold.plans import retrieval

    own = lambda i: " ".join(f"w{i}x{j}" for j in range(100))
    late = " ".join(f"topic{j}" for j in range(150))
    rows = [(0, f"{own(0)} {late}"), (1, f"{own(1)} {late}"), *[(i, own(i)) for i in range(2, 8)], (100, own(100))]
    spark.createDataFrame([(i, t, "de") for i, t in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["query"], r["key"]) for r in retrieval.ret_lsa(spark, str(tmp_path)).collect()}
    assert {(0, 0), (0, 1), (100, 100)} <= got and (100, 0) not in got


def chunk_plain(words, size, overlap):
    """The rule read off word by word: at most ``size``, up to the last sentence end past the overlap, the rest again."""
    start, out = 0, []
    while start < len(words):
        stop = start + size
        if stop < len(words):
            ends = [k for k in range(start + overlap + 1, stop + 1) if words[k - 1].rstrip("\"')")[-1:] in (".", "!", "?")]
            stop = max(ends, default=stop)
        out.append(" ".join(words[start:stop]))
        if stop >= len(words):
            return out
        start = max(start + 1, stop - overlap)
    return out


def test_chunks(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b.", "c!\"", "d')", "e?'", "f;"]) for _ in range(n)) for n in (0, 1, 5, 9, 10, 11, 30, 77, 140)] + [" ".join(["w"] * 60), "x. " * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size, overlap in ((10, 3), (10, 0), (4, 3), (500, 50)):
        got = {r.i: r.c for r in df.select("i", text.chunk_text(F.col("t"), size, overlap).alias("c")).collect()}
        assert got == {i: chunk_plain((t or "").split(), size, overlap) for i, t in enumerate(texts)}
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError, match="overlap"):
            text.chunk_text(F.col("t"), *bad)


def test_transactions_keep_their_own_values(spark):
    tx = "<nonDerivativeTransaction><transactionCoding><transactionCode>{}</transactionCode></transactionCoding><transactionAmounts>{}</transactionAmounts></nonDerivativeTransaction>"
    price = "<transactionPricePerShare><value>9.5</value></transactionPricePerShare>"
    xml = '<o xmlns="u"><issuer><issuerCik>12</issuerCik></issuer>' + tx.format("P", "") + tx.format("S", price) + "</o>"
    df = spark.createDataFrame([("0000000012", xml), ("12", "<o><issuer><issuerCik>12</issuerCik></issuer></o>")], "cik string, x string")
    got = filings.ownership_transactions(df, "x", ["cik"], issuer="cik").collect()
    assert [(r.transaction_index, r.transaction_code, r.price_per_share, r.shares, r.purchase_sale_signal) for r in got] == [(0, "P", None, None, "purchase"), (1, "S", 9.5, None, "sale")]
    with pytest.raises(Exception, match="issuer does not match"):
        filings.ownership_transactions(df.withColumn("cik", F.lit("13")), "x", ["cik"], issuer="cik").collect()
    assert [r.price_per_share for r in filings.ownership_documents(df, "x", ["cik"]).collect()] == [0.0, 9.5]


def packed(members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return data.getvalue()


def test_releases_are_checked(spark):
    head = "Name,Key,Day\r\n"
    good = {"r_1-2.csv": (head + "Caf\u00e9,1,01/31/2020\r\n").encode("cp1252"), "x.txt": "y"}
    read = lambda *zips: filings.checked_release(spark.createDataFrame([(f"z{i}", bytearray(packed(z))) for i, z in enumerate(zips)], "path string, content binary"), release="1-2", columns=["Name"], key="Key", day="Day", until="2021-01-01").collect()
    row = read(good)[0]
    assert (row.Name, row.Key, row.Day, row.member) == ("Caf\u00e9", "1", D(2020, 1, 31), "r_1-2.csv") and len(row.member_sha256) == 64
    for bad, said in (
        ({**good, "other.csv": "a"}, "one CSV"), ({"r_9.csv": head}, "one CSV"), ({"r_1-2.csv": "Name,Key\r\na,1\r\n"}, "lacks the columns"), ({"r_1-2.csv": head + "a,,01/31/2020\r\n"}, "without Key"),
        ({"r_1-2.csv": head + "a,1,01/31/2022\r\n"}, "after 2021"), ({"r_1-2.csv": head + "a,1,nonsense\r\n"}, "does not match format"), ({"r_1-2.csv": head + "a,1,01/31/2020\r\nb,1,01/31/2020\r\n"}, "repeats"),
    ):
        with pytest.raises(Exception, match=said):
            read(bad)
    with pytest.raises(Exception, match="repeats"):
        read(good, good)


def test_tagged_facts():
    page = '<xbrli:context id="c"><xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate>2020-12-31</xbrli:endDate></xbrli:context><xbrli:context id="d"><xbrldi:typedMember>x</xbrldi:typedMember><xbrli:instant>2020-06-30</xbrli:instant></xbrli:context>'
    fact = lambda attrs, said: f'<ix:nonFraction name="n" contextRef="c" {attrs}>{said}</ix:nonFraction>'
    page += fact('scale="6" sign="-"', "1,2<b>34</b>.5") + fact('format="ixt:num-comma-decimal"', "1") + fact('continuedAt="x"', "1") + fact("", "none") + '<ix:nonFraction name="m" contextRef="d">7</ix:nonFraction>'
    got = filings.tagged_facts(page)
    assert got == [("n", "c", -1234500000.0, None, False, None, "2020-01-01", "2020-12-31"), ("m", "d", 7.0, None, True, "2020-06-30", None, None)]
    assert filings.tagged_facts(None) == []


def test_submissions(spark):
    raw = "<DOCUMENT>\n<TYPE>10-K\n<FILENAME>a.htm\n<TEXT><p>a loss &amp; b</p><p hidden>loss</p> Loss</TEXT>\n</DOCUMENT><DOCUMENT><TYPE>EX-1\n<FILENAME>b.gif\n<TEXT>x</TEXT></DOCUMENT><DOCUMENT><TYPE>OTHER\n<FILENAME>c.txt\n<TEXT>loss</TEXT></DOCUMENT><DOCUMENT><TYPE>EX-2\n<FILENAME>d.pdf\n<TEXT>no code</TEXT></DOCUMENT><document><type>ex-3\n<filename>E.TXT\n</document><DOCUMENT><TYPE>EX-4\n<FILENAME>f.txt\n<TEXT>none</TEXT></DOCUMENT>"
    screen = lambda *texts: filings.screen_submissions(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, raw string"), key="k", raw="raw", forms=["10-K"], terms="loss|x{9}")
    got = screen(raw).orderBy("position").collect()
    want = [(0, "10-K", "primary_report", "screened", 2), (1, "EX-1", "exhibit", "unsupported_format_requires_review", None), (3, "EX-2", "exhibit", "unreadable_text_requires_review", None), (4, "ex-3", "exhibit", "unsupported_format_requires_review", None), (5, "EX-4", "exhibit", "screened", 0)]
    assert [(r.position, r.type, r.scope, r.status, r.keyword_matches) for r in got] == want
    assert got[0].excerpts == ["a loss & b Loss"] * 2 and got[1].excerpts is None and got[4].excerpts == []
    long = "<DOCUMENT><TYPE>10-K\n<FILENAME>a.txt\n<TEXT>" + "é" * 400 + " loss " + "b" * 600 + "</TEXT></DOCUMENT>"
    assert screen(long).first().excerpts == ["é" * 249 + " loss " + "b" * 449]
    for bad in ("", None):
        with pytest.raises(Exception, match="no documents"):
            screen(bad).collect()


def test_encoded_files():
    import binascii
    import zlib

    data = bytes(range(256)) * 3 + b"end"
    lines = [binascii.b2a_uu(data[i : i + 45]).decode().rstrip("\n") for i in range(0, len(data), 45)]
    assert filings.uudecode("\n".join(["head", "begin 644 a.pdf", *lines, "`", "end", "tail"])) == data
    odd = lines[-1][:-1] + "~"  # bits beyond the number of bytes
    assert filings.uudecode("\n".join(["begin 644 a.pdf", *lines[:-1], odd, "end"]))[: len(data) - 3] == data[:-3]
    for bad, said in ((["no"], "begins"), (["begin 644 a", "M!!!!"], "cut off"), (["begin 644 a", lines[0]], "no end")):
        with pytest.raises(ValueError, match=said):
            filings.uudecode("\n".join(bad))
    stream = lambda body, head=b"": b"<< " + head + b"/Length 9 >>\nstream\n" + body + b"\nendstream\n"
    page = b"BT /F1 9 Tf [(two \\(2\\)) -3 ( pie) (ces)] TJ (caf\\351) Tj <3120> ' ET q (not shown) Q"
    assert filings.pdf_text(b"%PDF\n" + stream(b"BT (one) Tj ET") + stream(zlib.compress(page), b"/Filter /FlateDecode ")) == "one two (2) pieces café 1"
    for empty in (b"", b"%PDF\n" + stream(b"BT ET"), stream(b"garbage", b"/FlateDecode ")):
        with pytest.raises(ValueError, match="no text"):
            filings.pdf_text(empty)



def test_layers_and_spacing():
    local: dict = {}

    def get(k):
        if k == "secret":
            raise PermissionError(k)
        return {"a": b"1"}[k]

    layers = origin.Layers((local.__getitem__, local.__setitem__), (get, None))
    assert layers.get("a") == b"1" and local == {"a": b"1"}
    with pytest.raises(KeyError):
        layers.get("b")
    with pytest.raises(PermissionError):
        layers.get("secret")
    now = [0.0]
    s = origin.Spacing(2.0, clock=lambda: now[0], sleep=lambda x: now.__setitem__(0, now[0] + x))
    assert [s.wait(), s.wait(), s.wait()] == [0.0, 2.0, 4.0] and now[0] == 4.0


def test_paged_search(spark):
    import http.server
    import json
    import threading

    class Search(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            start = int(self.path.rpartition("=")[2])
            body = json.dumps({"total": 23, "ids": list(range(start, min(start + 10, 23)))}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Search)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(origin.PagedSearch)
        pages = spark.read.format("paged_search").option("url", f"http://127.0.0.1:{server.server_port}/?start={{start}}").option("size", 10).load()
        got = readers.page_checks(pages, page="page", size=10).orderBy("page").collect()
        assert [tuple(r) for r in got] == [(0, 10, True, True, True, True), (1, 10, True, True, True, True), (2, 3, True, True, True, True)]
    finally:
        server.shutdown()


def test_followup(spark):
    h = spark.createDataFrame([("a", D(2020, 5, 1), D(2020, 3, 31)), ("a", D(2020, 8, 1), D(2020, 6, 30)), ("a", D(2020, 11, 1), D(2020, 9, 30)), ("a", D(2021, 3, 1), D(2020, 12, 31)), ("a", D(2022, 3, 1), D(2021, 12, 31)), ("b", D(2020, 5, 1), D(2020, 3, 31))], "k string, f date, p date")
    a = spark.createDataFrame([(k, D(2020, 2, 1), D(2020, 2, 1), D(2020, 12, 31), D(2022, 12, 31)) for k in "abc"], "k string, baseline date, anchor date, horizon date, cutoff date")
    out = {r.k: (r.periods, r.complete) for r in labels.followup_complete(h, a, by="k", filed="f", period="p").collect()}
    assert out == {"a": (5, True), "b": (1, False), "c": (0, False)}
    assert labels.followup_complete(h, a, by="k", filed="f", period="p", days=90).where("k = 'a'").first().complete is False


def test_pinned_tables_and_stores(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    pins = {r.path.rpartition("/")[2]: r.sha256 for r in sinks.manifest(spark, path).where("path LIKE '%.parquet'").collect()}
    assert readers.read_parquet(spark, path, pinned=pins).count() == 5
    with pytest.raises(ValueError, match="pinned"):
        readers.read_parquet(spark, path, pinned={k: "0" * 64 for k in pins})
    two = spark.createDataFrame([("z", bytearray(packed({"a.arff": "@data\n1,?\n", "b.arff": ""})))], "path string, content binary")
    with pytest.raises(Exception, match="one member"):
        filings.archive_lines(two, ".arff").collect()
