"""Ordered passes over hot keys, and spacing by pointer doubling, against the plain forms."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import asof, metrics, scan
from chronofold.streaming import monitor


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def hot(spark):
    """One key with nearly all rows, a null key, some small ones; ties and null times."""
    rng = random.Random(1)
    day = lambda: None if rng.random() < 0.01 else datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(900))
    key = lambda: rng.choice(["hot"] * 30 + [None, "a", "b"])
    left = spark.createDataFrame([(i, key(), day()) for i in range(6000)], "i long, k string, t date").repartition(5)
    right = spark.createDataFrame([(key(), day(), i) for i in range(2500)], "k string, s date, v long").repartition(5)
    return left, right


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_spread_asof_has_the_same_rows(hot, strict, tolerance):
    left, right = hot
    join = lambda spread: asof.asof_backward(left, right, by="k", left_time="t", right_time="s", values=["v"], tiebreak="v", strict=strict, tolerance_days=tolerance, spread=spread, large=100)
    assert rows_of(join(True)) == rows_of(join(False))


def test_hot_key_is_spread(hot):
    """A key with nearly all rows goes to many stretches, none much larger than the median; small keys are left whole."""
    left, _ = hot
    cut = scan.in_stretches(left, by="k", order=scan.as_number(F.col("t"), "date"), into="s", more_than=1000)
    sizes = [r["count"] for r in cut.where("k = 'hot' AND t IS NOT NULL").groupBy("s").count().collect()]
    assert len(sizes) == scan.STRETCHES and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert [r.s for r in cut.where("k IS NULL OR k <> 'hot'").select("s").distinct().collect()] == [-1]


def test_carry_over_empty_stretches(spark):
    """A fact reaches rows many stretches on, with none in between."""
    left = spark.createDataFrame([("k", datetime.date(2020, 1, 1) + datetime.timedelta(days=i)) for i in range(640)], "k string, t date")
    right = spark.createDataFrame([("k", datetime.date(2020, 1, 3), 1), ("k", datetime.date(2021, 5, 1), 2)], "k string, s date, v long")
    got = asof.asof_backward(left, right, by="k", left_time="t", right_time="s", values=["v"], spread=True, large=1).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {None: 3, 1: 484, 2: 153}


def test_running_sums(spark):
    rng = random.Random(3)
    scores = rng.sample(range(100_000), 3000)
    df = spark.createDataFrame([(s % 3 if s % 7 else None, s / 7, float(s % 5)) for s in scores], "g int, x double, w double").repartition(4)
    for by in ([], ["g"]):
        got = scan.running_sums(df, by=by, order="x", sums={"r": "w"}, more_than=10)
        w = Window.partitionBy(*by).orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        assert rows_of(got.select("g", "x", F.round("r", 6).alias("r"))) == rows_of(df.select("g", "x", F.round(F.sum("w").over(w), 6).alias("r")))


def test_curve_without_groups_is_in_stretches(spark):
    df = spark.createDataFrame([(i / 100, i % 2, 1.0) for i in range(200)], "p double, y int, w double")
    points = metrics.curve(df, p="p", y="y", w="w")
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("windowspecdefinition(_s" in line or "sum(_t_tp" in line for line in windows), "within stretches, or over a row for each of them"
    assert metrics.curve(df.limit(0), p="p", y="y", w="w").collect() == []
    last = points.orderBy("score").first()
    assert (last.tp, last.fp, last.all_pos, last.all_neg) == (100.0, 100.0, 100.0, 100.0)


@pytest.mark.parametrize("spread", [None, True])
def test_cooldown_in_steps(spark, spread):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None] + list(range(3000)))) for _ in range(900)] + [("lone", 5), ("far", 0), ("far", 10_000)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("t"))
    for seconds in (1, 40, 100_000):
        assert rows_of(monitor.cooldown_in_steps(df, key="k", time="t", seconds=seconds, spread=spread)) == rows_of(monitor.cooldown(df, key="k", time="t", seconds=seconds))
    assert monitor.cooldown_in_steps(df.limit(0), key="k", time="t", seconds=1).collect() == []
