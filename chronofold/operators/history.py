"""Financial history: quarters from cumulative values, trailing sums, ratios, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ytd_to_quarter(df: DataFrame, *, by: str, year: str, quarter: str, value: str) -> DataFrame:
    """Add ``quarter``'s own flow: the first as it is, others less the quarter before; null where that is missing."""
    w = Window.partitionBy(by, year).orderBy(quarter)
    own = F.when(F.col(quarter) == 1, F.col(value)).when(F.lag(quarter).over(w) == F.col(quarter) - 1, F.col(value) - F.lag(value).over(w))
    return df.withColumn("quarter", own)


def trailing_sum(df: DataFrame, *, by: str, number: str, value: str, periods: int, name: str) -> DataFrame:
    """Sum of the last ``periods`` consecutive periods; null unless all of them are there."""
    w = Window.partitionBy(by).orderBy(number)
    total = F.sum(value).over(w.rowsBetween(-(periods - 1), 0))
    return df.withColumn(name, F.when(F.lag(number, periods - 1).over(w) == F.col(number) - (periods - 1), total))


def altman_components(df: DataFrame, *, current_assets: str, current_liabilities: str, assets: str, retained: Sequence[str], ebit: Sequence[str], equity: str, liabilities: str, sales: Sequence[str]) -> DataFrame:
    """Five ratios; numerators fall back along their lists, and a zero or missing denominator gives null."""
    first = lambda names: F.coalesce(*[F.col(n) for n in names])
    a = F.col(assets)
    return df.withColumns({
        "x1": F.try_divide(F.col(current_assets) - F.col(current_liabilities), a),
        "x2": F.try_divide(first(retained), a),
        "x3": F.try_divide(first(ebit), a),
        "x4": F.try_divide(F.col(equity), F.col(liabilities)),
        "x5": F.try_divide(first(sales), a),
    })


def altman_z2(working: Column, retained: Column, ebit: Column, assets: Column, liabilities: Column) -> Column:
    """The four-factor score for firms outside manufacturing, where all inputs are there and positive as needed."""
    ok = (assets > 0) & (liabilities > 0)
    return F.when(ok, 6.56 * working / assets + 3.26 * retained / assets + 6.72 * ebit / assets + 1.05 * (assets - liabilities) / liabilities)


def quarantine(df: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(clean, conflicts): groups with different values are withheld whole; of the others one row stays."""
    g = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n_rows"))
    same = F.col("lo").eqNullSafe(F.col("hi"))
    return g.where(same).select(*keys, F.col("lo").alias(value)), g.where(~same)


def first_unconflicted(candidates: Sequence[tuple[Column, Column]]) -> Column:
    """(number of distinct values, value) by priority: the first with one value; a conflict before it ends the search."""
    out = F.when(F.lit(False), candidates[0][1])
    for n, v in candidates:
        out = out.when(n > 1, None).when(n == 1, v)
    return out


#: Coefficients of the manipulation score: constant, then by index.
BENEISH = {"const": -4.84, "dsri": 0.92, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "tata": 4.679, "lvgi": -0.327}


def beneish(indices: dict[str, Column]) -> Column:
    """The manipulation score of eight indices; any missing one makes it null."""
    out = F.lit(BENEISH["const"])
    for name, value in indices.items():
        out = out + BENEISH[name] * value
    return out


def beneish_indices(now: dict[str, Column], before: dict[str, Column]) -> dict[str, Column]:
    """The eight indices of a period against the one before, from statement values by name.

    sales, receivables, cogs, current_assets, ppe, assets, depreciation, sga,
    current_liabilities, debt, income, cash_flow.  What is missing, or has a zero
    to divide by, makes its indices null.
    """

    def ratios(v: dict[str, Column]) -> dict[str, Column]:
        over = F.try_divide
        return {
            "receivables": over(v["receivables"], v["sales"]), "margin": over(v["sales"] - v["cogs"], v["sales"]), "soft": 1 - over(v["current_assets"] + v["ppe"], v["assets"]), "sales": v["sales"],
            "wear": over(v["depreciation"], v["depreciation"] + v["ppe"]), "sga": over(v["sga"], v["sales"]), "leverage": over(v["current_liabilities"] + v["debt"], v["assets"]), "accruals": over(v["income"] - v["cash_flow"], v["assets"]),
        }

    a, b = ratios(now), ratios(before)
    grows = {"dsri": "receivables", "aqi": "soft", "sgi": "sales", "sgai": "sga", "lvgi": "leverage"}
    falls = {"gmi": "margin", "depi": "wear"}
    out = {k: F.try_divide(a[r], b[r]) for k, r in grows.items()} | {k: F.try_divide(b[r], a[r]) for k, r in falls.items()} | {"tata": a["accruals"]}
    return {k: out[k] for k in BENEISH if k != "const"}
