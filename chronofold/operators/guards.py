"""Checks at operator entry, each one aggregate job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself, or an error that names what is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule with the number of rows that break it; a null condition counts as broken."""
    counts = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return df.agg(*counts).selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, n_bad)")


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if duplicated_keys(df, keys).limit(1).count():
        raise ValueError(f"duplicate keys: {', '.join(keys)}")
    return df


def assert_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    bad = violations(df, rules).where("n_bad > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.n_bad} rows" for r in bad))
    return df


def finite(column: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clean_doubles(df: DataFrame) -> DataFrame:
    """Missing numbers are null, never NaN, from here on."""
    return df.withColumns({f.name: finite(f"`{f.name}`") for f in df.schema if f.dataType.simpleString() in ("double", "float")})
