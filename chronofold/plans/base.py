"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.staging import fresh_folder  # noqa: F401  for the plans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(into: list) -> Callable:
    """A decorator that lists a query under its function's name with its SQL."""

    def with_sql(sql: str | None = None):
        def add(f):
            into.append((f.__name__, f, sql))
            return f

        return add

    return with_sql


def day(column: str) -> Column:
    return F.to_date(F.col(column))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing headers: cik, accession, filed, form, status, price in cents."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("accession"), day("o_orderdate").alias("filed"),
        F.col("o_orderpriority").alias("form"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )


#: The same in SQL.
ORDERS = """o AS (SELECT o_custkey AS cik, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed, o_orderpriority AS form,
 o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored, weighted panel: unit, y, p, w, fold, from labelled documents.

    The score is a fixed function of the text's length, the weight of the id.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    y = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y"), "quality")
    p = F.round(F.lit(1.0) / (1 + F.floor(F.col("n_chars") / 200)), 4)
    return d.join(y, "doc_id").select(F.col("doc_id").alias("unit"), "y", p.alias("p"), (1 + F.col("doc_id") % 5).cast("double").alias("w"), (F.col("doc_id") % 4).cast("int").alias("fold"), "lang", "quality")


SCORED = """s AS (SELECT doc_id AS unit, CAST(toxic AS INTEGER) AS y, round(1.0 / (1 + floor(n_chars / 200)), 4) AS p,
 CAST(1 + doc_id % 5 AS DOUBLE) AS w, CAST(doc_id % 4 AS INTEGER) AS fold, lang, quality FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"""
