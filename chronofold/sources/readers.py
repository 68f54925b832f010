"""Sources: explicit schemas, refusals instead of guesses, missing numbers as nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.operators.guards import clean_doubles


def read_csv(spark: SparkSession, path: str, schema: str, *, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Typed text with a header; ids stay text, and numbers that do not parse are null."""
    return clean_doubles(spark.read.csv(path, header=True, schema=schema, sep=sep, encoding=encoding, mode="PERMISSIVE"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return clean_doubles(spark.read.schema(schema).json(path))


def read_parquet(spark: SparkSession, path: str, *, pinned: dict[str, str] | None = None) -> DataFrame:
    """A Parquet table; with ``pinned`` (file name -> SHA-256) only if its files are these, byte for byte."""
    if pinned is not None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        found = {r[0].rpartition("/")[2]: r[1] for r in files.select("path", F.sha2("content", 256)).collect()}
        if found != pinned:
            raise ValueError(f"the files of {path} are not the pinned ones")
    return clean_doubles(spark.read.parquet(path))


def soa_rows(df: DataFrame, block: str, fields: list[str], keep: list[str]) -> DataFrame:
    """Rows of a struct of parallel arrays; arrays of different lengths are an error."""
    sizes = [F.size(f"{block}.{f}") for f in fields]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.when(F.coalesce(same, F.lit(False)), F.arrays_zip(*[F.col(f"{block}.{f}").alias(f) for f in fields])).otherwise(F.raise_error(F.lit("arrays of different lengths")).cast(_zip_type(df, block, fields)))
    return df.select(*keep, F.inline(zipped))


def _zip_type(df: DataFrame, block: str, fields: list[str]) -> T.DataType:
    return df.select(F.arrays_zip(*[F.col(f"{block}.{f}").alias(f) for f in fields]).alias("z")).schema["z"].dataType


FACTS = "map<string, struct<units: map<string, array<struct<`end`: string, val: double, form: string, filed: string, accn: string>>>>>"


def fact_rows(df: DataFrame, column: str, keep: list[str], forms: list[str], unit: str = "USD") -> DataFrame:
    """Long rows of nested facts: tag, then unit, then fact."""
    tags = df.select(*keep, F.explode(F.from_json(column, FACTS)).alias("tag", "_t"))
    facts = tags.select(*keep, "tag", F.inline(F.element_at(F.col("_t.units"), F.lit(unit))))
    return facts.where(F.col("form").isin(forms)).withColumns({"end": F.to_date("end"), "filed": F.to_date("filed")})


def pipe_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """cik|name|form|date|file lines; others are headers and are left out."""
    parts = F.split(column, r"\|")
    ok = (F.size(parts) == 5) & parts[0].rlike(r"^\d+$")
    rows = lines.where(ok).select(*[parts[i].alias(n) for i, n in enumerate(("cik", "name", "form", "filed", "file"))])
    return rows.withColumn("filed", F.expr("try_cast(filed AS date)"))


def arff_rows(lines: DataFrame, names: list[str], column: str = "value") -> DataFrame:
    """Numeric data lines; ``?`` is null."""
    data = lines.where(~F.col(column).rlike(r"^\s*(@|%|$)"))
    parts = F.split(column, ",")
    return data.select(*[F.expr(f"try_cast(trim(get(split({column}, ','), {i})) AS double)").alias(n) for i, n in enumerate(names)], F.size(parts).alias("n_fields")).where(F.col("n_fields") == len(names)).drop("n_fields")


def page_checks(pages: DataFrame, *, page: str, size: int) -> DataFrame:
    """Checks of a paginated search, a row for each page (page, total, relation, ids).

    A page is right if its total is exact and the same as on all pages, it is
    one of the pages that such a total has, it is full unless it is the last,
    and none of its ids stands on another page or twice.
    """
    ids = pages.select(page, F.explode("ids").alias("id"))
    again = ids.groupBy("id").agg(F.min(page).alias(page), F.count("*").alias("n")).where("n > 1")
    bad = ids.join(again.select("id"), "id", "left_semi").groupBy(page).agg(F.count("*").alias("repeated"))
    span = pages.agg(F.min("total").alias("lo"), F.max("total").alias("hi"), F.count("*").alias("n_pages"))
    rows = pages.join(bad, page, "left").join(F.broadcast(span))
    whole = F.least(F.lit(size), F.col("hi") - F.col(page) * size)
    return rows.select(
        page, F.size("ids").alias("n"), ((F.col("lo") == F.col("hi")) & (F.col("relation") == "eq")).alias("stable"), F.col("repeated").isNull().alias("no_duplicates"),
        ((F.size("ids") == whole) & (F.col(page) >= 0)).alias("full"), (F.col("n_pages") == F.ceil(F.col("hi") / size)).alias("complete"),
    )
