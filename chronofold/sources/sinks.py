"""Sinks: nothing is overwritten by accident, and readers see whole results only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Write where nothing is yet, by Spark's commit protocol, and read back."""
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
    reader = df.sparkSession.read.schema(df.schema)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)


def unseen(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``; what is there is never changed."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    old = df.sparkSession.read.schema(df.schema).parquet(path)
    unseen(df, old, keys).write.mode("append").parquet(path)


def latest_by_id(df: DataFrame, id_column: str, order: str) -> DataFrame:
    """Upsert semantics: of rows with one id the last stays."""
    w = Window.partitionBy(id_column).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def export_roles(df: DataFrame, path: str, *, role: str, target: str, closed: str) -> DataFrame:
    """One folder for each role; the target is withheld from the closed role."""
    out = df.withColumn(target, F.when(F.col(role) != closed, F.col(target)))
    out.write.mode("errorifexists").partitionBy(role).parquet(path)
    return df.sparkSession.read.parquet(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, counting copies."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def publish(spark: SparkSession, df: DataFrame, root: str) -> str:
    """Write a new version below ``root``, and then one small pointer file that names it.

    Pointers are numbered, created once and never replaced, so of two publishers
    that have the same number the later one fails.  A reader takes the last
    pointer that is whole: the old version as long as the new one is not.  An
    empty version is not published.
    """
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{version}")
    if spark.read.schema(df.schema).parquet(f"{root}/{version}").limit(1).count() == 0:
        raise ValueError("an empty version is not published")
    number = len(_pointers(spark, root))
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/{number:012d}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place.getParent())
    try:
        pointer = fs.create(place, False)  # fails where the file is there, on every store
    except Exception as e:
        if "exists" in str(e).lower():
            raise ValueError("another version was published meanwhile") from None
        raise
    pointer.writeBytes(json.dumps({"version": version}) + "\n")
    pointer.close()
    return version


def _pointers(spark: SparkSession, root: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was published last."""
    for pointer in reversed(_pointers(spark, root)):
        named = spark.read.schema("version string").json(pointer).where("version IS NOT NULL").first()
        if named:
            return spark.read.parquet(f"{root}/{named.version}")
    raise ValueError("nothing is published there")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def markdown(rows: list, columns: list[str]) -> str:
    """A small, already collected report as a table."""
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows])
