"""Tables that cut a plan: written into the cluster's shared folder and read back."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared place; a local session without one gets a temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own; it is removed when Python exits."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_file(uri: str):
    """The store of an address as Arrow opens it, and the path in it."""
    from pyarrow import fs

    plain = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if plain == uri else (fs.LocalFileSystem(), "/" + plain.lstrip("/"))


def drop_folders() -> None:
    """Remove the folders that ``fresh_folder`` has named in this process."""
    while _made:
        spark, path = _made.pop()
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


atexit.register(drop_folders)


def estimated_bytes(df: DataFrame) -> int:
    """The size that Spark's planner expects, from its statistics alone; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
