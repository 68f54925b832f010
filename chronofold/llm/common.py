"""Shared plumbing of the document operators.

Every operator takes ordinary DataFrames.  Intermediate results that feed more
than one later step are written as Parquet into the folder that the session
names in ``spark.checkpoint.dir``, so a lost executor never loses more than the
tasks it was running.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No key of a heavy set built by ``heavy_keys`` can number more than this.
HEAVY_SHARE = 1000
#: Keys with so many rows at most are joined like all others.
LEAST_HEAVY = 200

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
#: Bytes of rows that go to Python at a time.
BATCH_BYTES = 4 << 20
#: Tables of one job's own need no checksum files beside them: on a file system of this kind each file that a task writes
#: starts a process to set its mode, and while that starts it counts the executor's memory a second time.  Other stores take no notice.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_written: dict[str, SparkSession] = {}
_listed: ContextVar[tuple[list[str], ...]] = ContextVar("listed", default=())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster.

    Where ``spark.checkpoint.dir`` is unset a local session gets a temporary
    folder of this machine; a cluster, whose machines share none, is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one; what is written there is removed when Python exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def partitions_for(table: DataFrame, each: int = 16 << 20) -> int:
    """How many partitions to deal a table's rows to: by its size on disk as Spark estimates it, and at least the session's number."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // each)) if size < 1 << 55 else least


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, cutting its lineage.

    The shuffle files behind the write are released once it has ended, since
    the written table replaces them.  Tables are removed when Python exits.
    Unless the session has its own limit, batches of rows that go to Python
    are limited in bytes from then on: texts may be long.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH, None) in (None, _DEFAULT):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**PLAIN_FILES).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    _written[path] = spark
    for paths in _listed.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(path: str) -> None:
    spark = _written.pop(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(table: DataFrame) -> None:
    """Remove a table that ``stage_table`` has written; others are left alone."""
    folders = {f.rpartition("/")[0].rpartition("/")[2] for f in table.inputFiles()[:1]}
    for path in [p for p in _written if p.rpartition("/")[2] in folders]:
        _remove(path)


@contextmanager
def passing():
    """Tables that this thread stages within are removed at the end, but for those given to what it yields."""
    paths: list[str] = []
    kept: list[DataFrame] = []
    before = _listed.set((*_listed.get(), paths))
    try:
        yield kept.append
    finally:
        _listed.reset(before)
    stay = {f.rpartition("/")[0].rpartition("/")[2] for table in kept for f in table.inputFiles()[:1]}
    for path in paths:
        if path in _written and path.rpartition("/")[2] not in stay:
            _remove(path)


def drop_staged() -> None:
    """Remove every table that ``stage_table`` has written in this process."""
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


atexit.register(drop_staged)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(id_column: str = "doc_id", text_column: str = "text"):
    """A join key that is never null and that only rows with the same id and text share.

    Such rows have the same results, so they may share what is found for them.
    """
    return F.xxhash64(F.col(id_column).cast("long"), F.col(text_column))


def heavy_keys(counted: DataFrame, count: str, keys: list[str], share: int = HEAVY_SHARE) -> list[int]:
    """Hashes of the keys of ``counted`` whose count exceeds 1/share of the sum of all counts.

    At most ``share`` keys can do so, which bounds what comes to the driver.
    Keys with no more than LEAST_HEAVY rows never count as heavy.
    """
    total, most = counted.agg(F.sum(count), F.max(count)).first()
    limit = max((total or 0) // share, LEAST_HEAVY)
    if (most or 0) <= limit:
        return []
    return [r[0] for r in counted.where(F.col(count) > limit).select(F.xxhash64(*keys)).collect()]


#: Rows of a table of numbers that may be broadcast, at most (some megabytes).
SMALL = 100_000


def small(table: DataFrame) -> bool:
    """Whether a staged table of numbers has few enough rows to be broadcast; where not, a join shuffles."""
    return table.count() <= SMALL


def join_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a staged table of numbers, by broadcast if it is ``small``, else by a shuffle of both sides."""
    return left.join(F.broadcast(right) if small(right) else right.hint("merge"), keys, how)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: list[int], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where single keys may hold a large share of ``left``.

    ``right`` has at most one row for each key, so its part with the hashes
    ``heavy`` (see ``heavy_keys``) has a bounded number of rows.  Rows of heavy
    keys meet their partner by broadcast, without being shuffled; all others
    are few for each key and go through an ordinary shuffled join.
    """
    if not heavy:
        return left.join(right.hint("merge"), keys, how)
    hot = F.xxhash64(*keys).isin(heavy)
    rest = left.where(~hot).join(right.where(~hot).hint("merge"), keys, how)
    return rest.unionByName(left.where(hot).join(F.broadcast(right.where(hot)), keys, how))


# ---------------------------------------------------------------- Arrow side


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", limit: int = 2 << 20):
    """Cut Arrow batches so that each has at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        i = batch.schema.get_field_index(column)
        size = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, applied to each element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers that are kept for the next time, for each base.
POWERS = 1 << 19


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length() if n > 1 else 1)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b & (2**64 - 1))
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= POWERS:
            _powers[base] = have
    return have[0][:n], have[1][:n]


class range_hash:  # noqa: N801  used like a function
    """A function (starts, ends) -> 64-bit hashes of those ranges of ``symbols``.

    Polynomial hashing modulo 2**64 by prefix sums; every range costs the same.
    ``symbols`` are already well-mixed 64-bit values.
    """

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        up, self.down = powers(base, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.prefix[1:])

    def __call__(self, starts, ends):
        return mix64((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def fixed(self, width: int) -> np.ndarray:
        """Hashes of all ranges of one width in order, unmixed: only their upper bits are good."""
        m = max(0, len(self.prefix) - width)
        return (self.prefix[width:] - self.prefix[:m]) * self.down[:m]


#: White space of the word rule: space and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each row (with an end)."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SPACES[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of text that are hashed at a time.
BLOCK = 1 << 18


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15 | 1) -> np.ndarray:
    """64-bit hashes of words given by byte ranges in ascending order, block by block."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        at = starts[lo]
        out[lo:hi] = range_hash(_BYTE_CODE[raw[at : ends[hi - 1]]], base)(starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    return out


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)
