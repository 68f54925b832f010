"""Token ids in wavelet matrices, one for each shard of documents.

A shard holds the ids of consecutive documents as sixteen bit planes.  Plane b
has bit b of each id, in the order into which the planes above it have sorted
the ids (zeros before ones, stably).  With the number of ones before each block
of a plane, access, rank (counting) and select (occurrence lookup) take one step
for each plane, and read only the blocks that they touch.

Bytes of a shard: header, document table, for each plane its directory and its
blocks.  Blocks are deflated where that makes them smaller.  ``encode_shards``
writes a file for each shard into the shared folder, under a name of its own
that is renamed once it is whole, so a lost task leaves nothing that counts and
its next try writes the same again.  ``Shard`` opens such a file and reads only
the ranges that it needs.  Where the folder is in a store that only Spark can
write, the shards' bytes are rows of a table instead.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import partitions_for, shared_folder, slices, stage_table
from chronofold.llm.tokens import encoder, vocabulary_path

MAGIC = b"WMTX0001"
BITS = 16
#: Bits of a block, the unit that is deflated and has an entry in its plane's directory.
BLOCK = 1 << 15
#: A shard is closed once it has so many tokens.
SHARD_TOKENS = 1 << 20


def build(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, start: int = 0) -> bytes:
    """The bytes of one shard.  ids: all documents' ids in order; sizes: ids of each document."""
    head = struct.pack("<8sIIQQ", MAGIC, BITS, BLOCK, len(ids), len(sizes))
    table = np.asarray(doc_ids, "<i8").tobytes() + np.asarray(sizes, "<i8").tobytes()
    out = [head, table]
    v = np.asarray(ids, np.uint16)
    n_blocks = -(-len(v) // BLOCK)
    for b in range(BITS - 1, -1, -1):
        ones = (v & np.uint16(1 << b)) != 0
        packed = np.packbits(ones, bitorder="little").tobytes()
        counts = np.array([np.count_nonzero(ones[k : k + BLOCK]) for k in range(0, len(v), BLOCK)], np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        blocks = []
        for k in range(n_blocks):
            raw = packed[k * BLOCK // 8 : (k + 1) * BLOCK // 8]
            share = counts[k] / min(BLOCK, len(v) - k * BLOCK)
            small = zlib.compress(raw, 1) if min(share, 1 - share) < 0.2 else raw  # nearly even bits don't deflate
            blocks.append(small if len(small) < len(raw) else raw)
        lengths = np.array([len(x) for x in blocks], "<u4")
        out += [before.astype("<u4").tobytes(), lengths.tobytes(), *blocks]
        v = np.concatenate([v[np.flatnonzero(~ones)], v[np.flatnonzero(ones)]])
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


class _Held:
    """Bytes at hand, read like a file."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]

    def size(self) -> int:
        return len(self.data)


class Shard:
    """Queries on one shard: its bytes, or an open file (``read_at`` and ``size``), of which only the ranges in question are read."""

    def __init__(self, source, check: bool = True):
        self.source = source = _Held(bytes(source)) if isinstance(source, bytes | bytearray | memoryview) else source
        if check:
            data = source.read_at(source.size(), 0)
            if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
                raise ValueError("the shard's checksum does not match")
        at = struct.calcsize("<8sIIQQ")
        magic, bits, block, self.n, docs = struct.unpack("<8sIIQQ", source.read_at(at, 0))
        if (magic, bits, block) != (MAGIC, BITS, BLOCK):
            raise ValueError("not a shard of this format")
        self.doc_ids, self.sizes = np.frombuffer(source.read_at(16 * docs, at), "<i8").reshape(2, docs)
        at += 16 * docs
        n_blocks = -(-self.n // BLOCK)
        self.planes, self._blocks = [], {}
        for _ in range(BITS):
            head = np.frombuffer(source.read_at(4 * (2 * n_blocks + 1), at), "<u4").astype(np.int64)
            before, lengths = head[: n_blocks + 1], head[n_blocks + 1 :]
            at += 4 * (2 * n_blocks + 1)
            places = at + np.concatenate([[0], np.cumsum(lengths)])
            self.planes.append((before, places, self.n - int(before[-1])))
            at = int(places[-1])

    def _bits(self, plane: int, k: int) -> np.ndarray:
        """The bits of one block."""
        if (plane, k) not in self._blocks:
            if len(self._blocks) > 256:
                self._blocks.clear()
            places = self.planes[plane][1]
            raw = self.source.read_at(int(places[k + 1] - places[k]), int(places[k]))
            length = min(BLOCK, self.n - k * BLOCK)
            if len(raw) < -(-length // 8):
                raw = zlib.decompress(raw)
            self._blocks[plane, k] = np.unpackbits(np.frombuffer(raw, np.uint8), count=length, bitorder="little")
        return self._blocks[plane, k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, r = divmod(i, BLOCK)
        return int(self.planes[plane][0][k]) + (int(self._bits(plane, k)[:r].sum(dtype=np.int64)) if r else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(BITS):
            bit = int(self._bits(p, i // BLOCK)[i % BLOCK])
            value = 2 * value + bit
            ones = self._ones(p, i)
            i = self.planes[p][2] + ones if bit else i - ones
        return value

    def rank(self, token: int, end: int, start: int = 0) -> int:
        """How often the id occurs at positions start to end, exclusive."""
        lo, hi = start, end
        for p in range(BITS):
            a, b = self._ones(p, lo), self._ones(p, hi)
            if token >> (BITS - 1 - p) & 1:
                lo, hi = self.planes[p][2] + a, self.planes[p][2] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of the id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        start = 0
        for p in range(BITS):
            ones = self._ones(p, start)
            start = self.planes[p][2] + ones if token >> (BITS - 1 - p) & 1 else start - ones
        i = start + k
        for p in range(BITS - 1, -1, -1):
            zeros = self.planes[p][2]
            i = self._find(p, 1, i - zeros) if token >> (BITS - 1 - p) & 1 else self._find(p, 0, i)
        return i

    def _find(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th bit of that value in a plane."""
        before = self.planes[plane][0]
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._bits(plane, block) == bit)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the sorts from the last plane up."""
        v = np.zeros(self.n, np.uint16)
        for p in range(BITS - 1, -1, -1):
            ones = np.concatenate([self._bits(p, k) for k in range(-(-self.n // BLOCK))]).astype(bool) if self.n else np.zeros(0, bool)
            zeros = self.planes[p][2]
            up = np.empty_like(v)
            up[np.flatnonzero(~ones)] = v[:zeros]
            up[np.flatnonzero(ones)] = v[zeros:] | np.uint16(1 << (BITS - 1 - p))
            v = up
        return v

    def documents(self):
        """(doc_id, ids) for each document."""
        ids, ends = self.decode(), np.cumsum(self.sizes)
        for doc, size, end in zip(self.doc_ids.tolist(), self.sizes.tolist(), ends.tolist(), strict=True):
            yield doc, ids[end - size : end]


SHARDS = "part int, shard int, n_docs long, n_tokens long, path string, data binary"


def _store(folder: str) -> str | None:
    """The folder, made, if files can be written there directly; None for stores that only Spark reaches."""
    try:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ValueError, OSError):
        return None
    return folder


def _opened(path: str | None, data: bytes | None, whole: bool = False) -> Shard:
    """A shard by its file, or by its bytes.  One that is read as a whole is held against its checksum; else only ranges are read."""
    if path is None:
        return Shard(data)
    store, place = pafs.FileSystem.from_uri(path)
    file = store.open_input_file(place)
    return Shard(file.read()) if whole else Shard(file, check=False)


def encode_shards(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, vocabulary: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode documents in ascending id order and write their shards; returns the table of shards.

    Columns part and shard give the order, and path the file (or data the
    bytes).  A null text is empty, so its document has its end id only;
    documents with a null id come first, under the least long; rows with equal
    ids are all kept, next to each other in the order of their texts' hashes;
    other columns are ignored.
    """
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("order"))
    # of many rows with one id, or none, the texts' hashes decide, so they spread like others
    ordered = rows.repartitionByRange(partitions or partitions_for(docs), "doc_id", "order").sortWithinPartitions("doc_id", "order").drop("order")
    folder = _store(shared_folder(rows.sparkSession, "shards"))

    def run(batches):
        encode, part, shard = encoder(path).encode, TaskContext.get().partitionId(), 0
        docs_, parts, tokens = [], [], 0
        store, root = pafs.FileSystem.from_uri(folder) if folder else (None, None)

        def close():
            nonlocal shard
            ids = np.concatenate(parts)
            data = build(ids, np.array(docs_, np.int64), np.array([len(x) for x in parts], np.int64))
            name = None
            if folder:
                name = f"{part:06d}-{shard:06d}.wmtx"
                unfinished = f"{root}/{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(unfinished) as f:
                    f.write(data)
                store.move(unfinished, f"{root}/{name}")
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(docs_)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([name and f"{folder}/{name}"], pa.string()), pa.array([None if name else data], pa.binary())]
            shard += 1
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "n_docs", "n_tokens", "path", "data"])

        for batch in slices(batches, limit=4 << 20):
            d = batch.to_pydict()
            for doc, ids in zip(d["doc_id"], encode(d["text"]), strict=True):
                docs_.append(doc)
                parts.append(np.append(ids, np.uint16(end_id)))
                tokens += len(ids) + 1
                if tokens >= SHARD_TOKENS:
                    yield close()
                    docs_, parts, tokens = [], [], 0
        if docs_:
            yield close()

    return stage_table(ordered.mapInArrow(run, SHARDS), "wavelet")


def with_starts(shards: DataFrame) -> DataFrame:
    """Add ``start``, the tokens of all shards before each.

    Totals of partitions meet in one task (a row for each partition); shards
    are summed within their own partition.
    """
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = shards.select("part", "shard", "n_tokens").withColumn("own", own).join(F.broadcast(before), "part")
    starts = starts.select("part", "shard", (F.col("base") + F.col("own")).alias("start"))
    return shards.join(starts, ["part", "shard"])


def read_digest(shards: DataFrame) -> DataFrame:
    """Read shards back that have ``start``; per document its place, length and crc32 of its ids."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs_, starts, sizes, crcs, at = [], [], [], [], row["start"]
                for doc, ids in _opened(row["path"], row["data"], whole=True).documents():
                    docs_.append(None if doc == -(2**63) else doc)
                    starts.append(at)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs_, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _dealt(shards, "start", "path", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _dealt(shards: DataFrame, *columns: str) -> DataFrame:
    """Shards dealt out evenly: the table of shards is small, and what it names is large."""
    return shards.select(*columns).repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """Occurrences of each given id in each shard, with the place of its first one there (null: none).

    Of each shard's file only the blocks are read that the counting touches.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = _opened(row["path"], row["data"])
                counts = [s.count(t) for t in tokens]
                first = [s.select(t, 0) if c else None for t, c in zip(tokens, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(tokens), pa.int32()), pa.array([row["shard"]] * len(tokens), pa.int32()), pa.array(tokens, pa.int32()), pa.array(counts, pa.int64()), pa.array(first, pa.int64())],
                    ["part", "shard", "token", "n", "first"],
                )

    return _dealt(shards, "part", "shard", "path", "data").mapInArrow(run, "part int, shard int, token int, n long, first long")


def occurrences(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """Occurrences of each given id in all shards, which have ``start``: token, n, and the places of the first and the last one.

    Places count the ids of all documents in order.  Ids that nowhere occur have
    n 0 and no places.  Counting and lookup go through the planes of each file;
    what leaves a shard is a row for each id that it has.
    """
    wanted = shards.sparkSession.createDataFrame([(t,) for t in sorted(set(tokens))], "token int")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s, found = _opened(row["path"], row["data"]), []
                for t in tokens:
                    if n := s.count(t):
                        found.append((t, n, row["start"] + s.select(t, 0), row["start"] + s.select(t, n - 1)))
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["token", "n", "first", "last"])

    told = _dealt(shards, "start", "path", "data").mapInArrow(run, "token int, n long, first long, last long")
    summed = told.groupBy("token").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return wanted.join(summed, "token", "left").select("token", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "first", "last")
