"""SimHash fingerprints and search within a Hamming radius.

Terms are words and pairs of neighbouring words; a text that is nearly without
spaces, or has fewer than four words, gives runs of eight bytes instead (the
whole text, if shorter).  Each occurrence of a term votes on every bit of the
fingerprint with the term's weight, its length in bytes: long terms are rare
ones.  A bit is set if its votes are positive.

For the search the bits are cut into blocks; two fingerprints within radius r
agree on at least (blocks - r) of them, so a table for each choice of so many
blocks, keyed by their bits, holds every such pair under a common key.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import join_small, mix64, partitions_for, range_hash, slices, stage_table, text_bytes, word_bounds, word_hashes, _BYTE_CODE

BITS = 128
#: The radius of the registered search, and the blocks of its tables.
RADIUS, BLOCKS = 3, 5
_RUN = 8


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of every term occurrence."""
    starts, ends, first = word_bounds(raw, offsets)
    per_row = np.diff(first)
    size = np.diff(offsets)
    plain = (per_row < 4) | (size > 24 * per_row)
    out = []
    if len(starts):
        h = word_hashes(raw, starts, ends)
        row = np.repeat(np.arange(len(per_row)), per_row)
        length = (ends - starts).astype(np.float32)
        use = ~plain[row]
        out.append((row[use], h[use], length[use]))
        pair = np.flatnonzero(use[1:] & (row[1:] == row[:-1]))
        out.append((row[pair], mix64(h[pair] * np.uint64(0xA24BAED4963EE407) + h[pair + 1]), 2 * (length[pair] + length[pair + 1])))
    if plain.any() and len(raw):
        at = np.flatnonzero(plain & (size > 0))
        count = np.maximum(size[at] - _RUN + 1, 1)
        row = np.repeat(at, count)
        begin = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offsets[row]
        end = np.minimum(begin + _RUN, offsets[row + 1])
        out.append((row, range_hash(_BYTE_CODE[raw], 0x9E6C63D0876A9A47)(begin, end), np.ones(len(row), np.float32)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.float32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32) * 2 - 1)


def fingerprints(column: pa.Array) -> np.ndarray:
    """rows x 16 bytes; a text without terms (empty or null) has all bits clear."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    row, h, w = _terms(raw, offsets)
    order = np.argsort(row, kind="stable")
    row, h, w = row[order], h[order], w[order]
    for lo in range(0, n, 64):  # so many rows at a time that the counts stay in cache
        hi = min(n, lo + 64)
        a, b = np.searchsorted(row, [lo, hi])
        if a == b:
            continue
        base, weight = (row[a:b] - lo) * 256, w[a:b].astype(np.float64)
        for half in range(2):
            code = h[a:b] if half == 0 else mix64(h[a:b] ^ np.uint64(0x94D049BB133111EB))
            for k in range(8):
                byte = (code >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)
                votes = np.bincount(base + byte, weight, (hi - lo) * 256).reshape(-1, 256) @ _SIGNS
                out[lo:hi, half * 8 + k] = np.packbits(votes > 0, axis=1, bitorder="little")[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of differing bits stands for, from 0 to 1; equal fingerprints give 1."""
    differ = np.unpackbits(a ^ b, axis=1).sum(axis=1)
    return np.where(differ == 0, 1.0, np.maximum(0.0, np.cos(np.pi * differ / BITS)))


def add_fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and its fingerprint as two longs, ``hi`` and ``lo``; nulls count as empty, equal rows stay."""

    def run(batches):
        for batch in slices(batches, "text"):
            words = fingerprints(batch.column(1)).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words[:, 0]), pa.array(words[:, 1])], ["doc_id", "hi", "lo"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, hi long, lo long")


def block_tables(radius: int, blocks: int) -> list[tuple[int, int]]:
    """A mask of (hi, lo) for each choice of blocks that pairs within the radius may agree on."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be less than the number of blocks")
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in itertools.pairwise(cuts)]
    tables = []
    for chosen in itertools.combinations(masks, blocks - radius):
        m = sum(chosen)
        halves = [m & (2**64 - 1), m >> 64]
        tables.append(tuple(x - 2**64 if x >= 2**63 else x for x in halves))
    return tables


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 6, blocks: int = 9) -> DataFrame:
    """Pairs of distinct fingerprints (hi, lo) - (hi2, lo2) no more than ``radius`` bits apart.

    Exact: every such pair shares a key in one of the permuted block tables.
    Both sides are first reduced to distinct fingerprints, so copies cost
    nothing and nothing is lost; members come from the fingerprints' tables.
    Rows with null fingerprints match nothing.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(m[0]).alias("a"), F.lit(m[1]).alias("b")) for k, m in enumerate(block_tables(radius, blocks))])

    def keyed(df, names):
        d = df.select("hi", "lo").where("hi IS NOT NULL AND lo IS NOT NULL").distinct().withColumn("_t", F.explode(tables))
        key = F.struct(F.col("_t.t").alias("t"), F.col("hi").bitwiseAND(F.col("_t.a")).alias("x"), F.col("lo").bitwiseAND(F.col("_t.b")).alias("y"))
        return d.select(key.alias("key"), F.col("hi").alias(names[0]), F.col("lo").alias(names[1]))

    pairs = keyed(queries, ("hi", "lo")).join(keyed(corpus, ("hi2", "lo2")), "key")
    bits = F.bit_count(F.col("hi").bitwiseXOR(F.col("hi2"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("lo2")))
    return pairs.select("hi", "lo", "hi2", "lo2", bits.alias("bits")).where(F.col("bits") <= radius).distinct()


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _compare(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    edited = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
    fp, fe, fn = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, edited, following[-1:]))
    nexts = np.concatenate([fp[1:], fn]) if len(texts) > 1 and all(a is b for a, b in zip(texts[1:], following, strict=False)) else fingerprints(pa.array(following, pa.large_string()))
    as_hex = lambda x: [r.tobytes().hex() for r in x]
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], as_hex(fp), as_hex(fe), likeness(fp, fe), likeness(fp, nexts)]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return [pa.array(c, t) for c, t in zip(columns, types, strict=True)]


def neighbours_digest(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document beside its edited form and the next document by id.

    Order: id (nulls first), then the text's hash and the text; the last document is followed by the
    first.  Null texts are empty; rows with equal ids are all kept.  An empty
    table gives no rows.  Documents are dealt by ranges of ids; a task knows
    all followers but that of its last row, so the first and last text of each
    range meet afterwards, range by range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # of many rows with one id, or none, the texts' hashes decide, so they spread like others
    ordered = rows.withColumn("order", F.xxhash64("text")).repartitionByRange(partitions_for(docs), "doc_id", "order").sortWithinPartitions("doc_id", "order", "text").drop("order")
    schema = f"{_ROW}, part int, first_text string, last_id long, last_text string"

    def run(batches):
        part, first, held = TaskContext.get().partitionId(), None, None
        for batch in slices(batches, "text"):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if first is None:
                first = texts[0]
            if held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            if len(texts) > 1:
                out = _compare(ids[:-1], texts[:-1], texts[1:])
                k = len(texts) - 1
                yield pa.RecordBatch.from_arrays([*out, *[pa.nulls(k, t) for t in (pa.int32(), pa.string(), pa.int64(), pa.string())]], [*_NAMES, "part", "first_text", "last_id", "last_text"])
        if held is not None:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([part], pa.int32()), pa.array([first]), pa.array([held[0]], pa.int64()), pa.array([held[1]])], [*_NAMES, "part", "first_text", "last_id", "last_text"])

    made = stage_table(ordered.mapInArrow(run, schema), "simhash")
    edges = made.where("part IS NOT NULL").select("part", "first_text", "last_id", "last_text")
    # only the numbers of the ranges that have rows are put in order in one place; the texts meet by number
    numbers = stage_table(edges.select("part", F.row_number().over(Window.orderBy("part")).alias("number")), "ranges")
    numbered = join_small(edges, numbers, ["part"])
    before = F.when(F.col("number") > 1, F.col("number") - 1).otherwise(numbers.count())
    ahead = numbered.select(before.cast("int").alias("number"), F.col("first_text").alias("following"))
    edges = numbered.join(ahead.hint("merge"), "number").select(F.col("last_id").alias("doc_id"), F.col("last_text").alias("text"), "following")

    def finish(batches):
        for batch in slices(batches, "text", 1 << 20):
            ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays(_compare(ids, texts, following), _NAMES)

    return made.where("part IS NULL").select(*_NAMES).unionByName(edges.mapInArrow(finish, _ROW))
