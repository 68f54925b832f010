"""Near-duplicate documents by HyperMinHash registers, banding and verification.

A document is the set of its distinct word shingles.  A register keeps the
least hash of its share of the set as a count of leading zeros and ten mantissa
bits, sixteen bits in all.  Sets of at least ``SMALL`` shingles use one hash
whose first bits choose the register; empty registers borrow from others by a
fixed rule.  Smaller sets would leave most registers empty, so theirs come from
a hash of their own each; sizes at which a pair could mix the two use both.

Bands of four registers are the keys of candidate groups.  With 32 bands, a
pair at the threshold of 0.8 fails to meet with a probability below 1e-7.

Documents with equal sets are one class from the start, so copies cost nothing.
Within a candidate group not all pairs are made: first each group's members are
compared with one leader, links join classes into components, and this is
repeated with other leaders while it pays; then, of the documents in groups that
still hold several components, all pairs that an exact prefix filter leaves are
compared.  So no link between components is missed,
and a tight group of any size costs one comparison a member.  A comparison
first corrects the share of equal registers for chance collisions; where that
estimate is far below the threshold the pair is dropped, else the full sets
decide.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import heavy_keys, join_small, mix64, passing, row_key, skew_join, slices, small, stage_table, text_bytes, word_bounds, word_hashes

REGISTERS, BAND = 128, 4
MANTISSA = 10
#: Sets up to LARGE have registers of the first kind, sets from SMALL on of the second; LARGE * 0.8 > SMALL.
SMALL, LARGE = 200, 320
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_OWN = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and offsets of rows."""
    raw, offsets = text_bytes(column)
    raw = _LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets)
    h = word_hashes(raw, starts, ends)
    per_row = np.diff(first)
    row = np.repeat(np.arange(len(per_row)), per_row)
    made = []
    m = len(h) - words + 1
    if m > 0:
        ok = np.flatnonzero(row[: m] == row[words - 1 :])
        code = np.zeros(len(ok), np.uint64)
        for k in range(words):
            code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + h[ok + k])
        made.append((row[ok], code))
    for r in np.flatnonzero((per_row > 0) & (per_row < words)):  # fewer words: the whole sequence
        code = np.full(1, 0x5851F42D4C957F2D + int(per_row[r]), np.uint64)
        for k in range(first[r], first[r + 1]):
            code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + h[k])
        made.append((np.array([r]), code))
    if not made:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    row, code = (np.concatenate(x) for x in zip(*made, strict=True))
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    row, code = row[new], code[new]
    return code, np.searchsorted(row, np.arange(len(offsets)))


def _pack(least: np.ndarray) -> np.ndarray:
    """Registers of least hashes: leading zeros (at most 53) and the bits after the first one."""
    x = np.maximum(least, np.uint64(1 << MANTISSA))
    top = np.floor(np.log2(x.astype(np.float64))).astype(np.int64)
    top = np.where((np.uint64(1) << np.minimum(top, 63).astype(np.uint64)) > x, top - 1, np.minimum(top, 63))
    mantissa = (x >> (top - MANTISSA).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return ((63 - top).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def own_registers(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x registers, each register with its own hash of the whole set; rows are not empty."""
    out = np.empty((len(bounds) - 1, REGISTERS), np.uint64)
    for i in range(REGISTERS):
        out[:, i] = np.minimum.reduceat(mix64(code ^ _OWN[i]), bounds[:-1])
    return _pack(out)


def shared_registers(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x registers from one hash, empty registers filled from others."""
    n = len(bounds) - 1
    x = mix64(code ^ np.uint64(0x2545F4914F6CDD1D))
    cell = np.repeat(np.arange(n), np.diff(bounds)) * REGISTERS + (x >> np.uint64(57)).astype(np.int64)
    rest = x << np.uint64(7)
    order = np.argsort(cell, kind="stable")
    cell, rest = cell[order], rest[order]
    firsts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    out = np.full(n * REGISTERS, 2**64 - 1, np.uint64)
    filled = np.zeros(n * REGISTERS, bool)
    out[cell[firsts]] = np.minimum.reduceat(rest, firsts)
    filled[cell[firsts]] = True
    have = filled.copy()
    value = out.copy()
    empty = np.flatnonzero(~filled)
    turn = 1
    while len(empty):
        # the source depends on the register and the turn alone, so equal sets borrow alike
        pick = (mix64((empty % REGISTERS).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(turn)) >> np.uint64(57)).astype(np.int64)
        source = empty - empty % REGISTERS + pick
        found = have[source]
        value[empty[found]] = mix64(out[source[found]] + np.uint64(turn))
        empty = empty[~found]
        turn += 1
    return _pack(value).reshape(n, REGISTERS)


def band_keys(registers: np.ndarray, kind: int) -> np.ndarray:
    """rows x bands of 64-bit keys."""
    r = registers.astype(np.uint64).reshape(len(registers), -1, BAND)
    code = np.arange(r.shape[1], dtype=np.uint64)[None, :] * np.uint64(2) + np.uint64(kind)
    for k in range(BAND):
        code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
    return code.view(np.int64)


@lru_cache(100_000)
def chance(n1: int, n2: int) -> float:
    """The share of registers of different least hashes that are equal all the same."""
    z = np.arange(1, 50, dtype=np.float64)
    level = lambda n: np.exp(-n * 2.0**-z) - np.exp(-n * 2.0 ** (1 - z))  # noqa: E731  least hash within a level
    return float((level(n1) * level(n2)).sum()) / (1 << MANTISSA)


def estimate(r1: np.ndarray, r2: np.ndarray, n1: int, n2: int) -> float:
    """The Jaccard similarity that the registers stand for, corrected for chance collisions."""
    share = float((r1 == r2).mean())
    per = n1 if max(n1, n2) <= LARGE else max(1, n1 // REGISTERS)
    c = chance(per, max(1, per * n2 // n1))
    return max(0.0, (share - c) / (1 - c))


SKETCH = "doc_id long, k long, n_shingles long, h1 long, h2 long, keys array<long>"


def identity_hashes(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set; with its size they stand for the set."""
    full = np.flatnonzero(np.diff(bounds))
    h = np.zeros((2, len(bounds) - 1), np.uint64)
    if len(full):
        for k, salt in enumerate((0x94D049BB133111EB, 0xBF58476D1CE4E5B9)):
            h[k, full] = np.add.reduceat(mix64(code ^ np.uint64(salt)), bounds[full])
    return h.view(np.int64)


def sketch(docs: DataFrame, words: int, *, id_column: str, text_column: str) -> DataFrame:
    """Row key, size, identity and band keys of each document's set."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 19):
            code, bounds = shingles(batch.column(1), words)
            size = np.diff(bounds)
            h = identity_hashes(code, bounds)
            keys: list = [[] for _ in size]
            for kind, rows, make in _kinds(size):
                if len(rows):
                    made = band_keys(make(*_taken(code, bounds, size, rows)), kind)
                    for r, row in zip(rows.tolist(), made, strict=True):
                        keys[r].append(row)
            flat = [np.concatenate(k) if k else np.zeros(0, np.int64) for k in keys]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]), pa.int32()), pa.array(np.concatenate(flat), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size.astype(np.int64)), pa.array(h[0]), pa.array(h[1]), lists], ["doc_id", "k", "n_shingles", "h1", "h2", "keys"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), row_key(id_column, text_column).alias("k")).mapInArrow(run, SKETCH)


def set_blobs(texts: DataFrame, words: int) -> DataFrame:
    """cid, size, the class's full set as ascending 64-bit hashes, and its registers of each kind that its size has.

    ``texts`` has text, cid and the class's identity (n_shingles, h1, h2).  A
    text that does not have that set, which shares a row key by chance, gives
    no row.
    """

    def run(batches):
        for batch in slices(batches, "text", 1 << 19):
            code, bounds = shingles(batch.column(0), words)
            data, size, h = code.tobytes(), np.diff(bounds), identity_hashes(code, bounds)
            own = np.array([batch.column(i).to_numpy() for i in (2, 3, 4)]) == np.array([size, *h])
            registers = [[None] * len(size) for _ in range(2)]
            for kind, rows, make in _kinds(size):
                if len(rows):
                    for r, x in zip(rows.tolist(), make(*_taken(code, bounds, size, rows)), strict=True):
                        registers[kind][r] = x.tobytes()
            blobs = [data[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            made = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(blobs, pa.binary()), *[pa.array(x, pa.binary()) for x in registers]], ["cid", "n_shingles", "blob", "own", "shared"])
            yield made.filter(pa.array(own.all(axis=0)))

    return texts.select("text", "cid", "n_shingles", "h1", "h2").mapInArrow(run, "cid long, n_shingles long, blob binary, own binary, shared binary")


def _kinds(size: np.ndarray):
    return ((0, np.flatnonzero((size > 0) & (size <= LARGE)), own_registers), (1, np.flatnonzero(size >= SMALL), shared_registers))


def _taken(code: np.ndarray, bounds: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and offsets of some rows only."""
    return np.concatenate([code[bounds[r] : bounds[r + 1]] for r in rows]), np.concatenate([[0], np.cumsum(size[rows])])


def _beside(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Staged pairs (a, b) with columns of both their sets, as name_a and name_b."""
    named = lambda x: sets.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    if small(pairs):  # the sets stay where they are
        return skew_join(named("b").join(F.broadcast(pairs.select("a", "b")), "b"), named("a"), ["a"], [])
    heavy = heavy_keys(pairs.groupBy("a").count(), "count", ["a"], 100)
    return skew_join(skew_join(pairs.select("a", "b"), named("b"), ["b"], []), named("a"), ["a"], heavy)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Registers are compared first: a pair whose estimate is more than five
    standard errors below the threshold does not fetch its full sets.
    """
    floor = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    def likely(batches):
        for batch in batches:
            a, b, *rest = (batch.column(i).to_pylist() for i in range(8))
            keep = []
            for n, m, x0, y0, x1, y1 in zip(*rest, strict=True):
                x, y = (x1, y1) if max(n, m) > LARGE else (x0, y0)
                keep.append(100 * min(n, m) >= percent * max(n, m) and estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, m) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches):
        for batch in slices(batches, "blob_b", 4 << 20):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    names = ["n_shingles", "own", "shared"]
    near = _beside(pairs, sets, names).select("a", "b", *[f"{c}_{x}" for c in names for x in "ab"]).mapInArrow(likely, "a long, b long")
    near = stage_table(near, "likely")
    return _beside(near, sets, ["blob"]).select("a", "b", "blob_a", "blob_b").mapInArrow(exact, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in ``edges`` (a, b); component is its least reachable id.

    Labels flow along edges and along labels themselves, so long chains take a
    logarithm of their length in rounds.  Each round is a written table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage_table(both, "edges")
    labels = stage_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    few = small(labels)  # of so few there is a copy for each task; of more, each step is a shuffle
    busy = [] if few else heavy_keys(both.groupBy("a").count(), "count", ["a"])
    while True:
        known, jump = labels.select(F.col("id").alias("a"), "component"), labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        if few:
            near = both.join(F.broadcast(known), "a")
            step = labels.join(F.broadcast(jump), "component", "left")
        else:
            near = skew_join(both, known, ["a"], busy)
            step = skew_join(labels, jump, ["component"], heavy_keys(labels.groupBy("component").count(), "count", ["component"]), "left")
        near = near.groupBy("b").agg(F.min("component").alias("near")).withColumnRenamed("b", "id")
        step = step.join(F.broadcast(near) if few else near, "id", "left")
        new = stage_table(step.select("id", F.col("component").alias("old"), F.least("component", "further", "near").alias("component")), "labels")
        labels = new.select("id", "component")
        if not new.where("component <> old").limit(1).count():
            return labels


#: Cells of the frequency table that orders shingles; its size does not depend on the input.
CELLS = 1 << 20


def prefix_pairs(members: DataFrame, blobs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the threshold; none that does is left out.

    Two sets with a similarity of t share one of the (n - ceil(t n) + 1) first
    shingles of each, whatever the order that both use.  Here it is from rare
    to frequent, by a table of counts of hashed shingles, so what many
    documents have in common (a line, a passage) pairs nobody.  The place of a
    shared shingle also bounds how many can follow it.
    """
    spark = members.sparkSession
    rows = stage_table(join_small(blobs.select("cid", "blob"), members, ["cid"]).select("cid", "component", "blob"), "open-sets")

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(blob, np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    cells = rows.select("blob").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(CELLS, np.int64)
    often[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    sent = spark.sparkContext.broadcast(often)

    def prefix(batches):
        table = sent.value
        for batch in slices(batches, "blob", 4 << 20):
            out: list[tuple] = []
            for cid, component, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = np.frombuffer(blob, np.uint64)
                n = len(h)
                first = np.lexsort((h, table[(h % np.uint64(CELLS)).astype(np.int64)]))[: n + percent * -n // 100 + 1]
                out.append((h[first].view(np.int64), np.arange(len(first)), np.full(len(first), n), np.full(len(first), cid), np.full(len(first), component)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["key", "place", "n", "id", "component"])

    keyed = stage_table(rows.select("cid", "component", "blob").mapInArrow(prefix, "key long, place long, n long, id long, component long"), "prefixes")
    # of each shingle's documents only those outside its largest component look for partners
    held = keyed.groupBy("key", "component").agg(F.count("*").alias("c"))
    shared = held.groupBy("key").agg(F.sum("c").alias("size"), F.max_by("component", F.struct("c", "component")).alias("major"), F.count("*").alias("parts")).where("parts > 1")
    shared = stage_table(shared.select("key", "size", "major"), "shared-keys")
    major = shared.select("key", "major")
    keyed = stage_table(join_small(keyed, major, ["key"]) if small(major) else skew_join(keyed, major, ["key"], heavy_keys(shared, "size", ["key"])), "shared-prefixes")
    x, y = (keyed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("place", "n", "id", "component", "major")]) for side in "ab")
    n, m = F.col("n_a"), F.col("n_b")
    most = 1 + F.least(n - 1 - F.col("place_a"), m - 1 - F.col("place_b"))
    once = (F.col("component_b") == F.col("major_b")) | (F.col("id_a") < F.col("id_b"))
    close = (F.col("component_a") != F.col("component_b")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))
    pairs = x.where("component_a <> major_a").join(y, (x["key"] == y["key"]) & once & close)
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


#: Star rounds at most; each only saves comparisons that the last step would make, and none follows one that linked little.
ROUNDS, WORTH = 4, 0.02
#: With so few pairs of different components left for each row, they are paired by the filter at once.
SPARSE = 16


def classes_of(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(sketches, classes): each row with its set's identity, and each set with its component.

    Classes have n_shingles, h1, h2, the number of their rows, ``rep`` (their
    least id), ``first`` (their least row: none, doc_id, k; rows without an id
    come last) and ``component``, a class number that linked classes share.
    Rows take part by their sets alone, so repeated and null ids do no harm.
    """
    sketches = stage_table(sketch(docs, words, id_column=id_column, text_column=text_column), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k"))
    classes = sketches.where("n_shingles > 0").groupBy(*IDENTITY).agg(F.count("*").alias("members"), F.min("doc_id").alias("rep"), first.alias("first"), F.first("keys").alias("keys"))
    classes = stage_table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = _linked(docs, classes, words, percent, id_column, text_column)
    classes = classes.drop("keys")
    if labels is None:
        return sketches, classes.withColumn("component", F.col("cid"))
    classes = join_small(classes, labels.select(F.col("id").alias("cid"), "component"), ["cid"], "left")
    return sketches, stage_table(classes.withColumn("component", F.coalesce("component", "cid")), "components")


IDENTITY = ["n_shingles", "h1", "h2"]


def _linked(docs: DataFrame, classes: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame | None:
    """(id, component) of the classes that link with another; None if there is no candidate."""
    keyed = classes.select("cid", "rep", "n_shingles", F.explode("keys").alias("key"))
    shared = stage_table(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    grouped = stage_table(skew_join(keyed, shared, ["key"], heavy_keys(shared, "size", ["key"])), "groups")
    involved = stage_table(join_small(classes.select("cid", F.col("first.k").alias("k"), *IDENTITY), stage_table(grouped.select("cid").distinct(), "members"), ["cid"]), "involved")
    asked = involved.count()
    if not asked:
        return None
    texts = join_small(docs.select(row_key(id_column, text_column).alias("k"), F.col(text_column).alias("text")), involved, ["k"])
    blobs = stage_table(set_blobs(texts, words), "sets")
    if blobs.count() > asked:  # rows that are repeated whole give their set once; copies meet in their own partitions first
        blobs = stage_table(blobs.dropDuplicates(["cid"]), "sets")
    links, labels, linked = None, None, 1.0
    tested: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        members = grouped
        if labels is not None:
            label = labels.select(F.col("id").alias("cid"), "component")
            members = join_small(grouped, label, ["cid"], "left").withColumn("component", F.coalesce("component", "cid"))
            spread = members.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(
                F.sum("c").alias("size"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")
            ).where("pairs > 0")
            spread = stage_table(spread, "spread")
            pairs_left, rows_left = spread.agg(F.sum("pairs"), F.sum("size")).first()
            if not pairs_left:
                break
            # groups that have become one component are not looked at again
            open_ = spread.select("key", "size")
            members = join_small(members.drop("size"), open_, ["key"]) if small(open_) else skew_join(members.drop("size"), open_, ["key"], heavy_keys(spread, "size", ["key"]))
            members = stage_table(members, "open")
            grouped = members.drop("component")
            if pairs_left <= SPARSE * rows_left or (turn > 1 and linked < WORTH) or turn == ROUNDS:
                pairs = prefix_pairs(stage_table(members.select("cid", "component").distinct(), "open"), blobs, percent)
                pairs = stage_table(join_small(pairs, tested, ["a", "b"], "left_anti"), "pairs")
                links = links.unionByName(stage_table(verify(pairs, blobs, percent), "links"))
                labels = components(links)
                break
        else:
            members = members.withColumn("component", F.col("cid"))
        # first the class of the least id leads all its groups; later each group draws a leader of its own, so a member meets many
        rank = F.struct(F.col("rep").isNull(), "rep", "cid") if turn == 0 else F.xxhash64("cid", "key", F.lit(turn))
        leader = members.groupBy("key", "size").agg(F.min_by(F.struct(F.col("cid").alias("a"), F.col("component").alias("ca"), F.col("n_shingles").alias("n")), rank).alias("_l"))
        leader = stage_table(leader, "leaders")
        led = leader.select("key", "_l")
        pairs = join_small(members.drop("size"), led, ["key"]) if small(leader) else skew_join(members.drop("size"), led, ["key"], heavy_keys(leader, "size", ["key"]))
        pairs = pairs.where((F.col("component") != F.col("_l.ca")) & (100 * F.least("n_shingles", "_l.n") >= percent * F.greatest("n_shingles", "_l.n")))
        pairs = pairs.select(F.least("_l.a", "cid").alias("a"), F.greatest("_l.a", "cid").alias("b")).distinct()
        if tested is not None:
            pairs = join_small(pairs, tested, ["a", "b"], "left_anti")
        pairs = stage_table(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = stage_table(verify(pairs, blobs, percent), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        linked = found.count() / max(1, pairs.count())
    return labels


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept (it is its component's least id).

    Words are runs without ASCII white space, A-Z in lower case.  A text of
    fewer words than a shingle is one shingle of its own; null and empty texts
    have none and link with nothing.  Every row takes part by its own text, so
    rows with equal ids may be in different components.  Rows with a null id
    link like others; their component is its least id, null if it has none.
    """
    sketches, classes = classes_of(docs, words, percent, id_column, text_column)
    least = stage_table(classes.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"), F.sum("members").alias("rows")).where("rows > 1"), "least")
    named = skew_join(classes.select("component", "members", *IDENTITY), least.select("component", "component_id"), ["component"], heavy_keys(least, "size", ["component"]))
    named = stage_table(named.select(*IDENTITY, "component_id", "members", F.lit(True).alias("grouped")), "named")
    out = skew_join(sketches.select("doc_id", *IDENTITY), named.drop("members"), IDENTITY, heavy_keys(named, "members", IDENTITY), "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, *, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near duplicates, and all rows without words.

    The row with the least id stays, one without an id only where no other is
    in the group; of rows that are equal in id and text any one.  Columns are
    unchanged, whatever their names.
    """
    with passing() as keep:  # what stays is told by one table; those that led to it go
        sketches, classes = classes_of(docs, words, percent, id_column, text_column)
        first = classes.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.k").alias("k")).distinct()
        copies = stage_table(sketches.where("n_shingles > 0").groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "copies")
        first = stage_table(first.join(copies, "k", "left"), "first")
        copied = bool(copies.limit(1).count())
        keep(first)
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).withColumn("k", row_key(of[id_column], of[text_column]))
    worded = F.coalesce(F.col(of[text_column]).rlike(WORD), F.lit(False))
    kept = rows.where(worded).join(first.where("n IS NULL"), "k", "left_semi").select(*names)
    if copied:
        again = rows.where(worded).join(first.where("n IS NOT NULL"), "k", "left_semi")
        kept = kept.unionByName(again.dropDuplicates(["k", of[id_column], of[text_column]]).select(*names))
    return kept.unionByName(rows.where(~worded).select(*names)).toDF(*docs.columns)


#: Any character that is not ASCII white space.
WORD = "[^ \\t\\n\\x0B\\f\\r]"
