"""Repeated windows across all documents, by winnowed anchors.

The task: of all windows of ``span`` consecutive symbols (words, or bytes), find
those whose content also starts anywhere else.  Every window has one anchor, the
leftmost least-hashed run of ``gram`` symbols in it.  Equal windows have equal
anchors at equal places, so documents meet on their anchors, and an anchor that
occurs once leads nowhere.  Consecutive windows with the same anchor make up a
segment: the anchor with the context on both sides that those windows reach.

1. ``find``: anchors are counted; places of those that occur again are kept.
   Places with the same context are one *piece*, with its number of places.
2. ``pieces``: one copy of each piece goes to its anchor's shard (several for an
   anchor of very many pieces), where the caller's search (suffix arrays, or
   seeds extended both ways) finds the repeated windows of each piece.
3. ``merge_shards``: windows that are new to their own shard of an anchor with
   several are looked up among those of the others.
4. ``with_ranges``: ranges of repeated windows go back to all places of a piece.

Every step is a count or a join on hashes, with partial sums before each
shuffle; keys that hold a large share of the rows are not shuffled
(``common.skew_join``).  Documents are found again by a hash of id and text, so
what rows with equal or null ids share is never more than rows that are equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import _BYTE_CODE, drop_table, heavy_keys, mix64, range_hash, row_key, skew_join, slices, stage_table, text_bytes, word_bounds, word_hashes

_INDEX = np.uint64((1 << 28) - 1)
#: Bytes of text that are worked on at a time; the arrays made of them stay in a core's cache.
SLICE = 1 << 18
#: Pieces of one anchor in a shard, at most about.
SHARD_PIECES = 500


@dataclass(frozen=True)
class Windows:
    """What is compared: windows of ``span`` symbols, anchored by runs of ``gram``."""

    span: int
    gram: int
    words: bool


def symbols(column: pa.Array, what: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, bytes or hashes of words, and offsets of rows."""
    raw, offsets = text_bytes(column)
    if not what.words:
        return raw, offsets
    starts, ends, first = word_bounds(raw, offsets)
    return mix64(word_hashes(raw, starts, ends)), first


@dataclass
class Segments:
    """Segments of a slice: row, first window, last window, place and hash of the anchor, content hash (with the anchor)."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    pad = -len(v) % w
    x = np.concatenate([v, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(sym: np.ndarray, offsets: np.ndarray, what: Windows) -> Segments:
    """Segments of all rows, made block by block, so that arrays stay small however long a text is.

    A segment that crosses a block is two; its windows are the same, and only
    they are compared in the end.
    """
    made = []
    for at in range(0, max(1, len(sym) - what.span + 1), SLICE):
        part = sym[at : at + SLICE + what.span - 1]
        s = _segments(part if what.words else _BYTE_CODE[part], np.clip(offsets - at, 0, len(part)), what)
        made.append(Segments(s.row, s.first + at, s.last + at, s.at + at, s.anchor, s.content))
    if len(made) == 1:
        return made[0]
    return Segments(*(np.concatenate([getattr(s, f.name) for s in made]) for f in fields(Segments)))


def _segments(sym: np.ndarray, offsets: np.ndarray, what: Windows) -> Segments:
    none = np.zeros(0, np.int64)
    n = len(sym)
    if n < what.span:
        return Segments(none, none, none, none, none, none)
    hashes = range_hash(sym, 0x9FB21C651E98DF25)
    grams = hashes.fixed(what.gram)
    ranked = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)
    place = (_sliding_least(ranked, what.span - what.gram + 1) & _INDEX).astype(np.int64)
    # windows may not cross rows
    fits = np.zeros(len(place), bool)
    for a, b in zip(offsets[:-1].tolist(), (offsets[1:] - what.span + 1).tolist(), strict=True):
        if b > a:
            fits[a:b] = True
    ok = np.flatnonzero(fits)
    if not len(ok):
        return Segments(none, none, none, none, none, none)
    at = place[ok]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)]))
    first, last = ok[new], ok[np.append(new[1:], len(ok)) - 1]
    at = at[new]
    anchor = mix64(grams[at])
    whole = hashes(first, last + what.span)
    content = mix64(whole ^ (anchor * np.uint64(0x9E3779B97F4A7C15)) + (at - first).astype(np.uint64))
    row = np.searchsorted(offsets, first, "right") - 1
    return Segments(row, first, last, at, anchor.view(np.int64), content.view(np.int64))


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), row_key(id_column, text_column).alias("k"))


PAIR = ["anchor", "content"]


@dataclass
class Found:
    """What is known of segments whose anchors occur again."""

    rows: DataFrame  # k, anchor, content: every place
    pieces: DataFrame  # anchor, content, n (places), k (of one of them), rivals (pieces of the anchor)
    heavy: list[int]  # pieces with a large share of all places
    copied: bool  # whether rows are repeated whole
    behind: tuple[DataFrame, ...] = ()  # the tables behind ``pieces``, which go once those are made


def find(rows: DataFrame, what: Windows) -> Found:
    """Step 1.  ``rows`` has text and k."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            s = segments(*symbols(batch.column(0), what), what)
            order = np.lexsort((s.content, s.row))
            row, content, anchor = s.row[order], s.content[order], s.anchor[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (content[1:] != content[:-1])])) if len(row) else row
            k = batch.column(1).to_numpy()[row[new]]
            count = np.diff(np.append(new, len(row))) if len(row) else new
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(anchor[new], pa.int64()), pa.array(content[new], pa.int64()), pa.array(count.astype(np.int32))], ["k", "anchor", "content", "n"])

    made = stage_table(rows.select("text", "k").mapInArrow(run, "k long, anchor long, content long, n int"), "anchors")
    copied = bool(rows.groupBy("k").count().where("count > 1").limit(1).count())
    often = stage_table(made.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1"), "often")
    places = skew_join(made, often.select("anchor"), ["anchor"], heavy_keys(often, "times", ["anchor"]))
    if copied:  # rows that are equal share what is found; their places still count
        places = places.groupBy("k", *PAIR).agg(F.sum("n").alias("n"))
    places = stage_table(places, "places")
    drop_table(made)
    drop_table(often)
    counted = stage_table(places.groupBy(*PAIR).agg(F.sum("n").alias("n"), F.min("k").alias("k")), "pieces")
    rivals = stage_table(counted.groupBy("anchor").agg(F.count("*").alias("rivals")), "rivals")
    marked = skew_join(counted, rivals, ["anchor"], heavy_keys(rivals, "rivals", ["anchor"]))
    return Found(places.select("k", *PAIR), marked, heavy_keys(counted, "n", PAIR), copied, (counted, rivals))


def pieces(rows: DataFrame, found: Found, what: Windows) -> DataFrame:
    """Step 2: one copy of each piece.  ``found.pieces`` is used up.

    Columns anchor, content, n (2: at least two places), shards of its anchor,
    seed (place of the anchor) and data (its bytes, or its words' hashes).
    """
    items = F.struct("content", F.least("n", F.lit(2)).cast("long").alias("n"), F.ceil(F.col("rivals") / SHARD_PIECES).cast("long").alias("shards"))
    wanted = found.pieces.groupBy("k").agg(F.collect_list(items).alias("items"))
    flat = rows.join(wanted, "k").select("text", "items.content", "items.n", "items.shards")
    names = ["anchor", "content", "n", "shards", "seed", "data"]

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            sym, offsets = symbols(batch.column(0), what)
            s = segments(sym, offsets, what)
            seg, item = _own(s, batch.column(1).flatten(), np.diff(batch.column(1).offsets), once=True)
            flat_n, shards = (batch.column(i).flatten().to_numpy()[item] for i in (2, 3))
            data = [sym[a:b].tobytes() for a, b in zip(s.first[seg].tolist(), (s.last[seg] + what.span).tolist(), strict=True)]
            columns = [s.anchor[seg], s.content[seg], flat_n, shards, s.at[seg] - s.first[seg]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(data, pa.binary())], names)

    out = stage_table(flat.mapInArrow(run, "anchor long, content long, n long, shards long, seed long, data binary"), "pieces")
    for table in found.behind:
        drop_table(table)
    if not found.copied:
        return out
    once = stage_table(out.dropDuplicates(PAIR), "pieces")
    drop_table(out)
    return once


def _own(s: Segments, content: pa.Array, sizes: np.ndarray, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The segments that stand in their own row's list, and the place of each in the flattened lists.

    With ``once`` a piece that stands in a row several times is taken once.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    code = lambda row, c: mix64(c.view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mine, theirs = code(s.row, s.content), code(row, content.to_numpy())
    if not len(theirs) or not len(mine):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(theirs)
    place = np.minimum(np.searchsorted(theirs[order], mine), len(theirs) - 1)
    seg = np.flatnonzero(theirs[order][place] == mine)
    if once:
        seg = np.sort(seg[np.unique(mine[seg], return_index=True)[1]])
    return seg, order[place[seg]]


HITS = "anchor long, content long, lo int, hi int, core long, times long, places array<int>, hashes array<long>"


@dataclass
class Piece:
    anchor: int
    content: int
    n: int
    shards: int
    seed: int
    data: bytes


#: For the pieces of a shard: which of each one's windows are repeated among them, and a hash of each window.
Search = Callable[[list[Piece]], list[tuple[np.ndarray, np.ndarray]]]
#: Stretches into which the windows of a piece are cut, by how far they reach to the left of the anchor.
STRETCHES = 8


def _cores(p: Piece, what: Windows, windows: np.ndarray) -> np.ndarray:
    """For each window of a piece a hash of what all windows of its stretch have in common.

    It takes in the anchor, as much to the left as the shortest and as much to
    the right as the longest reach of the stretch leaves: equal windows have
    equal cores.
    """
    room = what.span - what.gram
    width = -(-(room + 1) // STRETCHES)
    stretch = (p.seed - windows) // width
    symbols_ = np.frombuffer(p.data, np.uint64) if what.words else _BYTE_CODE[np.frombuffer(p.data, np.uint8)]
    starts, ends = p.seed - stretch * width, p.seed + what.gram + room + 1 - np.minimum((stretch + 1) * width, room + 1)
    code = range_hash(symbols_, 0xB5297A4D3F84D5B5)(starts, ends)
    return mix64(code ^ mix64(np.int64(p.anchor).view(np.uint64) + stretch.astype(np.uint64))).view(np.int64)


def search_shards(made: DataFrame, what: Windows, search: Search, enough: int) -> DataFrame:
    """Step 2, on the shards: ranges of repeated windows, and windows of anchors that have several shards.

    Rows with ``hi``: windows lo to hi (exclusive) of the piece are repeated.
    Rows with ``core``: windows of one stretch, by place and hash, that are new
    to their shard (times 1, with their piece), or that the shard has settled,
    each told once (times 2).  Whole shards are searched together until they have
    ``enough`` bytes.
    """
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.xxhash64("anchor", F.pmod("content", "shards"))
    dealt = made.withColumn("shard", shard).repartition(n, "shard").sortWithinPartitions("shard")
    names = [x.split()[0] for x in HITS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def settle(held: list[Piece]) -> pa.RecordBatch:
        out: list[tuple] = []
        told: dict[int, dict[int, int]] = {}  # core -> the windows that this shard has settled
        for p, (hit, h) in zip(held, search(held), strict=True):
            out += [(p.anchor, p.content, a, b, None, None, None, None) for a, b in spans_of(hit)]
            if p.shards > 1:
                core = _cores(p, what, np.arange(len(hit)))
                for a, b in _runs(core):
                    new = np.flatnonzero(~hit[a:b]) + a
                    if len(new):  # new to this shard: ask the others
                        out.append((p.anchor, p.content, None, None, int(core[a]), 1, new.astype(np.int32), h[new]))
                    if len(new) < b - a:  # settled here: tell the others once
                        told.setdefault(int(core[a]), {}).update(dict.fromkeys(h[a:b][hit[a:b]].tolist(), p.anchor))
        out += [(next(iter(w.values())), None, None, None, core, 2, [0] * len(w), list(w)) for core, w in told.items()]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches):
        held: list[Piece] = []
        size, last = 0, None
        for batch in batches:
            for *row, own in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if own != last and size >= enough:
                    yield settle(held)
                    held, size = [], 0
                held.append(Piece(*row))
                size, last = size + len(row[5]), own
        if held:
            yield settle(held)

    return stage_table(dealt.select("anchor", "content", "n", "shards", "seed", "data", "shard").mapInArrow(run, HITS), "hits")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return list(zip(new.tolist(), [*new[1:].tolist(), len(values)], strict=True))


#: Windows of several shards that one task of the merge looks through, about.
MERGED = 1 << 19


def merge_shards(hits: DataFrame) -> DataFrame:
    """Step 3: (anchor, content, lo, hi) of windows that are new to their own shard and stand in another.

    Stretches whose core is nowhere else have nothing to find and go at once.
    Windows of the others are dealt by their hash; a task sorts the windows of
    all shards and finds each one that asks by binary search.
    """
    asked = hits.where("core IS NOT NULL")
    cores = stage_table(asked.groupBy("core").agg(F.sum("times").alias("n"), F.min("times").alias("least")).where("n > 1 AND least = 1").select("core", "n"), "cores")
    open_ = skew_join(asked, cores.select("core"), ["core"], heavy_keys(cores, "n", ["core"]))
    windows = open_.select(*PAIR, "times", F.inline(F.arrays_zip(F.col("places").alias("lo"), F.col("hashes").alias("h"))))
    across = stage_table(windows.select(*PAIR, "lo", "times", F.xxhash64("anchor", "h").alias("key")), "across")
    n = max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-across.count() // MERGED))

    def run(batches):
        held = [[b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4)] + [b.column(1)] for b in batches if b.num_rows]
        if not held:
            return
        anchor, lo, times, key = (np.concatenate(c) for c in list(zip(*held, strict=True))[:4])
        content = pa.concat_arrays([x[4] for x in held])
        listed = np.sort(np.repeat(key, times.astype(np.int64)))
        ask = np.flatnonzero(times == 1)
        ask = ask[np.searchsorted(listed, key[ask], "right") - np.searchsorted(listed, key[ask]) > 1]
        lo = lo[ask].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[ask]), content.take(pa.array(ask)), pa.array(lo), pa.array(lo + 1, pa.int32())], [*PAIR, "lo", "hi"])

    return across.repartition(n, "key").select(*PAIR, "lo", "times", "key").mapInArrow(run, "anchor long, content long, lo int, hi int")


def with_ranges(docs: DataFrame, found: Found, hits: DataFrame) -> DataFrame:
    """Step 4: ``docs`` (with k) and a column ``items``: content and ranges of repeated windows of the row's pieces; null if none."""
    ranges = hits.where("hi IS NOT NULL").select(*PAIR, "lo", "hi").unionByName(merge_shards(hits))
    ranges = stage_table(ranges.groupBy(*PAIR).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    lists = skew_join(found.rows, ranges, PAIR, found.heavy).groupBy("k").agg(F.collect_list(F.struct("content", "ranges")).alias("items"))
    return docs.join(lists, "k", "left")


def removed(text: pa.Array, items: pa.Array, what: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols of a slice are in repeated windows, and offsets of its rows.  No item is null."""
    sym, offsets = symbols(text, what)
    s = segments(sym, offsets, what)
    step = np.zeros(len(sym) + 1, np.int32)
    listed = items.flatten()
    seg, item = _own(s, listed.field("content"), np.diff(items.offsets))
    if len(seg):
        ranges = listed.field("ranges")
        bounds = ranges.offsets.to_numpy()
        lo, hi = (ranges.values.field(x).to_numpy().astype(np.int64) for x in ("lo", "hi"))
        count = bounds[item + 1] - bounds[item]
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[item], count)
        own = np.repeat(seg, count)
        np.add.at(step, s.first[own] + lo[which], 1)
        np.add.at(step, s.first[own] + hi[which] - 1 + what.span, -1)
    return np.cumsum(step[:-1]) > 0, offsets


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
