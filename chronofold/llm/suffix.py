"""Repeated byte strings by per-shard suffix arrays.

``repeats`` first narrows texts down to pieces: short stretches around anchors
that occur more than once.  Pieces with the same anchor come into the same
shard, so equal windows do too.  A shard's suffix array is built by the
refinement of Larsson and Sadakane in numpy: suffixes are sorted by their first
bytes, and then by pairs of ranks, each round twice as far; groups that are
single are left alone.  Kasai's rule gives common prefixes in text order: the
value at a position is that of the one before it, less one, wherever the
neighbour in the array moves on by one as well; elsewhere bytes are compared.  A
window is repeated if it has ``span`` bytes in common with a neighbour in the
array.

A piece that stands in several places enters the array twice, which makes each
of its suffixes the neighbour of its copy; what is repeated is read from the
array alone.  An anchor with very many pieces is dealt out to several shards;
windows that are new to their own shard are looked up among the sorted windows
of the others by binary search (``repeats.merge_shards``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chronofold.llm.common import _BYTE_CODE, drop_table, range_hash, slices, text_bytes
from chronofold.llm.repeats import SLICE, Piece, Windows, find, keyed, pieces, removed, search_shards, spans_of, with_ranges

#: Bytes after which a suffix array is built; copies come on top.
ENOUGH = 3 << 17


def _undecided(pos: np.ndarray, new: np.ndarray, twin: np.ndarray | None) -> np.ndarray:
    """Which places of the array are in groups that may still be split: not single ones, and not pairs of a suffix and its copy."""
    last = np.append(new[1:], True)
    out = ~(new & last)
    if twin is not None and len(pos) > 1:
        pair = new[:-1] & last[1:] & ~new[1:] & (twin[pos[:-1]] == pos[1:])
        out[:-1][pair] = out[1:][pair] = False
    return out


def suffix_array(text: np.ndarray, ends: np.ndarray, upto: int, twin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of several strings laid end to end, and each position's rank.

    ``ends`` are the strings' ends.  Suffixes stop at their string's end and are
    then all different, so no comparison runs into the next string.  The order
    is complete up to ``upto`` bytes; suffixes that agree further stay in one
    group, with one rank, in text order.  ``twin`` gives for each position that
    of its copy further on, in a string that is put in twice (-1: none); such a
    pair agrees to its end, so where it is alone it is left alone.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(n.bit_length())
    if 3 * int(bits) > 64:
        raise ValueError("a shard has at most two million bytes")
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(n)
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - place  # bytes of each suffix
    key = np.zeros(n, np.uint64)
    code = text.astype(np.uint64) + np.uint64(1)
    for k in range(7):  # seven bytes at nine bits; 0 stands for the end
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = code[k:]
        part[left <= k] = 0
        key = key << np.uint64(9) | part
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if twin is not None:  # pairs of copies in text order
        swap = np.flatnonzero(twin[sa[1:]] == sa[:-1])
        sa[swap], sa[swap + 1] = sa[swap + 1].copy(), sa[swap].copy()
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(start, np.diff(np.append(start, n)))
    h = 7
    slots = np.flatnonzero(_undecided(sa, new, twin))
    while len(slots) and h < upto:
        pos = sa[slots]
        # the rank h bytes on, above those of suffixes that end before, which are in text order
        follow = np.where(left[pos] > h, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        key = (rank[pos].astype(np.uint64) << bits | follow.astype(np.uint64)) << bits | pos.astype(np.uint64)
        key.sort()
        pos, pair = (key & low).astype(np.int64), key >> bits
        sa[slots] = pos
        ended = (pair & low) == 0  # each ends at its own place, so no two are equal
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | ended[1:]])
        start = np.flatnonzero(new)
        rank[pos] = np.repeat(slots[start], np.diff(np.append(start, len(pos))))
        slots = slots[_undecided(pos, new, twin)]
        h *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the bytes it has in common with the suffix before it in the array.

    Kasai's rule in text order: where the bytes before both suffixes belong
    together in the same way, the value is the one at the position before, less
    one.  Only the others are compared, eight bytes at a time.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    first = np.zeros(n, bool)
    first[np.concatenate([[0], ends[:-1]])[np.diff(np.concatenate([[0], ends])) > 0]] = True
    derived = np.zeros(n, bool)
    derived[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (text[:-1] == text[before[1:] - 1])
    derived &= ~first & ~first[np.maximum(before, 0)]
    ask = np.flatnonzero(~derived & (before >= 0))
    other = before[ask]
    most = np.minimum(left[ask], left[other])
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    have = np.zeros(len(ask), np.int64)
    alive = np.flatnonzero(most > 0)
    while len(alive):
        at = have[alive]
        same = eight[ask[alive] + at] == eight[other[alive] + at]
        step = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        have[alive] = at + step
        alive = alive[(step == 8) & (at + 8 < most[alive])]
    value = np.zeros(n, np.int64)
    value[ask] = np.minimum(have, most) + ask
    value = value[np.maximum.accumulate(np.where(derived, -1, np.arange(n)))] - np.arange(n)
    return np.where(before < 0, 0, np.maximum(value, 0))


def repeated_starts(parts: list[bytes], span: int, twice: list[int] = ()) -> list[np.ndarray]:
    """For each byte string, whether the window at each of its starts occurs at another place in any of them.

    The strings with the numbers ``twice`` are put in again after the others.
    """
    parts = [*parts, *(parts[i] for i in twice)]
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(sizes)
    twin = None
    if len(twice):
        twin = np.full(len(text), -1, np.int64)
        for i, k in enumerate(twice, len(parts) - len(twice)):
            twin[ends[k] - sizes[k] : ends[k]] = np.arange(ends[i] - sizes[i], ends[i])
    sa, _ = suffix_array(text, ends, span, twin)
    hit = common_prefixes(text, ends, sa) >= span
    back = np.flatnonzero(hit[sa])  # and the suffix before it in the array
    hit[sa[back - 1]] = True
    return [hit[e - s : max(e - s, e - span + 1)] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def search(held: list[Piece], span: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Repeated windows of a shard's pieces, and hashes of the windows of those whose anchor has several shards."""
    hits = repeated_starts([p.data for p in held], span, [i for i, p in enumerate(held) if p.n > 1])
    return [(hit, range_hash(_BYTE_CODE[np.frombuffer(p.data, np.uint8)], 0x9E6D62D06F6A9A9B)(at := np.arange(len(hit)), at + span).view(np.int64) if p.shards > 1 else None) for p, hit in zip(held, hits, strict=False)]


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, kept binary, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, *, span: int = 400, gram: int = 48, id_column: str = "doc_id", text_column: str = "text", with_bytes: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, and with ``with_bytes`` the kept bytes and removed spans.

    A byte is removed if any string of ``span`` bytes over it also starts
    anywhere else, in the input as it is.  ``text`` has the kept bytes as a
    string (characters of which bytes went are replaced by U+FFFD).  Null and
    empty texts have no bytes; equal rows are different places, so all their
    windows are repeated; null and equal ids are kept and do no harm; other
    columns are ignored.  An empty table gives no rows.
    """
    what = Windows(span, min(gram, span), False)
    rows = keyed(docs, id_column, text_column)
    found = find(rows, what)
    made = pieces(rows, found, what)
    hits = search_shards(made, what, lambda held: search(held, span), ENOUGH)
    drop_table(made)
    rows = with_ranges(rows, found, hits).select("doc_id", "text", "items")
    drop_table(hits)
    schema = OUT if with_bytes else ", ".join(OUT.split(", ")[:6])
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batch: pa.RecordBatch, touched: bool) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column(1))
        gone = removed(batch.column(1), batch.column(2), what)[0] if touched else None
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            spans = spans_of(gone[a:b]) if touched else []
            kept = raw[a:b][~gone[a:b]].tobytes() if spans else raw[a:b].tobytes()
            out.append((b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace"), kept, [{"start": x, "end": y} for x, y in spans]))
        n, lost, count, digest, text, kept, spans = zip(*out, strict=True)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(text, pa.string())]
        if with_bytes:
            columns += [pa.array(kept, pa.binary()), pa.array(spans, _SPANS)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            some = batch.column(2).is_valid()
            for touched, mask in ((True, some), (False, pc.invert(some))):
                part = batch.filter(mask)
                if part.num_rows:
                    yield cut(part, touched)

    return rows.mapInArrow(run, schema)
