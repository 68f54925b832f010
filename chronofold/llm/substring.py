"""Repeated word sequences: seeds from winnowed anchors, extended both ways to maximal repeats.

Documents are joined on their anchors (``repeats``): all pieces of an anchor,
each the anchor with the words around it, come together.  Seeds are extended to
both sides: pieces that have the same words as far to the left stand together,
in the order of the words on the right, so the neighbours of a piece are those
that it has the longest extension to the right with.  Its length is counted word
by word.  A repeat goes from the left end to the end of that extension; it is
maximal to the right, and kept if it has ``span`` words at least.  A group of n
pieces is sorted, not compared in pairs.  A piece that stands in several places
comes as two, which extend over each other whole.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import drop_table, mix64, range_hash, row_key, slices
from chronofold.llm.repeats import SLICE, Piece, Windows, find, keyed, pieces, removed, search_shards, spans_of, with_ranges

#: Bytes of word hashes after which seeds are extended together.
ENOUGH = 2 << 20


#: Extensions that are counted at a time.
COUNTED = 1 << 14


def right_contexts(held: list[Piece], what: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The words to the right of each piece's seed, as far as a window can reach (0 beyond its end), and how many there are."""
    reach = what.span - what.gram
    out = np.zeros((len(held), reach), np.uint64)
    size = np.zeros(len(held), np.int64)
    for i, p in enumerate(held):
        words = np.frombuffer(p.data, np.uint64)[p.seed + what.gram :][:reach]
        out[i, : len(words)], size[i] = words, len(words)
    return out, size


def extensions(left: np.ndarray, owner: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row (what stands to the left, and a piece), the longest extension to the right that it shares with another row of the same left side."""
    by_right = np.lexsort(right.T[::-1]) if right.shape[1] else np.arange(len(right))
    rank = np.empty(len(right), np.int64)
    rank[by_right] = np.arange(len(right))
    order = np.lexsort((rank[owner], left))
    longest = np.zeros(len(left), np.int64)
    together = np.flatnonzero(left[order][1:] == left[order][:-1])
    for at in range(0, len(together), COUNTED):
        rows = together[at : at + COUNTED]
        a, b = order[rows], order[rows + 1]
        x, y = owner[a], owner[b]
        differs = right[x] != right[y]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), right.shape[1]) if right.shape[1] else np.zeros(len(rows), np.int64)
        common = np.minimum(same, np.minimum(size[x], size[y]))
        np.maximum.at(longest, a, common)
        np.maximum.at(longest, b, common)
    # a row that shares its left side with nothing has no extension, not even an empty one
    shared = np.zeros(len(left), bool)
    shared[order[together]] = shared[order[together + 1]] = True
    return np.where(shared, longest, -1)


def extend(held: list[Piece], what: Windows) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """For each piece, which of its windows lie in a repeat, and a hash of each window if the anchor has other shards.

    Window i of a piece reaches (seed - i) words to the left of its seed; it is
    repeated if the extension to the right of that left side covers its rest.
    """
    copies = [i for i, p in enumerate(held) for _ in range(2 if p.n > 1 else 1)]
    pieces_ = [held[i] for i in copies]
    sizes = np.array([len(p.data) // 8 for p in pieces_], np.int64)
    count = sizes - what.span + 1
    ends = np.cumsum(sizes)
    words = np.frombuffer(b"".join(p.data for p in pieces_), np.uint64)
    owner = np.repeat(np.arange(len(pieces_)), count)
    i = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = (ends - sizes)[owner] + i
    seed = (ends - sizes + np.array([p.seed for p in pieces_], np.int64))[owner]
    anchor = np.array([p.anchor for p in pieces_], np.int64).view(np.uint64)[owner]
    hashes = range_hash(words, 0xD6E8FEB86659FD93)
    left = mix64(hashes(start, seed) ^ anchor)
    right, size = right_contexts(pieces_, what)
    longest = extensions(left, owner, right, size)
    hit = longest >= start + what.span - seed - what.gram
    out: list = [None] * len(held)
    for k, (a, b) in enumerate(zip(np.cumsum(count) - count, np.cumsum(count), strict=True)):
        p = pieces_[k]
        if out[copies[k]] is None:  # of two copies the first tells for both
            whole = mix64(left[a:b] ^ hashes(seed[a:b] + what.gram, start[a:b] + what.span)).view(np.int64) if p.shards > 1 else None
            out[copies[k]] = (hit[a:b], whole)
    return out


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeats(docs: DataFrame, *, span: int = 50, gram: int = 8, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True, keep_columns: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` kept_text and spans.

    A word is removed if any window of ``span`` words over it occurs anywhere
    else, in the input as it is.  kept_text joins the kept words by one space;
    a text from which nothing is removed is kept as it is.  spans are ranges of
    removed words.  Null and empty texts have no words (a null text stays
    null); equal rows count as different places, so all their windows are
    repeated; null and equal ids do no harm.  ``keep_columns`` returns the rows
    of ``docs``, whatever their columns' names, with the text replaced instead,
    for use as a stage.
    """
    what = Windows(span, min(gram, span), True)
    rows = keyed(docs, id_column, text_column)
    found = find(rows, what)
    made = pieces(rows, found, what)
    hits = search_shards(made, what, lambda held: extend(held, what), ENOUGH)
    drop_table(made)
    if keep_columns:
        kept = [f"c{i}" for i in range(len(docs.columns))]
        of = dict(zip(docs.columns, kept, strict=True))
        rows = docs.toDF(*kept).withColumn("k", row_key(of[id_column], of[text_column]))
        schema, at = docs.schema, docs.columns.index(text_column)
    else:
        kept, schema, at = ["doc_id", "text"], OUT if with_text else ", ".join(OUT.split(", ")[:4]), 1
    rows = with_ranges(rows, found, hits).select(*kept, "items")
    drop_table(hits)
    names = schema.names if keep_columns else [x.split()[0] for x in schema.split(", ")]

    def cut(batch: pa.RecordBatch, touched: bool) -> pa.RecordBatch:
        text, out = batch.column(at), []
        gone, offsets = removed(text, batch.column(len(kept)), what) if touched else (None, None)
        for r, t in enumerate(text.to_pylist()):
            left = words = (t or "").encode().split()
            mask = gone[offsets[r] : offsets[r + 1]] if touched else None
            if touched:
                left = list(compress(words, (~mask).tolist()))
            joined = b" ".join(left)
            lost = len(words) - len(left)
            out.append((len(words), lost, joined, spans_of(mask) if lost else [], joined.decode() if lost else t))
        n, lost, joined, spans, texts = zip(*out, strict=True)
        if keep_columns:
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()).cast(batch.column(i).type) if i == at else batch.column(i) for i in range(len(kept))], names)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined])]
        if with_text:
            columns += [pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        for batch in slices(batches, kept[at], SLICE):
            some = batch.column(len(kept)).is_valid()
            for touched, mask in ((True, some), (False, pc.invert(some))):
                part = batch.filter(mask)
                if part.num_rows:
                    yield cut(part, touched)

    return rows.mapInArrow(run, schema)
