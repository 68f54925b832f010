"""Vector bin packing of examples into training sequences.

An example has three sizes: tokens, segments (one for each piece) and tokens
that bear loss.  A sequence has a limit on each.  Sequences are opened one
after another; among the examples that still fit, the one with the largest
weighted dot product of its sizes with the room that is left goes in next, so
that no one limit runs out long before the others.

Examples longer than a sequence are cut into full sequences and a rest.  After
packing, the emptiest sequences of a group are cut up to fill the gaps of the
others, and what is left at the end is laid out in sequences whose lengths are
powers of two, which need no padding.

Work is done in bounded groups of consecutive rows of each input partition.
Nothing is shuffled, a lost task redoes its own rows, and a row never waits for
more than its group.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import slices
from chronofold.llm.tokens import encoder, vocabulary_path


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


#: A group is packed once it has so many examples, or so many tokens.
GROUP_ROWS, GROUP_TOKENS = 4096, 4 << 20
#: A gap smaller than this is left as padding rather than filled with a sliver.
LEAST_CUT = 8


def pack_vectors(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of item numbers.  sizes: items x dimensions, each within limits.

    The weight of a dimension is the share of all bins that it needs, so the
    scarcest one counts most.  Ties go to the earlier item; items are taken
    largest first.
    """
    n = len(sizes)
    if n == 0:
        return []
    unit = sizes / limits
    need = unit.sum(axis=0)
    weight = need / max(need.max(), 1e-12)
    order = np.argsort(-(unit @ weight), kind="stable")
    demand, exact = unit[order] * weight, sizes[order]
    bins: list[list[int]] = []
    while n:
        room = limits.astype(np.int64).copy()
        alive = np.ones(n, bool)
        taken: list[int] = []
        left = np.arange(n)
        while len(left):
            fits = (exact[left] <= room).all(axis=1)
            left = left[fits]
            if not len(left):
                break
            best = int(left[np.argmax(demand[left] @ (room / limits))])
            taken.append(best)
            alive[best] = False
            room -= exact[best]
            left = left[left != best]
        bins.append([int(order[i]) for i in taken])
        order, demand, exact = order[alive], demand[alive], exact[alive]
        n = len(order)
    return bins


def _loss(start: int, length: int, total: int, bearing: int) -> int:
    """Loss-bearing tokens of a piece; they are the last ``bearing`` of the example."""
    return max(0, start + length - max(start, total - bearing))


def _longest(start: int, total: int, bearing: int, room: int, loss_room: int) -> int:
    """The longest piece from ``start`` that keeps within the room for tokens and for loss."""
    free = max(0, total - bearing - start)
    return min(room, total - start, free + loss_room)


def pack_group(totals: list[int], bearing: list[int], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (example, start, length) that cover every token once."""
    cap = np.array([limits.tokens, limits.segments, limits.loss])
    full: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int, int]] = []
    for i, (total, loss) in enumerate(zip(totals, bearing, strict=True)):
        start = 0
        while start < total:
            length = _longest(start, total, loss, limits.tokens, limits.loss)
            if start + length == total:
                rests.append((i, start, length))
            else:
                full.append([(i, start, length)])
            start += length
    # a piece that already fills its sequence needs no search
    full += [[r] for r in rests if r[2] == limits.tokens]
    rests = [r for r in rests if r[2] != limits.tokens]
    sizes = np.array([(n, 1, _loss(s, n, totals[i], bearing[i])) for i, s, n in rests], np.int64).reshape(-1, 3)
    bins = [[rests[k] for k in b] for b in pack_vectors(sizes, cap)]
    return full + _fill(bins, totals, bearing, limits)


def _fill(bins: list[list[tuple[int, int, int]]], totals: list[int], bearing: list[int], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Fill gaps with pieces of the emptiest bins; the last rest goes to powers of two."""
    used = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-used[k], k))
    bins = [list(bins[k]) for k in order]
    used = [used[k] for k in order]
    loss = [sum(_loss(s, n, totals[i], bearing[i]) for i, s, n in b) for b in bins]
    stock: list[tuple[int, int, int]] = []
    low, high = 0, len(bins)
    while low < high:
        gap = limits.tokens - used[low]
        if gap < LEAST_CUT or len(bins[low]) >= limits.segments or loss[low] >= limits.loss:
            low += 1
            continue
        if not stock:
            high -= 1
            if low >= high:
                stock = bins[high]
                break
            stock = bins[high]
        i, s, n = stock.pop()
        take = _longest(s, min(totals[i], s + n), max(0, bearing[i] - (totals[i] - s - n)), gap, limits.loss - loss[low])
        if take <= 0:
            stock.append((i, s, n))
            low += 1
            continue
        bins[low].append((i, s, take))
        used[low] += take
        loss[low] += _loss(s, take, totals[i], bearing[i])
        if take < n:
            stock.append((i, s + take, n - take))
    out = bins[: max(low, high)] if high > low else bins[:high]
    return out + _powers_of_two(stock, totals, bearing, limits)


def _powers_of_two(stock: list[tuple[int, int, int]], totals: list[int], bearing: list[int], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Lay pieces out in sequences of 2**k tokens, the largest first."""
    left, out = sum(n for _, _, n in stock), []
    stock = stock[::-1]
    while left:
        size = min(1 << (left.bit_length() - 1), limits.tokens)
        row, loss = [], 0
        room = size
        while room and stock and len(row) < limits.segments:
            i, s, n = stock.pop()
            take = _longest(s, min(totals[i], s + n), max(0, bearing[i] - (totals[i] - s - n)), room, limits.loss - loss)
            if take <= 0:
                stock.append((i, s, n))
                break
            row.append((i, s, take))
            room -= take
            loss += _loss(s, take, totals[i], bearing[i])
            if take < n:
                stock.append((i, s + take, n - take))
        left -= size - room
        out.append(row)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


def pack_documents(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    loss_column: str | None = None,
    limits: Limits = Limits(),
    end_id: int = 1,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pack whole documents; one row for each piece.

    ``loss_column`` counts the last tokens of an example (with the end id) that
    bear loss, as for the answer of an instruction pair; without it, or where it
    is null, all do.  ``with_ids`` adds the piece's ids as array<int>.

    A null or empty text is one token, its end id.  Null ids are kept as they
    are; rows with equal ids or equal texts are packed each for itself; other
    columns are ignored.  An empty table gives no rows.  Sequence ids are unique
    in one result: the partition's number above 32 bits for the sequence's.
    """
    path = vocabulary or vocabulary_path()
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 8 + ([pa.list_(pa.int32())] if with_ids else [])
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
        (F.col(loss_column).cast("long") if loss_column else F.lit(None).cast("long")).alias("loss"),
    )

    def run(batches):
        encode = encoder(path).encode
        base = TaskContext.get().partitionId() << 32
        count = 0
        group: list[tuple[int | None, np.ndarray, int]] = []
        tokens = 0

        def flush():
            nonlocal count
            totals = [len(g[1]) for g in group]
            out: list[tuple] = []
            for row in pack_group(totals, [g[2] for g in group], limits):
                at = 0
                for i, s, n in row:
                    doc, ids, loss = group[i]
                    part = ids[s : s + n]
                    values = (doc, s, n, zlib.crc32(part.astype("<u4").tobytes()), totals[i], base + count, at, _loss(s, n, totals[i], loss))
                    out.append((*values, part.astype(np.int32)) if with_ids else values)
                    at += n
                count += 1
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        for batch in slices(batches, limit=4 << 20):
            d = batch.to_pydict()
            for doc, ids, loss in zip(d["doc_id"], encode(d["text"]), d["loss"], strict=True):
                ids = np.append(ids, np.uint16(end_id))
                group.append((doc, ids, len(ids) if loss is None else max(0, min(int(loss), len(ids)))))
                tokens += len(ids)
                if len(group) >= GROUP_ROWS or tokens >= GROUP_TOKENS:
                    yield flush()
                    group, tokens = [], 0
        if group:
            yield flush()

    return rows.mapInArrow(run, schema)


def conversation_sizes(turns: DataFrame, *, end_id: int = 1, vocabulary: str | None = None, answers: str = "assistant") -> DataFrame:
    """Tokens, segments and loss-bearing tokens of each conversation: conv_id, tokens, segments, loss.

    Each turn is a segment, its text's ids and the end id; those of the role
    ``answers`` bear loss.  Null texts are empty, null roles bear none, and rows
    without a conversation's id belong to none.
    """
    path = vocabulary or vocabulary_path()

    def run(batches):
        encode = encoder(path).encode
        for batch in slices(batches, limit=4 << 20):
            sizes = [len(ids) + 1 for ids in encode(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["conv_id", "bears", "n"])

    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role") == answers, F.lit(False)).alias("bears"), "text")
    sized = rows.mapInArrow(run, "conv_id long, bears boolean, n long")
    return sized.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("loss"))


def pack_whole(sizes: DataFrame, limits: Limits, *, id_column: str = "conv_id") -> DataFrame:
    """Sequences of whole examples within all limits: the id, tokens, segments, loss, sequence_id, and whether the example is too large for any sequence.

    ``sizes`` has tokens, segments and loss of each example (null: 0).  One that
    is beyond a limit by itself has a sequence of its own.  Examples are packed
    in groups of consecutive rows of a partition, as in ``pack_documents``.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss])
    kind = sizes.schema[id_column].dataType.simpleString()
    names = [id_column, "tokens", "segments", "loss", "sequence_id", "oversized"]
    rows = sizes.select(id_column, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in names[1:4]])

    def run(batches):
        base, count = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                size = np.stack([part.column(i).to_numpy() for i in (1, 2, 3)], axis=1)
                large = (size > cap).any(axis=1)
                fit = np.flatnonzero(~large)
                bins = [[int(fit[k]) for k in b] for b in pack_vectors(size[fit], cap)] + [[int(k)] for k in np.flatnonzero(large)]
                sequence = np.zeros(len(size), np.int64)
                for number, b in enumerate(bins, count):
                    sequence[b] = base + number
                count += len(bins)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(4)], pa.array(sequence), pa.array(large)], names)

    return rows.mapInArrow(run, f"`{id_column}` {kind}, tokens long, segments long, loss long, sequence_id long, oversized boolean")
