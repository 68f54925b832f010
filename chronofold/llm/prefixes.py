"""The prefix trie of conversations: what a store of shared beginnings would hold.

A conversation is an array of turns, each turn a digest of 16 bytes.  The arrays
are sorted over all partitions, so that every node of the trie is a stretch of
rows.  Each partition goes through its rows once with a stack: rows that share
fewer turns with the row before than the stack is deep close nodes.  What is on
the stack at a partition's first and last row may go on beyond it; these open
stacks, a few rows for each partition, are stitched in order in a second pass.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import join_small, partitions_for, stage_table

#: Bytes of a turn's digest.
WIDTH = 16
#: Ids of a hash's input that stand in one row.
IDS = 50_000
#: Rows that Python hands over at a time.
ROWS = 20_000


def turn_arrays(turns: DataFrame) -> DataFrame:
    """The turns of each conversation in order: conv_id, turns (array of digest in hex and code points of the text).

    A null turn comes first; rows of one turn are ordered by their digest, and
    repeated rows are all kept.  A null role or text is empty.  Rows without a
    conversation's id belong to none.  Texts are digested whole, row by row, so
    only digests are gathered.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    row = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", digest.alias("digest"), F.length(text).alias("size"))
    ordered = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuild(arrays: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin with the first turns of the first one of their group.

    The first h turns come from conversation c - c % group (fewer if it has
    fewer, none if it is absent), all after its first h from c itself; h is the
    checksum of c in decimals modulo ``heads``.  A group has at most 2 * group
    members, so the join has no heavy key.
    """
    first = arrays.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(first, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    head = F.slice("head", F.lit(1), F.col("h"))
    return joined.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(head, own)).alias("turns"))


class _Node:
    """A node on the stack, with what is known of the rows below it."""

    __slots__ = ("digest", "size", "place", "low", "n", "kids", "leaves", "saved", "ids", "waiting")

    def __init__(self, digest: bytes, size: int, place: int):
        self.digest, self.size, self.place = digest, size, place  # place: among its partition's open ones, or -1
        self.low, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids, self.waiting = [], []

    def take(self, low, n: int, kids: int, leaves: int, saved: int) -> None:
        self.low = low if self.low is None else self.low if low is None else min(low, self.low)
        self.n, self.kids, self.leaves, self.saved = self.n + n, self.kids + kids, self.leaves + leaves, self.saved + saved

    def close(self) -> None:
        """All rows are seen: count itself."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_SCHEMA = pa.schema(
    [("open", pa.bool_()), *((c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _NODE)]
    + [("part", pa.int32()), ("place", pa.int32()), ("piece", pa.int32()), ("digest", pa.binary()), ("size", pa.int64()), ("ids", pa.string())]
)
_SWEPT = "open boolean, " + ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE) + ", part int, place int, piece int, digest binary, size long, ids string"


class _Rows:
    """Rows to hand over.  ``part`` and ``place`` of a finished node name its parent's open part, where the parent is not known yet."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, *row) -> None:
        self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _SCHEMA, strict=True)] if self.rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)
        self.rows = []
        return made


def _sweep(batches):
    """Nodes that lie within a partition, and the open stacks of its first and last row."""
    part = TaskContext.get().partitionId()
    out = _Rows()
    stack: list[_Node] = []
    last = b""
    places = 0

    def send_open(node: _Node, depth: int) -> None:
        for child in node.waiting:
            out.add(False, *child, part, node.place, None, None, None, None)
        for piece in range(max(1, -(-len(node.ids) // IDS))):
            ids = ",".join(map(str, node.ids[piece * IDS : (piece + 1) * IDS])) or None
            stats = (node.low, depth, None, node.n, node.kids, node.leaves, node.saved) if piece == 0 else (None, depth, None, 0, 0, 0, 0)
            out.add(True, *stats, None, part, node.place, piece, node.digest, node.size, ids)

    def pop() -> None:
        node, depth = stack.pop(), len(stack)
        if node.place >= 0:
            send_open(node, depth)
            return
        node.close()
        above = stack[-1]  # the root is always an open one
        above.take(node.low, node.n, 1, node.leaves, node.saved)
        for child in node.waiting:
            out.add(False, *child[:2], node.low, *child[3:], None, None, None, None, None, None)
        row = (node.low, depth, None, node.n, node.kids, node.leaves, node.saved, hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest())
        if above.place >= 0:
            out.add(False, *row, part, above.place, None, None, None, None)
        else:
            above.waiting.append(row)

    for batch in batches:
        for conv, turns, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "sizes")), strict=True):
            shared, most = 0, min(len(last), len(turns))
            while shared < most and last[shared : shared + WIDTH] == turns[shared : shared + WIDTH]:
                shared += WIDTH
            while len(stack) > shared // WIDTH + 1:
                pop()
            first = not stack
            if first:
                stack.append(_Node(b"", 0, 0))
                places = 1
            for depth in range(len(stack), len(sizes) + 1):
                stack.append(_Node(turns[(depth - 1) * WIDTH : depth * WIDTH], sizes[depth - 1], places if first else -1))
                places += first
            stack[-1].take(conv, 1, 0, 0, 0)
            stack[-1].ids.append(conv)
            last = turns
            if len(out.rows) >= ROWS:
                yield out.batch()
    for node in stack:  # the last row's stack is open, too; its parts follow the first row's
        if node.place < 0:
            node.place, places = places, places + 1
    while stack:
        pop()
        if len(out.rows) >= ROWS:
            yield out.batch()
    yield out.batch()


def _stitch(batches):
    """Open nodes in order of partitions: equal paths are one node.

    Finished nodes name their parent by part and place of one of its open parts;
    rows with ``open`` set say which node each part has become.
    """
    out = _Rows()
    stack: list[_Node] = []

    def pop() -> None:
        node, depth = stack.pop(), len(stack)
        node.close()
        ends, parts = node.ids[0], node.waiting
        above = (None, None)
        if stack:
            stack[-1].take(node.low, node.n, 1, node.leaves, node.saved)
            above = stack[-1].waiting[0]
        out.add(False, node.low, depth, None, node.n, node.kids, node.leaves, node.saved, ends.hexdigest(), *above, None, None, None, None)
        for part, place in parts:
            out.add(True, node.low, None, None, None, None, None, None, None, part, place, None, None, None, None)

    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if len(stack) <= depth or stack[depth].digest != row["digest"]:
                while len(stack) > depth:
                    pop()
                stack.append(_Node(row["digest"], row["size"], 0))
                stack[-1].ids = [hashlib.sha256(), False]  # of the ids so far, and whether there are any
            node = stack[depth]
            node.take(row["conv_id"], row["n_convs"], row["n_children"], row["n_leaves"], row["saved_tokens"])
            if row["piece"] == 0:
                node.waiting.append((row["part"], row["place"]))
            if row["ids"] is not None:
                node.ids[0].update((b"," if node.ids[1] else b"") + row["ids"].encode())
                node.ids[1] = True
            if len(out.rows) >= ROWS:
                yield out.batch()
    while stack:
        pop()
    yield out.batch()


def prefix_trie(arrays: DataFrame, each: int = 4 << 20) -> DataFrame:
    """A row for each distinct beginning of the conversations ``arrays`` (conv_id, turns), the empty one included.

    conv_id is the smallest member, parent_conv_id the parent's; n_convs,
    n_children and n_leaves count members, children and childless nodes below or
    at the node; saved_tokens sums (members - 1) * size of the last turn over the
    subtree; ends_sha256 is the hash of the ids of the members that end there, in
    ascending order.  A task holds the nodes of one partition (``each`` bytes of
    input); a conversation's own digests must fit in one.  No conversations, no
    rows.
    """
    digests = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    keyed = stage_table(arrays.select("conv_id", digests.alias("turns"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "turn-arrays")
    parts = partitions_for(keyed, each)
    swept = stage_table(keyed.repartitionByRange(parts, "turns", "conv_id").sortWithinPartitions("turns", "conv_id").mapInArrow(_sweep, _SWEPT), "trie-parts")
    spines = swept.where("open").repartition(1).sortWithinPartitions("part", "place", "piece")
    stitched = stage_table(spines.mapInArrow(_stitch, _SWEPT), "trie-stitched")
    became = stitched.where("open").select("part", "place", F.col("conv_id").alias("above"))
    nodes = swept.where("NOT open").select(*_NODE, "part", "place").unionByName(stitched.where("NOT open").select(*_NODE, "part", "place"))
    inside = nodes.where("part IS NULL").drop("part", "place")
    edge = join_small(nodes.where("part IS NOT NULL"), stage_table(became, "trie-open"), ["part", "place"])
    return inside.unionByName(edge.withColumn("parent_conv_id", F.col("above")).select(*_NODE))


def shared_beginnings(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations.  Other columns of the table are not read."""
    return prefix_trie(rebuild(turn_arrays(conversations.select("conv_id", "turn", "role", "text"))))
