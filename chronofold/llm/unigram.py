"""SentencePiece unigram coding: Viterbi over a double-array trie of pieces.

Pieces and their log scores come from a model file, which is read here without
the library; nothing is trained.  A model that was made by merging has the order
of its merges in place of log scores; its pieces get the log probabilities of
Zipf's law over that order, which sum to one.  White space becomes a marker, and a marker is
put before the text.  The best segmentation has the highest sum of scores; of
equal ones, the one whose last piece is longest wins (so for each prefix).  A
character that no piece starts at is written by its bytes.

A text is cut where no piece can cross: before a marker that follows another
character, and around characters that no longer piece contains and that have no
piece of their own.  A segment's best pieces do not depend on the rest of the
text, so each distinct segment is solved once for each worker and remembered.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The kind of model that is made by merging.
MERGES = 2
#: Segments that a worker remembers; beyond it the memo starts anew.
MEMO = 600_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    """(number, value) of a protocol buffer message's fields."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif kind == 5:
            value, i = struct.unpack_from("<f", b, i)[0], i + 4
        elif kind == 1:
            value, i = struct.unpack_from("<d", b, i)[0], i + 8
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class DoubleArray:
    """A trie over bytes in two arrays: the child of s by byte c is base[s] + c if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        search = 1  # below it nearly all places are taken
        queue = [(0, 0, len(keys), 0)]  # node, range of keys, depth
        for node, lo, hi, depth in queue:
            if lo < hi and len(keys[lo]) == depth:
                value[node] = values[lo]
                lo += 1
            children: list[tuple[int, int, int]] = []
            i = lo
            while i < hi:
                c, j = keys[i][depth], i
                while j < hi and keys[j][depth] == c:
                    j += 1
                children.append((c, i, j))
                i = j
            if not children:
                continue
            first = children[0][0]
            place = max(first + 1, search)
            start, full = place, 0
            while True:
                if place + 512 > size:
                    base, check, value, size = base + [0] * size, check + [-1] * size, value + [-1] * size, 2 * size
                if check[place] >= 0:
                    full += 1
                else:
                    at = place - first
                    if all(check[at + c] < 0 for c, _, _ in children):
                        break
                place += 1
            if full >= 0.9 * (place - start + 1) or place - start > 2000:
                search = place
            base[node] = at
            for c, i, j in children:
                check[at + c] = node
                queue.append((at + c, i, j, depth + 1))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, text: bytes, start: int):
        """(end, value) of every key that starts there, shortest first."""
        base, check, value = self.base, self.check, self.value
        node = 0
        for i in range(start, len(text)):
            child = base[node] + text[i]
            if check[child] != node or not child:
                return
            node = child
            if value[node] >= 0:
                yield i + 1, value[node]


@dataclass
class Pieces:
    """The pieces of a model file."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool  # a marker goes before the text
    squeeze: bool  # runs of white space count as one, and none at the ends

    @staticmethod
    def load(path: str) -> Pieces:
        with open(path, "rb") as f:
            data = f.read()
        texts, scores, kinds, spec, merged = [], [], [], {}, False
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                texts.append(x[1].decode())
                scores.append(x.get(2, 0.0))
                kinds.append(x.get(3, NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
            elif number == 2:
                merged = dict(_fields(value)).get(3, 1) == MERGES
        if spec.get(2):
            raise ValueError("only models with the identity normaliser are supported")
        if merged:
            scores = zipf(scores, [k in (NORMAL, USER) for k in kinds])
        return Pieces(texts, scores, kinds, bool(spec.get(3, 1)), bool(spec.get(4, 1)))


def zipf(order: list[float], ranked: list[bool]) -> list[float]:
    """Log probabilities by rank: of the pieces that are ranked, the r-th from the top has a share of 1 / r; others have 0.

    Equal values are ranked by place.
    """
    places = sorted((i for i, r in enumerate(ranked) if r), key=lambda i: (-order[i], i))
    total = math.log(sum(1 / r for r in range(1, len(places) + 1))) if places else 0.0
    out = [0.0] * len(order)
    for r, i in enumerate(places, 1):
        out[i] = -math.log(r) - total
    return out


class Unigram:
    """encode(texts) and decode(ids)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        usable = [i for i, k in enumerate(pieces.kinds) if k in (NORMAL, USER)]
        self.trie = DoubleArray([pieces.texts[i].encode() for i in usable], usable)
        self.scores = pieces.scores
        self.bytes = {int(pieces.texts[i][3:5], 16): i for i, k in enumerate(pieces.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(pieces.kinds) if k == UNKNOWN), None)
        if len(self.bytes) < 256 and self.unknown is None:
            raise ValueError("the model has neither byte pieces nor an unknown piece")
        self.penalty = min((pieces.scores[i] for i in usable), default=0.0) - 10.0
        inner = {c for i in usable for c in pieces.texts[i]}
        self.alone = "\n" not in inner  # then a line feed never joins others
        if any(MARK in t.lstrip(MARK) for t in (pieces.texts[i] for i in usable)):
            raise ValueError("a piece has a marker after other characters")
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {"": 0}
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0
        self.at, self.size, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 1

    def solve(self, segment: str) -> list[int]:
        """The best pieces of a segment, by dynamic programming from its start."""
        text = segment.encode()
        n = len(text)
        best = [-1e300] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        scores, base, check, value = self.scores, self.trie.base, self.trie.check, self.trie.value
        i = 0
        while i < n:
            here = best[i]
            c = text[i]
            width = 1 if c < 128 else 2 if c < 224 else 3 if c < 240 else 4
            node, single = 0, False
            for j in range(i, n):
                child = base[node] + text[j]
                if check[child] != node:
                    break
                node = child
                v = value[node]
                if v >= 0:
                    if j + 1 - i == width:
                        single = True
                    s = here + scores[v]
                    if s > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, v)
            if not single:
                s = here + self.penalty
                if s > best[i + width]:
                    best[i + width], back[i + width] = s, (i, -1)
            i += width
        out: list[int] = []
        end = n
        while end:
            start, v = back[end]
            if v >= 0:
                out.append(v)
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in reversed(text[start:end])]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            end = start
        return out[::-1]

    def _segments(self, text: str) -> str:
        """The text with its markers, cut by NULs (which the text itself does not have)."""
        if self.pieces.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if self.pieces.prefix:
            text = " " + text
        if "  " in text:
            text = _RUNS.sub(lambda m: "\0" + MARK * len(m[0]), text)
        else:
            text = text.replace(" ", "\0" + MARK)
        return text.replace("\n", "\0\n\0") if self.alone else text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        cut, plain = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if "\0" in text:
                whole = self._segments_with_nul(text)
                out[i] = np.array([x for s in whole for x in self.solve(s)], np.int32)
            else:
                plain.append(i)
                cut.append(self._segments(text))
        if not plain:
            return out
        if self.known > MEMO:
            self._forget()
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), "\0")
        coded = lists.values.dictionary_encode()
        segments = coded.dictionary.to_pylist()
        for s in segments:
            if s not in self.memo:
                self._remember(s)
        index = np.fromiter(map(self.memo.__getitem__, segments), np.int64, len(segments))[coded.indices.to_numpy()]
        size = self.size[index]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.at[index] - (ends - size), size)]
        bounds = lists.offsets.to_numpy()
        bounds = np.where(bounds > 0, ends[np.maximum(bounds, 1) - 1], 0)
        for k, i in enumerate(plain):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        return out

    def _segments_with_nul(self, text: str) -> list[str]:
        """As ``_segments``, for texts that have NULs themselves."""
        if self.pieces.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        text = ((" " if self.pieces.prefix else "") + text).replace(" ", MARK)
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)

    def _remember(self, segment: str) -> None:
        ids = self.solve(segment)
        n = len(ids)
        if self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), n), np.int32)])
        if self.known >= len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : self.used + n] = ids
        self.at[self.known], self.size[self.known] = self.used, n
        self.memo[segment] = self.known
        self.used, self.known = self.used + n, self.known + 1

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, markers back to spaces, the first one dropped."""
        if not hasattr(self, "_surface"):
            kinds = self.pieces.kinds
            surface = [t.encode() if k in (NORMAL, USER) else b"" for t, k in zip(self.pieces.texts, kinds, strict=True)]
            for b, i in self.bytes.items():
                surface[i] = bytes([b])
            if self.unknown is not None:
                surface[self.unknown] = " ⁇ ".encode()
            self._surface = [s.replace(MARK.encode(), b" ") for s in surface]
        surface = self._surface
        data = b"".join([surface[i] for i in ids.tolist()])
        if self.pieces.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_RUNS = re.compile(" +")
_models: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    """One coder for each Python worker and model file."""
    if path not in _models:
        _models[path] = Unigram(Pieces.load(path))
    return _models[path]


def encode_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode whole texts.

    Per row: doc_id, n_pieces, n_bytes_pieces (pieces from byte fallback),
    ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 (UTF-8 of the
    decoded text) and round_trip (the decoded text is the text).  ``with_ids``
    adds the ids.  A null or empty text has no pieces and decodes to the empty
    text.  A text that itself has the marker character decodes it to a space,
    which the format cannot tell apart.  Equal rows are kept, null ids too.
    """
    path = model or model_path()
    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if with_ids else "")

    def run(batches):
        coder = unigram(path)
        is_byte = np.array([k == BYTE for k in coder.pieces.kinds])
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column(1).to_pylist()
            ids = coder.encode(texts)
            decoded = [coder.decode(x) for x in ids]
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                pa.array([t == (s or "") for s, t in zip(texts, decoded, strict=True)]),
            ]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
