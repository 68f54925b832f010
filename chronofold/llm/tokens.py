"""Byte-pair ids of whole texts by the tokenizers library, with a memo of pieces.

The vocabulary's splitting rule always starts a new pre-token at a single
space, or single line feed, that stands between two non-space characters.
Texts are cut there, each distinct piece is encoded once by the library, and a
text's ids are the ids of its pieces in order.  Texts with any other white
space pattern, or with an added token of the vocabulary, go to the library
whole.  Results equal those of the library on the whole text; a test holds them
against it.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chronofold.llm.common import text_bytes

#: White space other than the space and the line feed.
_OTHER = re.compile("[" + "".join(map(chr, [9, 11, 12, 13, *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
#: First bytes of such characters beyond U+007F.
_WIDE = (0xC2, 0xE1, 0xE2, 0xE3)
#: Distinct pieces that a worker keeps; beyond it the memo starts anew.
MEMO = 800_000
#: New pieces that go to the library as one text.
_JOIN = 400


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts) -> one array of unsigned 16-bit ids for each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts with an added token, which the library finds before it splits, go to the library whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary do not fit in 16 bits")
        # tokens that start with a space, or are a line feed: in clean pieces they come first and nowhere else
        self.opens = np.zeros(1 << 16, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] in "ĠĊ"]] = True
        self._forget()

    def _forget(self) -> None:
        self.memo = pa.array([], pa.large_string())
        self.pool, self.used = np.zeros(1 << 20, np.uint16), 0
        self.at, self.size, self.known = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int32), 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Add pieces, each of which stands after one space unless it starts with a line feed."""
        spaced = [p if p[0] == "\n" else " " + p for p in pieces]
        joined = self._library(["".join(spaced[i : i + _JOIN]) for i in range(0, len(spaced), _JOIN)])
        ids = np.concatenate([np.array(x, np.uint16) for x in joined])
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(pieces):
            raise AssertionError("a piece does not open with its white space")
        n, m = len(ids), len(pieces)
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + m > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : self.used + n] = ids
        self.at[self.known : self.known + m] = starts + self.used
        self.size[self.known : self.known + m] = np.diff(np.append(starts, n))
        self.memo = pa.concat_arrays([self.memo, pa.array(pieces, pa.large_string())])
        self.used, self.known = self.used + n, self.known + m

    def _odd(self, texts: list[str]) -> np.ndarray:
        """Which texts have to go to the library whole."""
        raw, offsets = text_bytes(pa.array(texts, pa.large_string()))
        odd = np.zeros(len(texts), bool)
        if not len(raw):
            return odd
        row = lambda hit: np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1
        white = (raw == 32) | (raw == 10)
        pair = white.copy()
        pair[:-1] &= white[1:]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        pair[last] = white[last]  # at the end of a text one is enough, and so at its start
        odd[row(pair)] = True
        odd[row((raw < 32) & (raw != 10))] = True
        starts = np.flatnonzero(np.diff(offsets) > 0)
        odd[starts[white[offsets[:-1][starts]]]] = True
        wide = np.zeros(len(raw), bool)
        for byte in _WIDE:
            wide |= raw == byte
        for i in np.unique(row(wide)).tolist():
            odd[i] = odd[i] or bool(_OTHER.search(texts[i]))
        for token in self.added:
            for i in np.unique(row(raw == token.encode()[0])).tolist():
                odd[i] = odd[i] or token in texts[i]
        return odd

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        odd_ = self._odd([t or "" for t in texts])
        odd = np.flatnonzero(odd_).tolist()
        clean = [i for i in np.flatnonzero(~odd_).tolist() if texts[i]]
        if odd:
            for i, ids in zip(odd, self._library([texts[i] for i in odd]), strict=True):
                out[i] = np.array(ids, np.uint16)
        if not clean:
            return out
        if self.known > MEMO:
            self._forget()
        # a line feed before the text makes its first piece like the others; its id is cut off again
        lists = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in clean], pa.large_string()), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        coded = lists.values.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.memo)
        if place.null_count:
            new = coded.dictionary.filter(place.is_null()).to_pylist()
            known = self.known
            self._learn(new)
            place = place.to_numpy(zero_copy_only=False)
            place[np.isnan(place)] = np.arange(known, known + len(new))
            place = place.astype(np.int64)
        else:
            place = place.to_numpy()
        index = place[coded.indices.to_numpy()]
        size = self.size[index]
        ends = np.cumsum(size, dtype=np.int64)
        source = np.arange(ends[-1]) + np.repeat(self.at[index] - (ends - size), size)
        ids = self.pool[source]
        bounds = lists.offsets.to_numpy()
        bounds = np.where(bounds > 0, ends[np.maximum(bounds, 1) - 1], 0)
        for k, i in enumerate(clean):
            out[i] = ids[bounds[k] + 1 : bounds[k + 1]]
        pa.default_memory_pool().release_unused()  # the table of the memo's pieces is made anew each time
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
