"""What decides which windows are repeated: extension of seeds, and suffix arrays."""

import random

import numpy as np

from chronofold.llm import substring, suffix
from chronofold.llm.repeats import Piece, Windows

WHAT = Windows(6, 2, True)


def pieces(rng, many, letters=3):
    """Pieces around a seed of two words that all share."""
    out = []
    for _ in range(many):
        left, right = rng.randint(0, 4), rng.randint(0, 4)
        if left + right < 4:
            left = 4 - right
        words = [rng.randint(1, letters) for _ in range(left)] + [100, 101] + [rng.randint(1, letters) for _ in range(right)]
        out.append(Piece(7, len(out), rng.choice([1, 1, 1, 2]), 1, left, np.array(words, np.uint64).tobytes()))
    return out


def brute(held):
    starts = {}
    for k, p in enumerate(held):
        words = np.frombuffer(p.data, np.uint64).tolist()
        for i in range(len(words) - WHAT.span + 1):
            starts.setdefault((p.seed - i, tuple(words[i : i + WHAT.span])), []).append((k, i, p.n))
    out = [np.zeros(len(p.data) // 8 - WHAT.span + 1, bool) for p in held]
    for same in starts.values():
        for k, i, n in same:
            out[k][i] = len(same) > 1 or n > 1
    return out


def test_extension_equals_comparing_all_windows():
    for seed in range(30):
        held = pieces(random.Random(seed), 40, 2 + seed % 3)
        assert all(np.array_equal(a, b) for (a, _), b in zip(substring.extend(held, WHAT), brute(held), strict=True))


def test_extensions_are_the_longest():
    right = np.array([[1, 2, 3, 4], [1, 2, 9, 9], [1, 2, 3, 0], [5, 5, 5, 5], [1, 2, 3, 4]], np.uint64)
    size = np.array([4, 4, 3, 4, 4])
    left = np.array([1, 1, 1, 1, 2], np.uint64)
    assert substring.extensions(left, np.arange(5), right, size).tolist() == [3, 2, 3, 0, -1]


def test_counts_decide_nothing(monkeypatch):
    """Without extensions, or common prefixes, nothing is found, not even in pieces that stand in several places."""
    held = [Piece(1, 0, 2, 1, 2, np.arange(1, 9, dtype=np.uint64).tobytes()), Piece(1, 1, 1, 1, 2, np.arange(1, 9, dtype=np.uint64).tobytes())]
    assert all(hit.all() for hit, _ in substring.extend(held, WHAT))
    monkeypatch.setattr(substring, "extensions", lambda left, *_: np.full(len(left), -1))
    assert not any(hit.any() for hit, _ in substring.extend(held, WHAT))
    texts = [Piece(1, 0, 2, 1, 0, b"abcdefgh"), Piece(1, 1, 1, 1, 0, b"xbcdefgz"), Piece(1, 2, 1, 1, 0, b"different")]
    assert [hit.tolist() for hit, _ in suffix.search(texts, 6)] == [[True] * 3, [False, True, False], [False] * 4]
    monkeypatch.setattr(suffix, "common_prefixes", lambda text, ends, sa: np.zeros(len(text), np.int64))
    assert not any(hit.any() for hit, _ in suffix.search(texts, 6))


def test_pieces_of_several_shards_tell_their_windows():
    held = [Piece(1, k, 1, 2, 2, np.array(w, np.uint64).tobytes()) for k, w in enumerate(([1, 9, 9, 2, 3, 4, 5, 6], [1, 9, 9, 2, 3, 4, 5, 7]))]
    (_, a), (_, b) = substring.extend(held, WHAT)
    assert (a == b).tolist() == [True, True, False] and len(set(a.tolist())) == 3


def test_spent_tables_go(spark):
    """The pipeline's stages leave no more behind than the tables that their result is read from."""
    from chronofold.llm import common, minhash, substring

    text = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(i, f"{'ab'[i % 2]} {text} {'cd'[i % 2]}") for i in range(6)] + [(9, "alone " * 3), (10, None)], "doc_id long, text string")
    before = set(common._written)
    left = minhash.deduplicate(docs)
    assert sorted(p.rpartition("/")[2].partition("-")[0] for p in set(common._written) - before) == ["first"]
    assert {r.doc_id for r in left.collect()} >= {0, 9, 10}
    before = set(common._written)
    cut = substring.remove_repeats(docs, keep_columns=True)
    names = [p.rpartition("/")[2].rpartition("-")[0] for p in set(common._written) - before]
    assert not {"anchors", "often", "pieces", "rivals", "hits"} & set(names)
    assert {r.doc_id: r.text for r in cut.collect()}[0] == ""
