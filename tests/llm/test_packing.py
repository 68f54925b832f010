import zlib

import numpy as np
import pytest

from chronofold.llm.packing import Limits, conversation_sizes, pack_documents, pack_group, pack_vectors, pack_whole
from chronofold.llm.tokens import Encoder, vocabulary_path
from chronofold.llm.wavelet import Shard, build, encode_shards, occurrences, read_digest, token_counts, with_starts

ODD = [
    "", "a  b", " x", "x ", "it's\n\nfoo 12,3", "a\tb c d  e\n f", "\n", " ", "hello.\nWorld ab., c.", "don't can't 's",
    "été à <|endoftext|> b", "x y z", "a\x1c b", "Ġ Ċ x", "a 　b", "12 345 6.", "x" * 5000, "日本 語\nçé", "'s 't\n'll",
]


def test_encoder_equals_library():
    e = Encoder(vocabulary_path())
    for _ in range(2):
        for text, ids in zip(ODD, e.encode(ODD), strict=True):
            assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert e.encode([None])[0].tolist() == []


def test_added_tokens_are_coded_as_by_the_library():
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(vocabulary_path()), Encoder(vocabulary_path())
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c", "<|endoftext|> <|endoftext|>\nx", "a <|endoftext| > b", "plain words"]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert e.encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


def test_limits_hold_and_every_token_is_placed():
    rng = np.random.default_rng(1)
    totals = rng.integers(1, 300, 500).tolist() + [5000, 1]
    bearing = [int(rng.integers(0, t + 1)) for t in totals]
    limits = Limits(tokens=256, segments=6, loss=150)
    seen = [np.zeros(t, int) for t in totals]
    rows = pack_group(totals, bearing, limits)
    for row in rows:
        assert sum(n for _, _, n in row) <= 256 and 0 < len(row) <= 6
        assert sum(max(0, s + n - max(s, totals[i] - bearing[i])) for i, s, n in row) <= 150
        for i, s, n in row:
            seen[i][s : s + n] += 1
    assert all((x == 1).all() for x in seen)
    assert len(rows) < 1.25 * max(sum(totals) / 256, sum(bearing) / 150)


def test_vectors_beat_one_dimension():
    # long items with little loss pair with short items that are all loss
    sizes = np.array([[90, 1, 5]] * 20 + [[10, 1, 90]] * 20)
    assert len(pack_vectors(sizes, np.array([100, 10, 100]))) == 20
    assert pack_vectors(np.zeros((0, 3), int), np.array([1, 1, 1])) == []


def check_pieces(spark, frame, rows):
    e = Encoder(vocabulary_path())
    pdf = pack_documents(frame(rows), with_ids=True).toPandas()
    texts = dict(rows)
    for doc, part in pdf.sort_values("start").groupby("doc_id"):
        want = e.encode([texts[doc] or ""])[0].tolist() + [1]
        assert [x for ids in part["ids"] for x in ids] == want
        assert part["doc_tokens"].eq(len(want)).all()
    for r in pdf.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    padding = 0
    for _, part in pdf.sort_values("offset").groupby("sequence_id"):
        total = 0
        for r in part.itertuples():
            assert r.offset == total
            total += r.length
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert set(pdf["doc_id"]) == set(texts)
    return padding, pdf["length"].sum()


def test_documents(spark, frame):
    rows = [(i, f"word{i} and more " * (i % 37)) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(5000, None), (5001, "long text " * 20000)]
    padding, total = check_pieces(spark, frame, rows)
    assert padding < 0.02 * total
    assert pack_documents(frame([])).count() == 0
    assert pack_documents(frame(rows[:5]).selectExpr("*", "1 AS start", "2 AS length", "3 AS loss", "4 AS ids")).select("doc_id").distinct().count() == 5
    null_id = pack_documents(frame([(None, "a b"), (None, "a b")])).toPandas()
    assert null_id["doc_id"].isna().all() and null_id["length"].sum() == 6
    # instruction data: the last tokens bear loss
    conv = spark.createDataFrame([(1, "a b c d", 2), (2, "a b", None)], "doc_id long, text string, answer int")
    got = pack_documents(conv, loss_column="answer").groupBy("doc_id").sum("n_loss").collect()
    assert {r[0]: r[1] for r in got} == {1: 2, 2: 3}


def test_shard_queries():
    rng = np.random.default_rng(2)
    ids = rng.choice(np.array([3, 7, 50000, 65535, 0]), 70000, p=[0.6, 0.2, 0.1, 0.05, 0.05]).astype(np.uint16)
    s = Shard(build(ids, np.array([5, 9]), np.array([60000, 10000])))
    assert (s.decode() == ids).all() and [d for d, _ in s.documents()] == [5, 9]
    for i in (0, 1, 32767, 32768, 69999):
        assert s.access(i) == ids[i]
    for t in (3, 7, 50000, 65535, 0, 12):
        places = np.flatnonzero(ids == t)
        assert s.count(t) == len(places)
        assert s.rank(t, 40000, 100) == ((places >= 100) & (places < 40000)).sum()
        for k in (0, len(places) // 2, len(places) - 1):
            if len(places):
                assert s.select(t, k) == places[k]
    with pytest.raises(IndexError):
        s.select(12, 0)
    bad = bytearray(build(ids, np.array([5]), np.array([70000])))
    bad[100] ^= 1
    with pytest.raises(ValueError):
        Shard(bytes(bad))
    empty = Shard(build(np.zeros(0, np.uint16), np.zeros(0), np.zeros(0)))
    assert len(empty.decode()) == 0


def test_wavelet_round_trip(spark, frame, monkeypatch):
    e = Encoder(vocabulary_path())
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(500, None), (7, "same"), (7, "same")]
    shards = with_starts(encode_shards(frame(rows)))
    got = read_digest(shards).orderBy("start").collect()
    at = 0
    for (doc, text), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        want = e.encode([text or ""])[0].tolist() + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    n = sum(r.n for r in token_counts(shards, [2, 77]).where("token = 2").collect())
    assert n == len(rows)
    assert read_digest(with_starts(encode_shards(frame([])))).count() == 0
    assert all(r.path.endswith(".wmtx") and r.data is None for r in shards.collect())
    # without a store for files the bytes are rows of the table, and give the same
    monkeypatch.setattr("chronofold.llm.wavelet._store", lambda folder: None)
    held = with_starts(encode_shards(frame(rows)))
    assert all(r.path is None for r in held.collect())
    assert read_digest(held).orderBy("start").collect() == got
    clash = frame(rows).selectExpr("*", "1 AS path", "2 AS data", "3 AS part", "4 AS start")
    assert read_digest(with_starts(encode_shards(clash))).count() == len(rows)


def test_shard_reads_only_what_it_needs(tmp_path):
    """Access, counting and lookup read directories and a block of each plane, not the file."""
    from pyarrow import fs

    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50000, 1 << 19).astype(np.uint16)
    (tmp_path / "s").write_bytes(build(ids, np.array([1]), np.array([len(ids)])))
    file = fs.LocalFileSystem().open_input_file(str(tmp_path / "s"))

    class Counted:
        read = 0

        def read_at(self, n, at):
            Counted.read += n
            return file.read_at(n, at)

        def size(self):
            return file.size()

    s = Shard(Counted(), check=False)
    assert s.access(123456) == ids[123456] and s.count(int(ids[7])) == (ids == ids[7]).sum()
    assert Counted.read < file.size() / 3


def test_occurrences_equal_brute_force(spark, frame, monkeypatch):
    monkeypatch.setattr("chronofold.llm.wavelet.SHARD_TOKENS", 200)
    rows = [(i, f"word{i % 7} the the {'x y ' * (i % 30)}") for i in range(60)] + [(None, None), (61, "")]
    e = Encoder(vocabulary_path())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = np.concatenate([np.append(x, 2) for x in e.encode([t for _, t in order])])
    shards = with_starts(encode_shards(frame(rows), partitions=2))
    assert shards.count() > 3
    wanted = sorted({2, 262, 40_000, *ids.tolist()[:20]})
    got = {r.token: (r.n, r.first, r.last) for r in occurrences(shards, wanted).collect()}
    at = {t: np.flatnonzero(ids == t).tolist() for t in wanted}
    assert got == {t: (len(p), p[0] if p else None, p[-1] if p else None) for t, p in at.items()}


def test_read_back_checks_whole_files(spark, frame):
    shards = with_starts(encode_shards(frame([(1, "some text"), (2, "more")]), partitions=1))
    path = shards.first().path.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(-6, 2)
        f.write(b"!")
    with pytest.raises(Exception, match="checksum"):
        read_digest(shards).collect()


def test_conversations_under_three_limits(spark):
    """Each limit binds somewhere, none is broken, nothing is lost; sequences that look at tokens alone break the others."""
    rng = np.random.default_rng(5)
    turns = []
    for c in range(400):
        for t in range(int(rng.integers(1, 9))):
            role = "assistant" if rng.random() < 0.5 else rng.choice(["user", "system"])
            turns.append((c, t, str(role), "word " * int(rng.integers(1, 60) if c % 3 else rng.integers(1, 4))))
    turns += [(900, 0, None, None), (901, 0, "assistant", "long " * 3000), (None, 0, "user", "nobody's")]
    sizes = conversation_sizes(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3))
    long = len(Encoder(vocabulary_path()).encode(["long " * 3000])[0]) + 1
    assert {tuple(r) for r in sizes.where("conv_id >= 900").collect()} == {(900, 1, 1, 0), (901, long, 1, long)}
    limits = Limits(tokens=560, segments=20, loss=270)
    got = pack_whole(sizes.coalesce(1), limits).collect()
    assert sorted(r.conv_id for r in got) == sorted({t[0] for t in turns if t[0] is not None})
    assert {r.conv_id for r in got if r.oversized} == {r.conv_id for r in got if r.tokens > 560 or r.segments > 20 or r.loss > 270} >= {901}
    bins = {}
    for r in got:
        if not r.oversized:
            bins.setdefault(r.sequence_id, []).append((r.tokens, r.segments, r.loss))
    totals = np.array([np.sum(b, axis=0) for b in bins.values()])
    cap = np.array([560, 20, 270])
    assert (totals <= cap).all()
    assert (totals >= 0.95 * cap).any(axis=0).all(), "each limit is nearly reached by some sequence"
    each = np.array([x for b in bins.values() for x in b])
    assert len(bins) <= 1.1 * np.ceil(each.sum(axis=0) / cap).max() + 1
    alone = [each[b].sum(axis=0) for b in pack_vectors(each[:, :1], cap[:1])]
    assert np.mean([(x > cap).any() for x in alone]) > 0.3
    assert pack_whole(sizes.limit(0), limits).collect() == []
