"""Deduplication against plain versions on small tables."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from chronofold.llm import minhash, queries, repeats, simhash, substring, suffix

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


@pytest.fixture(scope="module")
def corpus():
    """Random texts, exact and near copies, shared passages, odd ones."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(rng.choice([5, 40, 120, 400])) for _ in range(40)]
    passage = text(70)
    rows = list(base)
    rows += [base[0], base[0], base[7]]
    for k in (1, 2, 3):
        w = base[10].split(" ")
        w[k * 5 % len(w)] = "edited"
        rows.append(" ".join(w))
    rows += [text(30) + " " + passage + " " + text(30) for _ in range(6)]
    rows += ["x", "x", "x y", "X Y", "a b c d e", "a b c d e f", None, "", " \n ", "loop " * 200, "é ü " * 90, "z" * 900, "tab\tsep\x0bmore " * 40]
    long = text(9000)
    rows += [long, long[:20000] + " changed " + long[20000:]]
    return list(enumerate(rows))


def brute_words(rows, span):
    texts = {i: words_of(t or "") for i, t in rows}
    seen = Counter(tuple(w[p : p + span]) for w in texts.values() for p in range(len(w) - span + 1))
    out = {}
    for i, w in texts.items():
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - span + 1):
            if seen[tuple(w[p : p + span])] > 1:
                gone[p : p + span] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("span", "gram"), [(35, 8), (5, 2)])
def test_substring(spark, frame, corpus, span, gram):
    got = {r[0]: tuple(r)[1:4] for r in substring.remove_repeats(frame(corpus), span=span, gram=gram).collect()}
    assert got == brute_words(corpus, span)


def test_substring_spans_and_stage(spark, frame, corpus):
    texts = dict(corpus)
    for r in substring.remove_repeats(frame(corpus), span=35).collect():
        w = words_of(texts[r.doc_id] or "")
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        if r.n_removed:
            gone = {p for s in r.spans for p in range(s.start, s.end)}
            assert r.kept_text == " ".join(x for p, x in enumerate(w) if p not in gone)
        else:
            assert r.kept_text == texts[r.doc_id]
    stage = substring.remove_repeats(frame(corpus).withColumnRenamed("lang", "k"), span=35, keep_columns=True)
    assert stage.columns == ["doc_id", "text", "k", "source", "n_chars"] and stage.count() == len(corpus)


def check_bytes(frame, table, span, gram):
    rows = [(i, (t or "").encode()) for i, t in table]
    seen = Counter(b[p : p + span] for _, b in rows for p in range(len(b) - span + 1))
    got = {r[0]: tuple(r)[1:5] for r in suffix.remove_repeats(frame(table), span=span, gram=gram).collect()}
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                gone[p : p + span] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert got[i] == (len(b), int(gone.sum()), len(repeats.spans_of(gone)), hashlib.sha256(kept).hexdigest()), i


def test_suffix(spark, frame, corpus):
    check_bytes(frame, corpus, 60, 12)


def test_many_shards_for_one_anchor(spark, frame, monkeypatch):
    """Segments of one anchor dealt to several shards give the same result."""
    monkeypatch.setattr(repeats, "SHARD_PIECES", 3)
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdef") for _ in range(90))
    rows = [(i, "".join(rng.choice("uvwxyz") for _ in range(80)) + shared + "".join(rng.choice("uvwxyz") for _ in range(80))) for i in range(40)]
    check_bytes(frame, rows, 60, 12)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (50, 1, 80, 0, 33)] + [b"a" * 60]
    text, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    sa, _ = suffix.suffix_array(text, ends, 1000)
    end_of = np.repeat(ends, [len(p) for p in parts])
    key = lambda p: bytes(text[p : end_of[p]])
    assert sorted(sa.tolist()) == list(range(len(text)))
    assert all(key(a) <= key(b) for a, b in itertools.pairwise(sa.tolist()))
    lcp = suffix.common_prefixes(text, ends, sa)
    for a, b in itertools.pairwise(sa.tolist()):
        want = next((k for k, (x, y) in enumerate(zip(key(a), key(b), strict=False)) if x != y), min(len(key(a)), len(key(b))))
        assert lcp[b] == want


def brute_components(rows, words, percent):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {}
    for i, t in rows:
        w = words_of(lower(t or ""))
        sets[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < words else frozenset(tuple(w[p : p + words]) for p in range(len(w) - words + 1))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, frame, corpus, words):
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame(corpus), words=words).collect()}
    assert got == brute_components(corpus, words, 80)


def test_chain_of_edits(spark, frame):
    """Links that only neighbours share still make one component."""
    w = [f"t{i}" for i in range(60)]
    rows = []
    for k in range(12):
        rows.append((100 - k, " ".join(w)))
        w = w[3:] + [f"n{k}_{j}" for j in range(3)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows), words=2).collect()}
    assert got == {i: v[1] for i, v in brute_components(rows, 2, 80).items()} and set(got.values()) == {89}


def test_estimates():
    rng = np.random.default_rng(4)
    for n in (100, 2000):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n // 5 : n + n // 5])
        make = minhash.own_registers if n <= minhash.LARGE else minhash.shared_registers
        r = [make(x, np.array([0, n]))[0] for x in (a, b)]
        assert abs(minhash.estimate(r[0], r[1], n, n) - 0.8 / 1.2) < 0.15


def test_simhash(spark, frame, corpus):
    texts = dict(corpus)
    got = {r.doc_id: r for r in simhash.neighbours_digest(frame(corpus)).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b = texts[i] or "", texts[j] or ""
        edited = simhash.edited_text(a, b)
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if a == b:
            assert got[i].near_next == 1.0
        assert got[i].near_next == pytest.approx(float(simhash.likeness(*(np.frombuffer(bytes.fromhex(got[k].fingerprint), np.uint8)[None] for k in (i, j)))[0]))
    assert got[0].fingerprint == got[40].fingerprint
    assert simhash.neighbours_digest(frame([])).count() == 0
    assert simhash.neighbours_digest(frame([(1, "only one here")])).first().near_next == 1.0
    assert got[10].near_edited > 0.4


def test_hamming_search_is_exact(spark):
    rng = random.Random(2)
    base = rng.getrandbits(128)
    values = [base] + [base ^ sum(1 << b for b in rng.sample(range(128), k)) for k in (1, 3, 6, 7, 9)] + [rng.getrandbits(128) for _ in range(50)] + [base]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(v & (2**64 - 1)), signed(v >> 64)) for v in values], "hi long, lo long")
    got = {(r.hi, r.lo, r.hi2, r.lo2) for r in simhash.within_radius(df, df, 6, 9).collect()}
    halves = {v: (signed(v & (2**64 - 1)), signed(v >> 64)) for v in values}
    assert got == {halves[a] + halves[b] for a in values for b in values if (a ^ b).bit_count() <= 6}


@pytest.mark.parametrize("run", [lambda d: substring.remove_repeats(d), lambda d: suffix.remove_repeats(d), lambda d: minhash.near_duplicates(d), lambda d: simhash.neighbours_digest(d)])
def test_empty_null_and_repeated(spark, frame, run):
    assert run(frame([])).count() == 0
    rows = [(None, "one two"), (None, None), (3, "one two"), (3, "one two"), (4, None)]
    clash = frame(rows).selectExpr("*", "1 AS k", "2 AS items", "3 AS component", "4 AS _k")
    assert run(clash).count() == len(rows)


@pytest.mark.parametrize("ids", [(None, None, None, 7), (3, 3, 3, None), (1, None, 1, None)])
def test_long_rows_without_an_id_of_their_own(spark, frame, ids):
    """Rows that share an id, or have none, get their own hits only."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(500)
    texts = [text(300) + passage + text(90), text(450) + passage + text(700), text(800), passage[:470] + text(333)]
    rows = [t.encode() for t in texts]
    seen = Counter(b[p : p + 400] for b in rows for p in range(len(b) - 399))
    want = []
    for b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        want.append((len(b), int(gone.sum()), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = suffix.remove_repeats(frame(list(zip(ids, texts, strict=True))))
    assert sorted((r.n_bytes, r.n_removed, bytes(r.kept)) for r in got.collect()) == sorted(want)


def brute_rows(rows, words, percent):
    """Component of each row by its own text, as the least id that is reachable."""
    by_place = brute_components([(p, t) for p, (_, t) in enumerate(rows)], words, percent)
    ids = {}
    for p, (i, _) in enumerate(rows):
        if i is not None:
            ids[by_place[p][1]] = min(i, ids.get(by_place[p][1], i))
    out = []
    for p, (i, _) in enumerate(rows):
        n, root, _ = by_place[p]
        component = ids.get(root) if n else i
        out.append((i, n, component, i == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [1, 200])
def test_repeated_and_null_ids_link_by_their_texts(spark, frame, monkeypatch, heavy):
    """A repeated id with different texts loses no link; rows without an id link too."""
    monkeypatch.setattr("chronofold.llm.common.LEAST_HEAVY", heavy)
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    a, b, c = text(60), text(60), text(300)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (None, c), (7, c + " z"), (None, c + " q"), (None, text(40)), (4, ""), (None, None)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(frame(rows), words=2).collect()), key=repr)
    assert got == brute_rows(rows, 2, 80)
    kept = sorted(((r.doc_id, r.text) for r in minhash.deduplicate(frame(rows), words=2).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (7, c + " z"), rows[8], (4, ""), (None, None)], key=repr)


def test_deduplicate_keeps_columns_of_any_name(spark, frame):
    rows = [(i, "one two three four five six seven" if i % 2 else "eight nine ten") for i in range(6)]
    clash = frame(rows).selectExpr("*", "1 AS k", "2 AS c0", "3 AS component", "4 AS `a.b`", "5 AS n")
    kept = minhash.deduplicate(clash, words=2)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1]


@pytest.mark.parametrize("heavy", [1, 200])
def test_words_of_rows_that_share_an_id(spark, frame, monkeypatch, heavy):
    """Rows with equal or null ids, whole repeated rows and clashing column names."""
    monkeypatch.setattr("chronofold.llm.common.LEAST_HEAVY", heavy)
    monkeypatch.setattr(repeats, "SHARD_PIECES", 2)
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(n))
    passage = text(45)
    rows = [(None, text(20) + " " + passage), (None, passage + " " + text(9)), (3, text(80)), (3, text(50) + " " + passage), (5, text(60)), (5, None), (None, "")]
    rows += [rows[4], rows[4], rows[0]]
    want = sorted(brute_words(list(enumerate(t for _, t in rows)), 35).values())
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame(rows), span=35).collect())
    assert got == want
    clash = frame(rows).selectExpr("*", "1 AS k", "'x' AS _text", "3 AS items", "4 AS c0", "5 AS `a.b`", "6 AS content")
    stage = substring.remove_repeats(clash, span=35, keep_columns=True)
    assert stage.columns == clash.columns and stage.count() == len(rows)
    assert {(r._text, r.k, r.c0) for r in stage.collect()} == {("x", 1, 4)}


def test_bytes_at_the_full_span(spark, frame):
    """The query's own setting on texts with copies and passages around 400 bytes."""
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = text(420)
    rows = [text(600), text(30) + passage + text(500), passage + text(50), text(10) + passage[:380], "ab" * 500, "ab" * 260, "z" * 401, None, ""]
    rows += [rows[0], rows[0][:450], text(3000) + rows[1] + text(800)]
    check_bytes(frame, list(enumerate(rows)), 400, 48)


def test_passages_are_measured_in_bytes(frame, tmp_path, spark):
    """A passage of sixty words goes from 400 bytes on, at 399 it stays, and n_bytes is the whole text's size either way."""
    short, full = " ".join(["abcde"] * 40 + ["fghijkl"] * 20), " ".join(["mnopq"] * 40 + ["rstuvwx"] * 19 + ["rstuvwxy"])
    assert (len(short), len(full)) == (399, 400) and len(short.split()) == len(full.split()) == 60
    rows = [(0, "1" + short + "2"), (1, "3" + short + "4"), (2, "5" + full + "6"), (3, "7" + full + "8")]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.text) for r in queries.op8_suffix_arrays(spark, str(tmp_path)).collect()}
    assert got == {0: (401, 0, rows[0][1]), 1: (401, 0, rows[1][1]), 2: (402, 400, "56"), 3: (402, 400, "78")}
    below = {r.doc_id: r.n_removed for r in suffix.remove_repeats(frame(rows), span=399).collect()}
    assert below == {0: 399, 1: 399, 2: 400, 3: 400}
