"""Conversation tries and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from chronofold.llm import prefixes, queries, variants

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [v[3:] for v in sorted(o)] for c, o in own.items() if c is not None}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def trie_of(rows):
    full = rebuilt(rows)
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def mixed(rng):
    """Ties, nulls, gaps, repeated rows, negative ids, groups without a first conversation."""
    rows = []
    for c in rng.sample(range(-150, 400), 200):
        for t in range(rng.choice([0, 1, 2, 5, 8, 12])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["u", "a", None]), rng.choice(["hi", "é😀", "", None, "x" * 30, str(c % 7)])))
    return [*rows, *rows[:40], (None, 1, "u", "no conversation")]


CASES = {
    "mixed": lambda: mixed(random.Random(3)),
    "one group of copies": lambda: [(c, t, "u", "same") for c in range(600) for t in range(c % 3 + 1)],
    "one long conversation": lambda: [*mixed(random.Random(4)), *((7, t, "u", f"deep {t % 2}") for t in range(3000))],
    "one long text": lambda: [(c, t, "u", "long " * 50_000) for c in range(5) for t in range(2)],
    "empty": list,
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("each", [4 << 20, 400])
def test_prefix_trie(spark, monkeypatch, case, each):
    """Many small partitions cut stretches of rows everywhere; the nodes stay the same, each told once."""
    monkeypatch.setattr(prefixes, "IDS", 7)
    rows = CASES[case]()
    got = prefixes.prefix_trie(prefixes.rebuild(prefixes.turn_arrays(spark.createDataFrame(rows, TURNS).repartition(3))), each)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_of(rows)


def test_trie_is_cut_by_partitions(spark):
    """The case above has open stacks to stitch: many partitions hold the hot group."""
    rows = spark.createDataFrame(CASES["one group of copies"](), TURNS)
    arrays = prefixes.rebuild(prefixes.turn_arrays(rows))
    keyed = arrays.selectExpr("conv_id", "unhex(array_join(transform(turns, t -> t.digest), '')) AS turns", "transform(turns, t -> t.size) AS sizes")
    swept = keyed.repartitionByRange(9, "turns", "conv_id").sortWithinPartitions("turns", "conv_id").mapInArrow(prefixes._sweep, prefixes._SWEPT)
    assert swept.where("open").select("part").distinct().count() == 9


def test_trie_with_other_columns(spark, tmp_path):
    """Columns with the names that the operator makes are not read."""
    rows = mixed(random.Random(9))
    table = spark.createDataFrame([(*r, 1, "x", 2, b"y") for r in rows], TURNS + ", depth int, turns string, part int, digest binary")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()), key=repr) == trie_of(rows)


# ---------------------------------------------------------------- variants


def words_of(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(count):
    near = {w: [x for x in count if distance_one(w, x)] for w in count}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-count[x], x))
            if count[best] >= 2 * count[w]:
                form[w] = best
    out = {}
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, count[w], len(near[w]), count.get(form.get(w)))
    return out


def told(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("letters", "sizes", "number"), [("ab", (1, 7), 150), ("abcé", (2, 6), 250), ("ab", (8, 13), 500)])
@pytest.mark.parametrize("shard", [20_000, 15, 3])
def test_near_words(spark, letters, sizes, number, shard):
    """Small shards are split again and again; no pair is lost or told twice."""
    rng = random.Random(len(letters) * sizes[1])
    count = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): rng.randint(1, 40) for _ in range(number)}
    got = variants.group_words(spark.createDataFrame(list(count.items()), "word string, n long"), shard)
    assert told(got) == grouped(count)


def test_near_in_trie_is_both_ways_and_once():
    words = ["", "a", "aa", "aaa", "aab", "ab", "abb", "b", "bab", "bb"]
    pairs = variants.near_in_trie(words, 0)
    assert len(pairs) == len(set(pairs))
    assert {(words[i], words[j]) for i, j in pairs} == {(a, b) for a in words for b in words if distance_one(a, b)}


def test_variants_of_documents(spark, frame, tmp_path):
    rng = random.Random(2)
    stem = ["receive", "recieve", "receives", "garçon", "garcon", "ÉTAGE", "étage", "Étage", "house", "horse", "morse", "abcd", "x×y÷z×ü"]
    rows = [(i, " ".join(rng.choice(stem[: 4 + i % 10]) for _ in range(200))) for i in range(60)]
    rows += [(None, "receive " * 5), (3, "tied tiedd tiede " * 9), (3, "tied tiedd tiede " * 9), (61, None), (62, ""), (63, "1 2 3"), (64, "q" * 40_000 + " " + "q" * 39_999), (65, "q" * 40_000), (66, "q" * 40_000 + "-" + "q" * 40_000)]
    rows += [(70 + i, "q" * 39_999) for i in range(3)] + [(80, "longer " * 30_000)]
    count = words_of(rows)
    assert told(variants.group_variants(frame(rows))) == grouped(count)
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").write.parquet(f"{tmp_path}/documents.parquet")
    assert told(queries.op13_spelling_variants(spark, str(tmp_path))) == grouped(count)
    assert told(variants.group_variants(frame([(None, None)]).limit(0))) == {}
