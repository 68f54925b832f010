"""What the fourth round of findings showed."""

import datetime
import difflib
import random

import numpy as np
import pyarrow as pa

from chronofold.functions import likeness, text
from chronofold.operators import latent
from chronofold.plans import texts
from chronofold.streaming import monitor

SF = "/root/testdata/sf0.001"


def test_asked_names_need_the_ratio(spark):
    """join_fuzzy_name: some of the names asked for are not known, and have a suggestion by likeness alone."""
    rows = texts.join_fuzzy_name(spark, SF).collect()
    assert {(r.name, r.suggestion) for r in rows if r.suggestion} == {("customer#000000000", "Customer#000000000"), ("Customer no. 000000100", "Customer#000000100")}
    assert sum(r.suggestion is None for r in rows) == 2


def test_names_meet_in_blocks(spark, monkeypatch):
    """join_fuzzy_name: the closest of all names that are much alike, over many small blocks; none of the registry is broadcast."""
    rng = random.Random(7)
    known = sorted({f"Name {rng.randrange(400):04d}{x}" for x in ["", "é", " ab", "ba", "x" * 70] for _ in range(60)})
    asked = [f"name {rng.randrange(400):04d}{x}" for x in ["", "e", "b a", "y" * 70] for _ in range(15)] + ["𝄞", "𝄞Name", " "]
    monkeypatch.setattr(likeness, "NAMES", 40)
    monkeypatch.setattr(likeness, "CELLS", 1 << 9)
    monkeypatch.setattr(text, "ASKED", 9)
    plans, write = [], text.written
    monkeypatch.setattr(text, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "n string")
    got = {r.n: r.suggestion for r in text.fuzzy_names(rows(asked), rows(known), name="n").collect()}
    best = lambda x: max((s for s in ((difflib.SequenceMatcher(None, k, x).ratio(), k) for k in known) if s[0] >= 0.6), default=(0, None))[1]
    assert got == {x: best(x) for x in asked}
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_characters_in_order_bound_the_ratio():
    """join_fuzzy_name: the longest common subsequence by bits is that of the plain table, and no ratio lies above it."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcé𝄞") for _ in range(n))

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            before, row = row, [0]
            for j, b in enumerate(y):
                row.append(before[j] + 1 if a == b else max(row[-1], before[j + 1]))
        return row[-1]

    known = [word(rng.randrange(90)) for _ in range(60)]
    code, ends = likeness._codes(known)
    for n in (1, 7, 62, 63):
        x = word(n)
        found = likeness._in_order(x, code, ends[:-1], np.diff(ends))
        assert found.tolist() == [plain(x, k) for k in known]
        assert all(difflib.SequenceMatcher(None, k, x).ratio() <= 2.0 * m / (len(x) + len(k)) for k, m in zip(known, found, strict=True))


def test_rows_that_are_told_are_those_of_a_plain_pass():
    """str_ttl: all items of a group at once, with what was told before, with times far apart and equal ones."""
    rng = random.Random(9)
    never = np.iinfo(np.int64).min
    for gap, span in ((1, 9), (10, 60), (10**15, 10**16)):
        rows = sorted((rng.randrange(12), rng.randrange(span)) for _ in range(200))
        last = np.array([never, *(rng.randrange(-span, span) for _ in range(13))])
        held, want = last.tolist(), []
        for n, (code, at) in enumerate(rows):
            if held[code] == never or at >= held[code] + gap:
                held[code] = at
                want.append(n)
        told, after = monitor.spaced_rows(*np.array(rows).T, last, gap)
        assert told.tolist() == want and after.tolist() == held
    assert monitor.spaced_rows(np.zeros(0, int), np.zeros(0, int), last, 5)[0].size == 0


def test_keys_are_told_in_groups(spark, tmp_path, monkeypatch):
    """str_ttl: many keys go to Python together, and what was told is known after a restart."""
    monkeypatch.setattr(monitor, "GROUPS", 2)
    told, t = [], lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)

    def poll(rows):
        spark.createDataFrame([(k, i, t(s)) for k, i, s in rows], "k string, i string, t timestamp").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, i string, t timestamp").parquet(f"{tmp_path}/in")
        run = monitor.write_once(monitor.told_in_groups(stream, key="k", item="i", time="t", seconds=100), lambda df, i: told.extend((r.key, r.item, int(r.told_at.timestamp() - t(0).timestamp())) for r in df.collect()), f"{tmp_path}/state")
        run.awaitTermination()
        out, told[:] = sorted(told, key=repr), []
        return out

    assert poll([("a", "x", 10), ("a", "x", 50), ("a", "y", 60), ("b", "x", 20), ("a", "x", 115), (None, "x", 30), ("c", None, 30)]) == sorted([("a", "x", 10), ("a", "x", 115), ("a", "y", 60), ("b", "x", 20), (None, "x", 30), ("c", None, 30)], key=repr)
    assert poll([("a", "x", 214), ("a", "y", 160), ("b", "z", 150), ("b", "x", 119), (None, "x", 129), ("c", None, 129)]) == [("a", "y", 160), ("b", "z", 150)]
    assert poll([("a", "x", 900), ("b", "x", 901), ("a", "x", 999), ("a", "y", 901)]) == [("a", "x", 900), ("a", "y", 901), ("b", "x", 901)]


def test_terms_are_looked_at_few_rows_at_a_time(monkeypatch):
    """ret_lsa: the weights of a large batch come in parts, which together are those of the whole."""
    lists = pa.array([["a", "b", "a"], [], None, ["c"], ["b", None, "b"]] * 3, pa.list_(pa.string()))
    places, idf = {"a": 0, "b": 1}, np.array([1.0, 2.0])
    monkeypatch.setattr(latent, "ROWS", 4)
    parts = list(latent.few_at_a_time([pa.RecordBatch.from_arrays([lists], ["terms"])]))
    assert [p.num_rows for p in parts] == [4, 4, 4, 3]
    row, at, v = (np.concatenate(x) for x in zip(*[(r + 4 * n, a, w) for n, p in enumerate(parts) for r, a, w in [latent._weights(p.column(0), places, idf)]], strict=True))
    rows = lambda r, a, w: sorted(zip(r.tolist(), a.tolist(), w.tolist(), strict=True))
    assert rows(row, at, v) == rows(*latent._weights(lists, places, idf))
