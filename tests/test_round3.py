"""What larger tables have shown: times at the edge of a second, cut-off references, and steps that grew faster than their rows."""

import csv
import datetime
import difflib
import io
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronofold.functions import text
from chronofold.operators import fanout, neighbours
from chronofold.operators import retrieval as r
from chronofold.plans import flows, inputs, relational
from chronofold.sources import filings
from chronofold.streaming import monitor


@pytest.fixture
def events(spark, tmp_path):
    """Makes an events table of (event_id, ts, user_id, event_type); returns its folder."""

    def make(rows):
        spark.createDataFrame([(i, datetime.datetime.fromisoformat(t), u, k) for i, t, u, k in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
        return str(tmp_path)

    return make


def test_reference_without_semicolon_stays():
    """fn_visible_text: SQL reads references with a semicolon only."""
    assert text.visible("<h1>a&&&amp</h1>b &lt c &amp;lt; &#65; &#66 &nosuch; &notit; &ampx;") == "a&&&amp\nb &lt c &lt; A &#66 &nosuch; &notit; &ampx;"


def test_day_of_the_last_half_second(spark, events):
    """str_admission: as in SQL, a time belongs to the day of its nearest second."""
    at = events([(1, "2024-01-01T23:59:59.400000", 1, "a"), (2, "2024-01-01T23:59:59.600000", 1, "a"), (3, "2024-01-02T00:00:00", 1, "a"), (4, "2024-01-02T00:00:01", 1, "a")])
    assert {r.event_id: r.admitted for r in flows.str_admission(spark, at).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_health_to_the_microsecond(spark, events):
    """str_health: a report from half a second after the time of asking is from the future; of equal times the first counts."""
    at = events([(1, "2024-01-30T18:00:00.500000", 1, "a"), (2, "2024-01-30T18:00:00", 2, "a"), (3, "2024-01-29T11:59:59.999999", 3, "a"), (4, "2024-01-30T17:00:00", 4, "error"), (5, "2024-01-30T17:00:00", 4, "a")])
    assert {r.user_id: r.healthy for r in flows.str_health(spark, at).collect()} == {1: False, 2: True, 3: False, 4: False}


@pytest.mark.parametrize("least", [None, 0.3])
def test_nearest_against_all_pairs(spark, monkeypatch, least):
    """ret_vector: the same rows as a join of all pairs, with copies, zero, short and missing vectors, and keys that are null; no task gives more than k rows for a query."""
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(150)]
    vectors += [list(vectors[3])] * 40 + [[0.0] * 6, [1.0, 2.0], None, [1.0, None, 0.0, 0.0, 0.0, 0.0]]
    rows = spark.createDataFrame([(i if i != 160 else None, v) for i, v in enumerate(vectors)], "i long, v array<float>").repartition(3).cache()
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(r, "QUERIES", 15)
    q = rows.where("i % 5 = 0 OR i > 188")
    pairs = q.select(F.col("i").alias("query"), F.col("v").alias("a")).crossJoin(rows.select(F.col("i").alias("key"), F.col("v").alias("b"))).select("query", "key", r.cosine(F.col("a"), F.col("b")).alias("similarity"))
    want = r.ranked(pairs if least is None else pairs.where(F.col("similarity") >= least), by="query", order=[F.desc(F.round("similarity", 6)), F.col("key")], k=7)
    found = r.nearest(q, rows, query="i", key="i", vector="v", k=7, least=least)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_meet_on_rare_characters(spark):
    """join_fuzzy_name: suggestions are those of all pairs by difflib, and a name without a likely partner meets none."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aabbcdé ") for _ in range(rng.randrange(9)))
    known = [word() for _ in range(150)] + ["Customer#0001", "Customer#0010", None, "x" * 40]
    asked = [word() for _ in range(80)] + known[:5] + ["customer#0001", "Zz 1 !!", "", None, "x" * 30, "Customer#0001"]
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "n string")
    pool = {x for x in known if x is not None}

    def best(x):
        scored = [] if x is None else [(difflib.SequenceMatcher(None, k, x).ratio(), k) for k in pool]
        return max((s for s in scored if s[0] >= 0.6), default=(0, None))[1]

    got = text.fuzzy_names(rows(asked), rows(known), name="n")
    assert sorted(map(repr, (tuple(x) for x in got.collect()))) == sorted(repr((x, best(x))) for x in asked)
    sent = []
    run = spark.sparkContext.broadcast
    spark.sparkContext.broadcast = lambda v: sent.append(v) or run(v)
    try:
        text.fuzzy_names(rows(["Zz 1 !!"]), rows(known), name="n").collect()
    finally:
        del spark.sparkContext.broadcast
    assert not sent, "no list of names goes through the driver"


def test_days_of_a_table_are_parsed_once(monkeypatch):
    """scan_html_table: a day that many rows tell is parsed once."""
    tried, parse = [], pd.to_datetime
    monkeypatch.setattr(pd, "to_datetime", lambda x, **kw: tried.append(x) or parse(x, **kw))
    row = "<tr><td>{}</td><td>{}</td><td></td></tr>"
    page = "<table><tr><th>Date</th><th>Added Ticker</th><th>Removed Ticker</th></tr>" + "".join(row.format(day, f"t{i}") for i, day in enumerate(["May 7, 2031", "none"] * 50)) + "</table>"
    assert filings.membership_changes(page, 0) == [(f"T{i}", datetime.date(2031, 5, 7), None, None) for i in range(0, 100, 2)]
    assert sorted(tried) == ["May 7, 2031", "none"]


def test_ownership_is_read_without_paths_in_the_jvm(spark):
    """scan_xml_tx, scan_xml_form4: each fragment is read once; prefixes, footnotes, data sections, blank and missing values."""
    tx = lambda s: f"<nonDerivativeTransaction>{s}</nonDerivativeTransaction>"
    xml = """<f:ownershipDocument xmlns:f="urn:y" xmlns:xsi="urn:z" xsi:schemaLocation="a b"><f:issuer><f:issuerCik>7</f:issuerCik></f:issuer>
<f:reportingOwner><f:reportingOwnerId><f:rptOwnerName> A &amp; B </f:rptOwnerName></f:reportingOwnerId><f:reportingOwnerRelationship><f:isDirector>1</f:isDirector></f:reportingOwnerRelationship></f:reportingOwner>
<f:reportingOwner><f:reportingOwnerId><f:rptOwnerCik>9</f:rptOwnerCik></f:reportingOwnerId></f:reportingOwner>""" + tx(
        "<securityTitle><value><![CDATA[Common <x>]]></value></securityTitle><transactionCoding><transactionCode xsi:nil='no'>P</transactionCode></transactionCoding>"
        "<transactionAmounts><transactionShares><value>5</value><footnoteId id='F1'/></transactionShares><transactionShares><value>6</value></transactionShares><transactionPricePerShare><value> </value></transactionPricePerShare></transactionAmounts>"
    ) + tx("<transactionDate><value>2020-01-0<b>2</b></value></transactionDate>") + "</f:ownershipDocument>"
    df = spark.createDataFrame([("7", xml)], "cik string, xml string")
    rows = filings.ownership_transactions(df, "xml", ["cik"], issuer="cik")
    assert [tuple(x) for x in rows.collect()] == [("7", 0, "Common <x>", None, "P", 5.0, None, None, "purchase"), ("7", 1, None, "2020-01-02", None, None, None, None, "other")]
    told = filings.ownership_documents(df, "xml", ["cik"])
    assert [tuple(x)[:7] for x in told.collect()] == [("7", None, "A & B", True, False, None, False)] * 2
    assert "xpath" not in told._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_fan_out_are_not_made_distinct(spark):
    """str_fanout_notify: copies go before the join; of an event with several keys each user is told once."""
    events = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (4, "z")], "e long, k string")
    users = spark.createDataFrame([("a", 10), ("a", 10), ("b", 10), ("b", 11), (None, 12)], "k string, u long")
    got = monitor.fan_out(events, users, None, key="k", event="e", user="u")
    assert sorted(map(tuple, got.collect())) == [(1, 10), (2, 10), (2, 11)]
    assert "Aggregate [" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.startswith("Union"), "the pairs of events with one key pass as they are"


class _Counted:
    """A map or value in state that counts what it is asked."""

    def __init__(self):
        self.kept, self.asked = {}, 0

    def containsKey(self, k):
        self.asked += 1
        return k in self.kept

    def getValue(self, k):
        self.asked += 1
        return self.kept[k]

    def updateValue(self, k, v):
        self.asked += 1
        self.kept[k] = v

    def exists(self):
        return bool(self.kept)

    def update(self, v):
        self.kept[0] = v


def test_expiring_state_is_asked_once_for_each_item():
    """str_ttl: a batch with many rows of one item looks it up once and writes it once."""
    p, timers = monitor._Expiring("item", "time", 10), []
    p.told, p.handle = _Counted(), type("H", (), {"registerTimer": lambda self, at: timers.append(at)})()
    rows = lambda seconds: iter([pd.DataFrame({"item": "x", "time": [pd.Timestamp(s, unit="s") for s in seconds]})])
    told = lambda seconds: [t.second for t in pd.concat(list(p.handleInputRows(("k",), rows(seconds), None)))["told_at"]]
    assert told(range(25)) == [0, 10, 20] and p.told.asked == 2 and timers == [30_000]
    assert told([25, 29, 30, 41]) == [30, 41] and p.told.asked == 5 and timers == [30_000, 51_000]


def test_latent_axes_take_few_passes(spark):
    """ret_lsa, ret_hybrid_latent: the fit goes through the rows once for a block of directions, not once for each; the axes stay those of a plain decomposition."""
    import numpy as np

    from chronofold.operators import latent

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice([f"w{(i % 9) * 20 + j:03d}" for j in range(60)]) for _ in range(40))) for i in range(400)]
    terms = latent.with_terms(spark.createDataFrame(rows, "key long, text string"), key="key", text="text")
    spark.sparkContext.setJobGroup("fit", "fit")
    space = latent.fit_space(terms, 200, 24)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 40
    m = np.zeros((len(rows), 200))
    for i, t in terms.collect():
        for x in set(t) & set(space.places):
            m[i, space.places[x]] = (1 + np.log(t.count(x))) * space.idf[space.places[x]]
    want = np.linalg.svd(m / np.linalg.norm(m, axis=1, keepdims=True))[2][:24].T
    assert np.allclose(space.axes @ space.axes.T, want @ want.T, atol=1e-6)


def test_scores_are_not_shuffled_pair_by_pair(spark, monkeypatch):
    """ret_hybrid_rrf, ret_eval, feat_rag_sentiment: a task gives the best rows of each query; pairs of query and row are not shuffled. Ties go by key, in blocks of queries too."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(12)]) for _ in range(1 + i % 9))) for i in range(200)] + [(500 + i, "w1 w2 w3") for i in range(50)] + [(600, None), (601, "")]
    docs = spark.createDataFrame(rows, "key long, text string").repartition(5)
    asked = spark.createDataFrame([(i, [f"w{i}", f"w{(i + 1) % 12}", "none"]) for i in range(12)] + [(50, []), (51, ["none"])], "query long, terms array<string>")
    index = r.question_index(docs, asked, key="key", text="text")
    told = lambda df: sorted((x.query, x["rank"], x.key, round(x.score, 9)) for x in df.collect())
    want = told(r.bm25(asked, tuple(index), k=7))
    got = r.bm25(asked, index, k=7)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 1
    assert told(got) == want and len(want) == 12 * 7
    odd = lambda s: s.where("key % 2 = 1")
    assert told(r.bm25(asked, index, k=7, keep=odd)) == told(r.bm25(asked, tuple(index), k=7, keep=odd))
    monkeypatch.setattr(r, "CELLS", 30)
    assert told(r.bm25(asked, index, k=7)) == want


def test_quotes_meet_on_a_word(spark):
    """ret_eval: texts and items meet on a word, not each text with each item; what is found is what contains finds."""
    items = [(1, "alpha, beta gamma"), (2, "pha beta gam"), (3, "one two"), (4, "-"), (5, None), (6, ""), (7, "x É beta. y z")]
    texts = ["alpha, beta gamma", "ALPHA, BETA GAMMA", "so alpha, beta gammas", "alphabeta gamma", "alpha beta gamma", "none two", "a-b", "", None, "x É beta. y zz", "beta"]
    rows, asked = spark.createDataFrame(list(enumerate(texts)), "key long, text string"), spark.createDataFrame(items, "query long, t string")
    got = r.quoting(rows, asked, key="key", text="text", query="query", said="t")
    want = sorted((i, k) for i, t in items for k, x in enumerate(texts) if t is not None and x is not None and t in x)
    assert sorted((x.query, x.key) for x in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_petitions_come_in_pieces(spark):
    """fn_petition_extract: texts stay in Arrow batches, of which few at a time are made strings; no whole batch becomes a series."""
    df = spark.createDataFrame([(i, "On March 1, 2020, Acme Inc. filed a voluntary petition under chapter 11. " * (i % 3), datetime.date(2020, 3, 15)) for i in range(500)] + [(500, None, None)], "i long, t string, filed date").withColumn("names", F.array(F.lit("Acme, Incorporated")))
    got = text.petitions(df, text="t", filed="filed", names="names")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan
    assert {x.i for x in got.collect()} == {i for i in range(500) if i % 3}


def test_phrases_by_matrices_and_by_joins(spark, monkeypatch):
    """ret_hybrid_rrf: the two ways to the list over two-word terms agree."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["red", "green", "blue", "old"]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(1 + i % 7)) for i in range(60)] + [(60, None)], "key long, text string")
    asked = spark.createDataFrame([(i, say(4)) for i in range(5)] + [(9, "red")], "query long, text string")
    told = lambda: sorted((x.query, x["rank"], x.key, round(x.score, 9)) for x in r.phrase_list(asked, docs, query="query", key="key", text="text", k=4).collect())
    got = told()
    monkeypatch.setattr(r, "PHRASES", 1)
    assert got == told() and got


def test_fanout_of_one_nation_is_spread(spark, tmp_path, monkeypatch):
    """join_left_fanout: no task holds a nation, lists of suppliers are cut, and nulls and unmatched rows stay."""
    monkeypatch.setattr(fanout, "LISTED", 8)
    spark.createDataFrame([*[(i, 1) for i in range(40)], (40, 2), (41, None)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(100 + i, i, "P") for i in range(20)] + [(200, 0, "P"), (201, 1, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([*[(i, 1) for i in range(30)], (None, 1), (99, None), (98, 3)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = relational.join_left_fanout(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    orders = [(i, 100 + i if i < 20 else None) for i in range(40)] + [(0, 200)]
    want = [(c, o, s) for c, o in orders for s in [*range(30), None]] + [(40, None, None), (41, None, None)]
    assert sorted((tuple(r)[:3] for r in rows), key=repr) == sorted(want, key=repr)
    tasks = [r.task for r in rows]
    assert max(tasks.count(t) for t in set(tasks)) < len(rows) / 2


def test_baseline_state_is_sparks_own(spark, tmp_path):
    """str_baseline: no item or key costs a call into Python; a batch adds its own new items and keys to the state, and copies and groups that are null do no harm."""
    schema, told = "k string, i long, g string, d date", []

    def poll(rows):
        spark.createDataFrame([(k, i, g, datetime.date(2024, 1, d)) for k, i, g, d in rows], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = monitor.write_once(monitor.baseline_then_new(stream, key="k", item="i", group="g", order="d"), lambda df, _: told.extend(tuple(r) for r in df.collect()), f"{tmp_path}/state")
        run.awaitTermination()
        state = run.recentProgress[0]["stateOperators"]
        out, told[:] = sorted(told), []
        return out, [(s["operatorName"], s["numRowsUpdated"]) for s in state]

    many = [(f"m{n}", n, "a", 1) for n in range(300)]
    out, state = poll([*many, ("x", 1, "a", 1), ("x", 2, "a", 5), ("x", 2, "b", 9), ("x", 3, "b", 2), ("x", 4, None, 7), ("y", 9, "a", 3), ("y", 8, "a", 3)])
    assert out == sorted([*[(k, i, g, "first") for k, i, g, _ in many], ("x", 2, "a", "first"), ("x", 3, "b", "first"), ("y", 9, "a", "first")])
    assert state == [("dedupe", 2 * 300 + 6 + 2)]
    out, state = poll([("x", 1, "a", 30), ("x", 7, "a", 1), ("x", 7, "a", 2), ("x", 6, None, 2), ("z", 1, "b", 4)])
    assert out == [("x", 6, None, "new"), ("x", 7, "a", "new"), ("z", 1, "b", "first")]
    assert state == [("dedupe", 4)]


def test_archives_are_made_once(spark, monkeypatch):
    """scan_tsv_zip: both members are read from archives that were made once."""
    made, packed = [], inputs._archives
    count = spark.sparkContext.accumulator(0)

    def counted(rows, members):
        def one(pdf):
            count.add(1)
            return pdf

        files = packed(rows, members)
        made.append(files.count())
        return files.mapInPandas(lambda batches: (one(b) for b in batches for b in (b.iloc[i : i + 1] for i in range(len(b)))), files.schema)

    monkeypatch.setattr(inputs, "_archives", counted)
    inputs.scan_tsv_zip(spark, "/root/testdata/sf0.001").collect()
    assert count.value == made[0] > 0


def test_members_are_read_as_by_names(spark):
    """archive_table: short and blank lines, equal names, quotes and columns that a header lacks, as a reader by names gives them."""
    text_ = 'a\tb\tb\tc\n1\t2\t3\t4\n5\n\n"x\ty"\t6" z\t\t8\t9\n7\tk\tl\n'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("t.txt", text_)
        z.writestr("none.txt", "")
    files = spark.createDataFrame([("p", bytearray(data.getvalue()))], "path string, content binary")
    columns = ["b", "a", "nosuch", "c"]
    lines = csv.DictReader(io.StringIO(text_, newline=""), delimiter="\t")
    want = [(*[row.get(c) or None for c in columns], ["a", "b", "b", "c"]) for row in lines]
    assert len(want) == 4 and [tuple(r) for r in filings.archive_table(files, "t.txt", columns).collect()] == want
    assert [tuple(r) for r in filings.archive_table(files, "t.txt", columns, only={"a": ["5", "7"]}).collect()] == [w for w in want if w[1] in ("5", "7")]
    assert filings.archive_table(files, "none.txt", columns).isEmpty()
