"""State that expires, failures of single entities, a polled feed, spacing over tasks, members of archives, table functions."""

import datetime
import http.server
import json
import threading
import time
import urllib.parse
import zipfile

import pytest
from pyspark.sql import functions as F

from chronofold.sources import generators, origin
from chronofold.sources.members import ZipLines
from chronofold.streaming import monitor

T = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)


def test_state_expires_over_restarts(spark, tmp_path):
    """Three runs from one checkpoint: within the time an item is not told again, after it it is, and its state is gone."""
    told = []

    def poll(rows):
        spark.createDataFrame([(k, i, T(s)) for k, i, s in rows], "k string, i string, t timestamp").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, i string, t timestamp").parquet(f"{tmp_path}/in")
        with monitor.state_in_rocks(spark):
            run = monitor.write_once(monitor.told_until_expiry(stream, key="k", item="i", time="t", seconds=100), lambda df, i: told.extend((r.key, r.item, int(r.told_at.timestamp() - T(0).timestamp())) for r in df.collect()), f"{tmp_path}/state")
            run.awaitTermination()
        out, told[:] = sorted(told), []
        return out

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    assert poll([("a", "x", 10), ("a", "x", 50), ("a", "y", 60), ("b", "x", 20), ("a", "x", 115)]) == [("a", "x", 10), ("a", "x", 115), ("a", "y", 60), ("b", "x", 20)]
    assert poll([("a", "x", 214), ("a", "y", 160), ("b", "z", 150), ("b", "x", 119)]) == [("a", "y", 160), ("b", "z", 150)]
    assert poll([("a", "x", 900), ("b", "x", 901), ("a", "x", 999), ("a", "y", 901)]) == [("a", "x", 900), ("a", "y", 901), ("b", "x", 901)]
    poll([("c", "q", 5000)])
    left = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "told").load()
    assert {r[0] for r in left.select("key.key").collect()} == {"c"}, "what has expired is removed by timers"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_bad_entities_wait_and_good_ones_commit(spark, tmp_path):
    """Of many entities one fails: the others are written, the run fails at its end, and the next poll tries it again with all its rows."""
    repaired = tmp_path / "repaired"

    def work(pdf):
        if (pdf["k"] == 7).any() and not repaired.exists():
            raise KeyError("no such filing")
        return pdf.assign(n=len(pdf))

    def poll(rows):
        spark.createDataFrame(rows, "k long, v long").write.mode("append").parquet(f"{tmp_path}/in")
        return monitor.run_isolated(spark.readStream.schema("k long, v long").parquet(f"{tmp_path}/in"), by="k", work=work, schema="k long, v long, n long", folder=str(tmp_path))

    out = lambda: sorted(tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/out").select("k", "v", "n").collect())
    with pytest.raises(monitor.EntitiesFailed, match="1 entities failed, such as .*no such filing"):
        poll([(k, 1) for k in range(20)])
    good = [(k, 1, 1) for k in range(20) if k != 7]
    assert out() == good
    with pytest.raises(monitor.EntitiesFailed):
        poll([(3, 2), (7, 2)])
    assert out() == sorted([*good, (3, 2, 1)])
    repaired.touch()
    poll([(4, 3)])
    assert out() == sorted([*good, (3, 2, 1), (4, 3, 1), (7, 1, 2), (7, 2, 2)])
    assert spark.read.parquet(f"{tmp_path}/failed/batch=2").isEmpty()


@pytest.fixture
def server():
    """A paged origin; ``items`` may grow, and every request's time is kept."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.server.times.append(time.time())
            q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            start, size = int(q["start"][0]), int(q["size"][0])
            body = json.dumps({"total": len(self.server.items), "ids": self.server.items[start : start + size]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    made.items, made.times = [f"id{i}" for i in range(57)], []
    threading.Thread(target=made.serve_forever, daemon=True).start()
    made.url = f"http://127.0.0.1:{made.server_port}/?start={{start}}&size={{size}}"
    yield made
    made.shutdown()


def test_requests_of_all_tasks_are_spaced(spark, server):
    spark.dataSource.register(origin.PagedSearch)
    pages = spark.read.format("paged_search").option("url", server.url).option("size", 5).option("tasks", 4).option("every", 0.5).load()
    got = pages.select("page", F.spark_partition_id().alias("task"), "ids").collect()
    assert sorted(r.page for r in got) == list(range(12)) and len({r.task for r in got}) == 4
    assert [x for r in sorted(got) for x in r.ids] == server.items
    times = sorted(server.times)
    # they are sent at least 0.5 s apart; on a busy machine one may arrive late
    assert len(times) >= 13 and min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.35


def test_turns_of_many_tasks():
    """Without a real clock: turns of four tasks that begin whenever they like are at least the interval apart."""
    came = []
    for number, begins in ((0, 3.7), (1, 0.0), (2, 3.71), (3, 8.0)):
        now = [begins]
        turns = origin.Turns(1.0, number, 4, clock=lambda now=now: now[0], sleep=lambda x, now=now: now.__setitem__(0, now[0] + x))
        came += [turns.wait() for _ in range(5)]
    assert min(b - a for a, b in zip(sorted(came), sorted(came)[1:], strict=False)) >= 1.0
    assert origin.Turns(0).wait() > 0


def test_polled_feed(spark, server, tmp_path):
    """Three polls of a feed that grows; one breaks off after it has written, and nothing is lost or doubled."""
    spark.dataSource.register(origin.PolledFeed)

    def poll(broken=False):
        def write(df, ident):
            df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={ident}")
            if broken:
                raise RuntimeError("killed")

        stream = spark.readStream.format("polled_feed").option("url", server.url).option("size", 10).option("tasks", 3).load()
        run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start()
        try:
            run.awaitTermination()
        except Exception as e:  # noqa: BLE001
            if not broken:
                raise
            assert "killed" in str(e)
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("place", "id").collect())

    assert poll() == list(enumerate(server.items))
    server.items += [f"more{i}" for i in range(26)]
    assert poll(broken=True) == list(enumerate(server.items))
    server.items += ["last"]
    poll()  # the batch that broke off
    assert poll() == list(enumerate(server.items))
    assert poll() == list(enumerate(server.items))


def test_zip_members(spark, tmp_path):
    spark.dataSource.register(ZipLines)
    for a in range(2):
        with zipfile.ZipFile(f"{tmp_path}/{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("big.tsv", "\n".join(f"é{a}\t{i}" for i in range(50_000)))
            z.writestr("small.tsv", "one\r\ntwo\n")
            z.writestr("empty.tsv", "")
            z.writestr("note.md", "no")
    (tmp_path / "other.txt").write_text("no archive")
    df = spark.read.format("zip_lines").option("path", f"file://{tmp_path}").option("members", "*.tsv").load().withColumn("task", F.spark_partition_id())
    got = {(r.a, r.member): (r.n, r.tasks, r.first) for r in df.groupBy(F.element_at(F.split("archive", "/"), -1).alias("a"), "member").agg(F.count("*").alias("n"), F.collect_set("task").alias("tasks"), F.min_by("line", "number").alias("first")).collect()}
    assert {k: (n, first) for k, (n, _, first) in got.items()} == {(f"{a}.zip", m): x for a in range(2) for m, x in (("big.tsv", (50_000, f"é{a}\t0")), ("small.tsv", (2, "one")))}
    tasks = [t for _, t, _ in got.values()]
    assert all(len(t) == 1 for t in tasks) and len({t[0] for t in tasks}) == 4, "each member is one task's"
    one = spark.read.format("zip_lines").option("path", f"{tmp_path}/0.zip").option("members", "none*").load()
    assert one.collect() == []
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("zip_lines").option("path", f"{tmp_path}/none.zip").load().collect()


def test_table_functions(spark):
    generators.register_all(spark)
    lines = ["head|a|b|c|d", "----", "1|A|10-K|2020-01-01|f.txt", "short|line", None, " 2 |B|8-K|2020-01-02|g.txt"]
    spark.createDataFrame([(f, i, x) for f in "pq" for i, x in enumerate(lines)], "f string, n int, line string").repartition(3).createOrReplaceTempView("index_t")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM index_lines(TABLE(index_t) PARTITION BY f ORDER BY n)").collect())
    assert got == sorted([("1", "A", "10-K", "2020-01-01", "f.txt"), ("2", "B", "8-K", "2020-01-02", "g.txt")] * 2)
    lines = ["junk", "<DOCUMENT>", "<TYPE>10-K", "<FILENAME>a.txt", "<TEXT>", "one", "<TYPE>in the text", "</TEXT>", "</DOCUMENT>", "<DOCUMENT>", "<TYPE>EX-1", "</document>", "<DOCUMENT>", "<TEXT>", "cut off"]
    spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, n int, line string").repartition(3).createOrReplaceTempView("parts_t")
    got = sorted(tuple(r)[:4] for r in spark.sql("SELECT * FROM submission_parts(TABLE(parts_t) PARTITION BY k ORDER BY n)").collect())
    assert got == [(0, "10-K", "a.txt", 2), (1, "EX-1", None, 0)]
    spark.createDataFrame([(1, 0, "a b c"), (1, 1, "d e"), (1, 2, None), (1, 3, "f"), (1, 4, "g h i j k l"), (1, 5, " ")], "d int, number long, sentence string").createOrReplaceTempView("chunk_t")
    got = [tuple(r) for r in spark.sql("SELECT * FROM sentence_chunks(TABLE(chunk_t) PARTITION BY d ORDER BY (number), 5)").collect()]
    assert got == [(0, 0, 1, 5, "a b c d e"), (1, 3, 3, 1, "f"), (2, 4, 4, 6, "g h i j k l")]
