"""Incremental monitoring: seen items, baselines, late arrivals, quotas, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronofold.operators.asof import asof_backward
from chronofold.staging import written


def new_items(stream: DataFrame, *, keys: list[str], date: str | None = None) -> DataFrame:
    """Each unseen item once, however late; future-dated ones are left out.

    State holds every key that was ever seen, as lateness has no bound here.
    ``bounded_items`` forgets old keys instead.
    """
    rows = stream if date is None else stream.where(F.col(date) <= F.current_date())
    return rows.dropDuplicates(keys)


def bounded_items(stream: DataFrame, *, keys: list[str], time: str, late: str) -> DataFrame:
    """As ``new_items``, with state for no longer than ``late``; later arrivals are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


#: The store that keeps state outside the heap, and has lists, maps and timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_in_rocks(spark: SparkSession):
    """Streams that are started within use ``ROCKS``; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


class _Expiring(StatefulProcessor):
    """For each key the items that were told, and when; timers remove what has expired."""

    def __init__(self, item: str, time: str, seconds: int):
        self.item, self.time, self.seconds = item, time, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getMapState("told", "item string", "at long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf["_at"] = (pdf[self.time] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
        out, last, new = [], {}, {}  # each item is looked up once and written once, whatever comes of it in a batch
        for item, at in pdf.sort_values(["_at", self.item])[[self.item, "_at"]].itertuples(index=False):
            if item not in last:
                last[item] = self.told.getValue((item,))[0] if self.told.containsKey((item,)) else None
            if last[item] is not None and at < last[item] + 1000 * self.seconds:
                continue
            last[item] = new[item] = int(at)
            out.append((key[0], item, pd.Timestamp(int(at), unit="ms")))
        for item, at in new.items():
            self.told.updateValue((item,), (at,))
        for at in set(new.values()):
            self.handle.registerTimer(at + 1000 * self.seconds)
        yield pd.DataFrame(out, columns=["key", "item", "told_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (item,) in [k for k, (at,) in self.told.iterator() if at + 1000 * self.seconds <= now]:
            self.told.removeKey((item,))
        yield pd.DataFrame([], columns=["key", "item", "told_at"])

    def close(self) -> None:
        pass


def told_until_expiry(stream: DataFrame, *, key: str, item: str, time: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """Each item of a key when it first comes, and again when it comes ``seconds`` or more after it was last told.

    ``key`` and ``item`` are strings, ``time`` a timestamp in the session's zone
    (UTC): key, item, told_at.  State is one entry for each item told within
    ``seconds`` of the watermark; timers of event time remove older ones, which
    changes no row.  Rows that are later than ``late`` are dropped.  Start the
    stream with ``write_once``, or within ``state_in_rocks``.
    """
    rows = stream.select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(time).alias("time")).withWatermark("time", late)
    return rows.groupBy("key").transformWithStateInPandas(_Expiring("item", "time", seconds), "key string, item string, told_at timestamp", "Append", "EventTime")


#: Groups of keys that a batch is told in.
GROUPS = 1024


def spaced_rows(code: np.ndarray, at: np.ndarray, last: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are told of rows in order of (code, at): the first of a code at or after ``gap`` from what was told last, and so on.

    ``last`` has for each code from 0 on when it was told, or the least number
    if it never was.  A step goes through all codes at once, with a row for each
    that has more to tell.  Also returned: ``last`` after these rows.
    """
    last, told = last.copy(), []
    ends = np.searchsorted(code, np.arange(len(last) + 1))
    # a place in the order of (code, at) is found among codes and ranks of times, as both do not fit in one number
    times, rank = np.unique(at, return_inverse=True)
    place = code * (len(times) + 1) + rank
    never = np.iinfo(np.int64).min
    open_ = np.flatnonzero(ends[1:] > ends[:-1])
    while len(open_):
        due = np.where(last[open_] == never, never, last[open_] + gap)
        row = np.searchsorted(place, open_ * (len(times) + 1) + np.searchsorted(times, due))
        open_, row = (x[row < ends[open_ + 1]] for x in (open_, row))
        last[open_] = at[row]
        told.append(row)
    return np.sort(np.concatenate(told)) if told else np.zeros(0, int), last


def told_in_groups(stream: DataFrame, *, key: str, item: str, time: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """As ``told_until_expiry``, for many keys with few items each: keys are told in groups, so no key costs a call into Python.

    Times are read in milliseconds.  The state of a group is one row with an
    entry for each item told within ``seconds`` of the watermark, and is written
    whole; a timer removes older ones, which changes no row.
    """
    rows = stream.select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(time).alias("time")).withWatermark("time", late)
    gap, never = 1000 * seconds, np.iinfo(np.int64).min

    def tell(part, frames, state):
        held = pd.DataFrame(dict(zip(("key", "item", "at"), state.get if state.exists else ([], [], []), strict=True))).astype({"key": object, "item": object, "at": "int64"})
        new = pd.concat(list(frames), ignore_index=True) if not state.hasTimedOut else pd.DataFrame({"key": [], "item": [], "time": pd.Series([], dtype="datetime64[ns]")})
        at = ((new["time"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)).to_numpy("int64")
        (k, keys), (i, names) = (pd.factorize(np.concatenate([held[c].to_numpy(object), new[c].to_numpy(object)]), use_na_sentinel=False) for c in ("key", "item"))
        codes, items = pd.factorize(k * max(len(names), 1) + i)
        last = np.full(len(items), never)
        last[codes[: len(held)]] = held["at"]
        code = codes[len(held) :]
        order = np.lexsort((at, code))
        row, last = spaced_rows(code[order], at[order], last, gap)
        # at a watermark none of the rows to come is earlier
        mark = state.getCurrentWatermarkMs()
        kept = np.flatnonzero(last + gap > mark)
        if len(kept):
            plain = lambda values, at: [x if x == x else None for x in values[at]]
            state.update((plain(keys, items[kept] // len(names)), plain(names, items[kept] % len(names)), last[kept].tolist()))
            state.setTimeoutTimestamp(max(int(last[kept].min()) + gap, mark + 1))
        elif state.exists:
            state.remove()
        told = new.iloc[order[row]]
        yield pd.DataFrame({"key": told["key"], "item": told["item"], "told_at": pd.to_datetime(at[order[row]], unit="ms")})

    parts = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).groupBy("part")
    return parts.applyInPandasWithState(tell, "key string, item string, told_at timestamp", "keys array<string>, items array<string>, at array<long>", "append", "EventTimeTimeout")


def baseline_then_new(stream: DataFrame, *, key: str, item: str, group: str, order: str) -> DataFrame:
    """Per key: of the first batch the newest item of each group is reported and the rest kept silently; later, every unseen item.

    State is an entry for each item and one for each key, held by Spark's own
    ``dropDuplicates``, so a batch touches its own items only: a mark comes out
    of it when an item, or a key, is seen for the first time.  The batch's rows
    meet their marks in groups of many keys.  Start the stream with
    ``write_once``, or within ``state_in_rocks``.
    """
    rows = stream.select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(group).alias("group"), F.col(order).alias("order"))
    marks = rows.select("key", F.explode(F.array(F.struct(F.lit(1).alias("mark"), F.col("item").alias("item")), F.struct(F.lit(2).alias("mark"), F.lit(None).cast(stream.schema[item].dataType).alias("item")))).alias("m"))
    marks = marks.select("key", "m.item", "m.mark").dropDuplicates(["key", "item", "mark"])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def tell(table: pa.Table) -> pa.Table:
        # the earliest row of an item stands for it, the last row of a group is its newest
        pdf = table.sort_by([("order", "ascending"), ("item", "ascending")]).select(["key", "item", "group", "mark"]).to_pandas(integer_object_nulls=True)
        fresh = pdf[pdf["mark"] == 0].drop_duplicates(["key", "item"]).merge(pdf.loc[pdf["mark"] == 1, ["key", "item"]], on=["key", "item"])
        first = fresh["key"].isin(pdf.loc[pdf["mark"] == 2, "key"])
        newest = ~fresh.duplicated(["key", "group"], keep="last") & fresh["group"].notna()
        shown = fresh[~first | newest].assign(kind=first.map({True: "first", False: "new"}))
        return pa.Table.from_pandas(shown[["key", "item", "group", "kind"]], schema, preserve_index=False)

    schema = to_arrow_schema(rows.select("key", "item", "group").schema).append(pa.field("kind", pa.string()))
    both = rows.withColumn("mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    told = both.groupBy(F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("part")).applyInArrow(tell, f"key {types['key']}, item {types['item']}, `group` {types['group']}, kind string")
    return told.toDF(key, item, group, "kind")


def isolated(df: DataFrame, *, by: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the rows of each entity; an entity on which it fails gives its own rows back with what went wrong.

    Columns: ``by``, ``error`` (null if all is well), ``made`` (array of the
    rows of ``schema``) and ``items`` (array of the entity's rows, where it
    failed).  An entity's new rows go to one call together.
    """
    names = [f.name for f in df.schema.fields]
    made = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    kind = f"{by} {df.schema[by].dataType.simpleString()}, error string, made array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in df.sparkSession.createDataFrame([], schema).schema.fields)}>>, items array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in df.schema.fields)}>>"

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            row = (key[0], None, work(pdf)[made].to_dict("records"), None)
        except Exception as e:  # noqa: BLE001  whatever it is, it is this entity's
            row = (key[0], f"{type(e).__name__}: {e}", None, pdf[names].to_dict("records"))
        return pd.DataFrame([row], columns=[by, "error", "made", "items"])

    return df.groupBy(by).applyInPandas(one, kind)


class EntitiesFailed(RuntimeError):
    """Some entities failed; the others are written."""


def run_isolated(stream: DataFrame, *, by: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, folder: str) -> int:
    """All that is available, entity by entity: good ones are written to ``folder``/out, bad ones wait in ``folder``/failed.

    Each batch takes the rows that the batch before it has left in ``failed``
    along, so an entity is tried again with every batch, together with what is
    new of it, until it succeeds; then its rows come out once.  Tables are
    replaced by batch number, so a batch that breaks off starts again.  At the
    end the run fails with ``EntitiesFailed`` if any entity is still bad.
    Returns the number of the last batch.
    """
    spark = stream.sparkSession
    last = []

    def write(batch: DataFrame, ident: int) -> None:
        rows = batch if ident == 0 else batch.unionByName(spark.read.parquet(f"{folder}/failed/batch={ident - 1}").select(F.inline("items")))
        done = written(isolated(rows, by=by, work=work, schema=schema), "isolated")
        done.where("error IS NULL").select(F.inline("made")).write.mode("overwrite").parquet(f"{folder}/out/batch={ident}")
        done.where("error IS NOT NULL").select(by, "error", "items").write.mode("overwrite").parquet(f"{folder}/failed/batch={ident}")
        last.append(ident)

    write_once(stream, write, f"{folder}/state").awaitTermination()
    if not last:
        return -1
    bad = spark.read.parquet(f"{folder}/failed/batch={last[-1]}")
    if not bad.isEmpty():
        raise EntitiesFailed(f"{bad.count()} entities failed, such as {bad.orderBy(by).first()[:2]}")
    return last[-1]


def tumbling_quota(stream: DataFrame, *, time: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """Requests of each key in each window."""
    rows = stream if late is None else stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, width), key).agg(F.count("*").alias("used")).select(F.col("window.start").alias("start"), key, "used")


def admitted(df: DataFrame, *, time: str, key: str, seconds: int, limit: int, tie: str, second: Column | None = None) -> DataFrame:
    """Whether each request is among the first ``limit`` of its window.

    A window begins at a multiple of ``seconds``.  ``second`` tells the whole
    second of a request by another rule than cutting off its fraction.
    """
    bucket = F.floor((F.unix_timestamp(time) if second is None else second) / seconds)
    n = F.row_number().over(Window.partitionBy(key, bucket).orderBy(time, tie))
    return df.withColumn("admitted", n <= limit)


def cooldown(df: DataFrame, *, key: str, time: str, seconds: int) -> DataFrame:
    """Alerts that are sent: the first, then the first at least ``seconds`` after the last one sent.

    What is sent depends on what was sent before.  Each key's times pass in
    order, in batches, beside the one number that is remembered of them; a key
    may have any number of alerts.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.unix_timestamp(time).alias("at")).where("at IS NOT NULL")

    def run(batches):
        open_, last = None, None
        for pdf in batches:
            sent = []
            for k, t in zip(pdf["key"], pdf["at"], strict=True):
                if k != open_:
                    open_, last = k, None
                if last is None or t - last >= seconds:
                    last = t
                    sent.append((k, t))
            yield pd.DataFrame(sent, columns=["key", "sent_at"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "at")
    return ordered.mapInPandas(run, "key string, sent_at long").select(F.col("key").cast(df.schema[key].dataType).alias(key), "sent_at")


def cooldown_in_steps(df: DataFrame, *, key: str, time: str, seconds: int, spread: bool | None = None) -> DataFrame:
    """The same rows as ``cooldown`` without an ordered pass: keys may be as large as they like.

    Each time's successor is the first time at least ``seconds`` later, an as-of
    join.  What is sent is what following successors from a key's first time
    reaches.  Each round follows twice as many at once: from the 2**i times that
    are reached so far it jumps 2**i successors on, so a chain of n alerts takes
    log n rounds, each of them joins on (key, time).
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.unix_timestamp(time).alias("at")).where("at IS NOT NULL").distinct()
    rows = written(rows.select(F.coalesce("key", F.lit("")).alias("key"), F.col("key").isNull().alias("none"), "at"), "times")
    ahead = rows.withColumn("_k", F.struct("key", "none")).withColumn("_t", -(F.col("at") + seconds))
    there = rows.select(F.struct("key", "none").alias("_k"), (-F.col("at")).alias("_t"), F.col("at").alias("next"))
    jump = asof_backward(ahead, there, by="_k", left_time="_t", right_time="_t", values=["next"], strict=False, spread=spread).select("key", "none", "at", "next")
    jump = written(jump.where("next IS NOT NULL"), "successors")
    keys = ["key", "none"]
    reached = rows.groupBy(*keys).agg(F.min("at").alias("at"))
    while True:
        more = written(reached.join(jump, [*keys, "at"]).select(*keys, F.col("next").alias("at")), "reached")
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        twice = jump.select(*keys, F.col("at").alias("next"), F.col("next").alias("after"))
        jump = written(jump.join(twice, [*keys, "next"]).select(*keys, "at", F.col("after").alias("next")), "successors")
    return reached.select(F.when(~F.col("none"), F.col("key")).cast(df.schema[key].dataType).alias(key), F.col("at").alias("sent_at"))


def spaced(df: DataFrame, *, key: str, time: str, seconds: float, tie: str) -> DataFrame:
    """When each request of a key may go out if requests are ``seconds`` apart: in order, none before it came.

    The n-th request waits for all before it, so its time is the greatest of
    (time of the j-th + (n - j) * seconds) over all j up to n: a running maximum.
    """
    w = Window.partitionBy(key).orderBy(time, tie)
    n = F.row_number().over(w) - 1
    at = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    return df.withColumn("_n", n).withColumn("_free", at - F.col("_n") * seconds).withColumn("goes_at", F.max("_free").over(w) + F.col("_n") * seconds).drop("_n", "_free")


def previous_same(new: DataFrame, full: DataFrame, *, key: str, group: str, date: str, item: str) -> DataFrame:
    """Each new item with the latest strictly earlier one of its key and group in the full list.

    One union and one ordered window: both lists pass once, whatever a key holds.
    """
    old = full.groupBy(key, group, date).agg(F.max(item).alias("_i"))
    rows = new.select(key, group, date, item, F.lit(None).cast(full.schema[item].dataType).alias("_i")).unionByName(old.withColumn(item, F.lit(None).cast(new.schema[item].dataType)), allowMissingColumns=True)
    w = Window.partitionBy(key, group).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)
    best = rows.withColumn("previous", F.last("_i", ignorenulls=True).over(w)).where(F.col("_i").isNull()).select(key, group, date, item, "previous").distinct()
    return new.join(best, [key, group, date, item], "left")


def fan_out(events: DataFrame, followers: DataFrame, done: DataFrame | None, *, key: str, event: str, user: str) -> DataFrame:
    """(event, user) notifications that are not there yet, each once.

    Both sides lose their copies first, so an event of one key meets each of its
    users once; only events of several keys need a look at the pairs.
    """
    once, who = events.select(event, key).where(F.col(key).isNotNull()).distinct(), followers.select(key, user).distinct()
    keyed = once.groupBy(event).agg(F.collect_list(key).alias("_keys"))
    pairs = lambda of: of.select(event, F.explode("_keys").alias(key)).join(who, key).select(event, user)
    rows = pairs(keyed.where("size(_keys) = 1")).unionByName(pairs(keyed.where("size(_keys) > 1")).distinct())
    return rows if done is None else rows.join(done.select(event, user), [event, user], "left_anti")


def sessions(stream: DataFrame, *, time: str, key: str, gap: str) -> DataFrame:
    """Session windows; beyond what the batch operators need."""
    return stream.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def health(status: DataFrame, *, state: str, at: str, now, hours: int = 30, by: str | None = None, tie: str | None = None) -> DataFrame:
    """Healthy if the last run succeeded and is neither older than ``hours`` nor in the future, to the microsecond; for each ``by`` if given.

    Of runs at the same time the one with the smallest number ``tie`` counts, if
    given.  A run without a state or a time is not healthy; without any run
    there is no row for a ``by``, and overall the answer is no.
    """
    order = F.struct(F.col(at), -F.col(tie)) if tie else F.col(at)
    last = status.groupBy(*([by] if by else [])).agg(F.max_by(F.struct(F.col(state).alias("s"), F.col(at).cast("timestamp").alias("t")), order).alias("_l"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("_l.t")
    return last.select(*([by] if by else []), F.coalesce((F.col("_l.s") == "success") & age.between(0, hours * 3_600_000_000), F.lit(False)).alias("healthy"))


def write_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run a stream into ``write(batch, id)``: all that is available, or at an interval.

    A batch is done once its checkpoint is written, so after a failure ``write``
    sees the same id again and must replace what it wrote under it.  State is
    kept outside the heap.
    """
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with state_in_rocks(stream.sparkSession):
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
