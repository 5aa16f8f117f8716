"""Jobs whose state the engine keeps: aggregation state, session windows, stream joins and keyed processors.

State lives in the engine's store (RocksDB), is checkpointed with the stream's position and goes when the watermark has
passed it. Results are appended once they are final. Nothing is rewritten per batch, and a restart continues from the
checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from argosift.streaming.jobs import WATERMARK, append_to, each_batch, event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def prepare_state(spark: SparkSession) -> None:
    """Settings for streams that are started from here on; a stream with a checkpoint keeps its own store."""
    spark.conf.set(_PROVIDER, _ROCKSDB)
    # A busy entity's rows become sessions where they are read; only these are shuffled.
    spark.conf.set(_LOCAL_SESSIONS, "true")


def stored(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """What a stream's aggregation holds now, one row per key, read from its checkpoint."""
    rows = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    return rows.select("key.*", "value.*")


def open_sessions(spark: SparkSession, checkpoint: str, keys: Sequence[str], gap: str = "5 minutes") -> DataFrame:
    """The sessions of :func:`sessions` that are not final yet, as (keys, started, ended, events)."""
    held = spark.read.format("statestore").load(checkpoint).select("value.*")
    ended = (F.col("session_window.end") - F.expr(f"interval {gap}")).cast("timestamp_ntz")
    return held.select(*keys, F.col("session_window.start").cast("timestamp_ntz").alias("started"), ended.alias("ended"),
                       F.col("count").alias("events"))


def open_matches(spark: SparkSession, checkpoint: str, keys: Sequence[str], tie: str = "event_id") -> DataFrame:
    """The later events of :func:`preceded_by` that are not final yet, with what they have met so far.

    Pairs reach the counts as soon as both sides are there; an event without any is still in the join's state.
    """
    met = stored(spark, checkpoint).select("at", tie, *keys, F.col("count").alias("matches"), F.col("max").alias("newest"))
    waiting = spark.read.format("statestore").option("operatorId", 1).option("joinSide", "left").load(checkpoint)
    alone = waiting.select("value.at", f"value.{tie}", *[f"value.{k}" for k in keys], F.lit(0).cast("long").alias("matches"),
                           F.lit(None).cast(met.schema["newest"].dataType).alias("newest"))
    both = met.unionByName(alone).groupBy("at", tie, *keys).agg(
        F.sum("matches").alias("matches"), F.max("newest").alias("newest"))
    return both.select(tie, *keys, "matches", F.col("newest.b_id").alias("nearest"))


def running_totals(df: DataFrame, keys: Sequence[str], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Counts per key over all batches, kept as aggregation state; read them with :func:`stored`."""
    prepare_state(df.sparkSession)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    return each_batch(totals, lambda batch, _: batch.write.format("noop").mode("append").save(), checkpoint, "update", every)


def window_totals(df: DataFrame, keys: Sequence[str], window: str, path: str, checkpoint: str,
                  every: str | None = None) -> StreamingQuery:
    """Counts per key and window, appended when a window closes; the state holds the open windows only."""
    prepare_state(df.sparkSession)
    totals = event_time(df).groupBy(F.window("at", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    flat = totals.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "events")
    return append_to(flat, path, checkpoint, every)


def sessions(df: DataFrame, keys: Sequence[str], path: str, checkpoint: str, gap: str = "5 minutes",
             every: str | None = None) -> StreamingQuery:
    """Bursts of one entity as (keys, started, ended, events), appended once no row can extend them."""
    prepare_state(df.sparkSession)
    grouped = event_time(df).groupBy(F.session_window("at", gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("events"))
    ended = (F.col("w.end") - F.expr(f"interval {gap}")).cast("timestamp_ntz")
    return append_to(grouped.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("started"), ended.alias("ended"),
                                    "events"), path, checkpoint, every)


def preceded_by(later: DataFrame, earlier: DataFrame, keys: Sequence[str], seconds: int, path: str, checkpoint: str,
                tie: str = "event_id", every: str | None = None) -> StreamingQuery:
    """For every ``later`` event: how many ``earlier`` events of its key lie at most ``seconds`` before it, and the newest.

    Both are streams. They are joined by key and time slot, so a busy key is dealt to as many tasks as it has slots; an
    earlier event is in its own slot and the next. The join's state goes once the watermark has passed what it may still
    meet; pairs are counted per later event, which is appended when it is final.
    """
    prepare_state(later.sparkSession)
    slot = F.floor(F.unix_micros("at") / F.lit(1_000_000 * int(seconds)))
    a = event_time(later).select(*keys, F.col("at"), F.col(tie), slot.alias("slot"))
    b = event_time(earlier).withColumnRenamed("at", "b_at").select(
        *[F.col(k).alias(f"b_{k}") for k in keys], "b_at", F.col(tie).alias("b_id"),
        F.explode(F.array(*[F.floor(F.unix_micros("b_at") / F.lit(1_000_000 * int(seconds))) + i for i in (0, 1)])).alias(
            "b_slot"))
    near = (F.col("b_at") <= F.col("at")) & (F.col("b_at") >= F.col("at") - F.expr(f"interval {int(seconds)} seconds"))
    same = F.col("slot") == F.col("b_slot")
    for k in keys:
        same = same & (F.col(k) == F.col(f"b_{k}"))
    counted = a.join(b, same & near, "left").groupBy("at", tie, *keys).agg(
        F.count("b_id").alias("matches"), F.max(F.struct("b_at", "b_id")).alias("_newest"))
    return append_to(counted.select(tie, *keys, "matches", F.col("_newest.b_id").alias("nearest")), path, checkpoint, every)


# --- snapshots ---------------------------------------------------------------------------------

class SnapshotChanges(StatefulProcessor):
    """Starts and ends between the snapshots of one host, for one bucket of its items.

    ``waiting`` maps the time of a snapshot that may still get rows to its items, ``last`` holds the items of the newest
    compared one and its time. A timer at the snapshot's time fires when the watermark has passed it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "items array<string>")
        self.last = handle.getValueState("last", "at long, items array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self.last.get()[0] if self.last.exists() else None
        found: dict[int, set[str]] = {}
        for part in rows:
            for at, items in part.groupby("ms")["item"]:
                found.setdefault(int(at), set()).update(i for i in items if i is not None)
        for at, items in found.items():
            if done is not None and at <= done:
                continue  # this snapshot was compared already
            if self.waiting.exists() and self.waiting.containsKey((at,)):
                items = items | set(self.waiting.getValue((at,))[0])
            else:
                self.handle.registerTimer(at)
            self.waiting.updateValue((at,), (sorted(items),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        ripe = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= at) if self.waiting.exists() else []
        for ms, items in ripe:
            now = set(items)
            if self.last.exists():
                before = set(self.last.get()[1])
                changes = [(i, "start") for i in sorted(now - before)] + [(i, "end") for i in sorted(before - now)]
                if changes:
                    yield pd.DataFrame({"host": [key[0]] * len(changes), "ms": [ms] * len(changes),
                                        "item": [c[0] for c in changes], "change": [c[1] for c in changes]})
            self.last.update((ms, sorted(now)))
            self.waiting.removeKey((ms,))

    def close(self) -> None:
        pass


def snapshot_changes(df: DataFrame, item: str, path: str, checkpoint: str, host: str = "host_id", ts: str = "snapshot_ts",
                     buckets: int = 16, every: str | None = None) -> StreamingQuery:
    """Start and end events between snapshots, appended once the watermark has passed the later snapshot.

    A host's items are dealt into ``buckets``, so a large host is not one task. Every bucket learns of every snapshot, as
    one without items has ended them all; these marks are made per batch of rows, not per row.
    """
    prepare_state(df.sparkSession)
    kind = df.schema[item].dataType
    rows = df.select(F.col(host).cast("string").alias("host"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"),
                     F.col(item).cast("string").alias("item"),
                     F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int").alias("bucket"))

    def marked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            marks = part[["host", "ms"]].drop_duplicates()
            yield pd.concat([part, *(marks.assign(item=None, bucket=b) for b in range(buckets))])[
                ["host", "ms", "item", "bucket"]]

    known = rows.where("host is not null and ms is not null").mapInPandas(
        marked, "host string, ms long, item string, bucket int")
    timed = known.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", WATERMARK)
    changes = timed.groupBy("host", "bucket").transformWithStateInPandas(
        SnapshotChanges(), "host string, ms long, item string, change string", "Append", "EventTime")
    return append_to(changes.select(
        F.col("host").alias(host), F.timestamp_millis("ms").cast("timestamp_ntz").alias(ts),
        F.col("item").cast(kind).alias(item), "change"), path, checkpoint, every)
