"""Structured Streaming jobs: ingest, windows and table-backed state.

Stateless and windowed jobs are ordinary streaming plans; sessions, joins, totals and
snapshots, whose state the engine keeps, are in ``state``. State that must follow
event order over a whole key (moving averages, hash chains) lives in versioned tables
updated by ``foreachBatch``: each micro-batch is summarised with the parallel batch
operators, so a hot key does not become one serial task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from argosift import constants as C
from argosift.functions import net as NET, severity as S
from argosift.operators import (anomaly as AN, audit as A, baseline as B, detect as D, mountain as M, parse as L,
                                reconcile as RC)
from argosift.session import cut, new_path
from argosift.sources.tables import table_exists

WATERMARK = "10 minutes"


# --- sources and sinks ---------------------------------------------------------------------

def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None,
               files_per_batch: int | None = None) -> DataFrame:
    """Files that appear in a folder; the checkpoint remembers which were read."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def event_time(df: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Adds the watermarked time column ``at``; later rows than the delay allows are dropped."""
    return df.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay)


def _started(writer: DataStreamWriter, every: str | None) -> StreamingQuery:
    """Starts a stream: over everything available, to its end, or on a clock, left running."""
    if every is not None:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs a stream over everything available and appends its rows to a table; with ``every``, goes on at that interval."""
    return _started(df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                    .outputMode("append"), every)


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
               every: str | None = None) -> StreamingQuery:
    """Runs ``fn(batch, batch_id)`` over everything available; with ``every``, goes on at that interval."""
    return _started(df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode), every)


def run_to_table(df: DataFrame, label: str) -> DataFrame:
    """Result of an append stream as a table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, label)
    append_to(df, path, new_path(spark, f"{label}-checkpoint"))
    return spark.read.schema(df.schema).parquet(path) if table_exists(spark, path) else spark.createDataFrame(
        [], df.schema)


class VersionedTable:
    """A small state table kept as one folder per batch; a repeated batch rewrites its own folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, version: int) -> str:
        return f"{self.path}/v{version:012d}"

    def before(self, version: int) -> DataFrame | None:
        """State left by the newest batch before ``version``."""
        names = [v for v in self.versions() if v < version]
        return self.spark.read.parquet(self._at(max(names))) if names else None

    def latest(self) -> DataFrame | None:
        names = self.versions()
        return self.spark.read.parquet(self._at(max(names))) if names else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self._at(version))

    def remove(self, version: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(version))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return [int(n[1:]) for n in names if n.startswith("v") and fs.exists(done(f"{self.path}/{n}/_SUCCESS"))]


class BatchTable:
    """An append table whose rows are kept per batch, so a repeated batch replaces its rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, batch_id: int, *parts: str) -> None:
        df.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.path}/batch={batch_id}")

    def add(self, df: DataFrame, batch_id: int, *parts: str) -> None:
        """Adds rows to a batch of which a part is written."""
        df.write.mode("append").partitionBy(*parts).parquet(f"{self.path}/batch={batch_id}")

    def of(self, batch_id: int, like: DataFrame) -> DataFrame:
        """The rows of one batch, with the columns of ``like``."""
        rows = self.spark.read.schema(like.schema).parquet(f"{self.path}/batch={batch_id}")
        return rows.select(*like.columns)

    def remove(self, before: int) -> None:
        """Deletes the rows of batches older than ``before``."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) < before:
                fs.delete(s.getPath(), True)

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of earlier batches than ``before``."""
        rows = self.spark.read.parquet(self.path)
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


# --- stateless and windowed jobs -------------------------------------------------------------

def live_monitor(lines: DataFrame, line: str = "line", ts: str = "ts") -> DataFrame:
    """Parsed and triaged lines with an alert flag."""
    from argosift.functions import text as X
    parsed = L.parse_lines(lines, line, ts)
    hit = X.matches_any(F.col(line), [p for r in C.RULES for p in r.log_patterns])
    graded = parsed.withColumn("triage", S.triage_line(hit, S.text_score(F.col(line))))
    return graded.withColumn("alert", F.col("triage") == "threat")


def live_scores(rows: DataFrame, profile: DataFrame, source_type: str, features: Sequence[str],
                threshold: float = 0.6) -> DataFrame:
    """Feature rows of a stream scored against a stored profile.

    Statistical, pattern and business-hour scores look at one row each. Burst rates need a key's earlier rows and are
    left to the batch detector.
    """
    plain = rows.withColumn("events_per_minute", F.lit(None).cast("double"))
    return AN.detect(B.with_profile(plain, profile), source_type, features, threshold=threshold)


def rule_windows(df: DataFrame, kind: str, columns: Sequence[str], rules: Sequence[C.Rule], keys: Sequence[str],
                 window: str) -> DataFrame:
    """Hits per rule and key in event-time windows; a rule that needs several compares ``events`` with its minimum."""
    single = [replace(r, min_occurrences=1) for r in rules]
    hits = D.match_rules(df, kind, columns, single, keys)
    return window_counts(hits, [*keys, "rule_id"], window)


def deduplicate(df: DataFrame, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """First copy of each id within the watermark."""
    return event_time(df).dropDuplicatesWithinWatermark(list(keys)).drop("at")


class OpenAndClosed:
    """A result table whose rows can still change for a while.

    Rows that are final are appended batch by batch; the open ones are kept as a version of their own, so a batch
    costs what is open, not what was ever written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.closed, self.open = BatchTable(spark, f"{path}/closed"), VersionedTable(spark, f"{path}/open")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Stores ``rows``, which have a ``closed`` flag."""
        stored = cut(rows)
        self.closed.write(stored.where("closed"), batch_id)
        self.open.write(stored.where("not closed"), batch_id)

    def read(self) -> DataFrame:
        return self.closed.read().unionByName(self.open.latest())


def _closed(rows: DataFrame, newest: str, final: Column) -> DataFrame:
    """Adds ``closed``: whether ``final`` has passed the newest time by the watermark delay."""
    clock = rows.agg(F.max(newest).alias("_clock"))
    # One row.
    return rows.crossJoin(F.broadcast(clock)).withColumn(
        "closed", final <= F.col("_clock") - F.expr(f"interval {WATERMARK}")).drop("_clock")


def write_windows(counted: DataFrame, keys: Sequence[str], table: OpenAndClosed, checkpoint: str,
                  end: str = "window_end") -> None:
    """Keeps the rows of a window stream in a table keyed by ``keys``, open windows included."""
    names = list(keys)

    def step(batch: DataFrame, batch_id: int) -> None:
        old = table.open.before(batch_id)
        rows = batch if old is None else batch.unionByName(
            old.drop("closed").join(batch.select(*names), names, "left_anti"))
        table.write(_closed(rows, "last_seen", F.col(end)), batch_id)

    each_batch(counted, step, checkpoint, "update")


def window_counts(df: DataFrame, keys: Sequence[str], window: str, slide: str | None = None,
                  aggregates: Sequence[Column] = (), **counters: Column) -> DataFrame:
    """Event-time window counts, with the time of the newest event of each window."""
    slot = F.window("at", window, slide) if slide else F.window("at", window)
    out = event_time(df).groupBy(slot.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("events"), *[F.count_if(c).alias(n) for n, c in counters.items()], *aggregates,
        F.max("at").cast("timestamp_ntz").alias("last_seen"))
    rest = [c for c in out.columns if c not in ("w", *keys)]
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys, *rest)


def sequence_windows(df: DataFrame, keys: Sequence[str], window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding windows of authentication failures."""
    return window_counts(df.where(S.is_auth_failure(F.col("message"))), keys, window, slide)


def scan_windows(df: DataFrame, keys: Sequence[str], port: str, window: str = "1 minute",
                 slide: str = "30 seconds") -> DataFrame:
    """Sliding windows with the distinct ports that were connected to; a port number is at most 65535."""
    ports = F.size(F.collect_set(F.col(port))).cast("long").alias("ports")
    return window_counts(df, keys, window, slide, [ports])


def transfer_windows(df: DataFrame, keys: Sequence[str], sent: str, window: str = "5 minutes",
                     slide: str = "1 minute", address: str | None = None) -> DataFrame:
    """Sliding windows with the bytes sent.

    With ``address`` only rows to public addresses count, and ``destinations`` estimates how many there are. Addresses are
    unbounded, so a window's state is a sketch of fixed size that is merged; it is exact for small numbers and off by
    about 2 % beyond.
    """
    if address is None:
        return window_counts(df, keys, window, slide, [F.sum(sent).alias("bytes_sent")])
    public = df.where(~NET.is_private_ip(F.col(address)) & (F.coalesce(F.col(address), F.lit("")) != ""))
    return window_counts(public, keys, window, slide, [
        F.sum(sent).alias("bytes_sent"), F.hll_sketch_estimate(F.hll_sketch_agg(address, F.lit(12))).alias("destinations")])


def sequence_hits(rows: DataFrame, minimum: int = 5) -> DataFrame:
    """Windows of :func:`sequence_windows` with enough failures, with the confidence of the batch rule."""
    return rows.where(F.col("events") >= minimum).withColumn("confidence", F.least(0.5 + F.col("events") * 0.05, F.lit(0.95)))


def scan_hits(rows: DataFrame, minimum: int = 10) -> DataFrame:
    """Windows of :func:`scan_windows` with enough ports, with the confidence of the batch rule."""
    return rows.where(F.col("ports") >= minimum).withColumn("confidence", F.least(0.6 + F.col("ports") * 0.02, F.lit(0.95)))


def transfer_hits(rows: DataFrame, min_bytes: int = 100 * 1024 * 1024, min_destinations: int = 3) -> DataFrame:
    """Windows of :func:`transfer_windows` with enough bytes and destinations, with the confidence of the batch rule."""
    return rows.where((F.col("bytes_sent") > min_bytes) & (F.col("destinations") > min_destinations)).withColumn(
        "confidence", F.lit(0.7))


def split_late(df: DataFrame, on_time: BatchTable, late: BatchTable, clock: BatchTable, checkpoint: str, ts: str = "ts",
               delay: str = WATERMARK, every: str | None = None) -> StreamingQuery:
    """Keeps the rows that a watermark would drop: a row older than ``delay`` before the newest of earlier batches is late.

    ``clock`` holds one row per batch, so a repeated batch is judged as it was. Rows without a time are on time.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        newest = clock.read(before=batch_id).agg(F.max("newest")).first()[0] if batch_id else None
        limit = F.lit(newest) - F.expr(f"interval {delay}")
        is_late = F.coalesce(F.col(ts) < limit, F.lit(False)) if newest is not None else F.lit(False)
        on_time.write(batch.where(~is_late), batch_id)
        late.write(batch.where(is_late), batch_id)
        clock.write(batch.agg(F.max(ts).alias("newest")), batch_id)

    return each_batch(df, step, checkpoint, every=every)


# --- table-backed state -------------------------------------------------------------------------

def moving_baseline(df: DataFrame, features: Sequence[str], keys: Sequence[str], table: VersionedTable,
                    checkpoint: str, alpha: float = 0.1, ts: str = "ts", tie: str = "event_id",
                    seed_rows: int = 1000, segment_rows: int = 1000, levels: int = 3,
                    buffer: VersionedTable | None = None) -> None:
    """Moving-average profiles updated per batch; the result does not depend on how batches are cut.

    A key's first ``seed_rows`` rows give its starting statistics. Until it has them, and until the event time has
    passed a row by the watermark delay, rows wait in ``buffer``; what is applied is therefore in time order. Rows
    older than what was applied are dropped, as in the windowed jobs.
    """
    n, names = len(features), list(keys)
    waiting = buffer or VersionedTable(df.sparkSession, table.path + "-buffer")

    def step(batch: DataFrame, batch_id: int) -> None:
        old, kept = table.before(batch_id), waiting.before(batch_id)
        fresh = batch.select(*names, ts, tie, *features)
        if old is not None:
            applied = old.select(*names, F.col("applied_to").alias("_to"))
            fresh = fresh.join(applied, names, "left").where(F.col("_to").isNull() | (F.col(ts) > F.col("_to"))).drop("_to")
        rows = cut(fresh if kept is None else fresh.unionByName(kept))
        clock = rows.agg(F.max(ts).alias("_clock"))
        limit = F.col("_clock") - F.expr(f"interval {WATERMARK}")
        known = (rows.withColumn("_state", F.lit(False)) if old is None else
                 rows.join(old.select(*names, F.lit(True).alias("_state")), names, "left"))
        timed = known.crossJoin(F.broadcast(clock)).withColumn("_ripe", F.col(ts) <= limit).drop("_clock")
        ripe = timed.groupBy(*names).agg(F.count_if("_ripe").alias("_n"))
        marked = timed.join(ripe, names).withColumn(
            "_go", F.col("_ripe") & (F.coalesce("_state", F.lit(False)) | (F.col("_n") >= seed_rows)))
        ready = cut(marked.drop("_ripe", "_n"))
        waiting.write(ready.where("not _go").select(*rows.columns), batch_id)
        go = ready.where("_go")
        state = B.moving_state(go.where("not coalesce(_state, false)"), features, names, ts, tie, alpha, seed_rows,
                               segment_rows, levels)
        latest = go.groupBy(*names).agg(F.max(ts).alias("applied_to"))
        if old is not None:
            segs = B.segment_summaries(go.where("coalesce(_state, false)"), features, names, ts, tie, alpha, segment_rows)
            summary = B.compose_summaries(segs, names, segment_rows, levels)
            state = B.apply_summary(old.drop("applied_to"), summary, names, n, alpha).unionByName(state)
            before = old.select(*names, F.col("applied_to").alias("_before"))
            latest = before.join(latest, names, "full").select(
                *names, F.greatest("_before", "applied_to").alias("applied_to"))
        table.write(state.join(latest, names), batch_id)

    each_batch(df, step, checkpoint)


def append_chain(df: DataFrame, links: BatchTable, heads: VersionedTable, checkpoint: str, chain: str = "host_id",
                 record: str = "record_id", ts: str = "ts", segment_rows: int = A.SEGMENT_ROWS,
                 nodes: BatchTable | None = None) -> None:
    """Adds each batch's records to the hash chains, continuing from the stored heads.

    With ``nodes``, each chain's mountain range grows as well: its new nodes are stored by level, and the heads carry its
    peaks and root, worked out from the batch and the heads before it.

    Ids already linked are skipped. A record's id and time belong together, so links are stored by day and only
    the days of the batch are looked up; a batch costs its own size, not the length of the chains.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        old = heads.before(batch_id)
        dated = batch.withColumn("day", F.to_date(ts))
        new = dated.dropDuplicates([record])
        if old is not None:
            # One row per day in the batch.
            days = [r[0] for r in dated.select("day").distinct().collect()]
            # Only earlier batches: a repeated batch must not take its own rows for known.
            known = links.read(before=batch_id).where(F.col("day").isin(days)).select("day", record)
            new = new.join(known, ["day", record], "left_anti")
        # Which of the rows with one id is taken is settled here, as the numbering reads them several times.
        numbered = A.sequence(cut(new), chain, ts, record, old)
        linked = A.link_records(numbered, chain, record=record, segment_rows=segment_rows, heads=old, also=["day"]).where(
            F.col(record).isNotNull())
        links.write(linked, batch_id, "day")
        added = links.of(batch_id, linked)
        latest = A.last_links(added, chain)
        if nodes is not None:
            begun = False

            def store(part: DataFrame) -> DataFrame:
                nonlocal begun
                (nodes.add if begun else nodes.write)(part, batch_id, "level")
                begun = True
                return nodes.of(batch_id, part)

            _, grown = M.advance(old, added, chain, store=store)
            latest = latest.join(grown.select(chain, "peaks", "root"), chain)
        if old is not None:
            latest = latest.unionByName(old.join(latest.select(chain), chain, "left_anti"))
        heads.write(latest, batch_id)

    each_batch(df, step, checkpoint)


def periodic_audit(df: DataFrame, primary: Callable[[], DataFrame], backup: Callable[[], DataFrame],
                   known: Callable[[], DataFrame], reports: BatchTable, checkpoint: str,
                   every: str | None = None) -> StreamingQuery:
    """One audit of the stored primary table against the backup per trigger of ``df``, which is only the clock.

    The tables are those of :func:`reconcile.store` as (record_id, content_hash, day, bucket), ``known`` the backup's
    stored digests. A firing scans the primary table for its digests and joins the records of damaged ranges only.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        counts = RC.summary(primary(), backup(), RC.added(known()))
        rep = A.graded(counts).withColumn("batch_no", F.lit(batch_id).cast("long"))
        alert = (F.col("tampered") > 0) | (F.col("missing") > 0) | ~F.col("chain_valid")
        reports.write(rep.withColumn("alert", alert), batch_id)

    return each_batch(df, step, checkpoint, every=every)


def drop_versions(table: VersionedTable, keep: int = 2) -> None:
    """Retention: removes all but the newest ``keep`` versions of a state table."""
    for version in sorted(table.versions())[:-keep]:
        table.remove(version)


def drop_batches(table: BatchTable, before: int) -> None:
    """Retention: removes the rows of batches older than ``before``."""
    table.remove(before)
