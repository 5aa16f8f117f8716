"""Jobs with engine-kept state: cuts, late rows, a hot key, eviction, restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from argosift.session import new_path
from argosift.streaming import jobs as J, state as S

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, host_id string, severity string"


def data(n=200):
    """Events in time order, two thirds of them of one host."""
    return [(i, T0 + timedelta(seconds=i * 47 + (i % 5) * 11), "h0" if i % 3 else "h1", "error" if i % 4 == 0 else "warning")
            for i in range(n)]


#: Moves the watermark past all others.
FLUSH = [(9_999, T0 + timedelta(days=3), "flush", "error"), (9_998, T0 + timedelta(days=3), "flush", "warning")]


def deliver(spark, parts, job):
    """Runs ``job`` after each delivery; every run is a restart from the checkpoint."""
    path = new_path(spark, "in")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        job(J.read_files(spark, path, spark.createDataFrame([], SCHEMA).schema))


def cut(rows, ends):
    return [rows[a:b] for a, b in zip([0, *ends], ends)]


def sessions_of(rows, gap):
    out = []
    for host in sorted({r[2] for r in rows}):
        for at in sorted(r[1] for r in rows if r[2] == host):
            if out and out[-1][0] == host and at - out[-1][2] < gap:
                out[-1] = (host, out[-1][1], at, out[-1][3] + 1)
            else:
                out.append((host, at, at, 1))
    return sorted(out)


@pytest.mark.parametrize("ends", [[202], [1, 60, 61, 202]], ids=["one", "uneven"])
def test_sessions(spark, ends):
    out, cp = new_path(spark, "out"), new_path(spark, "cp")
    deliver(spark, cut(data() + FLUSH, ends), lambda ev: S.sessions(ev, ["host_id"], out, cp, "90 seconds"))
    got = spark.read.parquet(out).where("host_id <> 'flush'")
    assert sorted(tuple(r) for r in got.collect()) == sessions_of(data(), timedelta(seconds=90))
    held = spark.read.format("statestore").load(cp)
    assert held.count() <= 2  # the closed sessions have left the state


def test_a_late_row_does_not_reopen_a_session(spark):
    out, cp = new_path(spark, "out"), new_path(spark, "cp")
    first = [(1, T0, "a", "error"), (2, T0 + timedelta(hours=2), "b", "error")]
    late = [(3, T0 + timedelta(seconds=5), "a", "error"), *FLUSH]
    deliver(spark, [first, late], lambda ev: S.sessions(ev, ["host_id"], out, cp, "1 minute"))
    got = spark.read.parquet(out).where("host_id <> 'flush'").select("host_id", "events").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("ends", [[202], [3, 150, 202]], ids=["one", "uneven"])
def test_pairs(spark, ends):
    out, cp = new_path(spark, "out"), new_path(spark, "cp")
    deliver(spark, cut(data() + FLUSH, ends), lambda ev: S.preceded_by(
        ev.where("severity = 'error'"), ev.where("severity = 'warning'"), ["host_id"], 120, out, cp))
    want = []
    for i, at, host, kind in data():
        if kind == "error":
            near = [(t, j) for j, t, h, k in data() if k == "warning" and h == host
                    and timedelta(0) <= at - t <= timedelta(seconds=120)]
            want.append((i, host, len(near), max(near)[1] if near else None))
    got = spark.read.parquet(out).where("host_id <> 'flush'").select("event_id", "host_id", "matches", "nearest")
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("ends", [[200], [3, 150, 200]], ids=["one", "uneven"])
def test_open_sessions_are_held(spark, ends):
    out, cp = new_path(spark, "out"), new_path(spark, "cp")
    deliver(spark, cut(data(), ends), lambda ev: S.sessions(ev, ["host_id"], out, cp, "90 seconds"))
    held = S.open_sessions(spark, cp, ["host_id"], "90 seconds")
    assert held.count() > 1
    got = spark.read.parquet(out).unionByName(held)
    assert sorted(tuple(r) for r in got.collect()) == sessions_of(data(), timedelta(seconds=90))


@pytest.mark.parametrize("seconds", [20, 120])
@pytest.mark.parametrize("ends", [[200], [3, 150, 200]], ids=["one", "uneven"])
def test_open_pairs_are_held(spark, ends, seconds):
    out, cp = new_path(spark, "out"), new_path(spark, "cp")
    deliver(spark, cut(data(), ends), lambda ev: S.preceded_by(
        ev.where("severity = 'error'"), ev.where("severity = 'warning'"), ["host_id"], seconds, out, cp))
    want = []
    for i, at, host, kind in data():
        if kind == "error":
            near = [(t, j) for j, t, h, k in data() if k == "warning" and h == host
                    and timedelta(0) <= at - t <= timedelta(seconds=seconds)]
            want.append((i, host, len(near), max(near)[1] if near else None))
    assert any(w[2] == 0 for w in want[-5:]) or seconds > 20
    held = S.open_matches(spark, cp, ["host_id"])
    assert held.count() > 1
    got = spark.read.parquet(out).select("event_id", "host_id", "matches", "nearest").unionByName(held)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_totals_and_eviction(spark):
    cp = new_path(spark, "cp")
    deliver(spark, cut(data(), [50, 120, 200]), lambda ev: S.running_totals(ev, ["host_id"], cp))
    got = {r["host_id"]: r["count"] for r in S.stored(spark, cp).collect()}
    assert got == {"h0": sum(r[2] == "h0" for r in data()), "h1": sum(r[2] == "h1" for r in data())}
    out, cp = new_path(spark, "out"), new_path(spark, "cp")
    deliver(spark, cut(data(), [50, 120, 200]), lambda ev: S.window_totals(ev, ["host_id"], "10 minutes", out, cp))
    limit = max(r[1] for r in data()) - timedelta(minutes=10)
    held = S.stored(spark, cp)
    assert held.count() and held.where(F.col("window.end").cast("timestamp_ntz") <= F.lit(limit)).count() == 0
    assert spark.read.parquet(out).agg(F.sum("events")).first()[0] + held.agg(F.sum("count")).first()[0] == 200


def snapshots():
    """Processes of two hosts at five times; h2 has no process at all at the third."""
    rows = []
    for k in range(5):
        for host, pids in (("h1", {1, 2, 10 + k}), ("h2", set() if k == 2 else {5, 6 + k % 2})):
            rows += [(p, T0 + timedelta(hours=k), host, "x") for p in sorted(pids)]
        rows.append((None, T0 + timedelta(hours=k), "h2", "x"))  # the snapshot was taken
    return rows


def changes(rows):
    out = []
    for host in ("h1", "h2"):
        times = sorted({r[1] for r in rows if r[2] == host})
        for a, b in zip(times, times[1:]):
            x, y = ({r[0] for r in rows if r[1] == t and r[2] == host and r[0] is not None} for t in (a, b))
            out += [(host, b, p, "start") for p in y - x] + [(host, b, p, "end") for p in x - y]
    return sorted(out)


@pytest.mark.parametrize("ends", [[100], [4, 5, 11, 100]], ids=["one", "uneven"])
def test_snapshot_changes(spark, ends):
    out, cp = new_path(spark, "out"), new_path(spark, "cp")
    flush = [(1, T0 + timedelta(days=3), "flush", "x")]
    deliver(spark, cut(snapshots() + flush, ends), lambda ev: S.snapshot_changes(
        ev.select("host_id", F.col("ts").alias("snapshot_ts"), F.col("event_id").alias("pid")), "pid", out, cp, buckets=3))
    got = spark.read.parquet(out).select("host_id", "snapshot_ts", "pid", "change")
    assert sorted(map(tuple, got.collect())) == changes(snapshots())


def test_stream_on_a_clock_goes_on(spark):
    path, out, cp = (new_path(spark, n) for n in ("clock", "out", "cp"))
    spark.createDataFrame(data(10), SCHEMA).write.parquet(path)
    query = J.append_to(J.read_files(spark, path, spark.createDataFrame([], SCHEMA).schema), out, cp, every="1 second")
    try:
        query.processAllAvailable()
        spark.createDataFrame(data(30)[10:], SCHEMA).write.mode("append").parquet(path)
        query.processAllAvailable()
        assert query.isActive and spark.read.parquet(out).count() == 30
    finally:
        query.stop()
