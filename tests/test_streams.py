"""Streaming jobs: late rows, restarts, repeated batches, submissions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from argosift import schemas
from argosift.functions.hashing import content_hash
from argosift.operators import audit as A, baseline as B, reconcile as RC
from argosift.session import new_path
from argosift.sources import registry as R, tables as TB
from argosift.streaming import jobs as J

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, host_id string, source string, event_type string, severity string, " \
         "message string"


def rows(spark, items):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=m), h, "auth", "x", "info", msg)
                                  for i, m, h, msg in items], SCHEMA)


def schema_of(spark):
    return rows(spark, []).schema


def test_late_rows_are_dropped_and_state_moves_on(spark):
    path, out, cp = (new_path(spark, n) for n in ("late", "late-out", "late-cp"))

    table = J.OpenAndClosed(spark, out)

    def deliver(items):
        rows(spark, items).coalesce(1).write.mode("append").parquet(path)
        counted = J.window_counts(J.read_files(spark, path, schema_of(spark)), ["host_id"], "10 minutes")
        J.write_windows(counted, ["window_start", "host_id"], table, cp)

    deliver([(1, 1, "h", "a"), (2, 5, "h", "a"), (3, 70, "h", "a")])
    deliver([(4, 2, "h", "late"), (5, 65, "h", "in time"), (6, 200, "h", "a")])
    got = {str(r["window_start"])[11:16]: (r["events"], r["closed"]) for r in table.read().collect()}
    assert got == {"00:00": (2, True), "01:00": (1, True), "01:10": (1, True), "03:20": (1, False)}


def test_ingest_remembers_its_position(spark):
    path, out, cp = (new_path(spark, n) for n in ("in", "out", "cp"))
    for part in ([(1, 1, "h", "a")], [(2, 2, "h", "b"), (3, 3, "h", "c")]):
        rows(spark, part).write.mode("append").parquet(path)
        J.append_to(J.read_files(spark, path, schema_of(spark)), out, cp)
    assert sorted(r[0] for r in spark.read.parquet(out).select("event_id").collect()) == [1, 2, 3]


def test_duplicates_across_batches_are_dropped(spark):
    path, out, cp = (new_path(spark, n) for n in ("dup", "dup-out", "dup-cp"))
    for part in ([(1, 1, "h", "a"), (1, 1, "h", "a")], [(1, 1, "h", "a"), (2, 2, "h", "b")]):
        rows(spark, part).write.mode("append").parquet(path)
        J.append_to(J.deduplicate(J.read_files(spark, path, schema_of(spark))), out, cp)
    assert sorted(r[0] for r in spark.read.parquet(out).select("event_id").collect()) == [1, 2]


def test_repeated_batch_replaces_its_own_state(spark):
    state = J.VersionedTable(spark, new_path(spark, "state"))
    df = spark.createDataFrame([("a", 1)], "k string, n long")
    state.write(df, 0)
    state.write(df.withColumn("n", F.lit(5).cast("long")), 1)
    state.write(df.withColumn("n", F.lit(6).cast("long")), 1)
    assert state.before(1).collect()[0]["n"] == 1 and state.latest().collect()[0]["n"] == 6
    assert state.before(0) is None


def test_chain_append_verifies_and_skips_known_ids(spark):
    path, cp = new_path(spark, "chain"), new_path(spark, "chain-cp")
    links = J.BatchTable(spark, new_path(spark, "links"))
    heads = J.VersionedTable(spark, new_path(spark, "heads"))

    def deliver(items):
        rows(spark, items).write.mode("append").parquet(path)
        stream = J.read_files(spark, path, schema_of(spark)).select(
            F.col("event_id").alias("record_id"), "ts", "host_id", content_hash(F.col("message")).alias("content_hash"))
        J.append_chain(stream, links, heads, cp, segment_rows=4)

    deliver([(i, i, "h" if i % 3 else "g", f"m{i}") for i in range(1, 12)])
    deliver([(i, i, "h" if i % 3 else "g", f"m{i}") for i in range(9, 25)])
    stored = links.read()
    assert stored.count() == 24 and stored.select("record_id").distinct().count() == 24
    assert all(r["chain_valid"] for r in A.verify(stored).collect())
    seqs = sorted(r[0] for r in stored.where("host_id = 'h'").select("sequence_number").collect())
    assert seqs == list(range(1, len(seqs) + 1))


def test_stream_moving_baseline_equals_batch(spark):
    path, cp = new_path(spark, "ema"), new_path(spark, "ema-cp")
    state = J.VersionedTable(spark, new_path(spark, "ema-state"))
    data = [(i, T0 + timedelta(minutes=i), "log" if i % 4 else "net", float((i * 37) % 11)) for i in range(300)]
    make = (lambda part: spark.createDataFrame(part, "event_id long, ts timestamp_ntz, source_type string, x double"))
    for part in (data[:100], data[100:170], data[170:]):
        make(part).write.mode("append").parquet(path)
        J.moving_baseline(J.read_files(spark, path, make([]).schema), ["x"], ["source_type"], state, cp,
                          seed_rows=20, segment_rows=16)
    got = {r["source_type"]: (r["means"][0], r["variances"][0], r["sample_count"]) for r in state.latest().collect()}
    for key in ("log", "net"):
        mine = [r for r in data if r[2] == key and r[1] <= data[-1][1] - timedelta(minutes=10)]
        want = B.learn_moving(make(mine), ["x"], seed_rows=20).collect()[0]
        assert got[key][:2] == pytest.approx((want["mean"], want["variance"]), rel=1e-9) and got[key][2] == len(mine)


def test_submissions_and_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text(
        '{"event_id": "e1", "timestamp": "2024-01-01T00:00:01", "source": "api", "severity": "info", "raw_data": {"k": "1"}}\n')
    got = R.read_submissions(spark, str(tmp_path / "sub")).collect()[0]
    assert (got["event_id"], got["raw_data"], got["host_id"]) == ("e1", {"k": "1"}, None)
    out = J.run_to_table(J.read_files(spark, str(tmp_path / "sub"), schemas.SUBMISSION, "json").select("event_id"), "sub")
    assert [r[0] for r in out.collect()] == ["e1"]
    log = tmp_path / "x.log"
    log.write_bytes(b"first line\n\n  second \xff line\nthird")
    whole = R.read_text_file(spark, str(log))
    from argosift.operators.parse import split_lines
    lines = split_lines(whole, "path", "text", tail_lines=3).orderBy("line_no").collect()
    assert [r["blank"] for r in lines] == [True, False, False] and lines[2]["line"] == "third"
    assert R.read_lines(spark, str(log)).count() == 3


def test_dual_write_does_not_admit_out_of_band_rows(spark):
    primary, backup = new_path(spark, "p"), new_path(spark, "b")
    first = rows(spark, [(1, 1, "h", "a"), (2, 2, "h", "b")])
    TB.write_both(first, primary, backup, "one")
    rows(spark, [(99, 3, "h", "smuggled")]).withColumns({"content_hash": A.event_hash(), "day": F.to_date("ts")}).write.mode(
        "append").partitionBy("day").parquet(f"{primary}/batch=other")
    for _ in range(2):
        # The second time is a retry of the same batch.
        TB.write_both(rows(spark, [(2, 2, "h", "b"), (3, 4, "h", "c")]), primary, backup, "two")
    assert spark.read.parquet(primary).count() == 4
    assert sorted(r[0] for r in spark.read.parquet(backup).select("record_id").collect()) == [1, 2, 3]
    status = {r["record_id"]: r["status"] for r in A.compare(spark.read.parquet(primary), spark.read.parquet(backup)).collect()}
    assert status == {1: "valid", 2: "valid", 3: "valid", 99: "missing_in_backup"}


def test_source_config_keeps_enabled_sources_only():
    specs = R.parse_config({"max_entries_per_source": 5, "a": {"enabled": True, "sources": [
        {"name": "x", "path": "p"}, {"name": "y", "enabled": False}]}, "b": {"sources": [{"name": "z"}]}})
    assert [s.name for s in specs] == ["x"]


# --- the same data in other batches gives the same tables ---------------------------------------

def _data(spark):
    """200 events of two hosts, a warning or an error each, in time order."""
    make = [(i, T0 + timedelta(seconds=i * 47 + (i % 5) * 11), f"h{i % 7 % 2}", "auth", "x",
             "error" if i % 3 == 0 else "warning", f"m{i}") for i in range(200)]
    return make, spark.createDataFrame(make, SCHEMA).schema


CUTS = [[200], [1, 150, 200]]


def _deliver(spark, cuts, job, name):
    data, schema = _data(spark)
    path = new_path(spark, f"{name}-in")
    at = 0
    for end in cuts:
        spark.createDataFrame(data[at:end], schema).coalesce(1).write.mode("append").parquet(path)
        job(J.read_files(spark, path, schema))
        at = end


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("cuts", CUTS[1:], ids=["uneven"])
def test_batch_cuts_do_not_matter(spark, cuts):
    def windows(splits, label):
        table, cp = J.OpenAndClosed(spark, new_path(spark, "windows")), new_path(spark, "windows-cp")
        _deliver(spark, splits, lambda ev: J.write_windows(J.window_counts(ev, ["host_id"], "10 minutes", "5 minutes"),
                                                           ["window_start", "host_id"], table, cp), label)
        return _rows(table.read(), "window_start", "host_id", "events", "closed")

    one = windows(CUTS[0], "one")
    assert one == windows(cuts, "many") and sum(r[2] for r in one) == 400


@pytest.mark.parametrize("cuts", CUTS[1:], ids=["uneven"])
def test_batch_cuts_do_not_matter_for_state(spark, cuts):
    def state(splits, label):
        table, cp = J.VersionedTable(spark, new_path(spark, "base")), new_path(spark, "base-cp")
        _deliver(spark, splits, lambda ev: J.moving_baseline(
            ev.withColumn("x", (F.col("event_id") * 37 % 11).cast("double")), ["x"], ["host_id"], table, cp, seed_rows=15,
            segment_rows=8), "base" + label)
        return {r["host_id"]: (round(r["means"][0], 9), round(r["variances"][0], 9), r["sample_count"])
                for r in table.latest().collect()}

    assert state(CUTS[0], "one") == state(cuts, "many")


def test_audit_of_several_deliveries_raises_no_alarm(spark):
    primary, backup, known = (new_path(spark, n) for n in ("ap", "ab", "ad"))
    reports, cp = J.BatchTable(spark, new_path(spark, "ar")), new_path(spark, "ar-cp")
    data, schema = _data(spark)
    at = 0

    def job(ev):
        J.periodic_audit(ev, lambda: spark.read.parquet(primary).select(
            F.col("event_id").alias("record_id"), A.event_hash().alias("content_hash"), *RC.RANGE),
            lambda: spark.read.parquet(backup), lambda: spark.read.parquet(known), reports, cp)

    path = new_path(spark, "audit-in")
    for end in (90, 200):
        part = spark.createDataFrame(data[at:end], schema)
        RC.store(part, primary, str(end), "event_id")
        RC.store(part.select(F.col("event_id").alias("record_id"), "ts", A.event_hash().alias("content_hash")), backup,
                 str(end), digest_path=known)
        part.coalesce(1).write.mode("append").parquet(path)
        job(J.read_files(spark, path, schema))
        at = end
    got = sorted((r["batch_no"], r["valid"], r["missing"], r["alert"]) for r in reports.read().collect())
    assert got == [(0, 90, 0, False), (1, 200, 0, False)]


def test_retention_keeps_the_newest(spark):
    state, rows_ = J.VersionedTable(spark, new_path(spark, "ret")), J.BatchTable(spark, new_path(spark, "retb"))
    df = spark.createDataFrame([("a", 1)], "k string, n long")
    for i in range(4):
        state.write(df.withColumn("n", F.lit(i)), i)
        rows_.write(df, i)
    J.drop_versions(state)
    J.drop_batches(rows_, 2)
    assert sorted(state.versions()) == [2, 3] and state.latest().first()["n"] == 3 and rows_.read().count() == 2
