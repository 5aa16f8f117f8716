"""Bloom filters of a history, canonical payloads, late rows, thresholds of live sequences."""

import glob
import json
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from argosift.functions import hashing as H
from argosift.operators import membership as M
from argosift.session import new_path
from argosift.streaming import jobs as J


def ids(spark, values):
    return spark.createDataFrame([(i, date(2024, 1, 1 + i % 3)) for i in values], "record_id long, day date")


def test_filters_never_miss_and_rarely_err(spark):
    filters = M.build(ids(spark, range(0, 20_000, 2)))
    held = {r[0] for r in M.may_hold(ids(spark, range(20_000)), filters).collect()}
    assert held >= set(range(0, 20_000, 2))
    assert len(held) - 10_000 < 300  # of 10,000 that are new


def test_history_is_not_opened_for_new_ids(spark):
    history, filters = new_path(spark, "history"), new_path(spark, "filters")
    stored = ids(spark, range(300))
    stored.write.partitionBy("day").parquet(history)
    M.build(stored).write.parquet(filters)
    table, known = spark.read.parquet(history), spark.read.parquet(filters)
    both = M.append_new(table, known, ids(spark, [5, 299, 300, 301, 301]))
    assert sorted(r[0] for r in both.collect()) == [300, 301]
    sure = [i for i in range(1000, 1100)]
    maybe = {r[0] for r in M.may_hold(ids(spark, sure), known).collect()}
    for path in glob.glob(f"{history}/day=*/*.parquet"):
        with open(path, "r+b") as f:
            f.truncate(5)
    got = M.append_new(table, known, ids(spark, [i for i in sure if i not in maybe]))
    assert got.count() == len(sure) - len(maybe)


def test_null_ids_days_and_empty_filters(spark):
    none = spark.createDataFrame([(None, None), (1, None), (None, date(2024, 1, 1))], "record_id long, day date")
    filters = M.build(none)
    assert M.may_hold(none, filters).count() == 0
    assert M.append_new(none.where("false"), M.build(none.where("false")), none).count() == 2  # one row of a null id


def test_payload_hash_ignores_the_order_of_keys(spark):
    one = {"z": [{"b": 1, "a": {"y": None, "x": "é\""}}, 2.5], "k": {"n": {"d": True, "c": []}}}

    def turned(x):
        if isinstance(x, dict):
            return {k: turned(v) for k, v in reversed(list(x.items()))}
        return [turned(v) for v in x] if isinstance(x, list) else x

    texts = [json.dumps(one), json.dumps(turned(one), indent=2), json.dumps({**one, "k": 1}), "no json {", None, "", "null"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", H.payload_hash(F.col("t")).alias("h"))
    h = [r["h"] for r in rows.orderBy("n").collect()]
    assert h[0] == h[1] and len(set(h)) == len(h) - 1 and None not in h


def test_late_rows_are_kept_and_a_repeated_batch_judges_alike(spark):
    t0 = datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz"
    on_time, late, clock = (J.BatchTable(spark, new_path(spark, n)) for n in ("o", "l", "c"))
    path, cp = new_path(spark, "in"), new_path(spark, "cp")
    for part in ([(1, 0), (2, 60)], [(3, 45), (4, 55), (5, None), (6, 61)]):
        rows = [(i, None if m is None else t0 + timedelta(minutes=m)) for i, m in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        J.split_late(J.read_files(spark, path, spark.createDataFrame([], schema).schema), on_time, late, clock, cp)
    assert sorted(r["event_id"] for r in on_time.read().collect()) == [1, 2, 4, 5, 6]
    assert [r["event_id"] for r in late.read().collect()] == [3]


def test_destination_sketch_is_near_for_many_addresses(spark):
    t0 = datetime(2024, 1, 1)
    schema = "ts timestamp_ntz, host string, addr string, sent long"
    rows = [(t0, "h", f"203.0.{i // 250}.{i % 250}", 60_000) for i in range(20_000)] + [(t0, "h", "10.0.0.1", 10**9), (
        t0, "few", "203.0.113.1", 10**9), (t0, "few", "203.0.113.2", 1), (t0, "few", "", 1), (t0, "few", None, 1)]
    path, cp = new_path(spark, "in"), new_path(spark, "cp")
    spark.createDataFrame(rows, schema).write.parquet(path)
    table = J.OpenAndClosed(spark, new_path(spark, "out"))
    J.write_windows(J.transfer_windows(J.read_files(spark, path, spark.createDataFrame([], schema).schema), ["host"], "sent",
                                       "5 minutes", "5 minutes", "addr"), ["window_start", "host"], table, cp)
    got = {r["host"]: (r["bytes_sent"], r["destinations"]) for r in table.read().collect()}
    assert got["few"] == (10**9 + 1, 2) and got["h"][0] == 20_000 * 60_000 and abs(got["h"][1] - 20_000) < 1000
    assert [r["host"] for r in J.transfer_hits(table.read()).collect()] == ["h"]
