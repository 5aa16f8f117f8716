"""Skew-safe windows against plain windows and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W, functions as F

from argosift.functions.times import micros
from argosift.operators import windows as OW

SCHEMA = "event_id long, ts timestamp_ntz, host_id string, v long"


@pytest.fixture(scope="module")
def rows(spark):
    """One host holds most rows, times repeat, one key is null."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        host = rng.choice(["hot"] * 6 + ["a", "b", None])
        when = None if i % 500 == 0 else start + timedelta(seconds=rng.randrange(0, 9000))
        data.append((i, when, host, rng.randrange(-5, 20)))
    return spark.createDataFrame(data, SCHEMA).repartition(6).cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("cell", [60, 600, 100_000])
def test_number_rows(rows, cell):
    w = W.partitionBy("host_id").orderBy("ts", "event_id")
    same(OW.number_rows(rows, ["host_id"], "ts", "event_id", "n", cell).select("event_id", "n"),
         rows.select("event_id", F.row_number().over(w).cast("long")))


@pytest.mark.parametrize("cell,seconds", [(60, 300), (600, 300), (600, 5000), (30, 0)])
def test_trailing_sums(rows, cell, seconds):
    w = W.partitionBy("host_id").orderBy(micros(F.col("ts"))).rangeBetween(-seconds * 1_000_000, 0)
    got = OW.trailing_sums(rows, ["host_id"], "ts", seconds, {"n": F.lit(1).cast("long"), "s": F.col("v")}, cell)
    same(got.select("event_id", "n", "s"),
         rows.select("event_id", F.count(F.lit(1)).over(w), F.sum("v").over(w)))


def test_running_sums(rows):
    base = rows.withColumn("us", micros(F.col("ts")))
    w = W.partitionBy("host_id").orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    same(OW.running_sums(base, ["host_id"], ["us"], ["v"], 120).select("event_id", "run_v"),
         base.select("event_id", F.sum("v").over(w)))


def test_previous_row(rows):
    w = W.partitionBy("host_id").orderBy("ts", "event_id")
    same(OW.previous_row(rows, ["host_id"], "ts", "event_id", ["event_id", "v"], 90).select(
        F.col("event_id"), "prev_event_id", "prev_v"),
        rows.select("event_id", F.lag("event_id").over(w), F.lag("v").over(w)))


@pytest.mark.parametrize("limit,segment", [(10, 10), (10, 64), (100, 256)])
def test_prior_rows(rows, limit, segment):
    w = W.partitionBy("host_id").orderBy("ts", "event_id")
    frame = w.rowsBetween(-limit, -1)
    same(OW.prior_rows(rows, ["host_id"], "ts", "event_id", limit, segment).select(
        "event_id", "prior_count", "prior_first"),
        rows.select("event_id", F.count(F.lit(1)).over(frame), F.first("ts").over(frame)))


def test_no_group_holds_a_whole_hot_key(rows):
    """The window of the numbering is partitioned by key and time cell."""
    plan = OW.number_rows(rows, ["host_id"], "ts", "event_id")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert windows and all("_cell" in line for line in windows)


def test_ordered_chains_do_not_repeat_earlier_steps(spark):
    """The plan that is left does not grow with the length of the chains."""
    from argosift.operators import correlate as K
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), "h", "metric", 0.5 + i / 10, "x") for i in range(4)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, host_id string, source_type string, "
                                     "anomaly_score double, reason_text string")
    windows = []
    for depth in (2, 4):
        found = K.attack_chains(df, chains={"c": [{"min_score": 0.5 + i / 10} for i in range(depth)]}, ordered=True)
        assert found.orderBy("event_id").select("event_id", "stages").collect()[-1] == (3, depth)
        windows.append(found._jdf.queryExecution().optimizedPlan().toString().count("Window "))
    assert windows[0] == windows[1]
