"""Moving averages, forests, detectors and text functions against small plain computations."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from argosift import constants as C
from argosift.functions import text as X, net as N, times as T
from argosift.operators import anomaly as A, baseline as B, detect as D, features as FX, forest as IF

T0 = datetime(2024, 1, 1)


def plain_moving(values, alpha, seed):
    head = values[:seed]
    mean = sum(head) / len(head)
    var = sum((x - mean) ** 2 for x in head) / (len(head) - 1)
    for x in values[seed:]:
        mean = (1 - alpha) * mean + alpha * x
        var = (1 - alpha) * var + alpha * (x - mean) ** 2
    return mean, var


@pytest.mark.parametrize("segment,levels", [(7, 3), (50, 1), (1000, 2)])
def test_moving_average_matches_sequential_updates(spark, segment, levels):
    rng = random.Random(1)
    rows = [(i, T0 + timedelta(seconds=i), rng.choice("aab"), rng.gauss(5, 2), rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, source_type string, x double, y double")
    got = {(r["source_type"], r["feature"]): r for r in B.learn_moving(
        df.repartition(5), ["x", "y"], alpha=0.1, seed_rows=20, segment_rows=segment, levels=levels).collect()}
    for key in "ab":
        for col, name in ((3, "x"), (4, "y")):
            values = [r[col] for r in rows if r[2] == key]
            mean, var = plain_moving(values, 0.1, 20)
            r = got[(key, name)]
            assert r["mean"] == pytest.approx(mean, rel=1e-9) and r["variance"] == pytest.approx(var, rel=1e-9)
            assert (r["min"], r["max"], r["sample_count"]) == (min(values), max(values), len(values))


def test_moving_average_keeps_the_start_of_a_short_run(spark):
    values = [4.0, 1.0, 7.0, 2.0, 9.0, 3.0]
    df = spark.createDataFrame([(i, T0 + timedelta(minutes=i), "a", v) for i, v in enumerate(values)],
                               "event_id long, ts timestamp_ntz, source_type string, x double")
    for segment in (1, 2, 10):
        r = B.learn_moving(df, ["x"], seed_rows=3, segment_rows=segment).collect()[0]
        assert (r["mean"], r["variance"]) == pytest.approx(plain_moving(values, 0.1, 3))


def test_short_key_keeps_plain_statistics(spark):
    df = spark.createDataFrame([(1, T0, "a", 2.0)], "event_id long, ts timestamp_ntz, source_type string, x double")
    r = B.learn_moving(df, ["x"]).collect()[0]
    assert (r["mean"], r["sample_count"]) == (2.0, 1) and r["std"] == pytest.approx(0.1)


def test_forest_ranks_planted_outliers_first_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "metric", *map(float, rng.normal(0, 1, 3))) for i in range(1500)]
    rows += [(2000 + i, "metric", 9.0 + i, -9.0 - i, 9.0) for i in range(4)]
    df = spark.createDataFrame(rows, "event_id long, source_type string, a double, b double, c double")
    names = ["a", "b", "c"]
    first, second = IF.train(df, names), IF.train(df.repartition(7), names)
    key = ["tree", "node", "feature", "split", "size"]
    assert sorted(map(tuple, first.select(key).collect())) == sorted(map(tuple, second.select(key).collect()))
    scored = IF.score(df, first, names).orderBy(F.desc("isolation_score")).limit(4).collect()
    assert {r["event_id"] for r in scored} == {2000, 2001, 2002, 2003}
    assert all(0 < r["isolation_score"] <= 1 for r in scored)


def test_forest_paths_follow_the_tree():
    x = np.random.default_rng(0).normal(size=(64, 2))
    nodes = {n[0]: n for n in IF.grow(x, lambda node, what: IF.drawn('s', 0, node, what, 1))}

    def walk(p, node=1, depth=0):
        _, feature, split, left, right, size = nodes[node]
        if feature < 0:
            return depth + IF.average_path(size)
        return walk(p, left if p[feature] < split else right, depth + 1)

    order = sorted(nodes)
    at = {n: i for i, n in enumerate(order)}
    leaf = np.array([nodes[n][1] < 0 for n in order])
    forest = {"roots": np.array([at[1]]), "leaf": leaf,
              "feature": np.array([max(nodes[n][1], 0) for n in order]),
              "split": np.array([nodes[n][2] for n in order]),
              "left": np.array([at.get(nodes[n][3], i) for i, n in enumerate(order)]),
              "right": np.array([at.get(nodes[n][4], i) for i, n in enumerate(order)]),
              "extra": np.array([IF.average_path(nodes[n][5]) for n in order])}
    assert IF.path_lengths(x, forest) == pytest.approx([walk(p) for p in x])


TEXTS = ["", "a", "Failed password for root from 10.0.0.5 port 2222 ssh2", "É tout à fait Ⅷ ² ½ x", "😀😀 ab\tc\n\nd ",
         "192.168.1.1:8080 and /etc/passwd C:\\Users\\x port: 022", "aaaa", "NBSP\u00a0here\u2003too"]


def test_text_features_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, m string")
    m = F.col("m")
    rows = df.select("i", X.word_count(m).alias("w"), X.uppercase_ratio(m).alias("u"), X.digit_ratio(m).alias("d"),
                     X.special_ratio(m).alias("s"), X.entropy_bits(m).alias("e"), X.port_list(m).alias("p"),
                     N.any_unusual_port(X.port_list(m)).alias("odd")).collect()
    for r in rows:
        t = TEXTS[r["i"]]
        n = max(len(t), 1)
        assert r["w"] == len(t.split())
        assert r["u"] == pytest.approx(sum(c.isupper() for c in t) / n)
        assert r["d"] == pytest.approx(sum(c.isdigit() for c in t) / n)
        assert r["s"] == pytest.approx(sum(not c.isalnum() and c != " " for c in t) / n)
        bits = -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0
        assert r["e"] == pytest.approx(bits, abs=1e-9)
    assert [list(r["p"]) for r in rows][5] == ["8080", "022"]
    assert [r["odd"] for r in rows][2] and [r["odd"] for r in rows][5] and not [r["odd"] for r in rows][1]


def test_private_addresses(spark):
    cases = {"10.1.2.3": True, "172.16.0.1": True, "172.32.0.1": False, "192.168.9.9": True, "127.0.0.1": True,
             "8.8.8.8": False, "fe80::1": False, "": False, "010.0.0.1": True}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert {r["ip"]: r["p"] for r in df.select("ip", N.is_private_ip(F.col("ip")).alias("p")).collect()} == cases


def test_pattern_test_equals_plain_regex(spark):
    lines = TEXTS + ["su root", "SSHD[1]: FAILED  PASSWORD", "Starting x", "Stopped", "oom-killer", "brute  force", "BruteForce",
                     "su   : x", "xmrig", "nc  -e /bin/sh"]
    df = spark.createDataFrame([(t,) for t in lines], "m string")
    patterns = ([p for p, _, _ in C.SUSPICIOUS_PATTERNS] + [p for _, p, _ in C.LOG_PATTERNS]
                + [p for r in C.RULES for p in r.log_patterns + r.process_patterns])
    m = F.col("m")
    bad = df.select(*[(X.matches(m, p) != m.rlike("(?i)" + p)).alias(f"c{i}") for i, p in enumerate(patterns)])
    assert not any(any(r) for r in bad.collect())


def test_detection_flags_a_strange_event(spark):
    rows = [(i, T0 + timedelta(minutes=i), "h", "auth", "session opened for user bob", "info") for i in range(250)]
    rows.append((999, T0 + timedelta(hours=3), "h", "auth",
                 "MALWARE trojan scan from 203.0.113.9 port 31337 wget /etc/shadow failed password sudo", "critical"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, host_id string, source string, message string, "
                                     "severity string").withColumn("source_type", F.lit("log"))
    feats = FX.log_features(df, severity="severity")
    scored = A.detect(B.with_profile(feats, B.learn(feats, C.LOG_FEATURES)), "log", C.LOG_FEATURES, threshold=0.6)
    top = scored.orderBy(F.desc("anomaly_score")).select("event_id", "is_anomaly", "anomaly_severity", "reasons").first()
    assert top["event_id"] == 999 and top["is_anomaly"] and "High-severity pattern detected in log" in top["reasons"]


def test_burst_raises_temporal_score(spark):
    rows = [(i, T0 + timedelta(hours=10, milliseconds=100 * i), "log", 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, source_type string, is_business_hours double")
    got = {r["event_id"]: r for r in A.temporal(A.burst_rate(df)).collect()}
    assert got[5]["temporal_score"] == 0.0 and got[30]["temporal_score"] == 0.7
    assert got[30]["temporal_reasons"][0].startswith("High event frequency")


def test_rule_needs_three_hits_in_its_window(spark):
    line = "Jan 1 00:00:00 h sshd[1]: Failed password for x"
    rows = [(i, T0 + timedelta(seconds=s), "h", line) for i, s in enumerate([0, 100, 200, 290, 1000, 1310])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, host_id string, line string")
    got = {r["event_id"]: r for r in D.match_rules(df, "log", ["line"]).collect()}
    assert sorted(got) == [2, 3] and got[3]["occurrences"] == 4 and got[2]["confidence"] == pytest.approx(0.9)


def test_log_times(spark):
    df = spark.createDataFrame([("Jan  5 01:02:03",), ("2024-02-03T04:05:06",), ("10/Oct/2023:13:55:36 +0000",), ("?",)],
                               "t string")
    got = [str(r[0]) for r in df.select(T.parse_log_time(F.col("t"), 2023, F.lit(None).cast("timestamp_ntz"))).collect()]
    assert got == ["2023-01-05 01:02:03", "2024-02-03 04:05:06", "2023-10-10 13:55:36", "None"]
