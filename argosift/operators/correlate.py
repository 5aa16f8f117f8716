"""Correlation of events and anomalies per host, entity and time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from argosift import constants as C
from argosift.functions import text as X, times as T
from argosift.functions.times import micros
from argosift.operators.windows import arrivals_and_expiries, running_max, running_sums, trailing_sums
from argosift.session import cut

SOURCE_TYPES = ("log", "process", "network", "metric")


def entities(source_type: Column, message: Column, remote_addr: Column, user: Column, name: Column) -> Column:
    """Array of (type, value): remote address, user and process, or the first three IPs of a log."""
    def one(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.struct(F.lit(kind).alias("type"), value.alias("value")))

    ips = F.slice(X.ip_list(F.coalesce(message, F.lit(""))), 1, 3)
    from_log = F.transform(ips, lambda ip: F.struct(F.lit("ip").alias("type"), ip.alias("value")))
    listed = F.array_compact(F.array(one("ip", F.when(source_type == "network", remote_addr)),
                                     one("user", F.when(source_type == "process", user)),
                                     one("process", F.when(source_type == "process", name))))
    return F.when(source_type == "log", from_log).otherwise(listed)


def entity_events(df: DataFrame, entity_col: str = "entities") -> DataFrame:
    """One row per event and entity."""
    return df.withColumn("_e", F.explode(entity_col)).withColumns(
        {"entity_type": F.col("_e.type"), "entity_value": F.col("_e.value")}).drop("_e", entity_col)


def temporal(df: DataFrame, keys: Sequence[str] = ("host_id",), ts: str = "ts", seconds: int = 300,
             source_types: Sequence[str] = SOURCE_TYPES) -> DataFrame:
    """Events with ≥2 events of other source types, and ≥3 types in all, in the trailing window.

    One running count per source type replaces a self-join; the types are a fixed list.
    """
    counts = {f"n_{s}": F.when(F.col("source_type") == s, 1).otherwise(0).cast("long") for s in source_types}
    seen = trailing_sums(df, keys, ts, seconds, counts)
    own = X.first_label(((F.col("source_type") == s, F.col(f"n_{s}")) for s in source_types), F.lit(0).cast("long"))
    total = sum((F.col(f"n_{s}") for s in source_types[1:]), F.col(f"n_{source_types[0]}"))
    kinds = sum((F.when(F.col(f"n_{s}") > 0, 1).otherwise(0) for s in source_types[1:]),
                F.when(F.col(f"n_{source_types[0]}") > 0, 1).otherwise(0))
    out = seen.withColumns({"other_events": total - own, "type_count": kinds.cast("long")})
    return (out.where((F.col("other_events") >= 2) & (F.col("type_count") >= 3))
            .withColumn("correlation_score", 0.3 + F.col("type_count") * 0.1)
            .drop(*[f"n_{s}" for s in source_types]))


def distinct_types(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, column: str,
                   values: Sequence[str]) -> DataFrame:
    """Adds ``type_count``: distinct values of ``column`` (a fixed list) in the trailing window."""
    counts = {f"n{i}": F.when(F.col(column) == v, 1).otherwise(0).cast("long") for i, v in enumerate(values)}
    seen = trailing_sums(df, keys, ts, seconds, counts)
    kinds = sum((F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in range(1, len(values))),
                F.when(F.col("n0") > 0, 1).otherwise(0))
    return seen.withColumn("type_count", kinds.cast("long")).drop(*counts)


def entity_frequency(df: DataFrame, ts: str = "ts", tie: str = "event_id", seconds: int = 300, minimum: int = 5,
                     keys: Sequence[str] = ("entity_type", "entity_value")) -> DataFrame:
    """Events whose entity has at least ``minimum`` events in the trailing window.

    One sweep counts the events in the window (``recent``) and all events so far
    (``upto``), equal times included. The oldest event of the window is number
    upto - recent + 1 of its entity, which one equality join turns into its time.
    The sweep is written once because both sides of that join read it.
    """
    slim = df.select(*keys, ts, tie)
    swept = arrivals_and_expiries(slim, keys, ts, seconds, {"recent": F.lit(1).cast("long")})
    both = swept.withColumn("m_upto", F.when(F.col("t_kind") == 0, 1).otherwise(0).cast("long"))
    counted = cut(running_sums(both, keys, ["t_us", "t_kind"], ["m_recent", "m_upto"]).where("t_kind = 0").select(
        *keys, ts, tie, F.col("run_m_recent").alias("recent"), F.col("run_m_upto").alias("upto")))
    busy = counted.where(F.col("recent") >= minimum).withColumn("first_no", F.col("upto") - F.col("recent") + 1)
    starts = counted.groupBy(*keys, F.col(ts).alias("first_ts")).agg(
        (F.max("upto") - F.count(F.lit(1)) + 1).alias("first_no"))
    joined = busy.join(starts, [*keys, "first_no"])
    span = (T.micros(F.col(ts)) - T.micros(F.col("first_ts"))) / F.lit(1_000_000.0)
    per_minute = F.col("recent") / F.greatest(span, F.lit(1.0)) * 60.0
    return joined.withColumns({
        "per_minute": per_minute,
        "correlation_score": F.least(0.3 + per_minute * 0.05, F.lit(0.9)),
    }).drop("first_no", "upto")


def anomaly_groups(df: DataFrame, keys: Sequence[str] = ("host_id",), ts: str = "ts", seconds: int = 300,
                   score: str = "anomaly_score") -> DataFrame:
    """Anomalies with others in the trailing window; score = mean + 0.2, at most 1."""
    # Scores are summed as whole billionths: values that enter and leave cancel exactly.
    units = F.round(F.col(score) * F.lit(1e9)).cast("long")
    seen = trailing_sums(df, keys, ts, seconds, {"group_size": F.lit(1).cast("long"), "group_units": units})
    mean = F.col("group_units") / F.lit(1e9) / F.col("group_size")
    return (seen.where(F.col("group_size") > 1)
            .withColumn("correlation_score", F.least(mean + 0.2, F.lit(1.0))).drop("group_units"))


def _stage_test(stage: dict) -> Column:
    test = F.lit(True)
    if "source_type" in stage:
        test = test & (F.col("source_type") == stage["source_type"])
    if "min_score" in stage:
        test = test & (F.col("anomaly_score") >= stage["min_score"])
    if "contains" in stage:
        test = test & F.lower("reason_text").contains(stage["contains"].lower())
    return test


def attack_chains(df: DataFrame, keys: Sequence[str] = ("host_id",), ts: str = "ts", tie: str = "event_id",
                  seconds: int = 3600, chains: dict = C.ATTACK_CHAINS, ordered: bool = False) -> DataFrame:
    """Per anomaly the chains whose first stages (at least two) are all seen in the trailing window.

    ``df`` holds anomalies with source_type, anomaly_score and reason_text. With ``ordered`` every stage must come
    after the one before it: along the chain each event carries the latest start of a chain that has reached it.
    """
    tests = {(c, i): _stage_test(s) for c, stages in chains.items() for i, s in enumerate(stages)}
    named = {key: f"stage_{list(chains).index(key[0])}_{key[1]}" for key in tests}
    rows = df.select(*keys, ts, tie, *[t.alias(named[k]) for k, t in tests.items()])
    if ordered:
        # Every step reads its rows several times; unless they are written, a step repeats all those before it.
        rows = cut(rows)
        depth = max(map(len, chains.values()))
        at = micros(F.col(ts))
        for i in range(depth):
            level = [k for k in tests if k[1] == i]
            if i:
                before = {f"from_{named[k]}": F.col(f"start_{named[(k[0], i - 1)]}") for k in level}
                rows = cut(running_max(rows, keys, ts, before, strict=True))
            rows = rows.withColumns({f"start_{named[k]}": F.when(F.col(named[k]), F.col(f"from_{named[k]}") if i else at)
                                     for k in level})
        rows = running_max(rows, keys, ts, {f"seen_{named[k]}": F.col(f"start_{named[k]}") for k in tests})
        seen = {k: F.coalesce(F.col(f"seen_{named[k]}") >= at - F.lit(seconds * 1_000_000), F.lit(False)) for k in tests}
    else:
        rows = trailing_sums(rows, keys, ts, seconds, {
            f"n_{named[k]}": F.when(F.col(named[k]), 1).otherwise(0).cast("long") for k in tests})
        seen = {k: F.col(f"n_{named[k]}") > 0 for k in tests}
    found = []
    for name, stages in chains.items():
        ok = [seen[(name, 0)]]
        for i in range(1, len(stages)):
            ok.append(ok[-1] & seen[(name, i)])
        count = sum((F.when(o, 1).otherwise(0) for o in ok[1:]), F.when(ok[0], 1).otherwise(0))
        found.append(F.struct(F.lit(name).alias("chain"), count.cast("long").alias("stages")))
    out = rows.select(*keys, ts, tie, F.explode(F.array(*found)).alias("r")).select(*keys, ts, tie, "r.*")
    return out.where(F.col("stages") >= 2).withColumn("correlation_score", 0.7 + F.col("stages") * 0.1)


def records(temporal_rows: DataFrame | None = None, entity_rows: DataFrame | None = None,
            anomaly_rows: DataFrame | None = None, minimum: float = 0.5) -> DataFrame:
    """Correlation records of all kinds in one layout, score at least ``minimum``."""
    parts = []
    if temporal_rows is not None:
        parts.append(temporal_rows.select(
            "event_id", "ts", F.lit("temporal").alias("correlation_type"), "correlation_score",
            F.lit("").alias("entity"),
            F.format_string("Activity across %d source types", "type_count").alias("description")))
    if entity_rows is not None:
        parts.append(entity_rows.select(
            "event_id", "ts", F.lit("entity").alias("correlation_type"), "correlation_score",
            F.col("entity_value").alias("entity"),
            F.format_string("High activity (%d events) from %s %s", "recent", "entity_type", "entity_value")
            .alias("description")))
    if anomaly_rows is not None:
        parts.append(anomaly_rows.select(
            "event_id", "ts", F.lit("pattern").alias("correlation_type"), "correlation_score",
            F.lit("").alias("entity"),
            F.format_string("Multiple anomalies (%d) detected in correlation window", "group_size")
            .alias("description")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kept = out.where(F.col("correlation_score") >= minimum)
    return kept.withColumn("correlation_id", F.concat(
        F.lit("CORR-"), F.substring(F.sha2(F.concat_ws("|", "correlation_type", F.col("event_id").cast("string"),
                                                        "entity"), 256), 1, 12)))
