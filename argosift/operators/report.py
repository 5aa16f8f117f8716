"""Summaries, top lists, risk scores and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from argosift import constants as C
from argosift.functions import severity as S, text as X, times as T


def log_summary(df: DataFrame, level: str = "level", source: str = "source", message: str = "message") -> DataFrame:
    """Counts by level, by source, by matched pattern and in total, as (dimension, value, lines).

    Level, source and total come from one pass with grouping sets.
    """
    grouped = df.groupingSets([[F.col(level)], [F.col(source)], []], F.col(level), F.col(source)).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("lines"))
    flat = grouped.select(
        X.lookup(F.col("_g"), {1: "level", 2: "source"}, "total").alias("dimension"),
        F.coalesce(level, source, F.lit("")).alias("value"), "lines")
    patterns = pattern_counts(df, message).select(F.lit("pattern").alias("dimension"),
                                                  F.col("pattern").alias("value"), "lines")
    return flat.unionByName(patterns)


def pattern_counts(df: DataFrame, message: str = "message") -> DataFrame:
    """Lines per named pattern: one aggregation with one counter per pattern, no row expansion."""
    m = F.col(message)
    counted = df.agg(*[F.count_if(X.matches(m, p)).alias(name) for name, p, _ in C.LOG_PATTERNS])
    names = [name for name, _, _ in C.LOG_PATTERNS]
    pairs = F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("lines")) for n in names])
    return counted.select(F.explode(pairs).alias("p")).select("p.*").where("lines > 0")


def top_patterns(df: DataFrame, message: str = "message", n: int = 10) -> DataFrame:
    counts = pattern_counts(df, message).withColumn("severity", S.pattern_severity(F.col("pattern")))
    return counts.orderBy(F.desc("lines"), "pattern").limit(n)


def tail_per_source(df: DataFrame, n: int, source: str = "source", ts: str = "ts",
                    tie: str = "event_id") -> DataFrame:
    """Last ``n`` rows per source; each task keeps at most that many before the shuffle."""
    w = W.partitionBy(source).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def last_per_level(df: DataFrame, n: int = 50, level: str = "level", ts: str = "ts", tie: str = "event_id",
                   levels: Sequence[str] = ("error", "warning", "critical")) -> DataFrame:
    """Last ``n`` lines per problem level, messages shortened to 100 characters."""
    kept = tail_per_source(df.where(F.col(level).isin(list(levels))), n, level, ts, tie)
    return kept.withColumn("line", F.concat(F.col(ts).cast("string"), F.lit(": "), F.substring("message", 1, 100)))


def top(df: DataFrame, by: str, n: int, tie: str = "event_id", descending: bool = True) -> DataFrame:
    order = F.desc(by) if descending else F.asc(by)
    return df.orderBy(order, tie).limit(n)


def recent(df: DataFrame, n: int, ts: str = "ts", tie: str = "event_id", severity: str | None = None,
           column: str = "severity") -> DataFrame:
    kept = df if severity is None else df.where(F.col(column) == severity)
    return kept.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def backlog(df: DataFrame, n: int = 50, level: str = "anomaly_severity", ts: str = "ts",
            tie: str = "event_id") -> DataFrame:
    """The ``n`` most urgent items: by priority, then oldest first."""
    return df.withColumn("priority", S.severity_rank(F.col(level))).orderBy(F.desc("priority"), ts, tie).limit(n)


def severity_distribution(df: DataFrame, severity: Column) -> DataFrame:
    """One row: lines per triage severity and the active threats (critical + high)."""
    marked = df.select(severity.alias("s"))
    counts = marked.agg(*[F.count_if(F.col("s") == k).alias(k) for k in ("critical", "high", "medium", "low")])
    return counts.withColumn("active_threats", F.col("critical") + F.col("high"))


def timeline(df: DataFrame, ts: str = "ts", unit: str = "hour", message: str = "message") -> DataFrame:
    """Events and threats per hour."""
    sev = S.triage_severity(F.col(message))
    return df.groupBy(T.truncate(unit, F.col(ts)).alias("slot")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(sev.isin("critical", "high")).alias("threats"))


def health_status(active_threats: Column, cpu: Column) -> Column:
    return F.when((cpu < 80) & (active_threats < 10), "Good").when(active_threats > 20, "Critical").otherwise("Warning")


def single_row(*frames: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def risk_score(df: DataFrame) -> DataFrame:
    """Adds risk_score and risk_status to a row of metrics, log counts and audit counts."""
    def band(name: str, high: int) -> Column:
        return F.when(F.col(name) > 90, high).when(F.col(name) > 75, 1).otherwise(0)

    score = (band("cpu_percent", 2) + band("memory_percent", 2) + band("disk_percent", 3)
             + F.when(F.col("criticals") > 0, 5).otherwise(0) + F.when(F.col("errors") > 10, 2).otherwise(0)
             + F.when(F.col("tampered") > 0, 10).otherwise(0) + F.when(F.col("missing") > 0, 8).otherwise(0))
    return df.withColumn("risk_score", score.cast("long")).withColumn(
        "risk_status", F.when(F.col("risk_score") >= 10, "CRITICAL").when(F.col("risk_score") >= 5, "WARNING")
        .when(F.col("risk_score") >= 2, "CAUTION").otherwise("HEALTHY"))


def advice(df: DataFrame) -> DataFrame:
    """Adds ``advice``: ordered recommendation codes for a report row, or the healthy defaults."""
    c = F.col
    found = X.labels([
        (c("cpu_percent") > 80, "cpu_high"), (c("memory_percent") > 80, "memory_high"),
        (c("disk_percent") > 85, "disk_low"), (c("criticals") > 0, "critical_events"), (c("errors") > 50, "many_errors"),
        (c("ssh_failed") > 5, "ssh_failures"), (c("brute_force") > 0, "brute_force"), (c("malware") > 0, "malware"),
        (c("tampered") > 0, "tampering"), (c("missing") > 0, "missing_records")])
    fine = F.array(*[F.lit(t) for t in ("healthy", "audit_regularly", "rotate_credentials")])
    return df.withColumn("advice", F.when(F.size(found) == 0, fine).otherwise(found))


def lines_with_pattern_name(df: DataFrame, message: str = "message", n: int = 10) -> DataFrame:
    """First ``n`` (pattern, event) pairs whose text contains the pattern's name, by pattern then event."""
    low = F.lower(message)
    names = X.labels((low.contains(name.lower()), F.lit(f"{i:02d}:{name}"))
                     for i, (name, _, _) in enumerate(C.LOG_PATTERNS))
    pairs = df.select("event_id", message, F.explode(names).alias("_p"))
    return pairs.orderBy("_p", "event_id").limit(n).select("event_id", message, F.substring("_p", 4, 100).alias("pattern"))


def indicators_of_compromise(df: DataFrame, message: str = "message", source: str = "source", ts: str = "ts",
                             user: str = "username") -> DataFrame:
    """Addresses, ports, paths and users found in log text with their evidence.

    ``sources`` holds the distinct source names of an indicator, a short fixed list.
    """
    m = F.col(message)

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(tagged("ip", X.ip_list(m)), tagged("port", X.port_list(m)), tagged("file", X.path_list(m)),
                     tagged("user", F.array_compact(F.array(F.col(user)))))
    rows = df.select(ts, source, F.explode(found).alias("e")).select(ts, source, "e.kind", "e.value")
    per_source = rows.groupBy("kind", "value", source).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return per_source.groupBy("kind", "value").agg(
        F.sum("n").alias("events"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.array_join(F.array_sort(F.collect_list(source)), ",").alias("sources"))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("table_name"), "records")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("events"))
