"""Processes, connections and metric samples: predicates, tags, diffs and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from argosift import constants as C
from argosift.functions import severity as S, text as X, times as T
from argosift.operators.windows import previous_row
from argosift.session import cut


# --- predicates and tags ----------------------------------------------------------------

def suspicious_process(df: DataFrame, ports: str | None = None) -> DataFrame:
    """Adds ``indicators`` and ``indicator_severity``; rows without indicators are dropped.

    ``ports`` names an optional array column of remote ports.
    """
    exe, name, cmd = F.lower(F.coalesce("exe", F.lit(""))), F.lower(F.coalesce("name", F.lit(""))), F.lower(
        F.coalesce("cmdline", F.lit("")))
    tests = [(exe.contains(p.lower()), f"Executable in suspicious path: {p}") for p in C.PROCESS_PATHS]
    tests += [(name.contains(n), F.concat(F.lit("Suspicious process name: "), name)) for n in C.PROCESS_NAMES]
    if ports:
        tests += [(F.array_contains(ports, p), f"Connection to high-risk port: {p}") for p in C.PROCESS_PORTS]
    tests += [(cmd.contains(c.lower()), f"Suspicious command pattern: {c}") for c in C.PROCESS_COMMANDS]
    marked = df.withColumn("indicators", X.labels(tests))
    return marked.where(F.size("indicators") > 0).withColumns(
        {"indicator_severity": F.lit("warning"), "risk_level": F.lit("medium")})


def process_severity(cpu: Column, memory: Column, connections: Column) -> Column:
    return F.when((cpu > 80) | (memory > 50) | (connections > 100), "warning").otherwise("info")


def process_tags(name: Column, connections: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return X.labels([(F.lit(True), "process"), *[(X.contains_any(low, ws), tag) for tag, ws in C.PROCESS_FAMILIES],
                     (connections > 0, "network_active")])


def suspicious_connection(df: DataFrame, per_process: str = "process_connections") -> DataFrame:
    """Adds ``indicators``, ``risk_score`` and ``indicator_severity``; keeps rows with indicators."""
    port, addr, many = F.col("remote_port"), F.col("remote_addr"), F.col(per_process)
    named = X.lookup(port, C.PORT_NAMES, F.lit(None).cast("string"))
    bits = X.entropy_bits(addr)
    listed = X.labels([
        (port.isin(list(C.PORT_NAMES)), F.format_string("Connection to suspicious port %d (%s)", port, named)),
        (port > 49152, F.format_string("Connection to high port %d", port)),
        (bits > 3.5, F.concat(F.lit("High entropy remote IP: "), X.fixed(bits, 2))),
        (many > 50, F.format_string("Process has %d connections (potential exfiltration)", many)),
    ])
    warn = port.isin(list(C.PORT_NAMES)) | (many > 50)
    marked = df.withColumn("indicators", listed)
    return marked.where(F.size("indicators") > 0).withColumns({
        "risk_score": (F.size("indicators") * 25).cast("long"),
        "indicator_severity": F.when(F.coalesce(warn, F.lit(False)), "warning").otherwise("info")})


def connection_direction(status: Column, remote_addr: Column) -> Column:
    return F.when(status == "LISTEN", "listen").when(
        F.coalesce(remote_addr, F.lit("")) != "", "outbound").otherwise("inbound")


def connection_severity(remote_port: Column, process_name: Column) -> Column:
    tool = X.contains_any(F.lower(F.coalesce(process_name, F.lit(""))), C.CONNECTION_TOOLS)
    return F.when(remote_port.isin(list(C.PORT_NAMES)) | tool, "warning").otherwise("info")


def connection_tags(remote_port: Column, status: Column) -> Column:
    known = [p for p, _ in C.PORT_TAGS]
    other = remote_port.isin([p for p in C.PORT_NAMES if p not in known])
    return X.labels([(F.lit(True), "network"), (F.lit(True), "connection"),
                     *[(remote_port == p, tag) for p, tag in C.PORT_TAGS], (other, "suspicious_port"),
                     (status == "ESTABLISHED", "established"), (status == "LISTEN", "listening")])


# --- joins ---------------------------------------------------------------------------------

def name_connections(conns: DataFrame, procs: DataFrame, keys: Sequence[str] = ("host_id", "pid")) -> DataFrame:
    """Adds the process name of a connection by pid. ``procs`` has one row per key."""
    names = procs.select(*keys, F.col("name").alias("owner_name"))
    return conns.join(names, list(keys), "left")


def with_parent(procs: DataFrame, scope: Sequence[str] = ("host_id",)) -> DataFrame:
    """Adds the parent's name; the root has none. Pids are unique inside ``scope`` (host, or host and snapshot)."""
    parents = procs.select(*scope, F.col("pid").alias("ppid"), F.col("name").alias("parent_name"))
    return procs.join(parents, [*scope, "ppid"], "left")


def descendants(procs: DataFrame, root: int, scope: Sequence[str] = ("host_id",)) -> DataFrame:
    """All processes below ``root`` of each ``scope``, itself included, with their depth.

    Every process points to an ancestor and knows whether the root is among the ones up to there. A round joins each
    pointer with its target's, which doubles its reach, so a tree of any depth takes as many rounds as its depth has
    binary digits, and a cycle ends when the reach covers all processes of a scope. A process whose root is found, or
    whose ancestors end, takes no further part. A pid is unique in its scope; of several rows the smallest parent counts.
    """
    names = list(scope)
    nodes = procs.select(*names, "pid", "ppid").groupBy(*names, "pid").agg(F.min("ppid").alias("ppid"))
    depth = F.when(F.col("pid") == root, 0).when(F.col("ppid") == root, 1).cast("long")
    state = cut(nodes.select(*names, "pid", F.col("ppid").alias("up"), F.lit(1).cast("long").alias("reach"),
                             depth.alias("depth")))
    open_rows = F.col("depth").isNull() & F.col("up").isNotNull()
    most = state.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach < most and not state.where(open_rows).isEmpty():
        target = state.select(*names, F.col("pid").alias("up"), F.col("up").alias("_up"), F.col("reach").alias("_reach"),
                              F.col("depth").alias("_depth"))
        met = state.where(open_rows).join(target, [*names, "up"], "left").select(
            *names, "pid", F.when(F.col("_depth").isNull(), F.col("_up")).alias("up"),
            (F.col("reach") + F.coalesce("_reach", F.lit(0))).alias("reach"),
            (F.col("reach") + F.col("_depth")).alias("depth"))
        state = cut(met.unionByName(state.where(~open_rows)))
        reach *= 2
    found = state.where("depth is not null").select(*names, "pid", "depth")
    return procs.select(*names, "pid", "ppid", "name").join(found, [*names, "pid"])


# --- snapshot differences ---------------------------------------------------------------------

def snapshot_index(df: DataFrame, host: str = "host_id", ts: str = "snapshot_ts") -> DataFrame:
    """One row per host and snapshot time with the times before and after it."""
    w = W.partitionBy(host).orderBy(ts)
    return df.select(host, ts).distinct().select(host, ts, F.lag(ts).over(w).alias("_before"),
                                                 F.lead(ts).over(w).alias("_after"))


def snapshot_changes(df: DataFrame, keys: Sequence[str], host: str = "host_id", ts: str = "snapshot_ts",
                     appeared: str = "start", vanished: str = "end") -> DataFrame:
    """Members that appear or vanish between consecutive snapshots of a host.

    Snapshots are ordered in their own small table (one row per host and time); each
    member row is then compared with the neighbouring snapshot by equality joins.
    """
    order = snapshot_index(df, host, ts)
    rows = df.select(host, ts, *keys).distinct().join(order, [host, ts])
    # One exchange by member; its own neighbours in time are compared with the host's.
    w = W.partitionBy(host, *keys).orderBy(ts)
    seen = rows.withColumns({"_held_before": F.lag(ts).over(w), "_held_after": F.lead(ts).over(w)})
    started = F.when(F.col("_before").isNotNull() & ~F.col("_held_before").eqNullSafe(F.col("_before")), F.struct(
        F.col(ts).alias("at"), F.lit(appeared).alias("change")))
    ended = F.when(F.col("_after").isNotNull() & ~F.col("_held_after").eqNullSafe(F.col("_after")), F.struct(
        F.col("_after").alias("at"), F.lit(vanished).alias("change")))
    found = seen.select(host, *keys, F.explode(F.array_compact(F.array(started, ended))).alias("c"))
    return found.select(host, F.col("c.at").alias(ts), *keys, F.col("c.change").alias("change"))


# --- rates --------------------------------------------------------------------------------------

def bandwidth(df: DataFrame, ts: str = "ts", tie: str = "event_id", host: str = "host_id",
              interval_seconds: float | None = None) -> DataFrame:
    """Byte deltas and rates between samples of a host; the first sample has none.

    Rates use the elapsed time, or ``interval_seconds`` when the sampling step is fixed.
    """
    prev = previous_row(df, [host], ts, tie, [ts, "net_bytes_sent", "net_bytes_recv"])
    had = prev.where(F.col(f"prev_{ts}").isNotNull())
    elapsed = (F.lit(float(interval_seconds)) if interval_seconds else
               (T.micros(F.col(ts)) - T.micros(F.col(f"prev_{ts}"))) / F.lit(1_000_000.0))
    sent = F.col("net_bytes_sent") - F.col("prev_net_bytes_sent")
    recv = F.col("net_bytes_recv") - F.col("prev_net_bytes_recv")
    rated = had.withColumns({"delta_sent": sent, "delta_recv": recv, "elapsed_s": elapsed})
    rate = {n: F.when(F.col("elapsed_s") > 0, F.col(d) / F.col("elapsed_s")).otherwise(0.0)
            for n, d in (("sent_per_s", "delta_sent"), ("recv_per_s", "delta_recv"))}
    out = rated.withColumns(rate).withColumn(
        "mbps", (F.col("sent_per_s") + F.col("recv_per_s")) * 8 / F.lit(1_000_000.0))
    return out.withColumn("severity", S.load_severity(F.col("mbps"), 100)).drop(
        f"prev_{ts}", "prev_net_bytes_sent", "prev_net_bytes_recv")


def disk_io(df: DataFrame, ts: str = "ts", tie: str = "event_id", host: str = "host_id") -> DataFrame:
    """Operations and MiB per second between samples of a host, from cumulative counters."""
    counters = ["read_bytes", "write_bytes", "read_count", "write_count"]
    prev = previous_row(df, [host], ts, tie, [ts, *counters])
    had = prev.where(F.col(f"prev_{ts}").isNotNull()).withColumn(
        "elapsed_s", (T.micros(F.col(ts)) - T.micros(F.col(f"prev_{ts}"))) / F.lit(1_000_000.0))

    def rate(name: str, scale: float) -> Column:
        return F.when(F.col("elapsed_s") > 0,
                      (F.col(name) - F.col(f"prev_{name}")) / F.lit(scale) / F.col("elapsed_s")).otherwise(0.0)

    mib = 1048576.0
    out = had.withColumns({"read_ops_per_s": rate("read_count", 1.0), "write_ops_per_s": rate("write_count", 1.0),
                           "read_mb_per_s": rate("read_bytes", mib), "write_mb_per_s": rate("write_bytes", mib)})
    return out.withColumn("severity", S.load_severity(F.col("read_mb_per_s") + F.col("write_mb_per_s"), 100)).drop(
        f"prev_{ts}", *[f"prev_{c}" for c in counters])


# --- roll-ups --------------------------------------------------------------------------------------

def health(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score 100 - 30 per critical - 10 per warning (at least 0), status and severity."""
    grouped = df.groupBy(*keys).agg(F.count_if(F.col("severity") == "critical").alias("criticals"),
                                    F.count_if(F.col("severity") == "warning").alias("warnings"))
    score = F.greatest(F.lit(0).cast("long"), 100 - 30 * F.col("criticals") - 10 * F.col("warnings"))
    return grouped.withColumn("health_score", score).withColumns({
        "status": F.when(F.col("health_score") < 50, "unhealthy").when(F.col("health_score") < 80, "degraded")
        .otherwise("healthy"),
        "severity": F.when(F.col("health_score") < 50, "critical").when(F.col("health_score") < 80, "warning")
        .otherwise("info")})


def connection_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    s = F.col("status")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "ESTABLISHED").alias("established"),
        F.count_if(s == "LISTEN").alias("listening"), F.count_if(s == "TIME_WAIT").alias("time_wait"),
        F.count_if(s == "CLOSE_WAIT").alias("close_wait"))


def disk_rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    gib = F.lit(1073741824.0)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("disk_count"), F.sum("used").alias("_used"),
                                F.sum("total").alias("_total"), F.max("percent").alias("highest_percent"))
    return out.withColumns({"used_gb": F.col("_used") / gib, "capacity_gb": F.col("_total") / gib,
                            "severity": S.metric_severity(F.col("highest_percent"), *C.METRIC_BANDS["disk"])}
                           ).drop("_used", "_total")


def temperature_rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(F.max("current").alias("max_temperature"),
                                F.count_distinct("sensor").alias("sensor_count"))
    return out.withColumn("severity", S.load_severity(F.col("max_temperature"), 80, 90))


def interface_rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct("interface").alias("interface_count"),
                                 F.count_distinct(F.when(F.col("is_up"), F.col("interface")))
                                 .alias("active_interfaces"))


def update_report(df: DataFrame, line: str, keys: Sequence[str] = ()) -> DataFrame:
    """Package lists: available and security updates."""
    real = (F.col(line) != "") & ~F.col(line).startswith("Listing")
    return df.groupBy(*keys).agg(F.count_if(real).alias("total_updates"),
                                 F.count_if(real & F.lower(line).contains("security")).alias("security_updates"))
