"""Numeric feature columns for logs, processes, connections and metric samples.

Each function adds one double column per feature, so that scoring stays in one
row and one stage; ``feature_vector`` packs them when an array is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from argosift import constants as C
from argosift.functions import net as N, severity as S, text as X, times as T


def feature_vector(source_type: str) -> Column:
    """The ordered features as one array, missing values as 0."""
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in C.FEATURES[source_type]])


def pattern_flag_names() -> list[str]:
    return list(dict.fromkeys(f"pattern_{name}" for _, name, _ in C.SUSPICIOUS_PATTERNS))


def log_features(df: DataFrame, message: str = "message", source: str = "source", ts: str = "ts",
                 severity: str | None = None) -> DataFrame:
    """The 21 log features, one flag per suspicious pattern, and detected_patterns."""
    m, when = F.col(message), F.col(ts)
    hits = [f"_hit{i}" for i in range(len(C.SUSPICIOUS_PATTERNS))]
    low = F.col("_low")
    staged = df.withColumn("_low", F.lower(m)).withColumns({
        **{h: X.matches(low, p, low) for h, (p, _, _) in zip(hits, C.SUSPICIOUS_PATTERNS)},
        "_ips": X.ip_list(m), "_ports": X.port_list(m), "_paths": X.path_list(m),
    })
    found = [(F.col(h), name, score) for h, (_, name, score) in zip(hits, C.SUSPICIOUS_PATTERNS)]
    count = sum((F.when(hit, 1).otherwise(0) for hit, _, _ in found[1:]), F.when(found[0][0], 1).otherwise(0))
    total = sum((F.when(hit, s).otherwise(0.0) for hit, _, s in found[1:]),
                F.when(found[0][0], found[0][2]).otherwise(0.0))
    flags = {f"pattern_{name}": X.flag(X.any_of(h for h, n, _ in found if n == name))
             for name in dict.fromkeys(n for _, n, _ in found)}
    score = S.text_score(m) if severity is None else F.when(
        F.coalesce(F.col(severity), F.lit("")) != "", S.level_score(F.col(severity))).otherwise(S.text_score(m))
    full = staged.withColumns({
        "message_length": F.length(m).cast("double"),
        "word_count": X.word_count(m).cast("double"),
        "uppercase_ratio": X.uppercase_ratio(m),
        "digit_ratio": X.digit_ratio(m),
        "special_char_ratio": X.special_ratio(m),
        "severity_score": score,
        "hour_of_day": T.hour_of_day(when),
        "day_of_week": T.day_of_week(when),
        "is_business_hours": X.flag(T.is_business_hours(when)),
        "is_weekend": X.flag(T.is_weekend(when)),
        "max_pattern_score": F.greatest(*[F.when(h, s).otherwise(0.0) for h, _, s in found]),
        "pattern_count": count.cast("double"),
        "avg_pattern_score": F.when(count > 0, total / count).otherwise(0.0),
        "ip_count": F.size("_ips").cast("double"),
        "has_private_ip": X.flag(N.any_private(F.col("_ips"))),
        "port_count": F.size("_ports").cast("double"),
        "has_unusual_port": X.flag(N.any_unusual_port(F.col("_ports"))),
        "path_count": F.size("_paths").cast("double"),
        "has_sensitive_path": X.flag(N.any_sensitive_path(F.col("_paths"))),
        "source_sensitivity": X.lookup(F.lower(F.col(source)), C.SOURCE_SENSITIVITY, C.SOURCE_SENSITIVITY_DEFAULT),
        "entropy": X.entropy(m),
        **flags,
        "detected_patterns": X.labels((h, n) for h, n, _ in found),
    })
    return full.drop(*hits, "_low", "_ips", "_ports", "_paths")


def process_features(df: DataFrame, user: str = "username", ts: str = "ts") -> DataFrame:
    """The 18 process features from name, cmdline, user and resource columns.

    ``cpu_percent`` and ``memory_percent`` are replaced by their scaled values.
    """
    name, cmd, who, when = F.lower("name"), F.col("cmdline"), F.col(user), F.col(ts)
    low = F.lower(cmd)
    cpu = F.least(F.col("cpu_percent") / 100.0, F.lit(1.0))
    mem = F.least(F.col("memory_percent") / 100.0, F.lit(1.0))
    return df.withColumns({
        "cpu_percent": cpu,
        "memory_percent": mem,
        "resource_total": (cpu + mem) / 2,
        "connection_count": F.least(F.col("connections") / 100.0, F.lit(1.0)),
        "open_files_count": F.least(F.col("open_files") / 1000.0, F.lit(1.0)),
        "children_count": F.least(F.col("children") / 50.0, F.lit(1.0)),
        "name_length": F.length("name") / 50.0,
        "cmdline_length": F.length(cmd) / 500.0,
        "is_suspicious_name": X.flag(name.isin(C.TOOL_NAMES)),
        "has_suspicious_in_cmdline": X.flag(X.contains_any(low, C.TOOL_NAMES)),
        "is_root": X.flag(who.isin(C.ROOT_USERS)),
        "is_service_account": X.flag(X.any_of(who.startswith(p) for p in C.SERVICE_PREFIXES)),
        "has_shell_operators": X.flag(X.contains_any(cmd, C.SHELL_OPERATORS)),
        "has_redirection": X.flag(X.contains_any(cmd, C.REDIRECTIONS)),
        "has_encoded_data": X.flag(X.contains_any(low, C.ENCODED_MARKERS)),
        "has_network_args": X.flag(X.contains_any(low, C.NETWORK_ARGS)),
        "hour_of_day": T.hour_of_day(when),
        "is_business_hours": X.flag(T.is_business_hours(when)),
    })


def network_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The 20 connection features."""
    remote, when = F.col("remote_addr"), F.col(ts)
    private, loopback = N.is_private_ip(remote), remote.startswith("127.")
    sent, recv = F.col("bytes_sent"), F.col("bytes_recv")
    ratio = F.when(recv > 0, sent / F.greatest(recv, F.lit(1))).otherwise(1.0)
    proc = F.coalesce(F.col("process_name"), F.lit(""))
    return df.withColumns({
        "local_port_normalized": F.least(F.col("local_port") / 65535.0, F.lit(1.0)),
        "remote_port_normalized": F.least(F.col("remote_port") / 65535.0, F.lit(1.0)),
        "is_privileged_local": X.flag(F.col("local_port") < 1024),
        "is_privileged_remote": X.flag(F.col("remote_port") < 1024),
        "is_common_port": X.flag(F.col("remote_port").isin(C.SAFE_PORTS)),
        "is_high_port": X.flag(F.col("remote_port") > 10000),
        "is_local_loopback": X.flag(F.col("local_addr").startswith("127.")),
        "is_remote_loopback": X.flag(loopback),
        "is_remote_private": X.flag(private),
        "is_remote_public": X.flag(~private & ~loopback),
        "is_tcp": X.flag(F.upper("protocol") == "TCP"),
        "is_udp": X.flag(F.upper("protocol") == "UDP"),
        "status_score": X.lookup(F.lower("status"), C.STATUS_SCORES, C.STATUS_DEFAULT),
        "bytes_sent_normalized": F.least(sent / 1000000.0, F.lit(1.0)),
        "bytes_recv_normalized": F.least(recv / 1000000.0, F.lit(1.0)),
        "data_ratio": ratio,
        "data_ratio_normalized": F.least(ratio / 10.0, F.lit(1.0)),
        "has_process": X.flag(proc != ""),
        "is_suspicious_process": X.flag(F.lower(proc).isin(C.TOOL_NAMES)),
        "hour_of_day": T.hour_of_day(when),
        "is_business_hours": X.flag(T.is_business_hours(when)),
    })


def metric_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The 17 metric features; byte counters that are absent count as 0."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)

    cpu, mem, disk, when = F.col("cpu_percent"), F.col("memory_percent"), F.col("disk_percent"), F.col(ts)
    high_cpu, high_mem, high_disk = X.flag(cpu > 80), X.flag(mem > 80), X.flag(disk > 90)
    read = F.least(number("disk_io_read") / F.lit(104857600.0), F.lit(1.0))
    write = F.least(number("disk_io_write") / F.lit(104857600.0), F.lit(1.0))
    sent = F.least(number("net_bytes_sent") / F.lit(10485760.0), F.lit(1.0))
    recv = F.least(number("net_bytes_recv") / F.lit(10485760.0), F.lit(1.0))
    count = number("process_count")
    return df.withColumns({
        "cpu_percent": cpu / 100.0, "memory_percent": mem / 100.0, "disk_percent": disk / 100.0,
        "high_cpu": high_cpu, "high_memory": high_mem, "high_disk": high_disk,
        "overall_stress": (high_cpu + high_mem + high_disk) / 3.0,
        "disk_io_read_normalized": read, "disk_io_write_normalized": write, "disk_io_total": (read + write) / 2,
        "net_bytes_sent_normalized": sent, "net_bytes_recv_normalized": recv, "net_total": (sent + recv) / 2,
        "process_count_normalized": F.least(count / 500.0, F.lit(1.0)),
        "high_process_count": X.flag(count > 300),
        "hour_of_day": T.hour_of_day(when),
        "is_business_hours": X.flag(T.is_business_hours(when)),
    })


BUILDERS = {"log": log_features, "process": process_features, "network": network_features,
            "metric": metric_features}
