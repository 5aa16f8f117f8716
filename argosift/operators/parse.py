"""Log line parsing, classification and line filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from argosift import constants as C
from argosift.functions import severity as S, text as X, times as T

_SEP = "\u0001"


def _fields(line: Column, pattern: str, n: int) -> Column:
    """All groups of one match as an array: the pattern runs once, not once per group."""
    groups = _SEP.join(f"${i}" for i in range(1, n + 1))
    return F.split(F.regexp_replace(line, f"(?s){_tail(pattern)}", groups), _SEP, n)


def _tail(pattern: str) -> str:
    """The pattern with its dots kept to one line and the rest of the text swallowed."""
    body = pattern.removesuffix("$")
    return f"(?-s:{body}).*$"


def parse_lines(df: DataFrame, line: str = "line", ts: str = "ts", year: int = 2024) -> DataFrame:
    """Adds log_format, event_ts, hostname, process, pid, status, message and level.

    Formats are tried in order: syslog, web access, plain text. Lines without a
    readable time keep the time in ``ts``.
    """
    raw = F.trim(F.col(line))
    is_syslog, is_access = raw.rlike(C.SYSLOG), raw.rlike(C.ACCESS)
    staged = df.withColumns({
        "log_format": F.when(is_syslog, "syslog").when(is_access, "access").otherwise("generic"),
    }).withColumn("_f", F.when(F.col("log_format") == "syslog", _fields(raw, C.SYSLOG, 5))
                  .when(F.col("log_format") == "access", _fields(raw, C.ACCESS, 6)))
    fmt, f = F.col("log_format"), F.col("_f")
    status = F.when(fmt == "access", f[4].cast("int"))
    message = (F.when(fmt == "syslog", f[4])
               .when(fmt == "access", F.concat(f[2], F.lit(" "), f[3], F.lit(" -> "), f[4]))
               .otherwise(raw))
    when_text = F.when(fmt == "syslog", f[0]).when(fmt == "access", f[1])
    parsed = staged.withColumns({
        "event_ts": T.parse_log_time(when_text, year, F.col(ts)),
        "hostname": F.when(fmt == "syslog", f[1]).when(fmt == "access", f[0]),
        "process": F.when(fmt == "syslog", f[2]).when(fmt == "access", F.lit("httpd")).otherwise("unknown"),
        "pid": F.when((fmt == "syslog") & (f[3] != ""), f[3].cast("long")),
        "status": status,
        "message": message,
    }).drop("_f")
    level = (F.when(F.col("status") >= 500, "error").when(F.col("status") >= 400, "warning")
             .when(F.col("status").isNotNull(), "info").otherwise(S.log_level(F.col("message"))))
    return parsed.withColumn("level", level)


def collect_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Strict syslog parse with the authentication fields; other lines are tagged unparsed."""
    raw = F.trim(F.col(line))
    ok = raw.rlike(C.STRICT_SYSLOG)
    staged = df.withColumn("_ok", ok).withColumn("_f", F.when(F.col("_ok"), _fields(raw, C.STRICT_SYSLOG, 5)))
    f, parsed = F.col("_f"), F.col("_ok")
    out = staged.withColumns({
        "hostname": F.when(parsed, f[1]),
        "process": F.when(parsed, f[2]),
        "message": F.when(parsed, f[4]).otherwise(raw),
    })
    out = auth_fields(out, "message")
    return out.withColumns({
        "event_type": F.when(parsed, F.col("auth_event")).otherwise("generic_log"),
        "severity": S.collector_severity(F.col("message")),
        "unparsed": ~parsed,
    }).drop("_ok", "_f", "auth_event")


def auth_fields(df: DataFrame, message: str = "message") -> DataFrame:
    """Adds auth_event (first matching kind) with user, address, method, command, action, outcome."""
    m = F.col(message)
    kind = X.first_label(((m.rlike(p), name) for name, p in C.AUTH_PATTERNS), "log_entry")
    staged = df.withColumn("auth_event", kind)
    patterns = dict(C.AUTH_PATTERNS)
    e = F.col("auth_event")

    def group(name: str, i: int) -> Column:
        return F.when(e == name, F.regexp_extract(m, patterns[name], i))

    login = e.isin("login_success", "login_failure")
    session = e.isin("session_open", "session_close")
    return staged.withColumns({
        "auth_method": F.coalesce(group("login_success", 1), group("login_failure", 1)),
        "username": F.coalesce(group("login_success", 2), group("login_failure", 2), group("sudo", 1),
                               group("session_open", 1), group("session_close", 1)),
        "source_ip": F.coalesce(group("login_success", 3), group("login_failure", 3)),
        "command": group("sudo", 2),
        "action": F.when(login, "login").when(e == "sudo", "privilege_escalation").when(session, "session"),
        "outcome": (F.when(e == "login_success", "success").when(e == "login_failure", "failure")
                    .when(e == "session_open", "open").when(e == "session_close", "close")),
    })


def log_tags(message: Column, source: Column) -> Column:
    low, src = F.lower(message), F.lower(source)
    return X.labels([
        (src.contains("auth"), "authentication"), (src.contains("secure"), "security"),
        (src.contains("kern"), "kernel"), (low.contains("ssh"), "ssh"), (low.contains("sudo"), "sudo"),
        (X.contains_any(low, ["fail", "denied"]), "security_event"),
    ])


def keep_line(line: Column, exclude=C.EXCLUDE_LINES, always=C.ALWAYS_INCLUDE_LINES) -> Column:
    """True unless the line matches an exclusion and no overriding inclusion."""
    dropped = X.matches_any(line, exclude, ignore_case=False) if exclude else F.lit(False)
    forced = X.matches_any(line, always) if always else F.lit(False)
    return forced | ~dropped


def filter_sources(df: DataFrame, rules: dict[str, dict[str, list[str]]], line: str = "message",
                   source: str = "source") -> DataFrame:
    """Keeps a row when its source's include patterns match and its exclude patterns do not."""
    keep = F.lit(True)
    for name, rule in rules.items():
        ok = F.lit(True)
        if rule.get("include"):
            ok = ok & X.matches_any(F.col(line), rule["include"])
        if rule.get("exclude"):
            ok = ok & ~X.matches_any(F.col(line), rule["exclude"])
        keep = F.when(F.col(source) == name, ok).otherwise(keep)
    return df.where(keep)


def split_lines(df: DataFrame, key: str, blob: str, tail_lines: int | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """One row per line of a text: key, line_no (1-based), line (trimmed), n_lines, blank, ``keep``.

    ``tail_lines`` keeps the last lines of each text, blank ones included.
    """
    whole = df.select(key, *keep, F.split(F.trim(F.col(blob)), "\n").alias("_lines"))
    lines = whole.select(key, *keep, F.size("_lines").cast("long").alias("n_lines"),
                         F.posexplode("_lines").alias("_pos", "_raw"))
    out = lines.select(key, *keep, (F.col("_pos") + 1).cast("long").alias("line_no"), "n_lines",
                       F.trim("_raw").alias("line"))
    if tail_lines:
        out = out.where(F.col("line_no") > F.col("n_lines") - tail_lines)
    return out.withColumn("blank", F.col("line") == "")


def windows_events(df: DataFrame, event_code: str = "event_code", event_kind: str = "event_kind",
                   log_type: str = "log_type") -> DataFrame:
    """Exported Windows records: low 16 bits of the id, severity and event type by kind."""
    return df.withColumns({
        "code": F.col(event_code).bitwiseAND(0xFFFF).cast("long"),
        "severity": X.lookup(F.col(event_kind), C.WINDOWS_TYPES, "info"),
        "event_type": F.concat(F.lit("windows_"), F.lower(F.col(log_type)), F.lit("_event")),
    })
