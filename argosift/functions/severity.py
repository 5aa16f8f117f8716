"""Severity, threat-type and score-band columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from argosift import constants as C
from argosift.functions.text import contains_any, first_label, labels, lookup, matches, matches_any


def log_level(message: Column) -> Column:
    low = F.lower(message)
    return first_label(((contains_any(low, ws), name) for name, ws in C.LEVEL_WORDS), "debug")


def collector_severity(message: Column) -> Column:
    low = F.lower(message)
    return first_label(((contains_any(low, ws), name) for name, ws in C.COLLECTOR_WORDS), "info")


def rule_severity(line: Column, rules=C.SEVERITY_RULES, default: str = "low") -> Column:
    """First severity class with a matching pattern."""
    return first_label(((matches_any(line, ps), name) for name, ps in rules), default)


def triage_severity(message: Column) -> Column:
    low = F.lower(message)
    return first_label(((contains_any(low, ws), name) for name, ws in C.TRIAGE_WORDS), "low")


def risk(message: Column, level: Column) -> tuple[Column, Column]:
    """(severity, risk score): by keyword first, then by log level."""
    low = F.lower(message)
    tests = [(contains_any(low, ws), name, score) for name, score, ws in C.RISK_WORDS]
    tests += [(F.lower(level) == lv, name, score) for lv, name, score in C.RISK_BY_LEVEL]
    return (first_label(((t, n) for t, n, _ in tests), C.RISK_DEFAULT[0]),
            first_label(((t, s) for t, _, s in tests), C.RISK_DEFAULT[1]))


def threat_type(message: Column) -> Column:
    low = F.lower(message)
    return first_label(((contains_any(low, ws), name) for name, ws in C.THREAT_TYPES), C.THREAT_DEFAULT)


def threat_indicators(message: Column) -> Column:
    low = F.lower(message)
    return labels([
        (contains_any(low, ["failed password", "authentication"]), "Authentication Attack"),
        (contains_any(low, ["brute", "multiple failed"]), "Brute Force"),
        (low.contains("memory") & contains_any(low, ["out of", "exhausted"]), "Resource Exhaustion"),
        (contains_any(low, ["denied", "refused"]), "Access Denied"),
        (contains_any(low, ["segfault", "crash"]), "System Crash"),
    ])


def service_name(message: Column, default: Column) -> Column:
    """Service from ``name[pid]:``, else a known name in the text, else ``default``."""
    low = F.lower(message)
    named = F.regexp_extract(message, r"(\w+)\[\d+\]:", 1)
    tests = [(named != "", named)] + [(low.contains(w), name) for w, name in C.SERVICE_WORDS]
    return first_label(tests, F.when(default == "unknown", "system").otherwise(default))


def matched_patterns(message: Column) -> Column:
    return labels((matches(message, p), name) for name, p, _ in C.LOG_PATTERNS)


def pattern_severity(name: Column) -> Column:
    up = F.upper(name)
    return first_label(((contains_any(up, ws), label) for label, ws in C.PATTERN_SEVERITY), "Info")


def level_score(level: Column) -> Column:
    return lookup(F.lower(level), C.SEVERITY_SCORES, C.SEVERITY_DEFAULT)


def text_score(message: Column) -> Column:
    """Score of the highest severity word in the text."""
    low = F.lower(message)
    ranked = sorted(C.SEVERITY_SCORES.items(), key=lambda kv: -kv[1])
    return first_label(((low.contains(w), s) for w, s in ranked), C.SEVERITY_DEFAULT)


def anomaly_severity(score: Column) -> Column:
    return first_label(((score >= bound, name) for name, bound in C.ANOMALY_BANDS), "low")


def threat_level(score: Column) -> Column:
    return first_label(((score >= bound, name) for name, bound in C.THREAT_BANDS), "none")


def severity_rank(name: Column) -> Column:
    return lookup(name, {n: i for i, n in enumerate(C.SEVERITY_RANK)}, -1)


def severity_of_rank(rank: Column) -> Column:
    return lookup(rank, dict(enumerate(C.SEVERITY_RANK)), "low")


def status_band(value: Column, warning: float, critical: float) -> Column:
    return F.when(value >= critical, "Critical").when(value >= warning, "Warning").otherwise("Normal")


def metric_severity(value: Column, warning: float, critical: float) -> Column:
    """Bands that include their bound (CPU, memory, disk)."""
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("info")


def load_severity(value: Column, warning: float, critical: float | None = None) -> Column:
    """Bands that exclude their bound (load, disk I/O, bandwidth, temperature)."""
    base = F.when(value > warning, "warning").otherwise("info")
    return base if critical is None else F.when(value > critical, "critical").otherwise(base)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def is_auth_failure(message: Column) -> Column:
    return contains_any(F.lower(message), C.AUTH_FAILURE_WORDS)


def triage_line(rule_hit: Column, score: Column) -> Column:
    return F.when(rule_hit | (score > 0.7), "threat").when(score > 0.5, "warning").otherwise("normal")


def is_tamper_statement(statement: Column) -> Column:
    return matches_any(statement, C.TAMPER_STATEMENTS)
