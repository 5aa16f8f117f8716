"""Time columns. All of them take naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from argosift.functions.text import first_label, fixed


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a naive timestamp (the session runs in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def truncate(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) / F.lit(24.0)


def day_of_week(ts: Column) -> Column:
    return F.weekday(ts) / F.lit(7.0)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def is_business_hours(ts: Column) -> Column:
    return F.hour(ts).between(9, 17) & (F.weekday(ts) < 5)


def time_bucket(ts: Column, hours: int = 4, separate_weekends: bool = True) -> Column:
    """``weekday_hN`` / ``weekend_hN``, or ``hN`` when weekends are not kept apart."""
    slot = F.floor(F.hour(ts) / F.lit(hours)).cast("string")
    if not separate_weekends:
        return F.concat(F.lit("h"), slot)
    day = F.when(is_weekend(ts), "weekend").otherwise("weekday")
    return F.concat(day, F.lit("_h"), slot)


def parse_log_time(text: Column, year: int, fallback: Column) -> Column:
    """``Mon D HH:MM:SS`` (year supplied), ISO or access-log time, else ``fallback``."""
    with_year = F.concat(F.lit(f"{year} "), F.regexp_replace(text, r"\s+", " "))
    attempts = [
        F.when(text.rlike(r"^[A-Z][a-z]{2}\s"), F.to_timestamp_ntz(
            F.when(text.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"), with_year),
            F.lit("yyyy MMM d HH:mm:ss"))),
        F.when(text.rlike(r"^\d{4}-\d\d-\d\d[ T]"), text.try_cast("timestamp_ntz")),
        F.when(text.rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}:"), F.to_timestamp_ntz(
            F.substring(text, 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))),
    ]
    return F.coalesce(*attempts, fallback)


def expired(ts: Column, ttl_seconds: int, as_of: Column) -> Column:
    """True when a record is older than its time to live at ``as_of``."""
    return ts + F.expr(f"interval {int(ttl_seconds)} seconds") < as_of


def next_adjustment(last: Column, minutes: int, as_of: Column) -> dict[str, Column]:
    """Next scheduled adjustment and the whole minutes left (0 when overdue)."""
    due = last + F.expr(f"interval {int(minutes)} minutes")
    left = F.greatest(micros(due) - micros(as_of), F.lit(0))
    return {"next_adjustment": due, "minutes_until_next": F.floor(left / F.lit(60_000_000)).cast("long")}


def human_uptime(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%dd %dh %dm", F.floor(s / 86400).cast("long"),
                           F.floor(s % 86400 / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"))


def human_bytes(count: Column) -> Column:
    size = count.cast("double")
    tests = [(size < 1024.0 ** (i + 1), F.concat(fixed(size / 1024.0 ** i, 2), F.lit(f" {unit}")))
             for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"])]
    return first_label(tests, F.concat(fixed(size / 1024.0 ** 5, 2), F.lit(" PB")))
