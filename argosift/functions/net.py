"""Address and port columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from argosift import constants as C
from argosift.functions import text


def is_private_ip(ip: Column) -> Column:
    """Private or loopback IPv4; anything that is not IPv4 is not private."""
    return F.coalesce(ip.rlike(f"^(?:{C.PRIVATE_IPV4})$"), F.lit(False))


def any_private(ips: Column) -> Column:
    return F.array_join(ips, "\n").rlike(f"(?m)^(?:{C.PRIVATE_IPV4})$")


def any_unusual_port(ports: Column) -> Column:
    """True when a port outside the safe set occurs (leading zeros ignored)."""
    safe = "|".join(str(p) for p in C.SAFE_PORTS)
    return F.array_join(ports, "\n").rlike(rf"(?m)^(?!0*(?:{safe})$)\d+$")


def any_sensitive_path(paths: Column) -> Column:
    return text.contains_any(F.lower(F.array_join(paths, "\n")), C.SENSITIVE_PATHS)
