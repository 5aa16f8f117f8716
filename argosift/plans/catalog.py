"""All registered queries."""

from argosift.plans import (q_anomaly, q_audit, q_correlate, q_features, q_parse, q_report, q_snapshots,  # noqa: F401
                            q_streams)
from argosift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
