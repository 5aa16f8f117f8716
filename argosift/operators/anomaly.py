"""Anomaly scores: statistical, pattern, temporal, combined and ensemble.

All scores are expressions over one row (features joined with their profile),
so scoring adds no shuffle beyond the event numbering used for burst rates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from argosift import constants as C
from argosift.functions import severity as S, text as X, times as T
from argosift.operators.baseline import STD_FLOOR, explain_sql
from argosift.operators.windows import prior_rows
from argosift.session import fence

DEVIATION_Z = 2.0
BURST_PER_MINUTE = 100.0


def _sum(terms: Sequence[Column]) -> Column:
    return sum(terms[1:], terms[0])


def statistical(df: DataFrame, features: Sequence[str], z_threshold: float = 3.0, min_samples: int = 100,
                extra_thresholds: Sequence[float] = ()) -> DataFrame:
    """Adds deviation columns and ``stat_score`` from a joined profile.

    The score is the mean |z| of the features beyond 2 deviations, over the
    threshold, at most 1. ``extra_thresholds`` add ``stat_score_<i>``.
    """
    floor, bound = f"{STD_FLOOR}D", f"{DEVIATION_Z}D"
    staged = df.selectExpr("*", f"coalesce(sample_count >= {int(min_samples)}, false) as _stable", *[
        f"({f} - mean__{f}) / greatest(std__{f}, {floor}) as _z_{f}" for f in features])
    over = {f: f"(_stable and abs(_z_{f}) > {bound})" for f in features}
    summed = staged.selectExpr(
        "*", " + ".join(f"if({over[f]}, 1, 0)" for f in features) + " as _n",
        " + ".join(f"if({over[f]}, abs(_z_{f}), 0D)" for f in features) + " as _sum")

    def score(threshold: float) -> str:
        return f"if(_n > 0, least(_sum / _n / {float(threshold)}D, 1D), 0D)"

    def listed(items: list[str]) -> str:
        return f"array_compact(array({', '.join(items)}))"

    names = listed([f"if({over[f]}, '{f}', null)" for f in features])
    shares = listed([f"if({over[f]}, abs(_z_{f}) / {float(z_threshold)}D, null)" for f in features])
    reasons = listed([f"if({over[f]} and abs(_z_{f}) > {float(z_threshold)}D, {explain_sql(f, f'_z_{f}')}, null)"
                      for f in features])
    extra = [f"{score(t)} as stat_score_{i}" for i, t in enumerate(extra_thresholds)]
    out = summed.selectExpr("*", f"{names} as deviating", f"{reasons} as stat_reasons",
                            f"map_from_arrays({names}, {shares}) as contributions",
                            f"{score(z_threshold)} as stat_score", *extra)
    profile_cols = [c for c in out.columns if c.split("__")[0] in ("mean", "std", "min", "max") and "__" in c]
    return out.drop("_n", "_sum", "_stable", *[f"_z_{f}" for f in features], *profile_cols)


def pattern_rules(source_type: str) -> list[tuple[Column, Column | float, Column | str]]:
    """(test, score, reason) of the fixed pattern checks of a source type."""
    c = F.col
    if source_type == "log":
        return [
            (c("max_pattern_score") > 0.8, c("max_pattern_score"), "High-severity pattern detected in log"),
            (c("pattern_count") >= 3, 0.7,
             F.format_string("Multiple suspicious patterns (%d)", c("pattern_count").cast("int"))),
            (c("entropy") > 0.9, 0.6, "High entropy suggests obfuscated content"),
        ]
    if source_type == "process":
        return [
            (c("is_suspicious_name") > 0, 0.8, "Process name matches known attack tool"),
            (c("has_encoded_data") > 0, 0.7, "Process has encoded/obfuscated arguments"),
            ((c("is_root") > 0) & (c("has_shell_operators") > 0), 0.6, "Root process with shell operators"),
        ]
    if source_type == "network":
        return [
            ((c("is_high_port") > 0) & (c("is_remote_public") > 0), 0.5,
             "Connection to public IP on high port (possible C2)"),
            (c("is_suspicious_process") > 0, 0.8, "Network activity from suspicious process"),
            (c("bytes_sent_normalized") > 0.8, 0.5, "Large outbound data transfer"),
        ]
    return [(c("overall_stress") > 0.8, 0.6, "System resource stress detected")]


def pattern(df: DataFrame, source_type: str) -> DataFrame:
    """Adds ``pattern_score`` (largest applicable score) and ``pattern_reasons``."""
    rules = pattern_rules(source_type)
    scores = [F.when(t, s if isinstance(s, Column) else F.lit(s)).otherwise(0.0) for t, s, _ in rules]
    return fence(df.withColumns({
        "pattern_score": F.greatest(*scores, F.lit(0.0)),
        "pattern_reasons": X.labels((t, r) for t, _, r in rules),
    }), "pattern_score")


def burst_rate(df: DataFrame, keys: Sequence[str] = ("source_type",), ts: str = "ts", tie: str = "event_id",
               history: int = 100, at_least: int = 10) -> DataFrame:
    """Adds ``events_per_minute`` over the key's last ``history`` earlier rows.

    Null when fewer than ``at_least`` exist or no time has passed.
    """
    seen = prior_rows(df, keys, ts, tie, history)
    span = (T.micros(F.col(ts)) - T.micros(F.col("prior_first"))) / F.lit(1_000_000.0)
    rate = F.when((F.col("prior_count") >= at_least) & (span > 0), F.col("prior_count") / span * 60.0)
    return seen.withColumn("events_per_minute", rate)


def temporal(df: DataFrame) -> DataFrame:
    """Adds ``temporal_score``/``temporal_reasons`` from business hours and burst rate."""
    off_hours = F.col("is_business_hours") == 0
    burst = F.coalesce(F.col("events_per_minute") > BURST_PER_MINUTE, F.lit(False))
    severe = F.coalesce(F.col("severity_score") > 0.5, F.lit(False)) if "severity_score" in df.columns else F.lit(False)
    base = F.when(off_hours, 0.2).otherwise(0.0)
    return df.withColumns({
        "temporal_score": F.least(F.when(burst, F.greatest(base, F.lit(0.7))).otherwise(base), F.lit(1.0)),
        "temporal_reasons": X.labels([
            (off_hours & severe, "High-severity event outside business hours"),
            (burst, F.concat(F.lit("High event frequency ("), X.fixed(F.col("events_per_minute"), 0), F.lit("/min)"))),
        ]),
    })


def weighted(scores: dict[str, Column]) -> Column:
    """Weighted mean of method scores; a null score drops out of both sums."""
    w = C.METHOD_WEIGHTS
    top = _sum([F.coalesce(s * F.lit(w[m]), F.lit(0.0)) for m, s in scores.items()])
    below = _sum([F.when(s.isNotNull(), w[m]).otherwise(0.0) for m, s in scores.items()])
    return F.when(below > 0, top / below).otherwise(0.0)


def _methods(stat: str) -> dict[str, Column]:
    isolation = F.when(F.col("isolation_score") > 0, F.col("isolation_score"))
    return {"statistical": F.col(stat), "isolation_forest": isolation, "pattern": F.col("pattern_score"),
            "temporal": F.col("temporal_score")}


def combine(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Adds anomaly_score, severity, is_anomaly and reasons from the method columns."""
    if "isolation_score" not in df.columns:
        df = df.withColumn("isolation_score", F.lit(None).cast("double"))
    iso = X.labels([(F.col("isolation_score") > 0.5,
                     F.concat(F.lit("Isolated pattern (score: "), X.fixed(F.col("isolation_score"), 2), F.lit(")")))])
    scored = fence(df.withColumn("anomaly_score", weighted(_methods("stat_score"))), "anomaly_score")
    return scored.withColumns({
        "anomaly_severity": S.anomaly_severity(F.col("anomaly_score")),
        "is_anomaly": F.col("anomaly_score") >= threshold,
        "reasons": F.concat("stat_reasons", iso, "pattern_reasons", "temporal_reasons"),
    })


def score_methods(df: DataFrame, source_type: str, features: Sequence[str], z_threshold: float = 3.0,
                  min_samples: int = 100, extra_thresholds: Sequence[float] = (),
                  burst_keys: Sequence[str] = ("source_type",)) -> DataFrame:
    """Statistical, pattern and temporal columns for feature rows joined with their profile.

    Burst rates are added here unless ``df`` has them; computing them on the raw rows
    before feature extraction shuffles less.
    """
    rows = df if "events_per_minute" in df.columns else burst_rate(df, burst_keys)
    scored = statistical(rows, features, z_threshold, min_samples, extra_thresholds)
    return temporal(pattern(scored, source_type))


def detect(df: DataFrame, source_type: str, features: Sequence[str], z_threshold: float = 3.0,
           threshold: float = 0.6, min_samples: int = 100) -> DataFrame:
    """Combined detection over feature rows joined with their profile."""
    return combine(score_methods(df, source_type, features, z_threshold, min_samples), threshold)


def ensemble(df: DataFrame, source_type: str, features: Sequence[str], detectors=C.ENSEMBLE, voting: float = 0.5,
             min_samples: int = 100) -> DataFrame:
    """Vote of several (z threshold, score threshold) detectors, computed side by side in one row."""
    z_values = [z for z, _ in detectors]
    scored = score_methods(df, source_type, features, min(z_values), min_samples, z_values)
    if "isolation_score" not in scored.columns:
        scored = scored.withColumn("isolation_score", F.lit(None).cast("double"))
    scored = scored.withColumns({f"_s{i}": weighted(_methods(f"stat_score_{i}")) for i in range(len(detectors))})
    parts = [F.col(f"_s{i}") for i in range(len(detectors))]
    votes = _sum([F.when(p >= t, 1).otherwise(0) for p, (_, t) in zip(parts, detectors)])
    ranks = [S.severity_rank(S.anomaly_severity(p)) for p in parts]
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    summed = scored.withColumns({
        "votes": votes,
        "vote_fraction": votes / F.lit(float(len(detectors))),
        "anomaly_score": _sum(parts) / F.lit(float(len(detectors))),
        "max_score": best,
    })
    out = fence(summed, "votes", "vote_fraction", "anomaly_score", "max_score").withColumn("is_anomaly", F.col("vote_fraction") >= voting)
    return out.withColumns({
        "anomaly_severity": S.severity_of_rank(F.when(F.col("is_anomaly"), top).otherwise(ranks[0])),
        "reasons": F.array_distinct(F.concat("stat_reasons", "pattern_reasons", "temporal_reasons")),
    }).drop(*[f"_s{i}" for i in range(len(detectors))], *[f"stat_score_{i}" for i in range(len(detectors))])


def vote(results: DataFrame, key: str = "event_id", voting: float = 0.5) -> DataFrame:
    """Ensemble over detector rows (any detectors): one row per event.

    ``results`` has key, detector, score, is_anomaly, reason_list, contributions.
    Rows per event are as many as there are detectors.
    """
    merged = results.groupBy(key).agg(
        F.count(F.lit(1)).alias("detectors"),
        F.count_if("is_anomaly").alias("votes"),
        F.avg("score").alias("anomaly_score"), F.max("score").alias("max_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reason_list")))).alias("reasons"),
        F.flatten(F.collect_list(F.map_entries("contributions"))).alias("_parts"))
    names = F.array_distinct(F.transform("_parts", lambda e: e["key"]))
    best = F.transform(names, lambda n: F.array_max(F.transform(
        F.filter("_parts", lambda e: e["key"] == n), lambda e: e["value"])))
    return merged.withColumns({
        "vote_fraction": F.col("votes") / F.col("detectors"),
        "contributions": F.map_from_arrays(names, best),
    }).withColumn("is_anomaly", F.col("vote_fraction") >= voting).drop("_parts")


def top_contributions(contributions: Column, n: int = 5) -> Column:
    """The ``n`` largest entries of a contribution map, ties by name, as ``name=value`` texts."""
    order = F.array_sort(
        F.map_entries(contributions),
        lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
        .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.transform(F.slice(order, 1, n), lambda e: F.concat(e["key"], F.lit("="), X.fixed(e["value"], 2)))
