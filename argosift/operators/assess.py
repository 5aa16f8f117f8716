"""Threat assessments, response plans, feedback, thresholds and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from argosift import constants as C
from argosift.functions import severity as S, text as X


def _texts(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


# --- assessments ---------------------------------------------------------------------

LAYOUT = ["subject_id", "ts", "kind", "threat_level", "confidence", "summary", "indicators", "assets",
          "techniques", "actions"]


def assess_anomalies(df: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Assessment rows of anomalies with score at least ``minimum``."""
    st, score, sev = F.col("source_type"), F.col("anomaly_score"), F.col("anomaly_severity")
    by_severity = (F.when(sev == "critical", _texts(C.ASSESS_ACTIONS["critical"]))
                   .when(sev == "high", _texts(C.ASSESS_ACTIONS["high"])).otherwise(_texts(C.ASSESS_ACTIONS["other"])))
    by_source = X.labels((st == k, v) for k, v in C.ASSESS_SOURCE_ACTION.items())
    techniques = X.first_label(((st == k, _texts(v)) for k, v in C.ASSESS_TECHNIQUES.items()), _texts([]))
    return df.where(score >= minimum).select(
        F.col("event_id").cast("string").alias("subject_id"), "ts", F.lit("anomaly").alias("kind"),
        S.threat_level(score).alias("threat_level"), F.least(score + 0.1, F.lit(1.0)).alias("confidence"),
        F.concat(F.lit("Anomaly detected in "), st, F.lit(" data")).alias("summary"),
        F.col("reasons").alias("indicators"),
        F.when(st == "process", _texts(["Local System"])).otherwise(_texts([])).alias("assets"),
        techniques.alias("techniques"), F.concat(by_severity, by_source).alias("actions"))


def assess_patterns(df: DataFrame, minimum: float = 0.5, rules=C.RULES) -> DataFrame:
    actions = X.first_label(((F.col("rule_id") == r.rule_id, _texts(r.actions)) for r in rules), _texts([]))
    return df.where(F.col("rule_severity") >= minimum).select(
        F.concat_ws(":", F.col("event_id").cast("string"), "rule_id").alias("subject_id"), "ts",
        F.lit("pattern").alias("kind"), S.threat_level(F.col("rule_severity")).alias("threat_level"),
        F.col("confidence"), F.concat(F.lit("Pattern detected: "), F.col("rule_name")).alias("summary"),
        F.col("evidence").alias("indicators"), _texts([]).alias("assets"),
        F.split("techniques", ",").alias("techniques"), actions.alias("actions"))


def assess_correlations(df: DataFrame, minimum: float = 0.5) -> DataFrame:
    score = F.col("correlation_score")
    return df.where(score >= minimum).select(
        F.col("correlation_id").alias("subject_id"), "ts", F.lit("correlation").alias("kind"),
        S.threat_level(score).alias("threat_level"), score.alias("confidence"),
        F.concat(F.lit("Event correlation: "), F.col("correlation_type")).alias("summary"),
        F.array("description").alias("indicators"),
        F.when(F.col("entity") != "", F.array("entity")).otherwise(_texts([])).alias("assets"),
        _texts([]).alias("techniques"), _texts(C.CORRELATION_ACTIONS).alias("actions"))


def assess_chains(df: DataFrame, keys: Sequence[str] = ("host_id",), tie: Column | None = None) -> DataFrame:
    text = F.format_string("Attack chain detected: %s (%d stages)", "chain", "stages")
    return df.select(
        F.concat_ws(":", *keys, "chain", (F.col("event_id") if tie is None else tie).cast("string")).alias("subject_id"),
        F.col("ts"), F.lit("attack_chain").alias("kind"), F.lit("high").alias("threat_level"),
        F.col("correlation_score").alias("confidence"), text.alias("summary"), F.array(text).alias("indicators"),
        F.array(*keys).alias("assets"), _texts(["Multi-stage attack"]).alias("techniques"),
        _texts(C.CHAIN_ACTIONS).alias("actions"))


def detail_text() -> Column:
    """Multi-line description of an anomaly: scores, top contributions and reasons."""
    from argosift.operators.anomaly import top_contributions
    head = F.concat(F.lit("Anomaly in "), F.col("source_type"), F.lit(" at "), F.col("ts").cast("string"),
                    F.lit(", score "), X.fixed(F.col("anomaly_score"), 2), F.lit(" ("), F.col("anomaly_severity"),
                    F.lit(")"))
    return F.concat_ws("\n", head, F.array_join(top_contributions(F.col("contributions")), "\n"),
                       F.array_join("reasons", "\n"))


def threat_rows(df: DataFrame, message: str = "message") -> DataFrame:
    """Critical and high log lines as threats with type, confidence and a shortened message."""
    m = F.col(message)
    urgent = [w for name, words in C.TRIAGE_WORDS if name in ("critical", "high") for w in words]
    marked = df.where(X.contains_any_once(F.lower(m), urgent)).withColumn("threat_severity", S.triage_severity(m))
    return marked.withColumns({
        "threat_type": S.threat_type(m),
        "confidence": F.when(F.col("threat_severity") == "critical", 0.95).otherwise(0.75),
        "short_message": F.substring(m, 1, 200),
        "risk_assessment": F.when(F.col("threat_severity") == "critical", "High").otherwise("Medium")})


# --- response plans --------------------------------------------------------------------

def plan_responses(assessments: DataFrame, allowed: Sequence[str] = ("log_event", "alert_admin", "block_ip"),
                   protected: Sequence[str] = C.PROTECTED_TARGETS, approval_at: float = 0.8) -> DataFrame:
    """Planned actions, nothing is carried out: always a log entry, an alert for high and
    critical levels, and a block per address named in an address indicator.

    Kinds outside ``allowed`` become log entries; protected addresses are left alone.
    """
    address_texts = F.filter("indicators", lambda t: F.lower(t).contains("ip"))
    found = F.flatten(F.transform(address_texts, lambda t: F.regexp_extract_all(t, F.lit(C.IP_ADDRESS), F.lit(0))))
    blocks = F.array_distinct(F.filter(found, lambda ip: ~ip.isin(list(protected))))

    def action(kind: str, target: Column) -> Column:
        return F.struct(F.lit(kind if kind in allowed else "log_event").alias("action_type"), target.alias("target"))

    alert = F.when(F.col("threat_level").isin("high", "critical"), action("alert_admin", F.lit("admin_team")))
    planned = F.array_compact(F.array(action("log_event", F.lit("security_log")), alert))
    if "block_ip" in allowed:
        planned = F.concat(planned, F.transform(blocks, lambda ip: action("block_ip", ip)))
    rows = assessments.select("subject_id", "ts", "threat_level", "confidence", F.posexplode(planned).alias("n", "a"))
    wait = F.col("confidence") >= approval_at
    return rows.select("subject_id", "ts", F.concat_ws("-", "subject_id", F.col("n").cast("string")).alias("action_id"),
                       "a.action_type", "a.target", wait.alias("requires_approval"),
                       F.when(wait, "requires_approval").otherwise("pending").alias("status"))


def action_state(log: DataFrame, key: str = "action_id", ts: str = "ts", tie: str = "entry_id") -> DataFrame:
    """Latest status per action from an append-only action log."""
    return log.groupBy(key).agg(F.max_by("status", F.struct(ts, tie)).alias("status"), F.max(ts).alias("updated"))


def rollback_rows(actions: DataFrame) -> DataFrame:
    """Inverse of every completed block or disable action."""
    undo = actions.where(F.col("action_type").isin("block_ip", "disable_user") & (F.col("status") == "completed"))
    return undo.select(F.concat(F.col("action_id"), F.lit("-ROLLBACK")).alias("action_id"), "action_type", "target",
                       F.when(F.col("action_type") == "block_ip", "unblock").otherwise("enable").alias("operation"))


def overlay_status(threats: DataFrame, status_log: DataFrame, key: str = "threat_id") -> DataFrame:
    """Threats with their latest status; dismissed ones are dropped."""
    latest = status_log.groupBy(key).agg(F.max_by("status", F.struct("ts", "entry_id")).alias("status"))
    joined = threats.join(latest, key, "left").withColumn("status", F.coalesce("status", F.lit("open")))
    return joined.where(F.col("status") != "dismissed")


# --- feedback -----------------------------------------------------------------------------

def outcome(was_anomaly: Column, is_malicious: Column) -> Column:
    return (F.when(was_anomaly & is_malicious, "TP").when(was_anomaly & ~is_malicious, "FP")
            .when(~was_anomaly & ~is_malicious, "TN").when(~was_anomaly & is_malicious, "FN"))


def confusion(feedback: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Outcome counts with accuracy, precision, recall and F1 (0 when undefined)."""
    o = outcome(F.col("was_anomaly"), F.col("is_malicious"))
    n = feedback.groupBy(*keys).agg(F.count(F.lit(1)).alias("feedback"), *[
        F.count_if(o == k).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def share(top: Column, below: Column) -> Column:
        return F.coalesce(F.try_divide(top, below), F.lit(0.0))

    rated = n.withColumns({"accuracy": share(tp + tn, tp + fp + tn + fn), "precision": share(tp, tp + fp),
                           "recall": share(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", share(2 * p * r, p + r))


def adapt_threshold(metrics: DataFrame, current: float | Column, minimum_feedback: int = 20) -> DataFrame:
    """Next anomaly threshold: up on low precision, down on low recall, else unchanged."""
    now = current if isinstance(current, Column) else F.lit(current)
    up = (F.col("precision") < 0.7) & (F.col("fp") > 10)
    down = (F.col("recall") < 0.7) & (F.col("fn") > 10)
    moved = F.when(up, F.least(now + 0.05, F.lit(0.95))).when(down, F.greatest(now - 0.05, F.lit(0.3))).otherwise(now)
    return metrics.withColumns({
        "old_threshold": now, "new_threshold": F.when(F.col("feedback") < minimum_feedback, now).otherwise(moved)})


def latest(log: DataFrame, keys: Sequence[str], value: str, ts: str, tie: str) -> DataFrame:
    """Latest value per key."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias(ts))


# --- alerts ---------------------------------------------------------------------------------

ALERT_LAYOUT = ["alert_id", "ts", "alert_type", "severity", "message"]


def alert_rows(df: DataFrame, kind: str, key: Column, ts: Column, message: Column, severity: Column) -> DataFrame:
    """Alerts in the common layout."""
    return df.select(F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("alert_id"), ts.alias("ts"),
                     F.lit(kind).alias("alert_type"), severity.alias("severity"), message.alias("message"))


def anomaly_alerts(df: DataFrame) -> DataFrame:
    score = F.col("anomaly_score")
    return alert_rows(df.where("is_anomaly"), "anomaly_detected", F.col("event_id"), F.col("ts"),
                      F.concat(F.lit("Anomaly in "), F.col("source_type"), F.lit(" (score: "), X.fixed(score, 2), F.lit(")")),
                      F.when(score > 0.8, "high").otherwise("medium"))


def threat_alerts(threats: DataFrame) -> DataFrame:
    return alert_rows(threats, "threat_detected", F.col("event_id"), F.col("ts"),
                      F.concat(F.lit("Threat: "), F.col("threat_type")), F.lit("high"))


def brute_force_alerts(windows: DataFrame, source: str) -> DataFrame:
    return alert_rows(windows, "brute_force", F.concat_ws("@", source, F.col("window_start").cast("string")),
                      F.col("window_start"), F.concat(F.lit("Multiple failed attempts from "), F.col(source),
                                                      F.lit(" ("), F.col("failures").cast("string"),
                                                      F.lit(" attempts)")), F.lit("high"))


def escalation_alerts(auth_rows: DataFrame) -> DataFrame:
    hits = auth_rows.where(F.col("action") == "privilege_escalation")
    return alert_rows(hits, "privilege_escalation", F.col("event_id"), F.col("ts"), F.concat(
        F.lit("User '"), F.col("username"), F.lit("' attempted: "), F.col("command")), F.lit("critical"))


def tampering_alerts(rep: DataFrame, ts: Column) -> DataFrame:
    """One alert for a report that needs one."""
    from argosift.operators.audit import should_alert
    return alert_rows(should_alert(rep), "tampering_detected", F.lit("audit"), ts, F.format_string(
        "tampered=%d missing=%d", "tampered", "missing"), F.when(~F.col("chain_valid"), "critical").otherwise("high"))


def integrity_alerts(issues: DataFrame, ts: Column) -> DataFrame:
    return alert_rows(issues, "integrity_violation", F.col("record_id"), ts, F.col("message"), F.lit("critical"))


def alert_members(members: DataFrame, events: DataFrame) -> DataFrame:
    """Events belonging to alerts, through rows of (alert_id, event_id)."""
    return members.join(events, "event_id")
