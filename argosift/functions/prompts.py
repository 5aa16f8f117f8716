"""Analyst question texts built from a row. Text only; nothing is sent anywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Answer fields asked for, by question kind.
ANSWER_FIELDS = {
    "log": ["classification", "severity", "explanation", "indicators", "recommended_actions"],
    "threat": ["threat_level", "confidence", "threat_type", "indicators_of_compromise", "attack_technique",
               "reasoning", "recommended_response"],
    "anomaly": ["is_anomaly", "anomaly_score", "deviations", "possible_causes", "risk_assessment",
                "investigation_steps"],
    "correlation": ["correlations_found", "correlation_groups", "attack_chain", "summary", "recommended_actions"],
    "hunt": ["threat_level", "findings", "indicators_of_compromise", "recommended_actions"],
}
TASKS = {
    "log": "Classify this log entry and rate its severity.",
    "threat": "Rate the threat level of this security event.",
    "anomaly": "Explain how this event departs from its baseline.",
    "correlation": "Find time, cause and attack-stage relations between these events.",
    "hunt": "Search these logs for attacks and list every indicator of compromise.",
}


def question(kind: str, body: Column, context: Column | None = None) -> Column:
    """Task, body, optional context and the JSON fields of the answer."""
    parts = [F.lit(TASKS[kind]), F.concat(F.lit("Data: "), body)]
    if context is not None:
        parts.append(F.concat(F.lit("Context: "), context))
    parts.append(F.lit("Answer as JSON with: " + ", ".join(ANSWER_FIELDS[kind])))
    return F.concat_ws("\n", *parts)
