"""Summary, assessment, response, feedback and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosift import constants as C
from argosift.functions import severity as S
from argosift.operators import assess as Z, audit as AU, correlate as K, detect as D, parse as L, report as R
from argosift.plans import sqltext as Q
from argosift.plans.q_anomaly import _ctes, _detect_sql, _detected
from argosift.plans.q_audit import _BOTH, _REPORT, _STATUS_VIEW, _statuses
from argosift.plans.q_correlate import (_ENTITIES, _FREQ, _MIXED, _SCORED, _TEMPORAL, _THREE, _chains_sql, chain_anomalies,
                                        _rule_hits, entity_events, mixed, scored_events)
from argosift.plans.q_parse import _auth_sql
from argosift.plans.registry import query
from argosift.plans.views import Inputs, with_views

_LEVELED = f"select *, {Q.LEVEL} as level from sec_log"
_PATTERN_COUNTS = " union all ".join(
    f"select '{n}' as pattern, count_if(regexp_matches(message, {Q.q(p)}, 'i'))::bigint as lines from sec_log"
    for n, p, _ in C.LOG_PATTERNS)


def leveled(t: Inputs):
    return t.sec_log().withColumn("level", S.log_level(F.col("message")))


@query("d1_log_summary", with_views(
    """select 'level' as dimension, level as value, count(*)::bigint as lines from leveled group by level
       union all select 'source', source, count(*)::bigint from leveled group by source
       union all select 'total', '', count(*)::bigint from leveled
       union all select 'pattern', pattern, lines from pats where lines>0""", "sec_log",
    ctes={"leveled": _LEVELED, "pats": _PATTERN_COUNTS}))
def log_summary(t: Inputs):
    return R.log_summary(leveled(t))


@query("f2_top_patterns", with_views(
    """select pattern, lines, case when pattern in ('OUT_OF_MEMORY','KERNEL_PANIC','MALWARE_SIGNATURE','BRUTE_FORCE') then
         'Critical' when pattern in ('SSH_FAILED_LOGIN','AUTHENTICATION_FAILURE','PRIVILEGE_ESCALATION') then 'Warning'
         else 'Info' end as severity from pats where lines>0 order by lines desc, pattern limit 10""", "sec_log",
    ctes={"pats": _PATTERN_COUNTS}))
def top_patterns(t: Inputs):
    return R.top_patterns(t.sec_log())


@query("e9_last_per_level", with_views(
    """select event_id, level, substr(message,1,100) as message from (select *, row_number() over (partition by level
         order by ts desc, event_id desc) as r from leveled where level in ('error','warning','critical')) where r<=50""",
    "sec_log", ctes={"leveled": _LEVELED}))
def last_per_level(t: Inputs):
    return R.last_per_level(leveled(t)).select("event_id", "level", F.substring("message", 1, 100).alias("message"))


@query("d11_severity_distribution", with_views(
    f"""select count_if(s='critical')::bigint as critical, count_if(s='high')::bigint as high,
          count_if(s='medium')::bigint as medium, count_if(s='low')::bigint as low,
          count_if(s in ('critical','high'))::bigint as active_threats from (select {Q.TRIAGE} as s from sec_log)""",
    "sec_log"))
def severity_distribution(t: Inputs):
    return R.severity_distribution(t.sec_log(), S.triage_severity(F.col("message")))


@query("d12_timeline", with_views(
    f"""select cast(cast(date_trunc('hour', ts) as timestamp) as varchar) as slot, count(*)::bigint as events,
          count_if({Q.TRIAGE} in ('critical','high'))::bigint as threats from sec_log group by 1""", "sec_log"))
def timeline(t: Inputs):
    return R.timeline(t.sec_log()).withColumn("slot", F.col("slot").cast("string"))


@query("d12_dashboard", with_views(
    f"""select active_threats, log_count, round(cpu,6) as cpu, case when cpu<80 and active_threats<10 then 'Good'
          when active_threats>20 then 'Critical' else 'Warning' end as health_status from
        (select count_if({Q.TRIAGE} in ('critical','high'))::bigint as active_threats from sec_log),
        (select count(*)::bigint as log_count from audit_log), (select avg(cpu_percent) as cpu from metric_base)""",
    "sec_log", "audit_log", "metric_base"))
def dashboard(t: Inputs):
    row = R.single_row(
        R.severity_distribution(t.sec_log(), S.triage_severity(F.col("message"))).select("active_threats"),
        t.audit_log(numbered=False).agg(F.count(F.lit(1)).alias("log_count")),
        t.metric_sample().agg(F.avg("cpu_percent").alias("cpu")))
    return row.select("active_threats", "log_count", F.round("cpu", 6).alias("cpu"),
                      R.health_status(F.col("active_threats"), F.col("cpu")).alias("health_status"))


_REPORT_ROW = f"""select avg(cpu_percent) as cpu_percent, avg(memory_percent) as memory_percent,
    max(disk_percent) as disk_percent, (select count_if(level='critical') from leveled) as criticals,
    (select count_if(level='error') from leveled) as errors, (select tampered from rep) as tampered,
    (select missing from rep) as missing,
    (select count_if(regexp_matches(message, {Q.q(C.LOG_PATTERNS[0][1])}, 'i')) from sec_log) as ssh_failed,
    (select count_if(regexp_matches(message, {Q.q(C.LOG_PATTERNS[13][1])}, 'i')) from sec_log) as brute_force,
    (select count_if(regexp_matches(message, {Q.q(C.LOG_PATTERNS[12][1])}, 'i')) from sec_log) as malware
  from metric_base"""
_REPORT_CTES = {"leveled": _LEVELED, **_STATUS_VIEW, "rep": _REPORT, "row1": _REPORT_ROW}


def report_row(t: Inputs):
    m = F.col("message")
    logs = leveled(t).agg(F.count_if(F.col("level") == "critical").alias("criticals"),
                          F.count_if(F.col("level") == "error").alias("errors"),
                          *[F.count_if(m.rlike("(?i)" + C.LOG_PATTERNS[i][1])).alias(n)
                            for i, n in ((0, "ssh_failed"), (13, "brute_force"), (12, "malware"))])
    metrics = t.metric_sample().agg(F.avg("cpu_percent").alias("cpu_percent"),
                                    F.avg("memory_percent").alias("memory_percent"),
                                    F.max("disk_percent").alias("disk_percent"))
    return R.single_row(logs, metrics, AU.report(_statuses(t)).select("tampered", "missing"))


@query("d10_risk_score", with_views(
    """select score::bigint as risk_score, case when score>=10 then 'CRITICAL' when score>=5 then 'WARNING' when score>=2
         then 'CAUTION' else 'HEALTHY' end as risk_status from (select
         case when cpu_percent>90 then 2 when cpu_percent>75 then 1 else 0 end
         +case when memory_percent>90 then 2 when memory_percent>75 then 1 else 0 end
         +case when disk_percent>90 then 3 when disk_percent>75 then 1 else 0 end
         +case when criticals>0 then 5 else 0 end+case when errors>10 then 2 else 0 end
         +case when tampered>0 then 10 else 0 end+case when missing>0 then 8 else 0 end as score from row1)""",
    "sec_log", *_BOTH, "metric_base", ctes=_REPORT_CTES))
def risk_score(t: Inputs):
    return R.risk_score(report_row(t)).select("risk_score", "risk_status")


@query("k17_report_advice", with_views(
    "select " + Q.joined([("cpu_percent>80", "'cpu_high'"), ("memory_percent>80", "'memory_high'"),
                          ("disk_percent>85", "'disk_low'"), ("criticals>0", "'critical_events'"),
                          ("errors>50", "'many_errors'"), ("ssh_failed>5", "'ssh_failures'"),
                          ("brute_force>0", "'brute_force'"), ("malware>0", "'malware'"),
                          ("tampered>0", "'tampering'"), ("missing>0", "'missing_records'")]) + " as advice from row1",
    "sec_log", *_BOTH, "metric_base", ctes=_REPORT_CTES))
def report_advice(t: Inputs):
    return R.advice(report_row(t)).select(F.array_join("advice", ",").alias("advice"))


@query("d21_collection_counts", with_views(
    """select host_id, source, event_type, count(*)::bigint as events from sec_log group by 1,2,3""", "sec_log"))
def collection_counts(t: Inputs):
    return R.counts_by(t.sec_log(), "host_id", "source", "event_type")


@query("f6_last_events", with_views(
    "select event_id, severity from sec_log order by ts desc, event_id desc limit 100", "sec_log"))
def last_events(t: Inputs):
    return R.recent(t.sec_log(), 100).select("event_id", "severity")


@query("f9_recent_alerts", with_views(
    "select event_id, message from sec_log where severity='error' order by ts desc, event_id desc limit 10", "sec_log"))
def recent_alerts(t: Inputs):
    return R.recent(t.sec_log(), 10, severity="error").select("event_id", "message")


@query("f5_backlog", with_views(
    f"""select event_id, severity from (select d.*, e.ts from ({_detect_sql('network', 0.35)}) d join net_conn e using
        (event_id)) order by case severity when 'critical' then 3 when 'high' then 2 when 'medium' then 1 else 0 end desc,
        ts, event_id limit 50""", "net_conn"))
def backlog(t: Inputs):
    rows = _detected(t, "network", 0.35)
    return R.backlog(rows).select("event_id", F.col("anomaly_severity").alias("severity"))


@query("g3_distinct_threats", with_views(
    f"select distinct {Q.words_case('message', C.THREAT_TYPES, C.THREAT_DEFAULT)} as threat from sec_log", "sec_log"))
def distinct_threats(t: Inputs):
    return t.sec_log().select(S.threat_type(F.col("message")).alias("threat")).distinct()


_PORTS_SQL = Q.ports("message")


@query("k24_indicators", with_views(
    f"""select kind, value, count(*)::bigint as events, cast(min(ts) as varchar) as first_seen, cast(max(ts) as varchar)
          as last_seen, array_to_string(list_sort(list(distinct source)), ',') as sources from (
          select ts, source, 'ip' as kind, unnest(list_distinct({Q.extract_all('message', C.IP_ADDRESS)})) as value from auth
          union all select ts, source, 'port', unnest(list_distinct({_PORTS_SQL})) from auth
          union all select ts, source, 'file', unnest(list_distinct({Q.extract_all('message', C.PATH_MENTION)})) from auth
          union all select ts, source, 'user', username from auth where username is not null) group by 1,2""",
    "sec_log", ctes={"src": "select * from sec_log", "auth": _auth_sql("message")}))
def indicators(t: Inputs):
    rows = R.indicators_of_compromise(L.auth_fields(t.sec_log()))
    return rows.select("kind", "value", "events", F.col("first_seen").cast("string").alias("first_seen"),
                       F.col("last_seen").cast("string").alias("last_seen"), "sources")


# --- assessments and responses ---------------------------------------------------------------

_LEVEL_OF = ("case when {x}>=0.9 then 'critical' when {x}>=0.7 then 'high' when {x}>=0.5 then 'medium' when {x}>=0.3 "
             "then 'low' else 'none' end")
_ASSESS_CTES = {"mixed": _MIXED, "ent": _ENTITIES, "freq": _FREQ, "temporal": _TEMPORAL, **_SCORED,
                "hits": _rule_hits("process"), "chains": _chains_sql(False)}


def assessments(t: Inputs):
    """Assessment rows of rule hits, correlations and chains."""
    pats = Z.assess_patterns(D.match_rules(t.proc(), "process", ["cmdline", "name"]))
    corr = Z.assess_correlations(K.records(K.temporal(mixed(t), seconds=3600),
                                           K.entity_frequency(entity_events(t), seconds=3600)))
    chains = Z.assess_chains(K.attack_chains(chain_anomalies(t), tie="event_key"),
                             tie=F.concat_ws("/", "event_key.source_type", F.col("event_key.event_id").cast("string")))
    return pats.unionByName(corr).unionByName(chains)


@query("k14_assessments", with_views(
    f"""select kind, threat_level, count(*)::bigint as assessments, round(avg(confidence),6) as confidence from (
          select 'pattern' as kind, {_LEVEL_OF.format(x='rule_severity')} as threat_level, 0.85::double as confidence
            from hits
          union all select 'correlation', {_LEVEL_OF.format(x='correlation_score')}, correlation_score from temporal
            where correlation_score>=0.5
          union all select 'correlation', {_LEVEL_OF.format(x='score')}, score::double from freq where score>=0.5
          union all select 'attack_chain', 'high', correlation_score from chains) group by 1,2""",
    *_THREE, ctes=_ASSESS_CTES))
def assessment_counts(t: Inputs):
    return assessments(t).groupBy("kind", "threat_level").agg(
        F.count(F.lit(1)).alias("assessments"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("k14_anomaly_assessments", with_views(
    f"""select event_id::varchar as subject_id, {_LEVEL_OF.format(x='anomaly_score')} as threat_level,
          round(least(anomaly_score+0.1,1.0),6)::double as confidence,
          'T1071 - Application Layer Protocol' as techniques, (case severity when 'critical' then 3 when 'high' then 3
            else 2 end + 1)::bigint as actions
        from ({_detect_sql('network', 0.35)}) where anomaly_score>=0.5""", "net_conn"))
def anomaly_assessments(t: Inputs):
    rows = _detected(t, "network", 0.35).withColumn("anomaly_score", F.round("anomaly_score", 6))
    return Z.assess_anomalies(rows).select(
        "subject_id", "threat_level", F.round("confidence", 6).alias("confidence"),
        F.array_join("techniques", ",").alias("techniques"), F.size("actions").cast("long").alias("actions"))


def _detail_sql(st: str, threshold: float) -> str:
    """Detail texts from the z-scores of every feature."""
    place = "list_position([" + ", ".join(f"'{f}'" for f in C.FEATURES[st]) + "], feature)"
    return f"""with {', '.join(f'{k} as ({v})' for k, v in _ctes(st).items())},
      shares as (select event_id, string_agg(feature||'='||printf('%.2f', share), chr(10) order by r) as texts from (
        select *, row_number() over (partition by event_id order by share desc, feature) as r from (
          select event_id, feature, abs(z)/3.0::double as share from z where abs(z)>2 and n>=100)) where r<=5 group by 1),
      marks as (select event_id, string_agg(feature||': '||case when z>0 then 'Higher' else 'Lower' end
          ||' than normal (value='||printf('%.3f', value)||', expected≈'||printf('%.3f', mean)||'±'
          ||printf('%.3f', greatest(std, 0.01))||')', chr(10) order by {place}) as texts from z
        where abs(z)>3 and n>=100 group by 1),
      found as ({_detect_sql(st, threshold)})
      select f.event_id, 'Anomaly in {st} at '||cast(x.ts as varchar)||', score '||printf('%.2f', f.anomaly_score)||' ('
        ||f.severity||')'||chr(10)||coalesce(shares.texts, '')||chr(10)||concat_ws(chr(10), marks.texts,
        case when is_high_port>0 and is_remote_public>0 then 'Connection to public IP on high port (possible C2)' end,
        case when is_suspicious_process>0 then 'Network activity from suspicious process' end,
        case when bytes_sent_normalized>0.8 then 'Large outbound data transfer' end) as detail
      from found f join feat x using (event_id) left join shares using (event_id) left join marks using (event_id)"""


@query("k14_detail_text", with_views(f"select * from ({_detail_sql('network', 0.35)})", "net_conn"))
def detail_text(t: Inputs):
    """Description of every scored connection, with its largest contributions and reasons."""
    return _detected(t, "network", 0.35).select("event_id", Z.detail_text().alias("detail"))


_PLAN_SRC = f"""select event_id::varchar||':C2-001' as subject_id, 0.75::double as confidence, remote_addr,
    not {Q.private_ip('remote_addr')} as is_public from net_conn where remote_port between 8080 and 8090
    or remote_port between 4443 and 4445 or remote_port between 9000 and 9999 or not {Q.private_ip('remote_addr')}"""


@query("k15_response_plan", with_views(
    """select subject_id, action_type, target, false as requires_approval from (
         select subject_id, 'log_event' as action_type, 'security_log' as target from plan_src
         union all select subject_id, 'block_ip', remote_addr from plan_src where is_public
           and remote_addr<>'203.0.113.7')""", "net_conn", ctes={"plan_src": _PLAN_SRC}))
def response_plan(t: Inputs):
    """Planned actions for connection rule hits; one address is protected."""
    hits = D.match_rules(t.net_conn(), "network", ["remote_port", "remote_addr"])
    plan = Z.plan_responses(Z.assess_patterns(hits), protected=[*C.PROTECTED_TARGETS, "203.0.113.7"])
    return plan.select("subject_id", "action_type", "target", "requires_approval")


_ACTIONS = """select event_id%5000 as action_id, ts, event_id as entry_id, case event_type when 'error' then 'failed'
  when 'purchase' then 'completed' when 'signup' then 'approved' else 'pending' end as status from events"""


def action_log(t: Inputs):
    return t.table("events").selectExpr(
        "event_id % 5000 as action_id", "ts", "event_id as entry_id",
        """case event_type when 'error' then 'failed' when 'purchase' then 'completed' when 'signup' then 'approved'
           else 'pending' end as status""")


@query("k21_action_state", with_views(
    "select action_id, max_by(status, entry_id) as status from acts group by 1", ctes={"acts": _ACTIONS}))
def action_state(t: Inputs):
    return Z.action_state(action_log(t)).select("action_id", "status")


@query("k21_rollbacks", with_views(
    """select action_id||'-ROLLBACK' as action_id, case when action_id%2=0 then 'unblock' else 'enable' end as operation from
       (select action_id, max_by(status, entry_id) as status from acts group by 1) where status='completed'""",
    ctes={"acts": _ACTIONS}))
def rollbacks(t: Inputs):
    state = Z.action_state(action_log(t)).select(
        F.col("action_id").cast("string").alias("action_id"), "status", F.lit("target").alias("target"),
        F.when(F.col("action_id") % 2 == 0, "block_ip").otherwise("disable_user").alias("action_type"))
    return Z.rollback_rows(state).select("action_id", "operation")


@query("k22_threat_status", with_views(
    f"""select event_id, coalesce(s.status,'open') as status from (select event_id, {Q.TRIAGE} as sev from sec_log) t
        left join (select event_id%4000 as threat_id, max_by(case event_type when 'view' then 'dismissed' when 'click' then
          'acknowledged' else 'open' end, event_id) as status from events where event_id%3=0 group by 1) s
          on s.threat_id=t.event_id
        where sev in ('critical','high') and coalesce(s.status,'open')<>'dismissed'""", "sec_log"))
def threat_status(t: Inputs):
    log = t.table("events").where("event_id % 3 = 0").selectExpr(
        "event_id % 4000 as threat_id", "ts", "event_id as entry_id",
        "case event_type when 'view' then 'dismissed' when 'click' then 'acknowledged' else 'open' end as status")
    threats = Z.threat_rows(t.sec_log()).withColumn("threat_id", F.col("event_id"))
    return Z.overlay_status(threats, log).select("event_id", "status")


# --- feedback -----------------------------------------------------------------------------------

_CONF = """select count(*)::bigint as feedback, count_if(a and m)::bigint as tp, count_if(a and not m)::bigint as fp,
  count_if(not a and not m)::bigint as tn, count_if(not a and m)::bigint as fn
  from (select was_anomaly as a, is_malicious as m from feedback)"""
_RATES = """select *, (tp+tn)/(tp+fp+tn+fn)::double as accuracy, case when tp+fp>0 then tp/(tp+fp)::double else 0 end
  as precision, case when tp+fn>0 then tp/(tp+fn)::double else 0 end as recall from conf"""


@query("c14_feedback_outcome", with_views(
    """select event_id, coalesce(case when was_anomaly and is_malicious then 'TP' when was_anomaly then 'FP'
         when is_malicious then 'FN' when not is_malicious then 'TN' end, '') as outcome
       from sec_log left join feedback using (event_id)""", "sec_log", "feedback"))
def feedback_outcome(t: Inputs):
    joined = t.sec_log().select("event_id").join(t.feedback(), "event_id", "left")
    return joined.select("event_id", F.coalesce(Z.outcome(F.col("was_anomaly"), F.col("is_malicious")), F.lit(""))
                         .alias("outcome"))


@query("d13_confusion", with_views(
    """select feedback, tp, fp, tn, fn, round(accuracy,6) as accuracy, round(precision,6)::double as precision,
         round(recall,6)::double as recall, round(case when precision+recall>0 then 2*precision*recall/(precision+recall)
         else 0 end,6)::double as f1 from rates""", "feedback", ctes={"conf": _CONF, "rates": _RATES}))
def confusion(t: Inputs):
    c = Z.confusion(t.feedback())
    return c.select("feedback", "tp", "fp", "tn", "fn", *[F.round(n, 6).alias(n) for n in
                                                          ("accuracy", "precision", "recall", "f1")])


@query("d14_recent_feedback", with_views(
    """select count(*)::bigint as recent, count_if(was_anomaly and is_malicious)::bigint as tp,
         count_if(was_anomaly and not is_malicious)::bigint as fp from (select * from feedback order by event_id desc
         limit 100)""", "feedback"))
def recent_feedback(t: Inputs):
    last = t.feedback().orderBy(F.desc("event_id")).limit(100)
    return Z.confusion(last).select(F.col("feedback").alias("recent"), "tp", "fp")


@query("k18_adaptive_threshold", with_views(
    """select 0.6::double as old_threshold, round(case when feedback<20 then 0.6 when precision<0.7 and fp>10 then
         least(0.65,0.95) when recall<0.7 and fn>10 then greatest(0.55,0.3) else 0.6 end,6)::double as new_threshold
       from rates""", "feedback", ctes={"conf": _CONF, "rates": _RATES}))
def adaptive_threshold(t: Inputs):
    rows = Z.adapt_threshold(Z.confusion(t.feedback()), 0.6)
    return rows.select("old_threshold", F.round("new_threshold", 6).alias("new_threshold"))


@query("e8_latest_threshold", """select user_id, max_by(value, event_id) as value from events group by user_id""")
def latest_threshold(t: Inputs):
    return Z.latest(t.table("events"), ["user_id"], "value", "ts", "event_id").select("user_id", "value")


@query("a13_threshold_history", with_views(
    "select user_id, max_by(value, event_id) as value, count(*)::bigint as entries from events group by user_id"))
def threshold_history(t: Inputs):
    """Threshold entries appended in two batches, then read back."""
    from argosift.session import new_path
    from argosift.sources import tables as TB
    path = new_path(t.spark, "thresholds")
    rows = t.table("events").select("user_id", "ts", "event_id", "value")
    TB.append_history(rows.where("event_id % 2 = 0"), path)
    TB.append_history(rows.where("event_id % 2 = 1"), path)
    stored = t.spark.read.parquet(path)
    counts = stored.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"))
    return Z.latest(stored, ["user_id"], "value", "ts", "event_id").select("user_id", "value").join(counts, "user_id")


# --- alerts -----------------------------------------------------------------------------------------

_ALERTS = f"""select 'threat_detected:'||event_id as alert_id, 'threat_detected' as alert_type, 'high' as severity,
    'Threat: '||{Q.words_case('message', C.THREAT_TYPES, C.THREAT_DEFAULT)} as message from sec_log
    where {Q.TRIAGE} in ('critical','high')
  union all select 'privilege_escalation:'||event_id, 'privilege_escalation', 'critical',
    'User '''||username||''' attempted: '||command from auth where action='privilege_escalation'
  union all select 'tampering_detected:audit', 'tampering_detected', 'high', 'tampered='||tampered||' missing='||missing
    from rep where tampered>0 or missing>0
  union all select 'integrity_violation:'||record_id, 'integrity_violation', 'critical', case status
    when 'missing_in_primary' then 'Record '||record_id||' was deleted from primary database' when 'missing_in_backup'
    then 'Record '||record_id||' exists in primary but not backup' else 'Record '||record_id||
    ' content was modified in primary' end from status_rows where status<>'valid'"""
_ALERT_CTES = {"src": "select * from sec_log", "auth": _auth_sql("message"), **_STATUS_VIEW, "rep": _REPORT}


def alerts(t: Inputs):
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    statuses = _statuses(t)
    return (Z.threat_alerts(Z.threat_rows(t.sec_log()))
            .unionByName(Z.escalation_alerts(L.auth_fields(t.sec_log())))
            .unionByName(Z.tampering_alerts(AU.report(statuses), now))
            .unionByName(Z.integrity_alerts(AU.issues(statuses), now)))


@query("k20_alert_rows", with_views(_ALERTS, "sec_log", *_BOTH, ctes=_ALERT_CTES))
def alert_rows(t: Inputs):
    return alerts(t).select("alert_id", "alert_type", "severity", "message")


@query("k20_brute_force_alerts", with_views(
    f"""select host_id, 'Multiple failed attempts from '||host_id||' ('||count(*)||' attempts)' as message from sec_log
        where {Q.contains_any('lower(message)', C.AUTH_FAILURE_WORDS)}
        group by host_id, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') having count(*)>=5""", "sec_log"))
def brute_force_alerts(t: Inputs):
    rows = Z.brute_force_alerts(D.brute_force(t.sec_log(), ["host_id"], "6 hours"), "host_id")
    return rows.select(F.regexp_extract("alert_id", r":(\S+)@", 1).alias("host_id"), "message")


@query("k20_anomaly_alerts", with_views(
    f"""select 'anomaly_detected:'||event_id as alert_id, 'Anomaly in network (score: '||printf('%.2f', anomaly_score)||')'
          as message, case when anomaly_score>0.8 then 'high' else 'medium' end as severity
        from (select event_id, round(anomaly_score,6) as anomaly_score from ({_detect_sql('network', 0.35)}) where is_anomaly)""",
    "net_conn"))
def anomaly_alerts(t: Inputs):
    rows = _detected(t, "network", 0.35).withColumn("anomaly_score", F.round("anomaly_score", 6))
    return Z.anomaly_alerts(rows).select("alert_id", "message", "severity")


@query("a15_alert_history", with_views(
    """select alert_id, severity from (select * from (select 'threat_detected:'||event_id as alert_id, 'high' as severity, ts
         from sec_log where """ + Q.TRIAGE + """ in ('critical','high')) order by ts desc, alert_id desc limit 10)""",
    "sec_log"))
def alert_history(t: Inputs):
    """Alerts written to the history table and the last ten read back."""
    from argosift.session import new_path
    from argosift.sources import tables as TB
    path = new_path(t.spark, "alerts")
    TB.append_history(Z.threat_alerts(Z.threat_rows(t.sec_log())), path)
    return TB.alert_history(t.spark, path, 10, "high").select("alert_id", "severity")


@query("c15_alert_members", with_views(
    f"""select host_id||'@'||cast(w as varchar) as alert_id, event_id, message from (select *,
          time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as w, count(*) over (partition by host_id,
          time_bucket(interval 6 hours, ts, timestamp '1970-01-01')) as n from sec_log
          where {Q.contains_any('lower(message)', C.AUTH_FAILURE_WORDS)}) where n>=5""", "sec_log"))
def alert_members(t: Inputs):
    """Alerts that list their failed logins, joined back to the events."""
    fails = t.sec_log().where(S.is_auth_failure(F.col("message"))).withColumn("alert_id", F.concat(
        "host_id", F.lit("@"), F.window("ts", "6 hours")["start"].cast("timestamp_ntz").cast("string")))
    raised = fails.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    # Members are rows, not lists: an alert may hold any number of events.
    members = fails.join(raised, "alert_id", "left_semi").select("alert_id", "event_id")
    return Z.alert_members(members, t.sec_log()).select("alert_id", "event_id", "message")


@query("a14_report_export", with_views(
    """select 'levels' as section, count(*)::bigint as records from (select distinct level from leveled)
       union all select 'sources', count(*)::bigint from (select distinct source from sec_log)""", "sec_log",
    ctes={"leveled": _LEVELED}))
def report_export(t: Inputs):
    """Report tables written as JSON and counted from the files."""
    from argosift.session import new_path
    from argosift.sources import tables as TB
    sections = {"levels": R.counts_by(leveled(t), "level"), "sources": R.counts_by(t.sec_log(), "source")}
    paths = TB.export_report(sections, new_path(t.spark, "report"))
    return R.table_stats({n: t.spark.read.json(p) for n, p in zip(sections, paths)}).withColumnRenamed(
        "table_name", "section")
