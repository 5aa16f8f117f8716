"""Rule, sequence, correlation and chain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosift import constants as C
from argosift.functions import text as X
from argosift.operators import anomaly as A, correlate as K, detect as D
from argosift.plans import sqltext as Q
from argosift.plans.q_anomaly import _PATTERN_SQL, _feature_sql, features_of
from argosift.plans.registry import query
from argosift.plans.views import NET_CONN, PROC, SEC_LOG, Inputs, spark_columns, with_views

# --- rules ---------------------------------------------------------------------------

_WIDE = 21600  # rule window of the test density, seconds


def _rules(window: int):
    return [r if r.min_occurrences == 1 else type(r)(**{**r.__dict__, "window_seconds": window}) for r in C.RULES]


def _rule_hits(kind: str) -> str:
    parts = []
    for r in C.RULES:
        if kind == "log" and r.log_patterns:
            tests = [f"regexp_matches(line, {Q.q(p)}, 'i')" for p in r.log_patterns]
        elif kind == "process" and r.process_patterns:
            tests = [f"(regexp_matches(cmdline, {Q.q(p)}, 'i') or regexp_matches(name, {Q.q(p)}, 'i'))"
                     for p in r.process_patterns]
        elif kind == "network" and r.port_ranges:
            tests = [f"remote_port between {a} and {b}" for a, b in r.port_ranges]
            tests += [f"not {Q.private_ip('remote_addr')}"] if r.public_ip else []
        else:
            continue
        count = "+".join(f"({t})::int" for t in tests)
        src = {"log": "log_line", "process": "proc", "network": "net_conn"}[kind]
        parts.append(f"select event_id, ts, host_id, '{r.rule_id}' as rule_id, {r.severity}::double as rule_severity, "
                     f"({count})::bigint as n from {src} where ({count})>0")
    return " union all ".join(parts)


@query("k11_rules_log", with_views(
    f"""select event_id, rule_id, rule_severity, case rule_id when 'AUTH-001' then 0.9 else 0.8 end::double as confidence,
          case rule_id when 'AUTH-001' then occ else 1 end::bigint as occurrences,
          (n + (rule_id='AUTH-001')::int)::bigint as evidence
        from (select *, count(*) over (partition by host_id, rule_id order by ts
                range between interval {_WIDE} seconds preceding and current row) as occ from hits)
        where rule_id<>'AUTH-001' or occ>=3""", "log_line", ctes={"hits": _rule_hits("log")}))
def rules_log(t: Inputs):
    """Log rules over raw lines; AUTH-001 needs three hits per host in its trailing window."""
    rows = D.match_rules(t.log_line(), "log", ["line"], _rules(_WIDE))
    return rows.select("event_id", "rule_id", "rule_severity", F.round("confidence", 6).alias("confidence"),
                       "occurrences", F.size("evidence").cast("long").alias("evidence"))


@query("k11_rules_log_default_window", with_views(
    """select rule_id, count(*)::bigint as events from (select *, count(*) over (partition by host_id, rule_id order by ts
         range between interval 300 seconds preceding and current row) as occ from hits)
       where rule_id<>'AUTH-001' or occ>=3 group by rule_id""", "log_line", ctes={"hits": _rule_hits("log")}))
def rules_log_default(t: Inputs):
    return D.match_rules(t.log_line(), "log", ["line"]).groupBy("rule_id").agg(F.count(F.lit(1)).alias("events"))


@query("k11_rules_process", with_views(
    "select event_id, rule_id, rule_severity, 0.85::double as confidence, n as evidence from hits", "proc",
    ctes={"hits": _rule_hits("process")}))
def rules_process(t: Inputs):
    rows = D.match_rules(t.proc(), "process", ["cmdline", "name"])
    return rows.select("event_id", "rule_id", "rule_severity", "confidence",
                       F.size("evidence").cast("long").alias("evidence"))


@query("k11_rules_network", with_views(
    "select event_id, rule_id, rule_severity, 0.75::double as confidence, n as evidence from hits", "net_conn",
    ctes={"hits": _rule_hits("network")}))
def rules_network(t: Inputs):
    rows = D.match_rules(t.net_conn(), "network", ["remote_port", "remote_addr"])
    return rows.select("event_id", "rule_id", "rule_severity", "confidence",
                       F.size("evidence").cast("long").alias("evidence"))


@query("c9_custom_rule", with_views(
    """select event_id, 'APP-1' as rule_id, 0.4::double as rule_severity from log_line
       where regexp_matches(line, 'retry [5-9]', 'i')""", "log_line"))
def custom_rule(t: Inputs):
    rule = C.Rule("APP-1", "Repeated retries", "policy_violation", 0.4, log_patterns=[r"retry [5-9]"])
    return D.match_rules(t.log_line(), "log", ["line"], [rule]).select("event_id", "rule_id", "rule_severity")


@query("c9_rules_table", with_views(
    """select event_id, 'W-'||word as rule_id, case word when 'retry' then 0.4 else 0.3 end::double as rule_severity
       from log_line, (values ('retry'), ('backup'), ('session')) w(word) where regexp_matches(line, word||' [a-z0-9]', 'i')
       union all select event_id, 'W-count', 0.6::double from (select event_id, count(*) over (partition by host_id
         order by ts range between interval 3600 seconds preceding and current row) as n from log_line
         where regexp_matches(line, 'refused', 'i')) where n>=2""", "log_line"))
def rules_table(t: Inputs):
    """Rules that users keep in a table: any number of them, with occurrence counts of their own."""
    rules = t.spark.createDataFrame(
        [(f"W-{w}", f"{w} [a-z0-9]", s, 0, 1) for w, s in (("retry", 0.4), ("backup", 0.3), ("session", 0.3))]
        + [("W-count", "refused", 0.6, 3600, 2)], D.RULE_TABLE)
    return D.match_rule_table(t.log_line(), rules, "line").select("event_id", "rule_id", "rule_severity")


_SIGNS = {"X-address": r"[0-9]{3}\.[0-9]{2}\.[0-9]{3}\.[0-9]+:[0-9]{4}", "X-number": r"\b[0-9]{5}\b", "X-either": "sessio[mn]|aud[io]t"}


@query("c9_many_rules", with_views(
    "select event_id, 'U-'||n as rule_id from (select event_id, regexp_extract(line, 'user u([0-9]+)', 1) as n from log_line) "
    "where n <> '' and n::int < 2000 union all select event_id, rule_id from log_line, (values "
    + ", ".join(f"({Q.q(k)}, {Q.q(p)})" for k, p in _SIGNS.items())
    + ") r(rule_id, pattern) where regexp_matches(line, pattern, 'i')", "log_line"))
def many_rules(t: Inputs):
    """A table of 2,003 rules, one per watched user and three without a plain word, over all lines."""
    users = t.spark.range(2000).selectExpr("'U-'||id as rule_id", r"concat('(invalid )?user u', id, '\\b') as pattern")
    signs = t.spark.createDataFrame(list(_SIGNS.items()), "rule_id string, pattern string")
    rules = users.unionByName(signs).selectExpr("*", "0.5D as rule_severity", "0 as window_seconds", "1 as min_occurrences")
    return D.match_rule_table(t.log_line(), rules, "line").select("event_id", "rule_id")


@query("e2_rule_occurrences", with_views(
    f"""select event_id, count(*) over (partition by host_id order by ts range between interval {_WIDE} seconds preceding
          and current row)::bigint as occurrences from log_line
        where {Q.matches_any('line', C.RULES[0].log_patterns)}""", "log_line"))
def rule_occurrences(t: Inputs):
    from argosift.operators.windows import trailing_sums
    hits = t.log_line().where(X.matches_any(F.col("line"), C.RULES[0].log_patterns))
    return trailing_sums(hits, ["host_id"], "ts", _WIDE, {"occurrences": F.lit(1).cast("long")}).select(
        "event_id", "occurrences")


# --- sequences ----------------------------------------------------------------------------

_FAIL = Q.contains_any("lower(message)", C.AUTH_FAILURE_WORDS)


@query("d4_brute_force", with_views(
    f"""select host_id, cast(time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as varchar) as window_start,
          count(*)::bigint as failures, round(least(0.5+count(*)*0.05,0.95),6)::double as confidence
        from sec_log where {_FAIL} group by 1,2 having count(*)>=5""", "sec_log"))
def brute_force(t: Inputs):
    rows = D.brute_force(t.sec_log(), ["host_id"], "6 hours")
    return rows.select("host_id", F.col("window_start").cast("string").alias("window_start"), "failures",
                       F.round("confidence", 6).alias("confidence"))


@query("d5_port_scan", with_views(
    """select remote_addr, cast(time_bucket(interval 10 days, ts, timestamp '1970-01-01') as varchar) as window_start,
         count(distinct local_port)::bigint as ports, round(least(0.6+count(distinct local_port)*0.02,0.95),6)::double
         as confidence, array_to_string(list_sort(list(distinct local_port))[1:10], ',') as sample
       from net_conn group by 1,2 having count(distinct local_port)>=5""", "net_conn"))
def port_scan(t: Inputs):
    rows = D.port_scan(t.net_conn(), window="10 days", minimum=5)
    return rows.select("remote_addr", F.col("window_start").cast("string").alias("window_start"), "ports",
                       F.round("confidence", 6).alias("confidence"),
                       F.array_join(F.col("sample_ports").cast("array<string>"), ",").alias("sample"))


@query("d6_exfiltration", with_views(
    f"""select host_id, cast(date_trunc('day', ts) as timestamp)::varchar as window_start,
          sum(bytes_sent)::bigint as bytes_sent, count(distinct remote_addr)::bigint as destinations from net_conn
        where not {Q.private_ip('remote_addr')} group by 1,2
        having sum(bytes_sent)>104857600 and count(distinct remote_addr)>3""", "net_conn"))
def exfiltration(t: Inputs):
    rows = D.exfiltration(t.net_conn(), ["host_id"], "1 day")
    return rows.select("host_id", F.col("window_start").cast("string").alias("window_start"), "bytes_sent",
                       "destinations")


@query("d3_distinct_counts", with_views(
    """select host_id, count(distinct remote_addr)::bigint as addresses, count(distinct remote_port)::bigint as ports
       from net_conn group by host_id""", "net_conn"))
def distinct_counts(t: Inputs):
    return t.net_conn().groupBy("host_id").agg(F.count_distinct("remote_addr").alias("addresses"),
                                               F.count_distinct("remote_port").alias("ports"))


# --- correlation ------------------------------------------------------------------------------

# One event stream of the four source types; ids are kept apart by type.
_KINDS = """case event_id%4 when 0 then 'log' when 1 then 'process' when 2 then 'network' else 'metric' end"""
_MIXED = f"""select s.event_id, s.ts, s.host_id, {_KINDS.replace('event_id', 's.event_id')} as source_type, s.message,
  n.remote_addr, p.username, p.name from sec_log s join net_conn n using (event_id) join proc p using (event_id)"""


def mixed(t: Inputs):
    """Events typed by turns as log, process, network and metric: one projection of the table."""
    wanted = {"message": SEC_LOG, "remote_addr": NET_CONN, "username": PROC, "name": PROC}
    extra = [next(e for e in columns if e.endswith(f" as {c}")) for c, columns in wanted.items()]
    host = next(e for e in SEC_LOG if e.endswith(" as host_id"))
    return t.events().selectExpr("event_id", "ts", *spark_columns([host, *extra]), f"{_KINDS} as source_type")


_TEMPORAL = """select event_id, source_type, (n_all-n_own)::bigint as other_events, kinds::bigint as type_count,
    round(0.3+kinds*0.1,6)::double as correlation_score from (
      select event_id, source_type, count(*) over w as n_all,
        case source_type when 'log' then count(*) filter (source_type='log') over w
          when 'process' then count(*) filter (source_type='process') over w
          when 'network' then count(*) filter (source_type='network') over w
          else count(*) filter (source_type='metric') over w end as n_own,
        (count(*) filter (source_type='log') over w>0)::int+(count(*) filter (source_type='process') over w>0)::int
        +(count(*) filter (source_type='network') over w>0)::int
        +(count(*) filter (source_type='metric') over w>0)::int as kinds
      from mixed window w as (partition by host_id order by ts range between interval 3600 seconds preceding
        and current row)) where n_all-n_own>=2 and kinds>=3"""


@query("c10_temporal_correlation", with_views(_TEMPORAL, "sec_log", "net_conn", "proc", ctes={"mixed": _MIXED}))
def temporal_correlation(t: Inputs):
    rows = K.temporal(mixed(t), seconds=3600)
    return rows.select("event_id", "source_type", "other_events", "type_count",
                       F.round("correlation_score", 6).alias("correlation_score"))


_SOURCES = ["auth", "syslog", "kernel", "cron", "messages", "secure"]


@query("e10_distinct_types", with_views(
    """select event_id, (select count(distinct b.source)::bigint from sec_log b where b.host_id=a.host_id and
         b.ts between a.ts - interval 1800 seconds and a.ts) as type_count from sec_log a""", "sec_log"))
def distinct_types(t: Inputs):
    return K.distinct_types(t.sec_log(), ["host_id"], "ts", 1800, "source", _SOURCES).select("event_id", "type_count")


_ENTITIES = f"""select event_id, ts, e.t as entity_type, e.v as entity_value from (select event_id, ts, unnest(case
    source_type when 'network' then [{{'t':'ip','v':remote_addr}}]
      when 'process' then [{{'t':'user','v':username}}, {{'t':'process','v':name}}]
      when 'log' then list_transform({Q.extract_all('message', C.IP_ADDRESS)}[1:3], lambda x: {{'t':'ip','v':x}})
      else [] end) as e from mixed)"""


def entity_events(t: Inputs):
    rows = mixed(t)
    found = K.entities(F.col("source_type"), F.col("message"), F.col("remote_addr"), F.col("username"), F.col("name"))
    return K.entity_events(rows.withColumn("entities", found).select("event_id", "ts", "entities"))


@query("h47_entities", with_views("select event_id, entity_type, entity_value from ent", "sec_log", "net_conn", "proc",
                                  ctes={"mixed": _MIXED, "ent": _ENTITIES}))
def entities(t: Inputs):
    return entity_events(t).select("event_id", "entity_type", "entity_value")


@query("d20_entity_counts", with_views(
    "select entity_type, entity_value, count(*)::bigint as events from ent group by 1,2", "sec_log", "net_conn", "proc",
    ctes={"mixed": _MIXED, "ent": _ENTITIES}))
def entity_counts(t: Inputs):
    return entity_events(t).groupBy("entity_type", "entity_value").agg(F.count(F.lit(1)).alias("events"))


_FREQ = """select *, n/greatest(span,1.0)*60.0 as per_minute, least(0.3+n/greatest(span,1.0)*60.0*0.05,0.9) as score
    from (select event_id, ts, entity_type, entity_value, count(*) over w as n,
      (epoch_us(ts)-epoch_us(min(ts) over w))/1000000.0::double as span from ent
      window w as (partition by entity_type, entity_value order by ts range between interval 3600 seconds preceding
        and current row)) where n>=5"""


@query("e6_entity_frequency", with_views(
    """select event_id, entity_type, entity_value, n::bigint as recent, round(per_minute,6) as per_minute,
         round(score,6)::double as correlation_score from freq""", "sec_log", "net_conn", "proc",
    ctes={"mixed": _MIXED, "ent": _ENTITIES, "freq": _FREQ}))
def entity_frequency(t: Inputs):
    rows = K.entity_frequency(entity_events(t), seconds=3600)
    return rows.select("event_id", "entity_type", "entity_value", "recent", F.round("per_minute", 6).alias("per_minute"),
                       F.round("correlation_score", 6).alias("correlation_score"))


# Anomaly-like rows: pattern scores of process and network events.
def scored_events(t: Inputs):
    """Rows with a pattern score, with searchable reason text."""
    log = A.pattern(features_of(t, "log"), "log").select(
        "event_id", "ts", "host_id", "source_type", F.col("pattern_score").alias("anomaly_score"),
        F.col("message").alias("reason_text"))
    proc = A.pattern(features_of(t, "process"), "process").select(
        "event_id", "ts", "host_id", "source_type", F.col("pattern_score").alias("anomaly_score"),
        F.concat(F.lit("suspicious "), "name").alias("reason_text"))
    net = A.pattern(features_of(t, "network"), "network").select(
        "event_id", "ts", "host_id", "source_type", F.col("pattern_score").alias("anomaly_score"),
        F.concat(F.lit("scan "), F.when(F.col("is_remote_private") > 0, "internal ").otherwise("transfer "),
                 "process_name").alias("reason_text"))
    return log.unionByName(proc).unionByName(net)


_TEXT = {"log": "message", "process": "'suspicious '||name",
         "network": "'scan '||case when is_remote_private>0 then 'internal ' else 'transfer ' end||process_name"}


def _scored_sql() -> str:
    parts = []
    for st in ("log", "process", "network"):
        inner = _feature_sql(st).replace("select event_id,", "select name, event_id,", 1) if st == "process" else (
            _feature_sql(st).replace("select event_id,", "select process_name, event_id,", 1) if st == "network"
            else _feature_sql(st))
        parts.append(f"select event_id, ts, host_id, '{st}' as source_type, {_PATTERN_SQL[st][0]} as anomaly_score, "
                     f"{_TEXT[st]} as reason_text from ({inner})")
    return " union all ".join(parts)


_SCORED = {"scored": _scored_sql()}
_ANOM = "select * from scored where source_type<>'log' and anomaly_score>=0.8"
_THREE = ("sec_log", "proc", "net_conn")


def _anomalies(t: Inputs):
    return scored_events(t).where("source_type <> 'log' and anomaly_score >= 0.8")


@query("c11_anomaly_groups", with_views(
    """select event_id, source_type, n::bigint as group_size, round(least(s/n+0.2,1.0),6)::double as correlation_score
       from (select event_id, source_type, count(*) over w as n, sum(anomaly_score) over w as s from anom
         window w as (partition by host_id order by ts range between interval 900 seconds preceding and current row))
       where n>1""", *_THREE, ctes={**_SCORED, "anom": _ANOM}))
def anomaly_groups(t: Inputs):
    rows = K.anomaly_groups(_anomalies(t), seconds=900)
    return rows.select("event_id", "source_type", "group_size", F.round("correlation_score", 6).alias("correlation_score"))


def _stage_sql(stage: dict) -> str:
    parts = [f"source_type='{stage['source_type']}'"]
    if "min_score" in stage:
        parts.append(f"anomaly_score>={stage['min_score']}")
    if "contains" in stage:
        parts.append(f"contains(lower(reason_text),'{stage['contains']}')")
    return "(" + " and ".join(parts) + ")"


def _chains_sql(ordered: bool) -> str:
    """Events with the stages seen in their trailing hour, by plain window functions."""
    steps = ["select *, " + ", ".join(f"{_stage_sql(s)} as t_{c}_{i}" for c, stages in C.ATTACK_CHAINS.items()
                                      for i, s in enumerate(stages)) + " from hot"]
    stages = {c: len(s) for c, s in C.ATTACK_CHAINS.items()}
    if ordered:
        for i in range(max(stages.values())):
            here = [c for c in stages if i < stages[c]]
            if i:
                steps.append("select *, " + ", ".join(
                    f"max(s_{c}_{i - 1}) over (partition by host_id order by ts range between unbounded preceding and "
                    f"interval 1 microsecond preceding) as p_{c}_{i}" for c in here) + f" from x{len(steps) - 1}")
            steps.append("select *, " + ", ".join(
                f"case when t_{c}_{i} then {f'p_{c}_{i}' if i else 'ts'} end as s_{c}_{i}" for c in here)
                + f" from x{len(steps) - 1}")
        seen = ("coalesce(max(s_{c}_{i}) over (partition by host_id order by ts range between unbounded preceding and "
                "current row) >= ts - interval 1 hour, false)")
    else:
        seen = ("(count(*) filter (where t_{c}_{i}) over (partition by host_id order by ts range between interval 1 hour "
                "preceding and current row) > 0)")
    steps.append("select *, " + ", ".join(f"{seen.format(c=c, i=i)} as y_{c}_{i}" for c in stages for i in range(stages[c]))
                 + f" from x{len(steps) - 1}")
    rows = []
    for c, n in stages.items():
        depth = "+".join("(" + " and ".join(f"y_{c}_{k}" for k in range(i + 1)) + ")::int" for i in range(n))
        rows.append(f"select event_id, source_type, host_id, '{c}' as chain, {depth} as stages from x{len(steps) - 1}")
    ctes = ", ".join(f"x{k} as ({s})" for k, s in enumerate(steps))
    return f"""with hot as (select * from scored where anomaly_score>=0.5), {ctes} select event_id, source_type, host_id, chain,
      stages::bigint as stages, round(0.7+stages*0.1,6)::double as correlation_score from ({' union all '.join(rows)})
      where stages>=2"""


def chain_anomalies(t: Inputs):
    """The anomalies in which chains are looked for; ids are kept apart by source type."""
    return scored_events(t).where("anomaly_score >= 0.5").withColumn("event_key", F.struct("event_id", "source_type"))


def _chain_query(name: str, ordered: bool):
    @query(name, with_views(f"select * from ({_chains_sql(ordered)})", *_THREE, ctes=_SCORED))
    def run(t: Inputs):
        rows = K.attack_chains(chain_anomalies(t), tie="event_key", ordered=ordered)
        return rows.select("event_key.event_id", "event_key.source_type", "host_id", "chain", "stages",
                           F.round("correlation_score", 6).alias("correlation_score"))


_chain_query("k12_attack_chains", False)
_chain_query("k12_attack_chains_ordered", True)


@query("k13_correlation_records", with_views(
    """select event_id, 'temporal' as correlation_type, correlation_score, '' as entity from temporal
         where correlation_score>=0.5
       union all select event_id, 'entity', round(score,6)::double, entity_value from freq where score>=0.5
       union all select event_id, 'pattern', round(least(s/n+0.2,1.0),6)::double, '' from (select event_id,
         count(*) over w as n, sum(anomaly_score) over w as s from anom window w as (partition by host_id order by ts
         range between interval 900 seconds preceding and current row)) where n>1 and least(s/n+0.2,1.0)>=0.5""",
    *_THREE, ctes={"mixed": _MIXED, "ent": _ENTITIES, "freq": _FREQ, "temporal": _TEMPORAL, **_SCORED, "anom": _ANOM}))
def correlation_records(t: Inputs):
    """Records of all kinds: temporal, entity and anomaly groups."""
    rows = K.records(K.temporal(mixed(t), seconds=3600), K.entity_frequency(entity_events(t), seconds=3600),
                     K.anomaly_groups(_anomalies(t), seconds=900))
    return rows.select("event_id", "correlation_type", F.round("correlation_score", 6).alias("correlation_score"),
                       "entity")


@query("b22_analysis_gate", with_views(
    "select event_id, source_type, round(anomaly_score,6) as anomaly_score from scored where anomaly_score>=0.5",
    *_THREE, ctes=_SCORED))
def analysis_gate(t: Inputs):
    return scored_events(t).where("anomaly_score >= 0.5").select("event_id", "source_type",
                                                                 F.round("anomaly_score", 6).alias("anomaly_score"))
