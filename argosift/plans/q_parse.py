"""Source, parsing and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosift import constants as C
from argosift.functions import prompts as P, severity as S, text as X, times as T
from argosift.operators import parse as L, report as R, snapshots as N
from argosift.plans import sqltext as Q
from argosift.plans.registry import query
from argosift.plans.views import Inputs, with_views
from argosift.sources import registry as REG

_TAIL_CONFIG = {"max_entries_per_source": 600}


# One source per given text table and two cuts of the event log.
def _specs(t: Inputs) -> list[REG.SourceSpec]:
    def at(name: str) -> str:
        return f"{t.folder}/{name}.parquet"

    return REG.parse_config({
        "app_logs": {"enabled": True, "sources": [
            {"name": "documents", "path": at("documents"), "format": "parquet", "columns": {"line": "text"},
             "priority": "high"},
            {"name": "conversations", "path": at("conversations"), "format": "parquet", "columns": {"line": "text"},
             "include_patterns": ["the"], "exclude_patterns": ["please"]},
            {"name": "pages", "path": at("pages"), "format": "parquet", "columns": {"line": "url"},
             "enabled": False},
        ]},
        "auth_logs": {"enabled": True, "sources": [
            {"name": "errors", "path": at("events"), "format": "parquet", "columns": {"line": "props"},
             "where": "event_type = 'error'", "priority": "critical"}]},
        "kernel_logs": {"enabled": False, "sources": [
            {"name": "clicks", "path": at("events"), "format": "parquet", "columns": {"line": "props"}}]},
    })


_SOURCES = """select 'documents' as source, text as line from documents union all
  select 'conversations', text from conversations
    where regexp_matches(text,'the','i') and not regexp_matches(text,'please','i') union all
  select 'errors', props from events where event_type='error'"""


@query("a1_source_registry", f"""select source, count(*)::bigint as lines, sum(length(line))::bigint as chars
  from ({_SOURCES}) group by source""")
def source_registry(t: Inputs):
    return REG.read_all(t.spark, _specs(t)).groupBy("source").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("g2_union_sources", f"select source, line from ({_SOURCES})")
def union_sources(t: Inputs):
    return REG.read_all(t.spark, _specs(t))


@query("a2_tail_scan", with_views(
    """select source, recency::bigint as recency, event_id, message from (select *, row_number() over
       (partition by source order by ts desc, event_id desc) as recency from sec_log) where recency<=600""", "sec_log"))
def tail_scan(t: Inputs):
    """As many of each source's last entries as its configuration asks for."""
    return R.tail_per_source(t.sec_log(), REG.tail_limit(_TAIL_CONFIG)).select("source", F.col("recency").cast("long").alias("recency"),
                                                     "event_id", "message")


_DOC_LINES = """select doc_id, n_lines, line_no, trim(raw, ' ') as line from (select doc_id,
  len(string_split(trim(text, ' '), chr(10)))::bigint as n_lines, unnest(string_split(trim(text, ' '), chr(10))) as raw,
  unnest(range(1, len(string_split(trim(text, ' '), chr(10)))+1))::bigint as line_no from documents)"""


@query("a3_scan_text", f"""select doc_id, count(*)::bigint as total_lines, count_if(line<>'')::bigint as parsed_lines,
  count_if({Q.words_case('line', C.LEVEL_WORDS, 'debug')}='error')::bigint as errors
  from ({_DOC_LINES}) group by doc_id""")
def scan_text(t: Inputs):
    lines = L.split_lines(t.documents(), "doc_id", "text")
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(~F.col("blank")).alias("parsed_lines"),
        F.count_if(S.log_level(F.col("line")) == "error").alias("errors"))


@query("a4_tail_of_text", f"select doc_id, line_no, line from ({_DOC_LINES}) where line_no > n_lines-2 and line<>''")
def tail_of_text(t: Inputs):
    return L.split_lines(t.documents(), "doc_id", "text", tail_lines=2).where("not blank").select(
        "doc_id", "line_no", "line")


@query("a6_windows_records", f"""select event_id, (event_id & 65535)::bigint as code,
  {Q.lookup('k', C.WINDOWS_TYPES, "'info'")} as severity, 'windows_'||lower(log_type)||'_event' as event_type
  from (select event_id, case event_type when 'error' then 1 when 'purchase' then 2 when 'view' then 4
        when 'click' then 8 else 16 end as k, case when event_id%3=0 then 'Security' when event_id%3=1 then 'System'
        else 'Application' end as log_type from events)""")
def windows_records(t: Inputs):
    """Event records whose high bits carry a qualifier, as exported from a Windows log."""
    exported = t.table("events").selectExpr(
        "event_id", "event_id + 65536 * (event_id % 7) * 4 as event_code",
        """case event_type when 'error' then 1 when 'purchase' then 2 when 'view' then 4 when 'click' then 8
           else 16 end as event_kind""",
        "case when event_id%3=0 then 'Security' when event_id%3=1 then 'System' else 'Application' end as log_type")
    return L.windows_events(exported).select("event_id", "code", "severity", "event_type")


@query("a7_source_availability", with_views(
    """select c.name, c.enabled, coalesce(n,0)::bigint as lines, n is not null as available from (values
         ('auth',true),('secure',true),('kernel',true),('nginx',false)) c(name, enabled)
       left join (select source, count(*) as n from sec_log group by source) s on s.source=c.name""", "sec_log"))
def source_availability(t: Inputs):
    specs = [REG.SourceSpec(n, "", enabled=e) for n, e in (("auth", True), ("secure", True), ("kernel", True),
                                                           ("nginx", False))]
    return REG.availability(t.spark, specs, t.sec_log()).select("name", "enabled", "lines", "available")


@query("a16_table_stats", with_views(
    """select 'primary' as table_name, count(*)::bigint as records from primary_events union all
       select 'backup', count(*)::bigint from audit_log""", "primary_events", "audit_log"))
def table_stats(t: Inputs):
    return R.table_stats({"primary": t.primary_events(), "backup": t.audit_log(numbered=False)})


_SYS = r"^(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)"
_LINE_PARTS = f"""select event_id, line, regexp_matches(line, {Q.q(_SYS)}) as is_sys, regexp_extract(line, {Q.q(_SYS)},
  ['w','hostname','process','pid','message']) as f, source, ts, host_id from log_line"""
_PARSED = """select event_id, 'syslog' as log_format, f.hostname as hostname, f.process as process,
  f.pid::bigint as pid, f.message as message, cast(strptime('2024 '||f.w, '%Y %b %d %H:%M:%S') as timestamp)
  as event_ts, source, ts, host_id from parts"""


@query("b1_parse_syslog", with_views(
    f"""select event_id, log_format, hostname, process, pid, message, cast(event_ts as varchar) as event_time,
          {Q.LEVEL} as level from parsed""", "log_line", ctes={"parts": _LINE_PARTS, "parsed": _PARSED}))
def parse_syslog(t: Inputs):
    return L.parse_lines(t.log_line()).select(
        "event_id", "log_format", "hostname", "process", "pid", "message",
        F.col("event_ts").cast("string").alias("event_time"), "level")


_ACCESS = C.ACCESS


@query("b2_parse_access", with_views(
    f"""select event_id, f.ip as hostname, f.method||' '||f.path||' -> '||f.status as message,
          case when f.status::int>=500 then 'error' when f.status::int>=400 then 'warning' else 'info' end as level,
          cast(cast(strptime(substr(f.w,1,20), '%d/%b/%Y:%H:%M:%S') as timestamp) as varchar) as event_time
        from (select event_id, regexp_extract(line, {Q.q(_ACCESS)}, ['ip','w','method','path','status','size']) as f
              from web_line)""", "web_line"))
def parse_access(t: Inputs):
    return L.parse_lines(t.web_line()).select("event_id", "hostname", "message", "level",
                                              F.col("event_ts").cast("string").alias("event_time"))


@query("b1_parse_generic", f"""select doc_id, 'generic' as log_format, 'unknown' as process,
  {Q.words_case('text', C.LEVEL_WORDS, 'debug')} as level from documents
  where not regexp_matches(trim(text,' '), {Q.q(_SYS)})""")
def parse_generic(t: Inputs):
    from_docs = t.documents().select("doc_id", F.col("text").alias("line"),
                                            F.lit(None).cast("timestamp_ntz").alias("ts"))
    return L.parse_lines(from_docs).where("log_format = 'generic'").select("doc_id", "log_format", "process", "level")


_AUTH = dict(C.AUTH_PATTERNS)


def _auth_sql(col: str) -> str:
    e = Q.case(((f"regexp_matches({col}, {Q.q(p)})", Q.q(n)) for n, p in C.AUTH_PATTERNS), "'log_entry'")

    def g(name: str, i: int) -> str:
        return f"case when ev='{name}' then regexp_extract({col}, {Q.q(_AUTH[name])}, {i}) end"

    return f"""select *, coalesce({g('login_success', 1)}, {g('login_failure', 1)}) as auth_method,
      coalesce({g('login_success', 2)}, {g('login_failure', 2)}, {g('sudo', 1)}, {g('session_open', 1)},
        {g('session_close', 1)}) as username,
      coalesce({g('login_success', 3)}, {g('login_failure', 3)}) as source_ip, {g('sudo', 2)} as command,
      case when ev in ('login_success','login_failure') then 'login' when ev='sudo' then 'privilege_escalation'
        when ev in ('session_open','session_close') then 'session' end as action,
      case ev when 'login_success' then 'success' when 'login_failure' then 'failure' when 'session_open' then 'open'
        when 'session_close' then 'close' end as outcome
      from (select *, {e} as ev from src)"""


_COLLECT = Q.words_case("message", C.COLLECTOR_WORDS, "info")


@query("b3_strict_parse", with_views(
    f"""select event_id, f.hostname as hostname, f.process as process, {_COLLECT.replace('message', 'f.message')}
          as severity, {Q.case(((f"regexp_matches(f.message, {Q.q(p)})", Q.q(n)) for n, p in C.AUTH_PATTERNS),
                               "'log_entry'")} as event_type, false as unparsed
        from parts""", "log_line", ctes={"parts": _LINE_PARTS}))
def strict_parse(t: Inputs):
    return L.collect_lines(t.log_line()).select("event_id", "hostname", "process", "severity", "event_type", "unparsed")


@query("b4_auth_fields", with_views(
    "select event_id, ev as auth_event, auth_method, username, source_ip, command, action, outcome from auth",
    "sec_log", ctes={"src": "select event_id, message from sec_log", "auth": _auth_sql("message")}))
def auth_fields(t: Inputs):
    return L.auth_fields(t.sec_log()).select("event_id", "auth_event", "auth_method", "username", "source_ip",
                                             "command", "action", "outcome")


@query("b5_global_filters", with_views(
    f"""select event_id, line from log_line where {Q.matches_any('line', C.ALWAYS_INCLUDE_LINES)}
        or not {Q.matches_any('line', [*C.EXCLUDE_LINES, 'nightly'], False)}""", "log_line"))
def global_filters(t: Inputs):
    return t.log_line().where(L.keep_line(F.col("line"), [*C.EXCLUDE_LINES, "nightly"])).select("event_id", "line")


@query("b6_source_filters", with_views(
    """select event_id, source from sec_log where case source when 'auth' then regexp_matches(message,'failed|session','i')
       when 'cron' then not regexp_matches(message,'backup|retry','i') else true end""", "sec_log"))
def source_filters(t: Inputs):
    rules = {"auth": {"include": ["failed", "session"]}, "cron": {"exclude": ["backup", "retry"]}}
    return L.filter_sources(t.sec_log(), rules).select("event_id", "source")


@query("b9_by_severity", with_views("select event_id, message from sec_log where severity='error'", "sec_log"))
def by_severity(t: Inputs):
    return t.sec_log().where("severity = 'error'").select("event_id", "message")


@query("b10_text_filter", "select doc_id from documents where contains(lower(text), 'licensed')")
def text_filter(t: Inputs):
    return t.documents().where(F.lower("text").contains("licensed")).select("doc_id")


@query("b17_log_tags", with_views(
    "select event_id, " + Q.joined([
        ("contains(lower(source),'auth')", "'authentication'"), ("contains(lower(source),'secure')", "'security'"),
        ("contains(lower(source),'kern')", "'kernel'"), ("contains(lower(message),'ssh')", "'ssh'"),
        ("contains(lower(message),'sudo')", "'sudo'"),
        ("contains(lower(message),'fail') or contains(lower(message),'denied')", "'security_event'")])
    + " as tags from sec_log", "sec_log"))
def log_tags(t: Inputs):
    return t.sec_log().select("event_id", F.array_join(L.log_tags(F.col("message"), F.col("source")), ",").alias("tags"))


def _classify(col: str, table: str, key: str, *views: str) -> str:
    rules = Q.case(((Q.matches_any(col, ps), Q.q(n)) for n, ps in C.SEVERITY_RULES), "'low'")
    return with_views(f"""select {key}, {Q.words_case(col, C.LEVEL_WORDS, 'debug')} as level,
      {Q.words_case(col, C.COLLECTOR_WORDS, 'info')} as collector, {rules} as by_rule,
      {Q.words_case(col, C.TRIAGE_WORDS, 'low')} as triage,
      {Q.words_case(col, C.THREAT_TYPES, C.THREAT_DEFAULT)} as threat,
      {Q.joined((f"regexp_matches({col}, {Q.q(p)}, 'i')", Q.q(n)) for n, p, _ in C.LOG_PATTERNS)} as patterns
      from {table}""", *views)


def _classified(df, col: str, key: str):
    m = F.col(col)
    return df.select(key, S.log_level(m).alias("level"), S.collector_severity(m).alias("collector"),
                     S.rule_severity(m).alias("by_rule"), S.triage_severity(m).alias("triage"),
                     S.threat_type(m).alias("threat"), F.array_join(S.matched_patterns(m), ",").alias("patterns"))


@query("h13_classify_logs", _classify("message", "sec_log", "event_id", "sec_log"))
def classify_logs(t: Inputs):
    """Levels, severities, threat types and named patterns (H13-H17, H19) of log messages."""
    return _classified(t.sec_log(), "message", "event_id")


@query("h15_classify_documents", _classify("text", "documents", "doc_id"))
def classify_documents(t: Inputs):
    """The same classification over whole documents."""
    return _classified(t.documents(), "text", "doc_id")


_RISK = ([(Q.contains_any("lower(message)", ws), n, s) for n, s, ws in C.RISK_WORDS]
         + [(f"lower(severity)={Q.q(lv)}", n, s) for lv, n, s in C.RISK_BY_LEVEL])


@query("h18_risk", with_views(
    f"""select event_id, {Q.case(((c, Q.q(n)) for c, n, _ in _RISK), "'medium'")} as risk_level,
          {Q.case(((c, f'{s}::double') for c, _, s in _RISK), '0.4::double')} as risk_score,
          {Q.joined([("contains(lower(message),'failed password') or contains(lower(message),'authentication')",
                      "'Authentication Attack'"),
                     ("contains(lower(message),'brute') or contains(lower(message),'multiple failed')",
                      "'Brute Force'"),
                     ("contains(lower(message),'memory') and (contains(lower(message),'out of') or "
                      "contains(lower(message),'exhausted'))", "'Resource Exhaustion'"),
                     ("contains(lower(message),'denied') or contains(lower(message),'refused')", "'Access Denied'"),
                     ("contains(lower(message),'segfault') or contains(lower(message),'crash')",
                      "'System Crash'")])} as indicators
        from sec_log""", "sec_log"))
def risk(t: Inputs):
    name, score = S.risk(F.col("message"), F.col("severity"))
    return t.sec_log().select("event_id", name.alias("risk_level"), score.alias("risk_score"),
                              F.array_join(S.threat_indicators(F.col("message")), ",").alias("indicators"))


@query("h21_service_name", with_views(
    f"""select event_id, case when regexp_extract(line, '(\\w+)\\[\\d+\\]:', 1)<>'' then
          regexp_extract(line, '(\\w+)\\[\\d+\\]:', 1) else source end as from_line,
          {Q.case(((f"contains(lower(message), {Q.q(w)})", Q.q(n)) for w, n in C.SERVICE_WORDS), 'source')}
          as from_message from log_line join (select event_id, message from sec_log) using (event_id)""", "log_line"))
def service_name(t: Inputs):
    both = L.parse_lines(t.log_line())
    return both.select("event_id", S.service_name(F.col("line"), F.col("source")).alias("from_line"),
                       S.service_name(F.col("message"), F.col("source")).alias("from_message"))


@query("h22_threat_rows", with_views(
    f"""select event_id, sev as threat_severity, {Q.words_case('message', C.THREAT_TYPES, C.THREAT_DEFAULT)}
          as threat_type, case sev when 'critical' then 0.95 else 0.75 end::double as confidence,
          substr(message,1,200) as short_message, case sev when 'critical' then 'High' else 'Medium' end
          as risk_assessment
        from (select *, {Q.TRIAGE} as sev from sec_log) where sev in ('critical','high')""", "sec_log"))
def threat_rows(t: Inputs):
    from argosift.operators.assess import threat_rows as rows
    return rows(t.sec_log()).select("event_id", "threat_severity", "threat_type", "confidence", "short_message",
                                    "risk_assessment")


@query("b26_threat_detail", with_views(
    f"""select event_id, sev as threat_severity, case sev when 'critical' then 'High' else 'Medium' end
          as risk_assessment from (select *, {Q.TRIAGE} as sev from sec_log)
        where event_id=(select min(event_id) from sec_log where event_type='error')""", "sec_log"))
def threat_detail(t: Inputs):
    from argosift.operators.assess import threat_rows as rows
    first = t.sec_log().where("event_type = 'error'").agg(F.min("event_id").alias("event_id"))
    return rows(t.sec_log()).join(first, "event_id", "left_semi").select("event_id", "threat_severity",
                                                                         "risk_assessment")


@query("h23_pattern_severity", with_views(" union all ".join(
    f"select event_id, {Q.q(n)} as pattern, '" + (
        "Critical" if n in ("OUT_OF_MEMORY", "KERNEL_PANIC", "MALWARE_SIGNATURE", "BRUTE_FORCE")
        else "Warning" if n in ("SSH_FAILED_LOGIN", "AUTHENTICATION_FAILURE", "PRIVILEGE_ESCALATION")
        else "Info") + f"' as severity from sec_log where {Q.matches_any('message', [p])}"
    for n, p, _ in C.LOG_PATTERNS), "sec_log"))
def pattern_severity(t: Inputs):
    """Display severity of every named pattern found in a line."""
    m = F.col("message")
    found = X.labels((X.matches(m, p), n) for n, p, _ in C.LOG_PATTERNS)
    seen = t.sec_log().select("event_id", F.explode(found).alias("pattern"))
    return seen.withColumn("severity", S.pattern_severity(F.col("pattern")))


@query("h24_human_units", """select event_id, case when b<1024 then printf('%.2f B', b) when b<1048576 then
    printf('%.2f KB', b/1024) when b<1073741824 then printf('%.2f MB', b/1048576) else printf('%.2f GB', b/1073741824)
    end as size_text, (s//86400)||'d '||((s%86400)//3600)||'h '||((s%3600)//60)||'m' as uptime
  from (select event_id, (event_id*1013)::double as b, event_id*37 as s from events)""")
def human_units(t: Inputs):
    return t.table("events").select("event_id", T.human_bytes(F.col("event_id") * 1013).alias("size_text"),
                                    T.human_uptime(F.col("event_id") * 37).alias("uptime"))


@query("h25_status_band", with_views(
    """select event_id, case when cpu_percent>=95 then 'Critical' when cpu_percent>=80 then 'Warning' else 'Normal' end
       as cpu_status from metric_base""", "metric_base"))
def status_band(t: Inputs):
    return t.metric_sample().select("event_id", S.status_band(F.col("cpu_percent"), 80, 95).alias("cpu_status"))


@query("h33_time_parse", """select event_id, cast(ts as varchar) as iso_time,
    cast(date_trunc('second', ts) as varchar) as syslog_time from events""")
def time_parse(t: Inputs):
    ts = F.col("ts")
    none = F.lit(None).cast("timestamp_ntz")
    return t.table("events").select(
        "event_id", T.parse_log_time(ts.cast("string"), 2024, none).cast("string").alias("iso_time"),
        T.parse_log_time(F.date_format("ts", "MMM d HH:mm:ss"), 2024, none).cast("string").alias("syslog_time"))


@query("h34_expired", "select event_id, ts + interval 86400 seconds < timestamp '2024-01-15' as expired from events")
def expired(t: Inputs):
    return t.table("events").select("event_id", T.expired(F.col("ts"), 86400, F.lit("2024-01-15").cast(
        "timestamp_ntz")).alias("expired"))


@query("h35_next_adjustment", """select event_id, cast(ts + interval 30 minutes as varchar) as next_adjustment,
    (greatest(epoch_us(ts + interval 30 minutes) - epoch_us(timestamp '2024-01-10'), 0)//60000000)::bigint
    as minutes_until_next from events""")
def next_adjustment(t: Inputs):
    cols = T.next_adjustment(F.col("ts"), 30, F.lit("2024-01-10").cast("timestamp_ntz"))
    return t.table("events").select("event_id", cols["next_adjustment"].cast("string").alias("next_adjustment"),
                                    cols["minutes_until_next"].alias("minutes_until_next"))


@query("h29_answer_json", """select conv_id, turn, case when turn%3<2 then 'benign' end as classification,
    case when turn%3<2 then length(text)/10.0::double end as confidence, case when turn%3<2 then text end as explanation
    from conversations""")
def answer_json(t: Inputs):
    """Reads the JSON part of an answer text: fenced, bare, or not JSON at all. The explanations are the turns' texts."""
    from argosift import schemas
    body = F.to_json(F.struct(F.lit("benign").alias("classification"), (F.length("text") / 10).alias("confidence"),
                              F.col("text").alias("explanation")))
    answer = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nend")))
              .when(F.col("turn") % 3 == 1, body).otherwise(F.concat(F.lit("no structured answer: "), "text")))
    parsed = t.table("conversations").select(
        "conv_id", "turn", F.from_json(X.fenced_json(answer), schemas.ANSWER).alias("a"))
    return parsed.select("conv_id", "turn", "a.classification", "a.confidence", "a.explanation")


@query("h30_question_text", with_views(" union all ".join(
    f"""select event_id, '{k}' as kind, concat_ws(chr(10), {Q.q(P.TASKS[k])}, 'Data: '||message, 'Context: '||source,
          {Q.q('Answer as JSON with: ' + ', '.join(P.ANSWER_FIELDS[k]))}) as question from sec_log""" for k in P.TASKS),
    "sec_log"))
def question_text(t: Inputs):
    """Questions of every kind about each line, from one scan."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), P.question(k, F.col("message"), F.col("source"))
                               .alias("question")) for k in P.TASKS])
    return t.sec_log().select("event_id", F.inline(kinds))


@query("b21_live_triage", with_views(
    f"""select event_id, case when {Q.matches_any('line', [p for r in C.RULES for p in r.log_patterns])} or score>0.7
          then 'threat' when score>0.5 then 'warning' else 'normal' end as triage
        from (select *, {Q.log_features(message='line')['severity_score']} as score from log_line)""", "log_line"))
def live_triage(t: Inputs):
    line = F.col("line")
    hit = X.matches_any(line, [p for r in C.RULES for p in r.log_patterns])
    return t.log_line().select("event_id", S.triage_line(hit, S.text_score(line)).alias("triage"))


_MARKED = """select event_id, case when event_id%50=0 then message||' SERVICE_START' else message end as message
  from sec_log"""
_NAMES = ",".join(f"({i},{Q.q(n)})" for i, (n, _, _) in enumerate(C.LOG_PATTERNS))


@query("c17_pattern_name_in_text", with_views(
    f"""select pattern, event_id, message from marked, (values {_NAMES}) v(i, pattern)
        where contains(lower(message), lower(pattern)) order by i, event_id limit 10""",
    "sec_log", ctes={"marked": _MARKED}))
def pattern_name_in_text(t: Inputs):
    marked = t.sec_log().withColumn("message", F.when(
        F.col("event_id") % 50 == 0, F.concat("message", F.lit(" SERVICE_START"))).otherwise(F.col("message")))
    return R.lines_with_pattern_name(marked).select("pattern", "event_id", "message")


@query("d24_update_report", """select lang, count_if(line<>'' and not starts_with(line,'Listing'))::bigint
    as total_updates, count_if(line<>'' and not starts_with(line,'Listing') and contains(lower(line),'security'))::bigint
    as security_updates from (select lang, trim(unnest(string_split(trim(text, ' '), chr(10))), ' ') as line
    from documents) group by lang""")
def update_report(t: Inputs):
    """Counts over text lines read as package lists, one list per language."""
    lines = L.split_lines(t.documents(), "doc_id", "text", keep=["lang"])
    return N.update_report(lines, "line", ["lang"])
