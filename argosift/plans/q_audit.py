"""Audit queries: integrity comparison, chains, writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosift import constants as C
from argosift.functions import hashing as H, severity as S
from argosift.operators import audit as A, membership as MB, reconcile as RC
from argosift.operators.windows import number_rows
from argosift.session import cut, new_path
from argosift.plans.registry import query
from argosift.plans.views import Inputs, with_views

_HASH = ("sha256(concat_ws('|',cast(event_id as varchar),cast(ts as varchar),source,event_type,severity,host_id,"
         "message))")
_STATUS = f"""select coalesce(p.event_id, b.record_id) as record_id,
  case when p.event_id is null then 'missing_in_primary' when b.record_id is null then 'missing_in_backup'
       when p.h <> b.content_hash then 'hash_mismatch' else 'valid' end as status
  from (select event_id, {_HASH} as h from primary_events) p
  full outer join audit_log b on p.event_id = b.record_id"""
_STATUS_VIEW = {"status_rows": _STATUS}
_BOTH = ("primary_events", "audit_log")
_SEG = A.SEGMENT_ROWS
_GENESIS = "sha256('genesis-v1')"
# Links of every record: segments advance one position per step.
_LINKS = {
    "seq_rows": f"""select host_id, (sequence_number-1)//{_SEG} as segment, (sequence_number-1)%{_SEG} as pos,
        sequence_number, record_id, content_hash from audit_log""",
    "links": f"""select host_id, segment, pos, sequence_number, record_id, content_hash,
          {_GENESIS} as previous_hash, sha256({_GENESIS}||':'||content_hash) as chain_hash
        from seq_rows where pos = 0
        union all
        select s.host_id, s.segment, s.pos, s.sequence_number, s.record_id, s.content_hash, l.chain_hash,
          sha256(l.chain_hash||':'||s.content_hash)
        from links l join seq_rows s on s.host_id=l.host_id and s.segment=l.segment and s.pos=l.pos+1""",
}


def _statuses(t: Inputs):
    return A.compare(t.primary_events(), t.audit_log(numbered=False))


def _links(t: Inputs):
    return A.link_records(t.audit_log())


def _corrupted(t: Inputs):
    """Links with one content hash changed in every chain's 50th record."""
    hit = F.col("sequence_number") == 50
    return _links(t).withColumn("content_hash", F.when(hit, F.sha2(F.lit("forged"), 256)).otherwise(
        F.col("content_hash")))


@query("c1_integrity_audit", with_views(
    "select status, count(*)::bigint as records from status_rows group by status", *_BOTH, ctes=_STATUS_VIEW))
def integrity_audit(t: Inputs):
    return _statuses(t).groupBy("status").agg(F.count(F.lit(1)).alias("records"))


@query("c1_record_status", with_views("select * from status_rows", *_BOTH, ctes=_STATUS_VIEW))
def record_status(t: Inputs):
    return _statuses(t)


@query("c1_status_by_ranges", with_views("select * from status_rows", *_BOTH, ctes=_STATUS_VIEW))
def status_by_ranges(t: Inputs):
    """Both tables are stored by day and bucket; records are joined in the ranges whose digests differ only."""
    primary, backup, known = (new_path(t.spark, n) for n in ("primary", "backup", "digests"))
    RC.store(t.primary_events(), primary, "all", "event_id")
    RC.store(t.audit_log(numbered=False), backup, "all", digest_path=known)
    current = t.spark.read.parquet(primary).select(F.col("event_id").alias("record_id"), A.event_hash().alias(
        "content_hash"), *RC.RANGE)
    return RC.statuses(current, t.spark.read.parquet(backup), RC.added(t.spark.read.parquet(known)))


@query("c2_deleted_records", with_views(
    """select record_id, host_id, content_hash from audit_log
       where record_id not in (select event_id from primary_events)""", *_BOTH))
def deleted_records(t: Inputs):
    return A.deleted(t.primary_events(), t.audit_log(numbered=False)).select("record_id", "host_id", "content_hash")


@query("c3_orphan_records", with_views(
    """select event_id, host_id, severity from primary_events
       where event_id not in (select record_id from audit_log)""", *_BOTH))
def orphan_records(t: Inputs):
    return A.orphans(t.primary_events(), t.audit_log(numbered=False)).select("event_id", "host_id", "severity")


@query("c4_common_records", with_views(
    """select host_id, count(*)::bigint as records from primary_events
       where event_id in (select record_id from audit_log) group by host_id""", *_BOTH))
def common_records(t: Inputs):
    return A.common(t.primary_events(), t.audit_log(numbered=False)).groupBy("host_id").agg(
        F.count(F.lit(1)).alias("records"))


@query("c5_write_consistency", with_views(
    """select coalesce(p.event_id, b.record_id) as event_id, p.event_id is not null as in_primary,
         b.record_id is not null as in_backup
       from primary_events p full outer join audit_log b on p.event_id=b.record_id
       where (p.event_id is null) <> (b.record_id is null)""", *_BOTH))
def write_consistency(t: Inputs):
    return A.inconsistent_writes(t.primary_events(), t.audit_log(numbered=False))


_FIELDS = A.CONTENT_FIELDS[1:]
_CHANGED = "concat_ws(','," + ",".join(
    f"case when p.event_id is not null and o.{f} is distinct from p.{f} then '{f}' end" for f in _FIELDS) + ")"


@query("c6_forensics", with_views(
    f"""select s.record_id, s.status, o.severity as original_severity, p.severity as current_severity,
          o.message as original_message, p.message as current_message, {_CHANGED} as changed_fields
        from status_rows s join backup_events o on o.event_id=s.record_id
        left join primary_events p on p.event_id=s.record_id
        where s.status in ('missing_in_primary','hash_mismatch')""",
    *_BOTH, "backup_events", ctes=_STATUS_VIEW))
def forensics(t: Inputs):
    rows = A.forensics(_statuses(t), t.backup_events(), t.primary_events())
    return rows.select("record_id", "status", "original_severity", "current_severity", "original_message",
                       "current_message", F.array_join("changed_fields", ",").alias("changed_fields"))


@query("f7_first_tampered", with_views(
    f"""select s.record_id, s.status, o.severity as original_severity, p.severity as current_severity,
          {_CHANGED} as changed_fields
        from (select * from status_rows where status in ('missing_in_primary','hash_mismatch')
              order by record_id limit 10) s join backup_events o on o.event_id=s.record_id
        left join primary_events p on p.event_id=s.record_id""",
    *_BOTH, "backup_events", ctes=_STATUS_VIEW))
def first_tampered(t: Inputs):
    bad = _statuses(t).where(F.col("status").isin("missing_in_primary", "hash_mismatch"))
    rows = A.forensics(bad.orderBy("record_id").limit(10), t.backup_events(), t.primary_events())
    return rows.select("record_id", "status", "original_severity", "current_severity",
                       F.array_join("changed_fields", ",").alias("changed_fields"))


_REPORT = """select count_if(status in ('valid','hash_mismatch'))::bigint as checked,
  count_if(status='valid')::bigint as valid, count_if(status='hash_mismatch')::bigint as tampered,
  count_if(status='missing_in_primary')::bigint as missing, count_if(status='missing_in_backup')::bigint as orphans
  from status_rows"""
_OVERALL = """case when tampered>0 or missing>0 then 'ALERT: Tampering Detected'
  when orphans>0 then 'WARNING: Issues Found' else 'OK: All records verified' end"""
_ISSUES = """select record_id, case status when 'missing_in_primary' then 'deleted_from_primary'
    when 'missing_in_backup' then 'missing_from_backup' else 'content_modified' end as issue_type,
  case status when 'missing_in_primary' then 'high' when 'missing_in_backup' then 'medium' else 'critical' end
    as severity,
  'Record '||record_id||case status when 'missing_in_primary' then ' was deleted from primary database'
    when 'missing_in_backup' then ' exists in primary but not backup'
    else ' content was modified in primary' end as message
  from status_rows where status<>'valid'"""


@query("d8_integrity_report", with_views(
    f"""select *, true as chain_valid, 0::bigint as broken_at, {_OVERALL} as overall_status from rep""",
    *_BOTH, ctes={**_STATUS_VIEW, "rep": _REPORT}))
def integrity_report(t: Inputs):
    return A.report(_statuses(t), A.verify(_links(t))).fillna(0, ["broken_at"])


@query("d8_broken_chain_report", with_views(
    f"""select case when broken then 0 else checked end as checked, case when broken then 0 else valid end as valid,
          case when broken then 0 else tampered end as tampered, case when broken then 0 else missing end as missing,
          case when broken then 0 else orphans end as orphans, not broken as chain_valid, broken_at,
          case when broken then 'CRITICAL: Backup chain compromised' else {_OVERALL} end as overall_status
        from rep, (select count(*)>0 as broken, min(sequence_number)::bigint as broken_at from audit_log
                   where sequence_number=50)""", *_BOTH, ctes={**_STATUS_VIEW, "rep": _REPORT}))
def broken_chain_report(t: Inputs):
    return A.report(_statuses(t), A.verify(_corrupted(t)))


@query("d8_issue_rows", with_views(_ISSUES, *_BOTH, ctes=_STATUS_VIEW))
def issue_rows(t: Inputs):
    return A.issues(_statuses(t))


@query("b23_alert_gate", with_views(
    f"""select *, true as chain_valid, {_OVERALL} as overall_status from rep where tampered>0 or missing>0""",
    *_BOTH, ctes={**_STATUS_VIEW, "rep": _REPORT}))
def alert_gate(t: Inputs):
    return A.should_alert(A.report(_statuses(t))).drop("broken_at")


@query("k16_integrity_actions", with_views(
    f"""select i as position, action from (select list_concat(
         case when tampered>0 then {C.INTEGRITY_ACTIONS['tampered']} else [] end,
         case when missing>0 then {C.INTEGRITY_ACTIONS['missing']} else [] end,
         {C.INTEGRITY_ACTIONS['always']}) as acts from rep) r,
       lateral (select unnest(acts) as action, unnest(range(len(acts))) as i)""",
    *_BOTH, ctes={**_STATUS_VIEW, "rep": _REPORT}))
def integrity_actions(t: Inputs):
    rows = A.recommendations(A.report(_statuses(t)))
    return rows.select(F.posexplode("actions").alias("position", "action")).select(
        F.col("position").cast("long").alias("position"), "action")


# Damage to a written chain, as a condition on the records that stay, and the content hash that a record then shows.
_LAST_SEGMENT = "max(sequence_number) over (partition by host_id)"
_DAMAGE = {
    "e3_chain_verify": ("true", "content_hash"),
    "e3_chain_verify_broken": ("true", "case when sequence_number = 50 then {forged} else content_hash end"),
    "e3_removed_segment_end": ("sequence_number % 512 <> 0", "content_hash"),
    "e3_removed_segment": ("sequence_number not between 513 and 1024", "content_hash"),
    "e3_removed_tail": ("sequence_number <= last_number - 3", "content_hash"),
}


def _damaged_sql(keep: str, content: str) -> str:
    """Verdict from the tables: the first number whose record is gone or whose content differs from what was linked."""
    content = content.format(forged="sha256('forged')")
    return with_views(
        f"""select host_id, count(*) filter (where kept)::bigint as records,
              coalesce(min(sequence_number) filter (where not kept or shown<>content_hash), 0)::bigint as first_broken,
              count(*) filter (where not kept or shown<>content_hash) = 0 as chain_valid
            from (select *, {keep} as kept, {content} as shown from (select *, {_LAST_SEGMENT} as last_number
              from audit_log)) group by host_id""", "audit_log")


def _verify_query(name: str, keep: str, content: str):
    @query(name, _damaged_sql(keep, content))
    def run(t: Inputs):
        """A chain is written with its heads, damaged in the stored table, and verified against the heads."""
        links = cut(_links(t))
        heads = cut(A.stored_heads(links))
        marked = links.join(heads.select("host_id", F.col("last_sequence").alias("last_number")), "host_id")
        damaged = marked.where(keep).withColumn("content_hash", F.expr(
            content.format(forged="sha2('forged', 256)"))).drop("last_number")
        return A.verify(damaged, heads=heads).fillna(0, ["first_broken"])


for _name, (_keep, _content) in _DAMAGE.items():
    _verify_query(_name, _keep, _content)


@query("e3_forged_payload", with_views(
    """select host_id, count(*)::bigint as records,
         coalesce(min(sequence_number) filter (where record_id%211=0), 0)::bigint as first_broken,
         count(*) filter (where record_id%211=0)=0 as chain_valid from audit_log group by host_id""", "audit_log"))
def forged_payload(t: Inputs):
    """Payloads edited beside an intact chain: their hashes no longer fit the linked content."""
    links = cut(_links(t))
    payload = t.backup_events().withColumn("message", F.when(F.col("event_id") % 211 == 0, "forged").otherwise(
        F.col("message"))).select(F.col("event_id").alias("record_id"), A.event_hash().alias("payload_hash"))
    return A.verify(links.join(payload, "record_id"), payload_hash=F.col("payload_hash"),
                    heads=A.stored_heads(links)).fillna(0, ["first_broken"])


@query("e7_sequence_numbers", with_views("select host_id, record_id, sequence_number from audit_log", "audit_log"))
def sequence_numbers(t: Inputs):
    return A.sequence(t.audit_log(numbered=False), "host_id", "ts", "record_id").select(
        "host_id", "record_id", "sequence_number")


@query("k19_chain_build", with_views(
    "select host_id, segment, sequence_number, record_id, content_hash, previous_hash, chain_hash from links",
    "audit_log", ctes=_LINKS))
def chain_build(t: Inputs):
    return _links(t)


@query("e8_chain_heads", with_views(
    f"""select host_id, sha_fold as head, records, last_segment from (
          select host_id, list_reduce(list_prepend({_GENESIS}, list(head order by segment)),
              lambda a, x: sha256(a||':'||x)) as l1, sum(n)::bigint as records,
              max(segment)::bigint as last_segment
          from (select host_id, segment, count(*) as n, max_by(chain_hash, sequence_number) as head
                from links group by host_id, segment) group by host_id),
        lateral (select sha256({_GENESIS}||':'||sha256({_GENESIS}||':'||sha256({_GENESIS}||':'||l1))) as sha_fold)""",
    "audit_log", ctes=_LINKS))
def heads(t: Inputs):
    return A.chain_heads(_links(t))


@query("b7_event_by_id", with_views("select event_id, host_id, source, message, severity from sec_log where event_id=137", "sec_log"))
def event_by_id(t: Inputs):
    return t.sec_log().where("event_id = 137").select("event_id", "host_id", "source", "message", "severity")


@query("b8_events_in_range", with_views(
    """select record_id, host_id, sequence_number from audit_log
       where ts between timestamp '2024-01-05' and timestamp '2024-01-09 12:00:00'""", "audit_log"))
def events_in_range(t: Inputs):
    rows = t.audit_log().where("ts between timestamp_ntz'2024-01-05' and timestamp_ntz'2024-01-09 12:00:00'")
    return rows.orderBy("host_id", "sequence_number").select("record_id", "host_id", "sequence_number")


@query("b24_tamper_statements", """select doc_id, regexp_matches(text,
    '(?i)DELETE FROM|DROP TABLE|TRUNCATE|UPDATE.*SET.*hash|ALTER TABLE') as tampering from documents""")
def tamper_statements(t: Inputs):
    return t.documents().select("doc_id", S.is_tamper_statement(F.col("text")).alias("tampering"))


@query("h45_content_hash", with_views(
    f"""select event_id, {_HASH} as content_hash,
         sha256('{{"event_type":"'||event_type||'","host_id":"'||host_id||'","source":"'||source||'"}}') as map_hash
       from sec_log""", "sec_log"))
def content_hash(t: Inputs):
    payload = F.create_map(F.lit("source"), F.col("source"), F.lit("host_id"), F.col("host_id"),
                           F.lit("event_type"), F.col("event_type"))
    return t.sec_log().select("event_id", A.event_hash().alias("content_hash"), H.map_hash(payload).alias("map_hash"))


_CANONICAL = """'{"a":{"host":"'||host_id||'","tags":[{"n":'||event_id||',"s":"'||source||'"},"x"]},"b":"'||severity||'"}'"""
_SHUFFLED = """'{ "b" : "'||severity||'", "a":{"tags":[{"s":"'||source||'", "n":'||event_id||'},"x"],"host":"'||host_id||'"}}'"""


@query("h45_nested_hash", with_views(
    f"select event_id, sha256({_CANONICAL}) as payload_hash, true as same from sec_log", "sec_log"))
def nested_hash(t: Inputs):
    """Nested payloads hash alike under another order of their keys, at every level."""
    rows = t.sec_log().selectExpr("event_id", f"{_CANONICAL} as one", f"{_SHUFFLED} as other")
    return rows.select("event_id", H.payload_hash(F.col("one")).alias("payload_hash"),
                       (H.payload_hash(F.col("one")) == H.payload_hash(F.col("other"))).alias("same"))


@query("h46_chain_link", with_views(
    f"select event_id, sha256({_GENESIS}||':'||{_HASH}) as chain_hash from sec_log", "sec_log"))
def chain_link(t: Inputs):
    return t.sec_log().select("event_id", H.link(H.genesis(), A.event_hash()).alias("chain_hash"))


@query("f8_ids_in_order", with_views(
    """select record_id, sequence_number, row_number() over (order by ts, record_id) as position from audit_log""",
    "audit_log"))
def ids_in_order(t: Inputs):
    """All ids with their place by time, and by sequence inside their chain."""
    rows = t.audit_log().withColumn("table", F.lit("audit"))
    return number_rows(rows, ["table"], "ts", "record_id", "position").select("record_id", "sequence_number", "position")


@query("g1_id_sets", with_views(
    """select 'only_primary' as part, count(*)::bigint as ids from (select event_id from primary_events except
         select record_id from audit_log)
       union all select 'only_backup', count(*)::bigint from (select record_id from audit_log except
         select event_id from primary_events)
       union all select 'common', count(*)::bigint from (select record_id from audit_log intersect
         select event_id from primary_events)""", *_BOTH))
def id_sets(t: Inputs):
    p = t.primary_events().select("event_id")
    b = t.audit_log(numbered=False).select(F.col("record_id").alias("event_id"))
    parts = {"only_primary": p.subtract(b), "only_backup": b.subtract(p), "common": p.intersect(b)}
    frames = [df.agg(F.count(F.lit(1)).alias("ids")).select(F.lit(n).alias("part"), "ids") for n, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("g5_idempotent_insert", with_views(
    """select severity, count(*)::bigint as records from (select event_id, severity from primary_events union all
         select event_id, severity from sec_log where event_id not in (select event_id from primary_events))
       group by severity""", "primary_events"))
def idempotent_insert(t: Inputs):
    incoming = t.sec_log().unionByName(t.sec_log()).select("event_id", "severity")
    table = t.primary_events().select("event_id", "severity")
    return table.unionByName(A.append_new(table, incoming, "event_id")).groupBy("severity").agg(
        F.count(F.lit(1)).alias("records"))


@query("a10_append_audit", with_views(
    "select record_id, content_hash from audit_log where record_id%2=1 or record_id%2=0", "audit_log"))
def append_audit(t: Inputs):
    """Appends the whole log to an audit table that already holds the even ids."""
    full = t.audit_log(numbered=False).select("record_id", "content_hash")
    stored = full.where("record_id % 2 = 0")
    return stored.unionByName(A.append_new(stored, full))


@query("a10_append_filtered", with_views(
    "select record_id, content_hash from audit_log", "audit_log"))
def append_filtered(t: Inputs):
    """The same over a stored history by day with its filters: only ids that they may hold are looked up in it."""
    history, filters = new_path(t.spark, "history"), new_path(t.spark, "filters")
    full = t.audit_log(numbered=False).select("record_id", "content_hash", F.to_date("ts").alias("day"))
    stored = full.where("record_id % 2 = 0")
    stored.write.partitionBy("day").parquet(history)
    MB.build(stored).write.parquet(filters)
    new = MB.append_new(t.spark.read.parquet(history), t.spark.read.parquet(filters), full)
    return stored.unionByName(new).select("record_id", "content_hash")


@query("a11_primary_changes", with_views(
    """select event_id, case when event_id%101=0 then 'debug' else severity end as severity, message from sec_log
       where event_id%97<>0""", "sec_log"))
def primary_changes(t: Inputs):
    log = t.sec_log()
    updates = log.where("event_id % 101 = 0").select("event_id", F.lit("debug").alias("severity"))
    removed = log.where("event_id % 97 = 0")
    return A.apply_changes(log, updates, removed, ["severity"]).select("event_id", "severity", "message")


@query("a9_dual_write", with_views(
    f"""select 'primary' as table_name, count(*)::bigint as records, count(distinct {_HASH})::bigint as hashes
        from sec_log union all
        select 'backup', count(*)::bigint, count(distinct {_HASH})::bigint from sec_log""", "sec_log"))
def dual_write(t: Inputs):
    """Writes the log twice to both tables, one batch of it again; the second write adds nothing."""
    from argosift.sources.tables import write_both
    primary, backup = new_path(t.spark, "primary"), new_path(t.spark, "backup")
    for batch in ("first", "first", "second"):
        write_both(t.sec_log(), primary, backup, batch)
    frames = [t.spark.read.parquet(p).agg(F.count(F.lit(1)).alias("records"),
                                          F.count_distinct("content_hash").alias("hashes"))
              .select(F.lit(n).alias("table_name"), "records", "hashes")
              for n, p in (("primary", primary), ("backup", backup))]
    return frames[0].unionByName(frames[1])
