"""Streaming queries; each runs to the end of its input and returns the written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from argosift import constants as C, schemas
from argosift.functions import severity as S
from argosift.operators import baseline as B, features as FX, mountain as M, reconcile as RC
from argosift.plans import sqltext as Q
from argosift.plans.registry import query
from argosift.operators.audit import event_hash
from argosift.plans.views import LOG_LINE, NET_CONN, PRIMARY, SEC_LOG, Inputs, spark_columns, with_views
from argosift.plans.q_anomaly import _detect_sql, features_of
from argosift.plans.q_correlate import _rule_hits
from argosift.session import cut, new_path
from argosift.sources import growing as G
from argosift.streaming import jobs as J, state as SS


def _events(t: Inputs) -> DataFrame:
    return J.read_files(t.spark, t.folder, schemas.EVENT, pattern="events.parquet")


def _log(t: Inputs) -> DataFrame:
    return _events(t).selectExpr(*spark_columns(SEC_LOG))


def _arrivals(t: Inputs, run: Callable[[DataFrame], None], store: Callable[[DataFrame], None] | None = None) -> None:
    """Delivers the events in three time slices and runs the stream after each of them."""
    path = new_path(t.spark, "arrivals")
    events = t.table("events")
    cuts = ["2024-01-01", "2024-01-09", "2024-01-20", "2999-01-01"]
    for start, end in zip(cuts, cuts[1:]):
        part = events.where(f"ts >= timestamp_ntz'{start}' and ts < timestamp_ntz'{end}'")
        if store:
            store(part)
        part.write.mode("append").parquet(path)
        run(J.read_files(t.spark, path, schemas.EVENT))


@query("i1_incremental_ingest", with_views("select event_id, source, message from sec_log", "sec_log"))
def incremental_ingest(t: Inputs):
    """Three deliveries read from a remembered position."""
    path, checkpoint = new_path(t.spark, "ingest"), new_path(t.spark, "ingest-checkpoint")
    _arrivals(t, lambda ev: J.append_to(ev.selectExpr(*spark_columns(SEC_LOG)).select(
        "event_id", "source", "message"), path, checkpoint))
    return t.spark.read.parquet(path)


@query("i1_growing_file", with_views("select line, count(*)::bigint as copies from log_line group by line", "log_line"))
def growing_file(t: Inputs):
    """A log file followed while it grows in three deliveries and is rotated once: every line comes once."""
    log, path, checkpoint = (new_path(t.spark, n) for n in ("log", "followed", "followed-checkpoint"))
    deliveries = iter(range(3))

    def run(_: DataFrame) -> None:
        k = next(deliveries)
        J.append_to(G.follow(t.spark, f"{log}/app.log*", split_bytes=1 << 16).select("line"), path, checkpoint)
        if k == 1:
            G.rotate(f"{log}/app.log", f"{log}/app.log.1")

    def store(part: DataFrame) -> None:
        lines = cut(part.selectExpr(*spark_columns(SEC_LOG)).selectExpr(*spark_columns(LOG_LINE)).select("line"))
        written = new_path(t.spark, "lines")
        lines.write.text(written)
        G.append_files(written, f"{log}/app.log")

    _arrivals(t, run, store)
    return t.spark.read.parquet(path).groupBy("line").agg(F.count(F.lit(1)).alias("copies"))


@query("i2_deduplicate", with_views("select event_id, severity from sec_log", "sec_log"))
def deduplicate(t: Inputs):
    """Every event delivered twice, kept once."""
    log = _log(t).select("event_id", "ts", "severity")
    return J.run_to_table(J.deduplicate(log.unionByName(log)), "dedup").select("event_id", "severity")


_FAIL = Q.contains_any("lower(message)", C.AUTH_FAILURE_WORDS)


def _stored_windows(t: Inputs, counted: Callable[[DataFrame], DataFrame], columns: list[str], keys: list[str],
                    label: str) -> DataFrame:
    """Window rows over three deliveries, open windows included."""
    table, checkpoint = J.OpenAndClosed(t.spark, new_path(t.spark, label)), new_path(t.spark, f"{label}-checkpoint")
    _arrivals(t, lambda ev: J.write_windows(counted(ev.selectExpr(*spark_columns(columns))), keys, table, checkpoint))
    return table.read()


def _sliding_sql(keys: str, source: str, where: str, slide: str, steps: int, body: str) -> str:
    width = f"interval '{steps} {slide}'"
    newest = f"(select max(ts) from {source} where {where})"
    return f"""select {keys}, cast(w as varchar) as window_start, w + {width} <= {newest} - interval 10 minutes as closed,
        {body} from (select *, unnest([time_bucket(interval '1 {slide}', ts) - i * interval '1 {slide}'
          for i in range({steps})]) as w from {source} where {where}) group by {keys}, w"""


@query("i3_sliding_sequences", with_views(
    _sliding_sql("host_id", "sec_log", _FAIL, "hour", 6, "count(*)::bigint as events"), "sec_log"))
def sliding_sequences(t: Inputs):
    """Failed logins per host in sliding windows (D4 as a stream)."""
    rows = _stored_windows(t, lambda ev: J.sequence_windows(ev, ["host_id"], "6 hours", "1 hour"), SEC_LOG,
                           ["window_start", "host_id"], "sequences")
    return rows.select("host_id", F.col("window_start").cast("string").alias("window_start"), "closed", "events")


@query("i3_sliding_port_scans", with_views(
    _sliding_sql("local_addr", "net_conn", "true", "hour", 3, "count(distinct remote_port)::bigint as ports"),
    "net_conn"))
def sliding_port_scans(t: Inputs):
    """Distinct ports per address in sliding windows (D5 as a stream)."""
    rows = _stored_windows(t, lambda ev: J.scan_windows(ev, ["local_addr"], "remote_port", "3 hours", "1 hour"), NET_CONN,
                           ["window_start", "local_addr"], "scans")
    return rows.select("local_addr", F.col("window_start").cast("string").alias("window_start"), "closed", "ports")


@query("i3_sliding_transfers", with_views(
    _sliding_sql("host_id", "net_conn", "true", "hour", 2, "sum(bytes_sent)::bigint as bytes_sent"), "net_conn"))
def sliding_transfers(t: Inputs):
    """Bytes sent per host in sliding windows (D6 as a stream)."""
    rows = _stored_windows(t, lambda ev: J.transfer_windows(ev, ["host_id"], "bytes_sent", "2 hours", "1 hour"), NET_CONN,
                           ["window_start", "host_id"], "transfers")
    return rows.select("host_id", F.col("window_start").cast("string").alias("window_start"), "closed", "bytes_sent")


def _hits_sql(body: str, confidence: str, condition: str) -> str:
    return f"select *, round({confidence}, 6)::double as confidence from ({body}) where {condition}"


@query("i3_sequence_hits", with_views(_hits_sql(
    _sliding_sql("host_id", "sec_log", _FAIL, "hour", 6, "count(*)::bigint as events"), "least(0.5+events*0.05,0.95)",
    "events >= 5"), "sec_log"))
def sequence_hits(t: Inputs):
    """Windows with at least five failed logins, with their confidence (D4 as a stream)."""
    rows = _stored_windows(t, lambda ev: J.sequence_windows(ev, ["host_id"], "6 hours", "1 hour"), SEC_LOG,
                           ["window_start", "host_id"], "sequence-hits")
    return J.sequence_hits(rows).select("host_id", F.col("window_start").cast("string").alias("window_start"), "closed",
                                        "events", F.round("confidence", 6).alias("confidence"))


@query("i3_port_scan_hits", with_views(_hits_sql(
    _sliding_sql("remote_addr", "net_conn", "true", "day", 10, "count(distinct local_port)::bigint as ports"),
    "least(0.6+ports*0.02,0.95)", "ports >= 5"), "net_conn"))
def port_scan_hits(t: Inputs):
    """Remote addresses that touch at least five local ports in ten days (D5 as a stream)."""
    rows = _stored_windows(t, lambda ev: J.scan_windows(ev, ["remote_addr"], "local_port", "10 days", "1 day"), NET_CONN,
                           ["window_start", "remote_addr"], "scan-hits")
    return J.scan_hits(rows, 5).select("remote_addr", F.col("window_start").cast("string").alias("window_start"), "closed",
                                       "ports", F.round("confidence", 6).alias("confidence"))


@query("i3_exfiltration_hits", with_views(_hits_sql(
    _sliding_sql("host_id", "net_conn", f"not {Q.private_ip('remote_addr')}", "hour", 24,
                 "sum(bytes_sent)::bigint as bytes_sent, count(distinct remote_addr)::bigint as destinations"), "0.7",
    "bytes_sent > 104857600 and destinations > 3"), "net_conn"))
def exfiltration_hits(t: Inputs):
    """Hosts that send over 100 MB to more than three public addresses in a day (D6 as a stream)."""
    rows = _stored_windows(t, lambda ev: J.transfer_windows(ev, ["host_id"], "bytes_sent", "24 hours", "1 hour",
                                                            "remote_addr"), NET_CONN, ["window_start", "host_id"],
                           "transfer-hits")
    return J.transfer_hits(rows).select(
        "host_id", F.col("window_start").cast("string").alias("window_start"), "closed", "bytes_sent", "destinations",
        F.round("confidence", 6).alias("confidence"))


@query("i4_tumbling_counts", with_views(
    f"""select cast(w as varchar) as slot, w + interval 1 hour <= (select max(ts) from sec_log) - interval 10 minutes
          as closed, count(*)::bigint as events, count_if({Q.TRIAGE} in ('critical','high'))::bigint as threats
        from (select *, time_bucket(interval 1 hour, ts) as w from sec_log) group by w""", "sec_log"))
def tumbling_counts(t: Inputs):
    severe = S.triage_severity(F.col("message")).isin("critical", "high")
    rows = _stored_windows(t, lambda ev: J.window_counts(ev, [], "1 hour", threats=severe), SEC_LOG, ["window_start"],
                           "hours")
    return rows.select(F.col("window_start").cast("string").alias("slot"), "closed", "events", "threats")


@query("i5_sessions", """select user_id, cast(min(ts) as varchar) as started, count(*)::bigint as events,
    max(ts) + interval 30 minutes <= (select max(ts) from events) - interval 10 minutes as closed from (
    select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *,
      case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end
      as fresh from events)) group by user_id, s""")
def session_rows(t: Inputs):
    """Sessions over three deliveries: those that the watermark has closed, and the open ones that the state holds."""
    path, checkpoint = new_path(t.spark, "sessions"), new_path(t.spark, "sessions-checkpoint")
    _arrivals(t, lambda ev: SS.sessions(ev, ["user_id"], path, checkpoint, "30 minutes"))
    done = t.spark.read.schema("user_id long, started timestamp_ntz, ended timestamp_ntz, events long").parquet(path)
    held = SS.open_sessions(t.spark, checkpoint, ["user_id"], "30 minutes")
    rows = done.withColumn("closed", F.lit(True)).unionByName(held.withColumn("closed", F.lit(False)))
    return rows.select("user_id", F.col("started").cast("string").alias("started"), "events", "closed")


@query("i6_interval_join", with_views(
    """select a.event_id as later_id, a.host_id, count(b.event_id)::bigint as matches,
         arg_max(b.event_id, {'t': b.ts, 'i': b.event_id}) as nearest from sec_log a left join sec_log b
         on a.host_id=b.host_id and b.ts<=a.ts and b.ts>=a.ts - interval 900 seconds and b.severity='warning'
       where a.severity='error' group by 1,2""", "sec_log"))
def preceding_warnings(t: Inputs):
    """Per error the warnings of its host in the 15 minutes before it, over three deliveries; errors that the streams
    have not passed yet come from the state."""
    path, checkpoint = new_path(t.spark, "pairs"), new_path(t.spark, "pairs-checkpoint")

    def run(ev: DataFrame) -> None:
        log = ev.selectExpr(*spark_columns(SEC_LOG))
        SS.preceded_by(log.where("severity = 'error'"), log.where("severity = 'warning'"), ["host_id"], 900, path, checkpoint)

    _arrivals(t, run)
    done = t.spark.read.schema("event_id long, host_id string, matches long, nearest long").parquet(path)
    rows = done.unionByName(SS.open_matches(t.spark, checkpoint, ["host_id"]))
    return rows.select(F.col("event_id").alias("later_id"), "host_id", "matches", "nearest")


@query("i7_retention", with_views(
    """select source, cast(w as varchar) as window_start, count(*)::bigint as events
       from (select *, time_bucket(interval 1 hour, ts) as w from sec_log)
       where w + interval 1 hour > (select max(ts) from sec_log) - interval 10 minutes group by 1,2""", "sec_log"))
def retention(t: Inputs):
    """What the store still holds after three deliveries: the windows that the watermark has not passed."""
    path, checkpoint = new_path(t.spark, "kept"), new_path(t.spark, "kept-checkpoint")
    _arrivals(t, lambda ev: SS.window_totals(ev.selectExpr(*spark_columns(SEC_LOG)), ["source"], "1 hour", path,
                                             checkpoint))
    return SS.stored(t.spark, checkpoint).select(
        "source", F.col("window.start").cast("timestamp_ntz").cast("string").alias("window_start"),
        F.col("count").alias("events"))


@query("i13_submission_stream", "select event_type, count(*)::bigint as events, count(distinct event_id)::bigint as ids "
                                "from events group by 1")
def submission_stream(t: Inputs):
    """Pushed JSON submissions, read as a stream in three deliveries."""
    inbox, path, checkpoint = (new_path(t.spark, n) for n in ("inbox", "received", "received-checkpoint"))
    events = t.table("events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("timestamp"),
                                      F.lit("api").alias("source"), "event_type")
    for part in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.mode("append").json(inbox)
        J.append_to(J.read_files(t.spark, inbox, schemas.SUBMISSION, "json"), path, checkpoint)
    return t.spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"))


@query("i13_late_rows", """select event_type, count_if(not late)::bigint as kept, count_if(late)::bigint as dropped,
    count(*)::bigint as rows from (select event_type, ts < timestamp '2024-01-09' and event_id % 17 = 0 and ts < (
      select max(ts) from events where ts < timestamp '2024-01-20') - interval 10 minutes as late from events) group by 1""")
def late_rows(t: Inputs):
    """Some rows of the first delivery come with the third: they are kept in a table of their own and counted."""
    on_time, late, clock = (J.BatchTable(t.spark, new_path(t.spark, n)) for n in ("on-time", "late", "clock"))
    path, checkpoint = new_path(t.spark, "inbox"), new_path(t.spark, "inbox-checkpoint")
    events = t.table("events")
    held = (F.col("ts") < F.lit("2024-01-09").cast("timestamp_ntz")) & (F.col("event_id") % 17 == 0)
    deliveries = [events.where("ts < timestamp_ntz'2024-01-09'").where(~held),
                  events.where("ts >= timestamp_ntz'2024-01-09' and ts < timestamp_ntz'2024-01-20'"),
                  events.where("ts >= timestamp_ntz'2024-01-20'").unionByName(events.where(held))]
    for part in deliveries:
        part.write.mode("append").parquet(path)
        J.split_late(J.read_files(t.spark, path, schemas.EVENT), on_time, late, clock, checkpoint)
    both = on_time.read().withColumn("late", F.lit(False)).unionByName(late.read().withColumn("late", F.lit(True)))
    return both.groupBy("event_type").agg(F.count_if(~F.col("late")).alias("kept"), F.count_if("late").alias("dropped"),
                                          F.count(F.lit(1)).alias("rows"))


@query("d2_cumulative_counts", with_views(
    "select source, severity, count(*)::bigint as events from sec_log group by 1,2", "sec_log"))
def cumulative_counts(t: Inputs):
    """Counts carried over three deliveries, read from the stream's own state."""
    checkpoint = new_path(t.spark, "totals-checkpoint")
    _arrivals(t, lambda ev: SS.running_totals(ev.selectExpr(*spark_columns(SEC_LOG)), ["source", "severity"], checkpoint))
    return SS.stored(t.spark, checkpoint).select("source", "severity", F.col("count").alias("events"))


_FEATS = ["message_length", "severity_score", "entropy", "pattern_count"]


_SEED = 20


@query("i8_moving_baseline", with_views(
    """select source, feature, round(s.m,6) as mean, round(s.v,6) as variance from ema""", "sec_log", ctes={
        "feat": "select event_id, ts, source, " + Q.plain({k: Q.log_features("severity")[k] for k in _FEATS})
                + " from sec_log",
        "long": f"""select event_id, ts, source, feature, value, row_number() over (partition by source, feature
            order by ts, event_id) as r from feat unpivot (value for feature in ({', '.join(_FEATS)}))
            where ts <= (select max(ts) from sec_log) - interval 10 minutes""",
        "seed": f"""select source, feature, avg(value) as m0, power(stddev_samp(value),2) as v0 from long
            where r <= {_SEED} group by 1,2 having count(*) = {_SEED}""",
        "later": f"""select source, feature, list({{'m':0.0::double,'v':0.0::double,'x':value}} order by ts, event_id) as xs
            from long where r > {_SEED} group by 1,2""",
        "ema": """select source, feature, case when xs is null then {'m':m0,'v':v0,'x':0.0::double} else
            list_reduce(list_prepend({'m':m0,'v':v0,'x':0.0::double}, xs), lambda a, b: {
            'm':0.9*a.m+0.1*b.x, 'v':0.9*a.v+0.1*(b.x-(0.9*a.m+0.1*b.x))*(b.x-(0.9*a.m+0.1*b.x)), 'x':b.x}) end as s
            from seed left join later using (source, feature)"""}))
def moving_baseline(t: Inputs):
    """Moving averages over three deliveries: the first rows of a source are the seed, however they arrive."""
    state = J.VersionedTable(t.spark, new_path(t.spark, "profile"))
    checkpoint = new_path(t.spark, "profile-checkpoint")

    def run(ev: DataFrame) -> None:
        rows = FX.log_features(ev.selectExpr(*spark_columns(SEC_LOG)), severity="severity")
        J.moving_baseline(rows.select("event_id", "ts", "source", *_FEATS), _FEATS, ["source"], state, checkpoint,
                          seed_rows=_SEED)

    _arrivals(t, run)
    names = F.array(*[F.lit(f) for f in _FEATS])
    rows = state.latest().select("source", F.explode(F.arrays_zip(names.alias("f"), "means", "variances")).alias("e"))
    return rows.select("source", F.col("e.f").alias("feature"), F.round("e.means", 6).alias("mean"),
                       F.round("e.variances", 6).alias("variance"))


_CHAIN = {
    "seq_rows": """select host_id, (sequence_number-1)//512 as segment, (sequence_number-1)%512 as pos, sequence_number,
        record_id, content_hash from audit_log""",
    "links": """select host_id, segment, pos, sequence_number, record_id, content_hash,
          sha256(sha256('genesis-v1')||':'||content_hash) as chain_hash from seq_rows where pos = 0
        union all select s.host_id, s.segment, s.pos, s.sequence_number, s.record_id, s.content_hash,
          sha256(l.chain_hash||':'||s.content_hash)
        from links l join seq_rows s on s.host_id=l.host_id and s.segment=l.segment and s.pos=l.pos+1""",
}


@query("i9_chain_append", with_views("select host_id, sequence_number, record_id, chain_hash from links", "audit_log",
                                     ctes=_CHAIN))
def chain_append(t: Inputs):
    """Chains grown over three deliveries equal the chain built at once."""
    links = J.BatchTable(t.spark, new_path(t.spark, "links"))
    heads = J.VersionedTable(t.spark, new_path(t.spark, "heads"))
    checkpoint = new_path(t.spark, "chain-checkpoint")

    def run(ev: DataFrame) -> None:
        rows = ev.selectExpr(*spark_columns(SEC_LOG)).where("event_id%103<>0").select(
            F.col("event_id").alias("record_id"), "ts", "host_id", event_hash().alias("content_hash"))
        J.append_chain(rows, links, heads, checkpoint)

    _arrivals(t, run)
    return links.read().select("host_id", "sequence_number", "record_id", "chain_hash")


_MOUNTAIN = {
    "nodes": """select host_id, 0 as level, (sequence_number-1)::bigint as idx,
          sha256('leaf:'||sequence_number||':'||content_hash) as hash from audit_log
        union all select host_id, level+1, idx//2, sha256('node:'||string_agg(hash, ':' order by idx)) from nodes
        group by host_id, level, idx//2 having count(*) = 2""",
    "lengths": """select n as delivery, host_id, count(*)::bigint as records from audit_log join (values
          (0, timestamp '2024-01-09'), (1, timestamp '2024-01-20'), (2, timestamp '2999-01-01')) d(n, until) on ts < until
        group by 1,2""",
    "roots": """select delivery, host_id, records, sha256('root:'||records||':'||list_reduce(list(hash order by level),
          lambda acc, h: sha256('node:'||h||':'||acc))) as root, count(*)::bigint as peaks
        from lengths join nodes using (host_id) where (records >> level) % 2 = 1 and idx = (records >> level) - 1
        group by delivery, host_id, records""",
}


def _grown_chains(t: Inputs) -> tuple[J.BatchTable, J.BatchTable, J.VersionedTable]:
    """Links, nodes and heads of chains after three deliveries."""
    links, nodes = (J.BatchTable(t.spark, new_path(t.spark, n)) for n in ("links", "nodes"))
    heads = J.VersionedTable(t.spark, new_path(t.spark, "heads"))
    checkpoint = new_path(t.spark, "chain-checkpoint")

    def run(ev: DataFrame) -> None:
        rows = ev.selectExpr(*spark_columns(SEC_LOG)).where("event_id%103<>0").select(
            F.col("event_id").alias("record_id"), "ts", "host_id", event_hash().alias("content_hash"))
        J.append_chain(rows, links, heads, checkpoint, nodes=nodes)

    _arrivals(t, run)
    return links, nodes, heads


@query("i9_incremental_root", with_views("select delivery, host_id, records, root, peaks from roots", "audit_log",
                                         ctes=_MOUNTAIN))
def incremental_root(t: Inputs):
    """Roots stored after each of three deliveries, each worked out from the delivery and the heads before it."""
    _, _, heads = _grown_chains(t)
    kept = [heads.before(v + 1).withColumn("delivery", F.lit(v)) for v in sorted(heads.versions())]
    rows = kept[0]
    for other in kept[1:]:
        rows = rows.unionByName(other)
    return rows.select("delivery", "host_id", F.col("last_sequence").alias("records"), "root",
                       F.size("peaks").cast("long").alias("peaks"))


@query("i9_growth_audit", with_views(
    """select delivery, host_id, (delivery <> 1 or host_id not in ('host-1', 'host-2', 'host-3')) as grown_valid
       from lengths""", "audit_log", ctes=_MOUNTAIN))
def growth_audit(t: Inputs):
    """Every delivery is checked against the heads before and after it; the second one was damaged in three chains."""
    links, _, heads = _grown_chains(t)
    middle = F.col("sequence_number") == F.col("_mid")
    out = None
    for v in sorted(heads.versions()):
        batch = t.spark.read.parquet(links.path).where(F.col("batch") == v).drop("batch")
        if v == 1:
            mid = batch.groupBy("host_id").agg(F.expr("(min(sequence_number) + max(sequence_number)) div 2").alias("_mid"))
            marked = batch.join(mid, "host_id")
            changed = F.when(middle & (F.col("host_id") == "host-1"), F.lit("x")).otherwise(F.col("content_hash"))
            batch = marked.withColumn("content_hash", changed).where(~(middle & (F.col("host_id") == "host-2"))).withColumn(
                "sequence_number", F.when(middle & (F.col("host_id") == "host-3"), F.col("sequence_number") + 1).otherwise(
                    F.col("sequence_number"))).drop("_mid")
        rows = M.audit_growth(heads.before(v), batch, heads.before(v + 1)).withColumn("delivery", F.lit(v))
        out = rows if out is None else out.unionByName(rows)
    return out.select("delivery", "host_id", "grown_valid")


@query("e3_inclusion_proof", with_views(
    """select host_id, sequence_number, forged, max(level)::bigint as siblings, any_value(peaks) as peaks,
         any_value(root) as root, not forged as proved
       from (select r.host_id, (r.records+1)//2 as sequence_number, r.peaks, r.root, n.level from roots r join nodes n
             on n.host_id=r.host_id and n.idx=((r.records+1)//2-1)>>n.level and (n.idx+1)<<n.level<=r.records
             where delivery=2), (values (false), (true)) f(forged) group by 1,2,3""", "audit_log", ctes=_MOUNTAIN))
def inclusion_proof(t: Inputs):
    """The middle record of every grown chain is proved from its siblings and the other peaks; a forged one is not."""
    links, nodes, versions = _grown_chains(t)
    heads = versions.latest()
    middle = heads.select("host_id", F.expr("(last_sequence + 1) div 2").alias("sequence_number"))
    shown = links.read().join(middle, ["host_id", "sequence_number"]).select("host_id", "sequence_number", "content_hash")
    both = shown.withColumn("forged", F.lit(False)).unionByName(shown.withColumns(
        {"content_hash": F.sha2(F.lit("forged"), 256), "forged": F.lit(True)}))
    rows = M.proved(M.proofs(both, nodes.read(), heads), heads).join(heads.select("host_id", "root"), "host_id")
    return rows.select("host_id", "sequence_number", "forged", F.size("path").cast("long").alias("siblings"),
                       F.size("peaks").cast("long").alias("peaks"), "root", "proved")


_STATES = """select coalesce(p.ts, b.ts) as ts, case when p.event_id is null then 'missing_in_primary'
    when b.record_id is null then 'missing_in_backup' when p.h<>b.content_hash then 'hash_mismatch' else 'valid' end
    as status from (select *, sha256(concat_ws('|',cast(event_id as varchar),cast(ts as varchar),source,event_type,severity,
      host_id,message)) as h from primary_events) p full outer join audit_log b on p.event_id=b.record_id"""


@query("i10_periodic_audit", with_views(
    """select n as batch_no, count_if(status='valid')::bigint as valid, count_if(status='hash_mismatch')::bigint as tampered,
         count_if(status='missing_in_primary')::bigint as missing, count_if(status='missing_in_backup')::bigint as orphans,
         count_if(status in ('hash_mismatch','missing_in_primary'))>0 as alert
       from states join (values (0, timestamp '2024-01-09'), (1, timestamp '2024-01-20'), (2, timestamp '2999-01-01'))
         d(n, until) on ts < until group by 1""", "primary_events", "audit_log", ctes={"states": _STATES}))
def audit_stream(t: Inputs):
    """The stored tables are audited after each of three deliveries; the stream is only the clock."""
    reports = J.BatchTable(t.spark, new_path(t.spark, "reports"))
    primary, backup, known = (new_path(t.spark, n) for n in ("primary", "backup", "digests"))
    checkpoint = new_path(t.spark, "audit-checkpoint")
    stored = iter("abc")

    def run(ev: DataFrame) -> None:
        J.periodic_audit(
            ev, lambda: t.spark.read.parquet(primary).select(
                F.col("event_id").alias("record_id"), event_hash().alias("content_hash"), *RC.RANGE),
            lambda: t.spark.read.parquet(backup), lambda: t.spark.read.parquet(known), reports, checkpoint)

    def store(part: DataFrame) -> None:
        log, batch = part.selectExpr(*spark_columns(SEC_LOG)), next(stored)
        RC.store(log.where("event_id%97<>0").selectExpr(*spark_columns(PRIMARY)), primary, batch, "event_id")
        RC.store(log.where("event_id%103<>0").select(
            F.col("event_id").alias("record_id"), "ts", event_hash().alias("content_hash")), backup, batch,
            digest_path=known)

    _arrivals(t, run, store)
    return reports.read().select(F.col("batch_no").cast("int").alias("batch_no"), "valid", "tampered", "missing",
                                 "orphans", "alert")


@query("i11_live_monitor", with_views(
    f"""select event_id, {Q.LEVEL} as level, case when {Q.matches_any('line', [p for r in C.RULES for p in r.log_patterns])}
          or score>0.7 then 'threat' when score>0.5 then 'warning' else 'normal' end as triage
        from (select l.*, s.message, {Q.log_features(message='line')['severity_score']} as score from log_line l
              join sec_log s using (event_id))""", "log_line"))
def live_monitor(t: Inputs):
    lines = _log(t).selectExpr(*spark_columns(LOG_LINE))
    return J.run_to_table(J.live_monitor(lines).select("event_id", "level", "triage"), "monitor")


@query("i11_live_scores", with_views(
    f"select event_id, anomaly_score, is_anomaly, severity from ({_detect_sql('log', 0.35)})", "sec_log"))
def live_scores(t: Inputs):
    """Lines scored as they arrive, against a profile that a batch has learned and stored."""
    rows = FX.log_features(_log(t).withColumn("source_type", F.lit("log")), severity="severity")
    profile = cut(B.learn(features_of(t, "log"), C.LOG_FEATURES))
    scored = J.live_scores(rows, profile, "log", C.LOG_FEATURES, 0.35)
    return J.run_to_table(scored.select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly",
                                        F.col("anomaly_severity").alias("severity")), "scores")


@query("i11_live_rules", with_views(
    """select host_id, rule_id, cast(time_bucket(interval 1 hour, ts) as varchar) as window_start, count(*)::bigint as events
       from hits group by 1,2,3""", "log_line", ctes={"hits": _rule_hits("log")}))
def live_rules(t: Inputs):
    """Rule hits per host and hour, over three deliveries."""
    table, checkpoint = J.OpenAndClosed(t.spark, new_path(t.spark, "rules")), new_path(t.spark, "rules-checkpoint")
    _arrivals(t, lambda ev: J.write_windows(J.rule_windows(
        ev.selectExpr(*spark_columns(SEC_LOG)).selectExpr(*spark_columns(LOG_LINE)), "log", ["line"], C.RULES,
        ["host_id"], "1 hour"), ["window_start", "host_id", "rule_id"], table, checkpoint))
    return table.read().select("host_id", "rule_id", F.col("window_start").cast("string").alias("window_start"), "events")


_NEXT = """select distinct host_id, snapshot_ts, lag(snapshot_ts) over w as before, lead(snapshot_ts) over w as after
  from (select distinct host_id, snapshot_ts from proc_snapshot) window w as (partition by host_id order by snapshot_ts)"""


@query("i12_snapshot_events", with_views(
    """select s.host_id, cast(s.snapshot_ts as varchar) as seen_at, s.pid, 'start' as change from proc_snapshot s
         join nxt using (host_id, snapshot_ts) left join proc_snapshot p on p.host_id=s.host_id and p.pid=s.pid
         and p.snapshot_ts=nxt.before where nxt.before is not null and p.pid is null and s.snapshot_ts<=closed_to
       union all select s.host_id, cast(nxt.after as varchar), s.pid, 'end' from proc_snapshot s
         join nxt using (host_id, snapshot_ts) left join proc_snapshot p on p.host_id=s.host_id and p.pid=s.pid
         and p.snapshot_ts=nxt.after where nxt.after is not null and p.pid is null and nxt.after<=closed_to""",
    "proc_snapshot", ctes={"nxt": _NEXT.replace("select distinct host_id, snapshot_ts, lag",
                                                "select distinct (select max(snapshot_ts) from proc_snapshot) "
                                                "- interval 10 minutes as closed_to, host_id, snapshot_ts, lag")}))
def snapshot_stream(t: Inputs):
    """Starts and ends over three deliveries, of all snapshots that the watermark has passed."""
    path, checkpoint = new_path(t.spark, "changes"), new_path(t.spark, "changes-checkpoint")

    def run(ev: DataFrame) -> None:
        rows = ev.selectExpr("'host-'||cast(user_id%8 as string) as host_id",
                             "cast(date_trunc('day',ts) as timestamp_ntz) as snapshot_ts", "1000+user_id as pid")
        SS.snapshot_changes(rows, "pid", path, checkpoint)

    _arrivals(t, run)
    rows = t.spark.read.schema("host_id string, snapshot_ts timestamp_ntz, pid long, change string").parquet(path)
    return rows.select("host_id", F.col("snapshot_ts").cast("string").alias("seen_at"), "pid", "change")
