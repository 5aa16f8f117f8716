"""Process, connection and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosift import constants as C
from argosift.functions import severity as S
from argosift.operators import snapshots as N
from argosift.plans import sqltext as Q
from argosift.plans.registry import query
from argosift.plans.views import Inputs, with_views


def _ci(col: str, words) -> list[str]:
    return [f"contains(lower({col}), {Q.q(w.lower())})" for w in words]


_PROC_IND = "+".join(f"({t})::int" for t in [*_ci("exe", C.PROCESS_PATHS), *_ci("name", C.PROCESS_NAMES),
                                             *_ci("cmdline", C.PROCESS_COMMANDS)])


@query("b11_suspicious_processes", with_views(
    f"""select event_id, pid, ({_PROC_IND})::bigint as indicators, 'warning' as indicator_severity,
          case when contains(lower(exe),'/tmp/') then 'Executable in suspicious path: /tmp/' else 'x' end as first_kind
        from proc where ({_PROC_IND})>0""", "proc"))
def suspicious_processes(t: Inputs):
    rows = N.suspicious_process(t.proc())
    first = F.when(F.col("indicators")[0].startswith("Executable"), F.col("indicators")[0]).otherwise("x")
    return rows.select("event_id", "pid", F.size("indicators").cast("long").alias("indicators"), "indicator_severity",
                       first.alias("first_kind"))


_LINKED = """select p.*, ports from proc p left join (select host_id, pid, list(distinct remote_port) as ports
  from net_conn group by 1,2) n on n.host_id=p.host_id and n.pid=1000+p.event_id%200"""
_PORT_IND = "+".join(f"coalesce(list_contains(ports, {p}), false)::int" for p in C.PROCESS_PORTS)


@query("b11_risky_port_processes", with_views(
    f"select event_id, ({_PROC_IND}+{_PORT_IND})::bigint as indicators, ({_PORT_IND})::bigint as port_indicators "
    f"from linked where ({_PROC_IND}+{_PORT_IND})>0", "proc", "net_conn", ctes={"linked": _LINKED}))
def risky_port_processes(t: Inputs):
    """Processes judged together with the remote ports they are connected to."""
    ports = t.net_conn().groupBy("host_id", F.col("pid").alias("conn_pid")).agg(
        F.collect_set("remote_port").alias("ports"))
    procs = t.proc().withColumn("conn_pid", 1000 + F.col("event_id") % 200)
    rows = N.suspicious_process(procs.join(ports, ["host_id", "conn_pid"], "left"), "ports")
    risky = F.filter("indicators", lambda x: x.startswith("Connection to high-risk port"))
    return rows.select("event_id", F.size("indicators").cast("long").alias("indicators"),
                       F.size(risky).cast("long").alias("port_indicators"))


@query("b12_process_severity", with_views(
    """select event_id, case when cpu_percent>80 or memory_percent>50 or connections>100 then 'warning' else 'info' end
       as severity from proc""", "proc"))
def process_severity(t: Inputs):
    return t.proc().select("event_id", N.process_severity(F.col("cpu_percent"), F.col("memory_percent"),
                                                          F.col("connections")).alias("severity"))


@query("b13_process_tags", with_views(
    "select event_id, " + Q.joined([("true", "'process'"), *[
        (Q.contains_any("lower(name)", ws), Q.q(tag)) for tag, ws in C.PROCESS_FAMILIES],
        ("connections>0", "'network_active'")]) + " as tags from proc", "proc"))
def process_tags(t: Inputs):
    return t.proc().select("event_id", F.array_join(N.process_tags(F.col("name"), F.col("connections")), ",")
                           .alias("tags"))


_PORTS = "(" + ",".join(str(p) for p in C.PORT_NAMES) + ")"


@query("b14_suspicious_connections", with_views(
    f"""select event_id, n::bigint as indicators, (n*25)::bigint as risk_score, sev as indicator_severity from (
          select event_id, (remote_port in {_PORTS})::int+(remote_port>49152)::int
            +(({Q.entropy_bits('remote_addr')})>3.5)::int+(per>50)::int as n,
            case when remote_port in {_PORTS} or per>50 then 'warning' else 'info' end as sev
          from net_conn join (select host_id, pid, count(*) as per from net_conn group by 1,2) using (host_id, pid))
        where n>0""", "net_conn"))
def suspicious_connections(t: Inputs):
    conns = t.net_conn()
    per = conns.groupBy("host_id", "pid").agg(F.count(F.lit(1)).alias("process_connections"))
    rows = N.suspicious_connection(conns.join(per, ["host_id", "pid"]))
    return rows.select("event_id", F.size("indicators").cast("long").alias("indicators"), "risk_score",
                       "indicator_severity")


@query("b15_connection_direction", with_views(
    f"""select event_id, case when status='LISTEN' then 'listen' when remote_addr<>'' then 'outbound' else 'inbound' end
          as direction, case when remote_port in {_PORTS} or {Q.contains_any('lower(process_name)', C.CONNECTION_TOOLS)}
          then 'warning' else 'info' end as severity from net_conn""", "net_conn"))
def connection_direction(t: Inputs):
    return t.net_conn().select(
        "event_id", N.connection_direction(F.col("status"), F.col("remote_addr")).alias("direction"),
        N.connection_severity(F.col("remote_port"), F.col("process_name")).alias("severity"))


_OTHER = "(" + ",".join(str(p) for p in C.PORT_NAMES if p not in dict(C.PORT_TAGS)) + ")"


@query("b16_connection_tags", with_views(
    "select event_id, " + Q.joined([("true", "'network'"), ("true", "'connection'"),
                                    *[(f"remote_port={p}", Q.q(tag)) for p, tag in C.PORT_TAGS],
                                    (f"remote_port in {_OTHER}", "'suspicious_port'"),
                                    ("status='ESTABLISHED'", "'established'"), ("status='LISTEN'", "'listening'")])
    + " as tags from net_conn", "net_conn"))
def connection_tags(t: Inputs):
    return t.net_conn().select("event_id", F.array_join(N.connection_tags(F.col("remote_port"), F.col("status")), ",")
                               .alias("tags"))


@query("b18_metric_severity", with_views(
    """select event_id, case when cpu_percent>=95 then 'critical' when cpu_percent>=80 then 'warning' else 'info' end as cpu,
         case when memory_percent>=95 then 'critical' when memory_percent>=85 then 'warning' else 'info' end as memory,
         case when disk_percent>=95 then 'critical' when disk_percent>=85 then 'warning' else 'info' end as disk,
         case when cpu_percent/40>2 then 'critical' when cpu_percent/40>1 then 'warning' else 'info' end as load,
         case when memory_percent*4>90 then 'critical' when memory_percent*4>80 then 'warning' else 'info' end as heat
       from metric_base""", "metric_base"))
def metric_severity(t: Inputs):
    """Threshold bands; load and temperature are derived from the metric columns."""
    return t.metric_sample().select("event_id", *[
        S.metric_severity(F.col(f"{n}_percent"), *band).alias(n) for n, band in C.METRIC_BANDS.items()],
        S.load_severity(F.col("cpu_percent") / 40, 1, 2).alias("load"),
        S.load_severity(F.col("memory_percent") * 4, 80, 90).alias("heat"))


_NEXT = """select distinct host_id, snapshot_ts, lag(snapshot_ts) over w as before, lead(snapshot_ts) over w as after
  from (select distinct host_id, snapshot_ts from proc_snapshot) window w as (partition by host_id order by snapshot_ts)"""


@query("c12_process_changes", with_views(
    """select s.host_id, cast(s.snapshot_ts as varchar) as seen_at, s.pid, 'start' as change from proc_snapshot s
         join nxt using (host_id, snapshot_ts) left join proc_snapshot p on p.host_id=s.host_id and p.pid=s.pid
         and p.snapshot_ts=nxt.before where nxt.before is not null and p.pid is null
       union all select s.host_id, cast(nxt.after as varchar), s.pid, 'end' from proc_snapshot s
         join nxt using (host_id, snapshot_ts) left join proc_snapshot p on p.host_id=s.host_id and p.pid=s.pid
         and p.snapshot_ts=nxt.after where nxt.after is not null and p.pid is null""",
    "proc_snapshot", ctes={"nxt": _NEXT}))
def process_changes(t: Inputs):
    """Processes that start or end between daily snapshots."""
    rows = N.snapshot_changes(t.proc_snapshot(), ["pid"])
    return rows.select("host_id", F.col("snapshot_ts").cast("string").alias("seen_at"), "pid", "change")


_CONN_KEYS = ["local_addr", "local_port", "remote_addr", "remote_port", "status", "pid"]
_CONN_SNAP = f"""select distinct host_id, cast(date_trunc('day', ts) as timestamp) as snapshot_ts, {', '.join(_CONN_KEYS)}
  from net_conn"""
_CK = " and ".join(f"p.{k}=s.{k}" for k in ["host_id", *_CONN_KEYS])


@query("c13_connection_changes", with_views(
    f"""select host_id, cast(moment as varchar) as seen_at, change, count(*)::bigint as connections from (
          select s.host_id, s.snapshot_ts as moment, 'opened' as change from snap s join nxt using (host_id, snapshot_ts)
            where nxt.before is not null and not exists (select 1 from snap p where {_CK} and p.snapshot_ts=nxt.before)
          union all select s.host_id, nxt.after, 'closed' from snap s join nxt using (host_id, snapshot_ts)
            where nxt.after is not null and not exists (select 1 from snap p where {_CK} and p.snapshot_ts=nxt.after))
        group by 1,2,3""", "net_conn", ctes={"snap": _CONN_SNAP, "nxt": _NEXT.replace("proc_snapshot", "snap")}))
def connection_changes(t: Inputs):
    snap = t.net_conn().withColumn("snapshot_ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    rows = N.snapshot_changes(snap, _CONN_KEYS, appeared="opened", vanished="closed")
    return rows.groupBy("host_id", F.col("snapshot_ts").cast("string").alias("seen_at"), "change").agg(
        F.count(F.lit(1)).alias("connections"))


@query("g4_vanished_members", with_views(
    """select s.host_id, cast(s.snapshot_ts as varchar) as last_seen, s.pid from proc_snapshot s join nxt
         using (host_id, snapshot_ts) where nxt.after is not null and not exists (select 1 from proc_snapshot p
         where p.host_id=s.host_id and p.pid=s.pid and p.snapshot_ts=nxt.after)""", "proc_snapshot", ctes={"nxt": _NEXT}))
def vanished_members(t: Inputs):
    """Members of every snapshot that the next one of their host no longer has."""
    snap = t.proc_snapshot()
    following = N.snapshot_index(snap).select("host_id", F.col("_before").alias("snapshot_ts"), F.col("snapshot_ts")
                                              .alias("_next"))
    held = snap.join(following, ["host_id", "snapshot_ts"])
    still = snap.select("host_id", F.col("snapshot_ts").alias("_next"), "pid")
    return held.join(still, ["host_id", "_next", "pid"], "left_anti").select(
        "host_id", F.col("snapshot_ts").cast("string").alias("last_seen"), "pid")


@query("e11_snapshot_order", with_views(
    """select host_id, cast(snapshot_ts as varchar) as taken_at, dense_rank() over (partition by host_id
         order by snapshot_ts)::bigint as position, coalesce(cast(lag(snapshot_ts) over (partition by host_id
         order by snapshot_ts) as varchar),'') as previous from (select distinct host_id, snapshot_ts from proc_snapshot)""",
    "proc_snapshot"))
def snapshot_order(t: Inputs):
    from pyspark.sql import Window as W
    w = W.partitionBy("host_id").orderBy("snapshot_ts")
    taken = t.proc_snapshot().select("host_id", "snapshot_ts").distinct()
    return taken.select("host_id", F.col("snapshot_ts").cast("string").alias("taken_at"),
                        F.dense_rank().over(w).cast("long").alias("position"),
                        F.coalesce(F.lag("snapshot_ts").over(w).cast("string"), F.lit("")).alias("previous"))


_DESC = """select host_id, pid, name, 0 as depth from host_proc where pid=1003 union all
  select p.host_id, p.pid, p.name, t.depth+1 from host_proc p join tree t on p.host_id=t.host_id and p.ppid=t.pid"""


@query("c16_process_tree", with_views("select host_id, pid, name, depth::bigint as depth from tree", "host_proc",
                                      ctes={"tree": _DESC}))
def process_tree(t: Inputs):
    """Descendants of process 1003 on each host; hosts reuse the same pids."""
    return N.descendants(t.host_proc(), 1003).select("host_id", "pid", "name", "depth")


@query("c18_connection_owner", with_views(
    """select n.event_id, coalesce(p.name,'') as owner_name from net_conn n left join (select host_id, pid, max(name) as name
       from (select host_id, 1000+event_id%200 as pid, name from proc) group by 1,2) p using (host_id, pid)""",
    "net_conn", "proc"))
def connection_owner(t: Inputs):
    procs = t.proc().select("host_id", (1000 + F.col("event_id") % 200).alias("pid"), "name").groupBy(
        "host_id", "pid").agg(F.max("name").alias("name"))
    return N.name_connections(t.net_conn(), procs).select("event_id", F.coalesce("owner_name", F.lit(""))
                                                          .alias("owner_name"))


@query("c19_parent_process", with_views(
    """select c.host_id, c.pid, coalesce(p.name,'') as parent_name from host_proc c left join host_proc p
         on c.host_id=p.host_id and c.ppid=p.pid""", "host_proc"))
def parent_process(t: Inputs):
    return N.with_parent(t.host_proc()).select("host_id", "pid", F.coalesce("parent_name", F.lit(""))
                                               .alias("parent_name"))


@query("e4_bandwidth", with_views(
    """select event_id, ds::bigint as delta_sent, dr::bigint as delta_recv, round(e,6) as elapsed_s,
         round((ds+dr)/e*8/1000000.0,9)::double as mbps from (select event_id,
         net_bytes_sent-lag(net_bytes_sent) over w as ds, net_bytes_recv-lag(net_bytes_recv) over w as dr,
         (epoch_us(ts)-epoch_us(lag(ts) over w))/1000000.0::double as e from host_metric
         window w as (partition by host_id order by ts, event_id)) where e is not null""", "host_metric"))
def bandwidth(t: Inputs):
    rows = N.bandwidth(t.host_metric())
    return rows.select("event_id", "delta_sent", "delta_recv", F.round("elapsed_s", 6).alias("elapsed_s"),
                       F.round("mbps", 9).alias("mbps"))


@query("e4_bandwidth_fixed_step", with_views(
    """select event_id, round((ds+dr)/5.0::double*8/1000000.0,9)::double as mbps,
         case when (ds+dr)/5.0::double*8/1000000.0>100 then 'warning' else 'info' end as severity from (select event_id,
         net_bytes_sent-lag(net_bytes_sent) over w as ds, net_bytes_recv-lag(net_bytes_recv) over w as dr
         from host_metric window w as (partition by host_id order by ts, event_id)) where ds is not null""", "host_metric"))
def bandwidth_fixed(t: Inputs):
    rows = N.bandwidth(t.host_metric(), interval_seconds=5)
    return rows.select("event_id", F.round("mbps", 9).alias("mbps"), "severity")


@query("e5_disk_io", with_views(
    """select event_id, round((wc-pwc)/e,6) as write_ops_per_s, round((rb-prb)/1048576.0/e,9) as read_mb_per_s from (
         select event_id, wc, rb, lag(wc) over w as pwc, lag(rb) over w as prb,
           (epoch_us(ts)-epoch_us(lag(ts) over w))/1000000.0::double as e from (select *, net_bytes_sent*1000 as rb,
           net_bytes_recv//7 as wc from host_metric) window w as (partition by host_id order by ts, event_id))
       where e is not null""", "host_metric"))
def disk_io(t: Inputs):
    """Disk counters derived from the byte counters of the samples."""
    counters = t.host_metric().withColumns({
        "read_bytes": F.col("net_bytes_sent") * 1000, "write_bytes": F.col("net_bytes_recv") * 500,
        "read_count": F.expr("net_bytes_sent div 9"), "write_count": F.expr("net_bytes_recv div 7")})
    return N.disk_io(counters).select("event_id", F.round("write_ops_per_s", 6).alias("write_ops_per_s"),
                                      F.round("read_mb_per_s", 9).alias("read_mb_per_s"))


@query("d9_health_score", with_views(
    """select host_id, cast(h as varchar) as cycle, score::bigint as health_score, case when score<50 then 'unhealthy'
         when score<80 then 'degraded' else 'healthy' end as status from (select host_id, h,
         greatest(0, 100-30*count_if(s='critical')-10*count_if(s='warning')) as score from (
         select host_id, date_trunc('hour', ts) as h, unnest([
           case when cpu_percent>=95 then 'critical' when cpu_percent>=80 then 'warning' else 'info' end,
           case when disk_percent>=95 then 'critical' when disk_percent>=85 then 'warning' else 'info' end]) as s
         from metric_base) group by 1,2)""", "metric_base"))
def health_score(t: Inputs):
    graded = F.explode(F.array(*[S.metric_severity(F.col(f"{n}_percent"), *C.METRIC_BANDS[n]) for n in ("cpu", "disk")]))
    rows = t.metric_sample().select("host_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").cast("string")
                                    .alias("cycle"), graded.alias("severity"))
    return N.health(rows, ["host_id", "cycle"]).select("host_id", "cycle", "health_score", "status")


@query("d17_connection_summary", with_views(
    """select host_id, count(*)::bigint as total, count_if(status='ESTABLISHED')::bigint as established,
         count_if(status='LISTEN')::bigint as listening, count_if(status='TIME_WAIT')::bigint as time_wait,
         count_if(status='CLOSE_WAIT')::bigint as close_wait from net_conn group by host_id""", "net_conn"))
def connection_summary(t: Inputs):
    return N.connection_summary(t.net_conn(), ["host_id"])


@query("d17_connections_by_process", with_views(
    "select process_name, remote_port, count(*)::bigint as events from net_conn group by 1,2", "net_conn"))
def connections_by_process(t: Inputs):
    return t.net_conn().groupBy("process_name", "remote_port").agg(F.count(F.lit(1)).alias("events"))


@query("d18_disk_rollup", """select o_custkey%50 as host, count(*)::bigint as disk_count, round(sum(u)/1073741824.0,9)
    as used_gb, max(p) as highest_percent, case when max(p)>=95 then 'critical' when max(p)>=85 then 'warning' else 'info'
    end as severity from (select o_custkey, (o_orderkey%1000)*1000000 as u, (o_orderkey%97)::double as p from orders)
    group by 1""")
def disk_rollup(t: Inputs):
    """Partitions read from order keys: used bytes and percentages per host."""
    disks = t.table("orders").select(
        (F.col("o_custkey") % 50).alias("host"), ((F.col("o_orderkey") % 1000) * 1000000).alias("used"),
        F.lit(2_000_000_000).alias("total"), (F.col("o_orderkey") % 97).cast("double").alias("percent"))
    return N.disk_rollup(disks, ["host"]).select("host", "disk_count", F.round("used_gb", 9).alias("used_gb"),
                                                 "highest_percent", "severity")


@query("d19_temperatures", with_views(
    """select host_id, max(cpu_percent) as max_temperature, count(distinct event_id%5)::bigint as sensor_count,
         case when max(cpu_percent)>90 then 'critical' when max(cpu_percent)>80 then 'warning' else 'info' end as severity
       from metric_base group by host_id""", "metric_base"))
def temperatures(t: Inputs):
    rows = t.metric_sample().select("host_id", F.col("cpu_percent").alias("current"),
                                    (F.col("event_id") % 5).alias("sensor"))
    return N.temperature_rollup(rows, ["host_id"])


@query("d23_interfaces", with_views(
    """select host_id, count(distinct local_addr)::bigint as interface_count, count(distinct case when
       status='ESTABLISHED' then local_addr end)::bigint as active_interfaces from net_conn group by host_id""", "net_conn"))
def interfaces(t: Inputs):
    rows = t.net_conn().select("host_id", F.col("local_addr").alias("interface"),
                               (F.col("status") == "ESTABLISHED").alias("is_up"))
    return N.interface_rollup(rows, ["host_id"])


@query("f1_top_processes", with_views(
    "select event_id, name, cpu_percent from proc order by cpu_percent desc, event_id limit 20", "proc"))
def top_processes(t: Inputs):
    from argosift.operators import report as R
    return R.top(t.proc(), "cpu_percent", 20).select("event_id", "name", "cpu_percent")


@query("f10_first_connections", with_views(
    "select event_id, local_addr||':'||local_port as local, remote_addr||':'||remote_port as remote from net_conn "
    "order by event_id limit 50", "net_conn"))
def first_connections(t: Inputs):
    return t.net_conn().orderBy("event_id").limit(50).select(
        "event_id", F.concat_ws(":", "local_addr", F.col("local_port").cast("string")).alias("local"),
        F.concat_ws(":", "remote_addr", F.col("remote_port").cast("string")).alias("remote"))
