"""Baseline, anomaly, ensemble and forest queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from argosift import constants as C
from argosift.functions import times as T
from argosift.operators import anomaly as A, baseline as B, features as FX, forest as IF, report as R
from argosift.plans import sqltext as Q
from argosift.plans.registry import query
from argosift.plans.views import Inputs, with_views
from argosift.session import cut

# --- feature tables of the four source types --------------------------------------

_VIEW = {"log": "sec_log", "process": "proc", "network": "net_conn", "metric": "metric_base"}


def features_of(t: Inputs, source_type: str, with_rates: bool = False):
    """Feature rows of one source type; ``with_rates`` adds burst rates first, on the raw rows."""
    base = {"log": t.sec_log, "process": t.proc, "network": t.net_conn, "metric": t.metric_sample}[source_type]()
    base = base.withColumn("source_type", F.lit(source_type))
    if with_rates:
        base = A.burst_rate(base)
    return (FX.log_features(base, severity="severity") if source_type == "log" else FX.BUILDERS[source_type](base))


def _feature_sql(source_type: str) -> str:
    exprs = (Q.log_features("severity") if source_type == "log" else
             Q.metric_features(counters=False) if source_type == "metric" else Q.FEATURE_SQL[source_type]())
    extra = ", source, severity, message" if source_type == "log" else ""
    return f"select event_id, ts, host_id{extra}, {Q.plain(exprs)} from {_VIEW[source_type]}"


def _ctes(source_type: str, keys: str = "", bucket: bool = False) -> dict[str, str]:
    """feat, long (one row per feature), prof (statistics), z (scores)."""
    names = ", ".join(C.FEATURES[source_type])
    key = keys + (", " if keys else "")
    using = f"using ({key}feature)"
    return {
        "feat": _feature_sql(source_type) if not bucket else
        f"""select *, case when isodow(ts)>=6 then 'weekend' else 'weekday' end||'_h'||(hour(ts)//4) as bucket
            from ({_feature_sql(source_type)})""",
        "long": f"select event_id, {key}feature, value from feat unpivot (value for feature in ({names}))",
        "prof": f"""select {key}feature, count(*)::bigint as n, avg(value) as mean,
            coalesce(stddev_samp(value),0.1) as std, min(value) as lo, max(value) as hi
            from long group by {key}feature""",
        "z": f"""select long.*, n, mean, std, (value-mean)/greatest(std,0.01) as z from long join prof {using}""",
    }


def feature_table(t: Inputs, source_type: str, with_rates: bool = False, keep: Sequence[str] = ()):
    """Feature rows written once: learning and scoring both read them."""
    rows = features_of(t, source_type, with_rates)
    rates = ["events_per_minute"] if with_rates else []
    return cut(rows.select("event_id", "ts", "host_id", "source_type", *rates, *keep, *C.FEATURES[source_type]))


def _joined(t: Inputs, source_type: str, with_rates: bool = False, keep: Sequence[str] = ()):
    """Feature rows with the profile learned from all of them."""
    rows = feature_table(t, source_type, with_rates, keep)
    return B.with_profile(rows, cut(B.learn(rows, C.FEATURES[source_type])))


# --- baselines -----------------------------------------------------------------------

def _profile_sql() -> str:
    parts = []
    for st in C.FEATURES:
        c = _ctes(st)
        parts.append(f"""select '{st}' as source_type, feature, n as sample_count, round(mean,11) as mean,
            round(std,6) as std, round(lo,6) as min, round(hi,6) as max, round(std*std,5) as variance, n>=100 as stable
            from (with feat as ({c['feat']}), long as ({c['long']}), prof as ({c['prof']}) select * from prof)""")
    return " union all ".join(parts)


@query("d7_profiles", with_views(_profile_sql(), *_VIEW.values()))
def profiles(t: Inputs):
    """Baseline statistics of every feature of the four source types."""
    frames = [B.to_long(B.learn(features_of(t, st), names), names) for st, names in C.FEATURES.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("source_type", "feature", "sample_count", *[F.round(c, 11 if c == "mean" else 6).alias(c) for c in B.STATS],
                      F.round("variance", 5).alias("variance"), "stable")


@query("k1_source_profiles", with_views(
    """select source, feature, n as sample_count, round(mean,10) as mean, round(std,6) as std from prof""",
    "sec_log", ctes={k: v for k, v in _ctes("log", "source").items() if k != "z"}))
def source_profiles(t: Inputs):
    names = C.LOG_FEATURES
    return B.to_long(B.learn(features_of(t, "log"), names, ["source"]), names, ["source"]).select(
        "source", "feature", "sample_count", F.round("mean", 10).alias("mean"), F.round("std", 6).alias("std"))


@query("k3_time_bucket_profiles", with_views(
    "select bucket, feature, n as sample_count, round(mean,10) as mean, round(std,6) as std from prof", "sec_log",
    ctes={k: v for k, v in _ctes("log", "bucket", True).items() if k != "z"}))
def time_bucket_profiles(t: Inputs):
    rows = features_of(t, "log").withColumn("bucket", T.time_bucket(F.col("ts")))
    names = C.LOG_FEATURES
    return B.to_long(B.learn(rows, names, ["bucket"]), names, ["bucket"]).select(
        "bucket", "feature", "sample_count", F.round("mean", 10).alias("mean"), F.round("std", 6).alias("std"))


@query("a12_profile_store", with_views(
    "select source, feature, n as sample_count, round(mean,10) as mean from prof", "sec_log",
    ctes={k: v for k, v in _ctes("log", "source").items() if k != "z"}))
def profile_store(t: Inputs):
    """Profiles written one folder per source, read back."""
    from argosift.session import new_path
    from argosift.sources import tables as TB
    names = C.LOG_FEATURES
    path = new_path(t.spark, "profiles")
    TB.save_profiles(B.to_long(B.learn(features_of(t, "log"), names, ["source"]), names, ["source"]), path, "source")
    return TB.load_profiles(t.spark, path).select("source", "feature", "sample_count",
                                                  F.round("mean", 10).alias("mean"))


@query("c7_deviation_score", with_views(
    "select event_id, round(sum(abs(z))/count(*)/3.0, 6) as deviation from z group by event_id", "sec_log",
    ctes=_ctes("log")))
def deviation_score(t: Inputs):
    """Events joined with their profile and scored by mean |z| / 3."""
    return _joined(t, "log").select("event_id", F.round(B.deviation_score(C.LOG_FEATURES), 6).alias("deviation"))


@query("h41_weighted_deviation", with_views(
    """select event_id, round(sum(abs(z)*case feature when 'entropy' then 2.0 when 'severity_score' then 3.0 else 1.0
       end)/count(*)/3.0, 6) as deviation from z group by event_id""", "sec_log", ctes=_ctes("log")))
def weighted_deviation(t: Inputs):
    score = B.deviation_score(C.LOG_FEATURES, {"entropy": 2.0, "severity_score": 3.0})
    return _joined(t, "log").select("event_id", F.round(score, 6).alias("deviation"))


@query("c8_bucket_deviation", with_views(
    """select event_id, case when min(n)>=100 then round(sum(abs(z))/count(*)/3.0, 6) else 0.0 end as deviation
       from z group by event_id""", "sec_log", ctes=_ctes("log", "bucket", True)))
def bucket_deviation(t: Inputs):
    rows = feature_table(t, "log").withColumn("bucket", T.time_bucket(F.col("ts")))
    profile = cut(B.learn(rows, C.LOG_FEATURES, ["bucket"]))
    joined = B.with_profile(rows, profile, ["bucket"])
    return joined.select("event_id", F.round(B.deviation_score(C.LOG_FEATURES), 6).alias("deviation"))


@query("c7_baseline_in_force", with_views(
    """select event_id, coalesce(round((cpu_percent-mean)/greatest(std,0.01),6), -999.0) as z, coalesce(v.version, -1)
         as version
       from metric_base e left join (select *, lead(valid_from) over (order by valid_from) as valid_to from (
         select date_trunc('week', ts)::timestamp + interval 7 days as valid_from, isodow(min(ts))::bigint*0
           + (epoch(date_trunc('week', min(ts)))::bigint//604800) as version, avg(cpu_percent) as mean,
           stddev_samp(cpu_percent) as std from metric_base group by 1)) v
       on e.ts>=v.valid_from and (v.valid_to is null or e.ts<v.valid_to)""", "metric_base"))
def baseline_in_force(t: Inputs):
    """Weekly profile versions; each event is scored against the one in force at its time."""
    rows = t.metric_sample().withColumn("source_type", F.lit("metric"))
    week = T.truncate("week", F.col("ts"))
    versions = B.learn(rows.withColumns({"week": week}), ["cpu_percent"], ["source_type", "week"]).select(
        "source_type", (F.col("week") + F.expr("interval 7 days")).alias("valid_from"), "mean__cpu_percent",
        "std__cpu_percent", F.floor(T.micros(F.col("week")) / F.lit(604_800_000_000)).cast("long").alias("version"))
    joined = B.in_force(rows, cut(versions), ["source_type"], "ts", "valid_from")
    return joined.select("event_id", F.coalesce(F.round(B.z_score("cpu_percent"), 6), F.lit(-999.0)).alias("z"),
                         F.coalesce("version", F.lit(-1).cast("long")).alias("version"))


@query("h40_deviations", with_views(
    """select event_id, count(*)::bigint as n, array_to_string(list_sort(list(feature)), ',') as features,
         round(max(abs(z)),6) as largest from z where abs(z)>2 group by event_id""", "sec_log", ctes=_ctes("log")))
def deviations(t: Inputs):
    scored = A.statistical(_joined(t, "log"), C.LOG_FEATURES).where(F.size("deviating") > 0)
    largest = F.array_max(F.map_values("contributions")) * 3.0
    return scored.select("event_id", F.size("deviating").cast("long").alias("n"),
                         F.array_join(F.array_sort("deviating"), ",").alias("features"),
                         F.round(largest, 6).alias("largest"))


@query("h42_expected_bounds", with_views(
    """select feature, round(greatest(0.0, mean-2*std),6) as low, round(least(1.0, mean+2*std),6) as high from prof
       union all select 'unknown', 0.0, 1.0""", "sec_log",
    ctes={k: v for k, v in _ctes("log").items() if k != "z"}))
def expected_bounds(t: Inputs):
    profile = B.learn(features_of(t, "log"), C.LOG_FEATURES)
    profile = profile.withColumns({f"{s}__unknown": F.lit(None).cast("double") for s in B.STATS})
    pairs = [F.struct(F.lit(f).alias("feature"), F.round(B.bounds(f)[0], 6).alias("low"),
                      F.round(B.bounds(f)[1], 6).alias("high")) for f in [*C.LOG_FEATURES, "unknown"]]
    return profile.select(F.explode(F.array(*pairs)).alias("b")).select("b.*")


_EMA = {
    **{k: v for k, v in _ctes("log", "source").items() if k == "feat"},
    "long": f"""select event_id, ts, source, feature, value from feat
        unpivot (value for feature in ({', '.join(C.LOG_FEATURES)}))""",
    "ranked": "select *, row_number() over (partition by source, feature order by ts, event_id) as rn from long",
    "seed": """select source, feature, avg(value) as m0, power(coalesce(stddev_samp(value),0.1),2) as v0 from ranked
        where rn<=1000 group by source, feature""",
    "later": """select source, feature, list({'m':0.0::double,'v':0.0::double,'x':value} order by rn) as xs from ranked
        where rn>1000 group by source, feature""",
    "ema": """select source, feature, case when xs is null then {'m':m0,'v':v0,'x':0.0::double} else
        list_reduce(list_prepend({'m':m0,'v':v0,'x':0.0::double}, xs), lambda a, b: {'m':0.9*a.m+0.1*b.x,
        'v':0.9*a.v+0.1*(b.x-(0.9*a.m+0.1*b.x))*(b.x-(0.9*a.m+0.1*b.x)),'x':b.x}) end as s
        from seed left join later using (source, feature)""",
    "spread": "select source, feature, count(*)::bigint as n, min(value) as lo, max(value) as hi from long group by 1,2",
}


@query("k2_moving_profiles", with_views(
    """select source, feature, n as sample_count, round(s.m,6) as mean, round(s.v,6) as variance, round(lo,6) as min,
         round(hi,6) as max from ema join spread using (source, feature)""", "sec_log", ctes=_EMA))
def moving_profiles(t: Inputs):
    """Moving-average baselines: exact ordered updates, computed from parallel segments."""
    long = B.learn_moving(features_of(t, "log"), C.LOG_FEATURES, ["source"])
    return long.select("source", "feature", "sample_count", *[F.round(c, 6).alias(c) for c in
                                                              ("mean", "variance", "min", "max")])


@query("k23_host_profiles", with_views(
    """select host_id, count(*)::bigint as samples, round(avg(cpu_percent),10) as cpu, round(avg(memory_percent),10) as memory,
         round(avg(process_count),10) as processes from metric_base group by host_id""", "metric_base"))
def host_profiles(t: Inputs):
    return B.host_profile(t.metric_sample(), ["cpu_percent", "memory_percent", "process_count"]).select(
        "host_id", "samples", F.round("mean__cpu_percent", 10).alias("cpu"),
        F.round("mean__memory_percent", 10).alias("memory"), F.round("mean__process_count", 10).alias("processes"))


@query("k23_hourly_means", with_views(
    """select host_id, hour(ts)::bigint as hour, round(avg(cpu_percent),10) as cpu, round(avg(memory_percent),10) as memory
       from metric_base group by 1,2""", "metric_base"))
def hourly_means(t: Inputs):
    return t.metric_sample().groupBy("host_id", F.hour("ts").cast("long").alias("hour")).agg(
        F.round(F.avg("cpu_percent"), 10).alias("cpu"), F.round(F.avg("memory_percent"), 10).alias("memory"))


@query("k23_process_frequency", with_views(
    "select host_id, name, count(*)::bigint as events from proc group by 1,2", "proc"))
def process_frequency(t: Inputs):
    return R.counts_by(t.proc(), "host_id", "name")


@query("k23_scaled_features", with_views(
    """select event_id, round((cpu_percent-avg(cpu_percent) over w)/stddev_pop(cpu_percent) over w, 6) as cpu,
         round((process_count-avg(process_count) over w)/stddev_pop(process_count) over w, 6) as processes
       from metric_base window w as (partition by host_id)""", "metric_base"))
def scaled_features(t: Inputs):
    scaled = B.standard_scale(t.metric_sample(), ["cpu_percent", "process_count"])
    return scaled.select("event_id", F.round("scaled_cpu_percent", 6).alias("cpu"),
                         F.round("scaled_process_count", 6).alias("processes"))


@query("h48_clamped_settings", """select event_id, greatest(0.1,least(0.95,value/50))::double as anomaly_threshold,
    greatest(1.0,least(5.0,value/10))::double as z_score_threshold, greatest(0.01,least(0.5,value/100))::double
    as learning_rate from events""")
def clamped_settings(t: Inputs):
    raw = t.table("events").select("event_id", (F.col("value") / 50).alias("anomaly_threshold"),
                                   (F.col("value") / 10).alias("z_score_threshold"),
                                   (F.col("value") / 100).alias("learning_rate"))
    return B.clamp_settings(raw)


# --- anomaly scores ----------------------------------------------------------------------

_PATTERN_SQL = {
    "log": ("greatest(case when max_pattern_score>0.8 then max_pattern_score else 0 end, "
            "case when pattern_count>=3 then 0.7 else 0 end, case when entropy>0.9 then 0.6 else 0 end)::double",
            "((max_pattern_score>0.8)::int+(pattern_count>=3)::int+(entropy>0.9)::int)"),
    "process": ("greatest(case when is_suspicious_name>0 then 0.8 else 0 end, case when has_encoded_data>0 then 0.7 "
                "else 0 end, case when is_root>0 and has_shell_operators>0 then 0.6 else 0 end)::double",
                "((is_suspicious_name>0)::int+(has_encoded_data>0)::int+(is_root>0 and has_shell_operators>0)::int)"),
    "network": ("greatest(case when is_high_port>0 and is_remote_public>0 then 0.5 else 0 end, case when "
                "is_suspicious_process>0 then 0.8 else 0 end, case when bytes_sent_normalized>0.8 then 0.5 else 0 "
                "end)::double",
                "((is_high_port>0 and is_remote_public>0)::int+(is_suspicious_process>0)::int+"
                "(bytes_sent_normalized>0.8)::int)"),
    "metric": ("(case when overall_stress>0.8 then 0.6 else 0 end)::double", "(overall_stress>0.8)::int"),
}
_STAT = """select event_id, case when count(*) filter (abs(z)>2)>0 then least(avg(abs(z)) filter (abs(z)>2)/{t},1.0)
    else 0.0 end::double as stat, (count(*) filter (abs(z)>{t} and abs(z)>2))::bigint as stat_reasons from z
    group by event_id"""
_TEMPORAL = """select event_id, case when is_business_hours=0 then 0.2 else 0.0 end::double as temporal from feat"""


def _detect_sql(st: str, threshold: float) -> str:
    score, reasons = _PATTERN_SQL[st]
    severe = "severity_score>0.5" if st == "log" else "false"
    c = _ctes(st)
    c["stat"] = _STAT.format(t="3.0::double")
    inner = ", ".join(f"{k} as ({v})" for k, v in c.items())
    return f"""select '{st}' as source_type, event_id, anomaly_score, is_anomaly, severity, reasons from (
      with {inner} select event_id, round(w,6) as anomaly_score, w>={threshold} as is_anomaly,
        case when w>=0.95 then 'critical' when w>=0.8 then 'high' when w>=0.6 then 'medium' else 'low' end as severity,
        (stat_reasons+{reasons}+(is_business_hours=0 and {severe})::int)::bigint as reasons
      from (select feat.*, stat_reasons, (stat*0.4+{score}*0.2+
              (case when is_business_hours=0 then 0.2 else 0.0 end)*0.1)/0.7::double as w
            from feat join stat using (event_id)))"""


def with_rate(t: Inputs) -> Inputs:
    """Views whose events carry their burst rate, written once."""
    rated = A.burst_rate(t.events().withColumn("source_type", F.lit("all")))
    return t.with_events(cut(rated.select(*t.events().columns, "events_per_minute")), "events_per_minute")


def _detected(t: Inputs, st: str, threshold: float, rated: bool = False):
    joined = _joined(t, st, not rated, ["events_per_minute"] if rated else [])
    return A.detect(joined, st, C.FEATURES[st], threshold=threshold)


@query("k4_statistical_score", with_views(
    "select event_id, round(stat,6) as stat_score, stat_reasons as reasons from stat", "sec_log",
    ctes={**_ctes("log"), "stat": _STAT.format(t="3.0::double")}))
def statistical_score(t: Inputs):
    rows = A.statistical(_joined(t, "log"), C.LOG_FEATURES)
    return rows.select("event_id", F.round("stat_score", 6).alias("stat_score"),
                       F.size("stat_reasons").cast("long").alias("reasons"))


def _pattern_query(st: str):
    score, reasons = _PATTERN_SQL[st]

    @query(f"k7_pattern_score_{st}", with_views(
        f"select event_id, round({score},6) as pattern_score, ({reasons})::bigint as reasons from feat", _VIEW[st],
        ctes={"feat": _feature_sql(st)}))
    def run(t: Inputs):
        return A.pattern(features_of(t, st), st).select(
            "event_id", F.round("pattern_score", 6).alias("pattern_score"),
            F.size("pattern_reasons").cast("long").alias("reasons"))


for _st in C.FEATURES:
    _pattern_query(_st)


@query("e1_burst_rate", with_views(
    """select event_id, coalesce(round(case when n>=10 and s>0 then n/s*60 end, 6), -1.0) as events_per_minute from (
         select event_id, least(row_number() over w - 1, 100) as n, (epoch_us(ts) - epoch_us(first_value(ts) over
           (partition by source order by ts, event_id rows between 100 preceding and 1 preceding)))/1000000.0::double as s
         from sec_log window w as (partition by source order by ts, event_id))""", "sec_log"))
def burst_rate(t: Inputs):
    rows = A.burst_rate(t.sec_log(), ["source"])
    return rows.select("event_id", F.coalesce(F.round("events_per_minute", 6), F.lit(-1.0)).alias("events_per_minute"))


@query("k8_temporal_score", with_views(
    """select event_id, case when is_business_hours=0 then 0.2 else 0.0 end::double as temporal_score,
         (is_business_hours=0 and severity_score>0.5)::int::bigint as reasons from feat""", "sec_log",
    ctes={"feat": _feature_sql("log")}))
def temporal_score(t: Inputs):
    rows = A.temporal(A.burst_rate(features_of(t, "log")))
    return rows.select("event_id", "temporal_score", F.size("temporal_reasons").cast("long").alias("reasons"))


_FAST = """select event_id, timestamp '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(timestamp '2024-01-01'))
    // 10000) as ts from events"""


@query("k8_burst_score", with_views(
    """select event_id, case when n>=10 and s>0 and n/s*60>100 then greatest(base,0.7) else base end::double as temporal_score,
         (n>=10 and s>0 and n/s*60>100)::int::bigint as bursts from (
         select event_id, case when hour(ts) between 9 and 17 and isodow(ts)<6 then 0.0 else 0.2 end as base,
           least(row_number() over w - 1, 100) as n, (epoch_us(ts) - epoch_us(first_value(ts) over (order by ts, event_id
             rows between 100 preceding and 1 preceding)))/1000000.0::double as s
         from fast window w as (order by ts, event_id))""", ctes={"fast": _FAST}))
def burst_score(t: Inputs):
    """The log played ten thousand times faster, so that its events come in bursts under one key."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    fast = F.timestamp_micros(T.micros(start) + F.floor((T.micros(F.col("ts")) - T.micros(start)) / 10000)).cast(
        "timestamp_ntz")
    events = t.events().select("event_id", fast.alias("ts"), F.lit("log").alias("source_type"))
    rows = A.temporal(A.burst_rate(events).withColumn("is_business_hours", T.is_business_hours(F.col("ts")).cast("int")))
    return rows.select("event_id", "temporal_score", F.size(F.filter(
        "temporal_reasons", lambda r: r.startswith("High event frequency"))).cast("long").alias("bursts"))


@query("k9_combined_detect", with_views(" union all ".join(_detect_sql(st, 0.35) for st in C.FEATURES),
                                        *_VIEW.values()))
def combined_detect(t: Inputs):
    """Combined detection of all four source types (threshold lowered to the test data).

    Every view has all events, so the burst rate of a source type is that of the events; it is computed once.
    """
    rated = with_rate(t)
    frames = [_detected(rated, st, 0.35, rated=True).select(
        "source_type", "event_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly",
        F.col("anomaly_severity").alias("severity"), F.size("reasons").cast("long").alias("reasons"))
        for st in C.FEATURES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("b20_anomaly_filter", with_views(
    f"select event_id, anomaly_score from ({_detect_sql('log', 0.35)}) where is_anomaly and anomaly_score>=0.5",
    "sec_log"))
def anomaly_filter(t: Inputs):
    rows = _detected(t, "log", 0.35).where(F.col("is_anomaly") & (F.col("anomaly_score") >= 0.5))
    return rows.select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("f3_top_anomalies", with_views(
    f"select event_id, anomaly_score from ({_detect_sql('log', 0.35)}) order by anomaly_score desc, event_id limit 30",
    "sec_log"))
def top_anomalies(t: Inputs):
    rows = _detected(t, "log", 0.35).select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"))
    return R.top(rows, "anomaly_score", 30)


_SHARE = "select event_id, feature, round(abs(z)/3.0,6) as share from z where abs(z)>2"


@query("f4_top_contributions", with_views(
    """select event_id, array_to_string(list(feature order by share desc, feature), ',') as features from (
         select *, row_number() over (partition by event_id order by share desc, feature) as r from share) where r<=5
       group by event_id""", "sec_log", ctes={**_ctes("log"), "share": _SHARE}))
def top_contributions(t: Inputs):
    rows = A.statistical(_joined(t, "log"), C.LOG_FEATURES).where(F.size("deviating") > 0)
    shares = F.transform_values("contributions", lambda k, v: F.round(v, 6))
    names = F.transform(A.top_contributions(shares), lambda e: F.split(e, "=")[0])
    return rows.select("event_id", F.array_join(names, ",").alias("features"))


_ENS = """select event_id, (case when is_business_hours=0 then 0.2 else 0.0 end)::double as temporal, {p} as pattern,
  s1, s2, s3 from feat join (select event_id, {s} from z group by event_id) using (event_id)"""


def _ensemble_sql(st: str) -> str:
    stats = ", ".join(f"case when count(*) filter (abs(z)>2)>0 then least(avg(abs(z)) filter (abs(z)>2)/{z}::double,"
                      f"1.0) else 0.0 end as s{i + 1}" for i, (z, _) in enumerate(C.ENSEMBLE))
    base = _ENS.format(p=_PATTERN_SQL[st][0], s=stats)
    w = [f"((s{i}*0.4+pattern*0.2+temporal*0.1)/0.7::double)" for i in (1, 2, 3)]
    votes = "+".join(f"({x}>={t})::int" for x, (_, t) in zip(w, C.ENSEMBLE))
    top = f"greatest({','.join(w)})"

    def band(x: str) -> str:
        return f"case when {x}>=0.95 then 'critical' when {x}>=0.8 then 'high' when {x}>=0.6 then 'medium' else 'low' end"

    return f"""select event_id, ({votes})::bigint as votes, round(({'+'.join(w)})/3.0,6) as anomaly_score,
        round({top},6) as max_score, ({votes})/3.0>=0.5 as is_anomaly,
        case when ({votes})/3.0>=0.5 then {band(top)} else {band(w[0])} end as severity from base"""


@query("k10_ensemble", with_views(_ensemble_sql("network"), "net_conn", ctes={
    **_ctes("network"), "base": _ENS.format(p=_PATTERN_SQL["network"][0], s=", ".join(
        f"case when count(*) filter (abs(z)>2)>0 then least(avg(abs(z)) filter (abs(z)>2)/{z}::double,1.0) else 0.0 "
        f"end as s{i + 1}" for i, (z, _) in enumerate(C.ENSEMBLE)))}))
def ensemble(t: Inputs):
    rows = A.ensemble(_joined(t, "network", True), "network", C.NETWORK_FEATURES)
    return rows.select("event_id", F.col("votes").cast("long").alias("votes"),
                       F.round("anomaly_score", 6).alias("anomaly_score"), F.round("max_score", 6).alias("max_score"),
                       "is_anomaly", F.col("anomaly_severity").alias("severity"))


@query("d15_vote", with_views(
    """select event_id, count(*)::bigint as detectors, (count(*) filter (hit))::bigint as votes,
         round(avg(score),6) as anomaly_score, round(max(score),6) as max_score,
         array_to_string(list_sort(list(distinct reason) filter (hit)), ',') as reasons
       from (select event_id, 'cpu' as reason, cpu_percent/100 as score, cpu_percent>30 as hit from metric_base
         union all select event_id, 'memory', memory_percent/100, memory_percent>30 from metric_base
         union all select event_id, 'disk', disk_percent/100, disk_percent>70 from metric_base) group by event_id""",
    "metric_base"))
def vote(t: Inputs):
    """Votes of three single-metric detectors given as rows."""
    m = t.metric_sample()
    parts = []
    for name, bound in (("cpu", 30), ("memory", 30), ("disk", 70)):
        v = F.col(f"{name}_percent")
        parts.append(m.select("event_id", F.lit(name).alias("detector"), (v / 100).alias("score"),
                              (v > bound).alias("is_anomaly"),
                              F.when(v > bound, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
                              .alias("reason_list"), F.create_map(F.lit(name), v / 100).alias("contributions")))
    rows = A.vote(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return rows.select("event_id", "detectors", "votes", F.round("anomaly_score", 6).alias("anomaly_score"),
                       F.round("max_score", 6).alias("max_score"),
                       F.when(F.size("reasons") > 0, F.array_join("reasons", ",")).alias("reasons"))


@query("d16_weighted_mean", with_views(
    """select event_id, round((cpu_percent/100*0.4+coalesce(iso*0.3,0)+disk_percent/100*0.2)
         /(0.6+case when iso is null then 0 else 0.3 end), 6) as score from (select *, case when event_id%3=0 then
         memory_percent/100 end as iso from metric_base)""", "metric_base"))
def weighted_mean(t: Inputs):
    iso = F.when(F.col("event_id") % 3 == 0, F.col("memory_percent") / 100)
    score = A.weighted({"statistical": F.col("cpu_percent") / 100, "isolation_forest": iso,
                        "pattern": F.col("disk_percent") / 100})
    return t.metric_sample().select("event_id", F.round(score, 6).alias("score"))


@query("d22_pattern_scores", with_views(
    "select event_id, round(max_pattern_score,6) as top, round(avg_pattern_score,6) as mean, pattern_count as n from feat",
    "sec_log", ctes={"feat": _feature_sql("log")}))
def pattern_scores(t: Inputs):
    return features_of(t, "log").select("event_id", F.round("max_pattern_score", 6).alias("top"),
                                        F.round("avg_pattern_score", 6).alias("mean"), F.col("pattern_count").alias("n"))


_BANDS = """case when s>=0.95 then 'critical' when s>=0.8 then 'high' when s>=0.6 then 'medium' else 'low' end"""
_LEVELS = """case when s>=0.9 then 'critical' when s>=0.7 then 'high' when s>=0.5 then 'medium' when s>=0.3 then 'low'
  else 'none' end"""


@query("h43_score_bands", f"""select event_id, {_BANDS} as severity, {_LEVELS} as threat_level from (
    select event_id, least(value/50,1.0) as s from events)""")
def score_bands(t: Inputs):
    from argosift.functions import severity as S
    score = F.least(F.col("value") / 50, F.lit(1.0))
    return t.table("events").select("event_id", S.anomaly_severity(score).alias("severity"),
                                    S.threat_level(score).alias("threat_level"))


# --- isolation forest -----------------------------------------------------------------------

_SEED, _TREES, _SAMPLE = 7, 100, 256


def _draw_sql(text: str) -> str:
    return f"(('0x'||substr(md5({text}), 1, 13))::bigint / {float(1 << 52)}::double)"


def _forest_ctes(st: str) -> dict[str, str]:
    """Samples, the rows and nodes of every level, and all nodes of the trees."""
    names = C.FEATURES[st]
    name = f"'{_SEED}|{st}|'||tree||'|'||node||'|"
    feature = f"floor({_draw_sql(name + chr(39) + '||' + repr('feature'))} * {len(names)})::int"
    out = {
        "feat": _feature_sql(st),
        "slim": f"select event_id, [{', '.join(f'coalesce({f}::double, 0.0)' for f in names)}] as x from feat",
        "dealt": f"""select event_id, x, ((floor({_draw_sql(f"'{_SEED}|'||event_id")} * {_TREES})::int + i) % {_TREES})::int
            as tree from slim, (select unnest(range(least(ceil({4 * _SAMPLE * _TREES} / count(*)::double), {_TREES})::int))
            as i from slim)""",
        "picked": f"""select *, count(*) over (partition by tree) as psi from (select *, row_number() over (partition by tree
            order by md5('{_SEED}|'||tree||'|'||event_id), event_id) as r from dealt) where r <= {_SAMPLE}""",
        "r0": "select tree, 1 as node, psi, x from picked",
    }
    for d in range(9):
        out[f"f{d}"] = f"select *, {feature} as f from r{d}"
        out[f"g{d}"] = f"""select tree, node, psi, f, size, case when size > 1 and {d} < ceil(log2(greatest(psi, 2)))
              and split > lo then split end as split from (select *, lo + {_draw_sql(name + chr(39) + '||' + repr('split'))}
              * (hi - lo) as split from (select tree, node, psi, f, count(*) as size, min(x[f+1]) as lo, max(x[f+1]) as hi
              from f{d} group by all))"""
        if d < 8:
            out[f"r{d + 1}"] = f"""select f{d}.tree, 2 * f{d}.node + (x[f{d}.f+1] >= split)::int as node, f{d}.psi, x
                from f{d} join g{d} using (tree, node) where split is not null"""
    out["nodes"] = " union all ".join(f"select * from g{d}" for d in range(9))
    return out


def _path_sql(n: str) -> str:
    return (f"(case when {n} <= 1 then 0.0 when {n} = 2 then 1.0 else 2.0*(ln({n}-1)+{C.EULER})-2.0*({n}-1)/{n} end)"
            "::double")


def _score_ctes(st: str) -> dict[str, str]:
    """Every row walked down every tree."""
    out = {**_forest_ctes(st), "w0": f"""select event_id, x, tree::int as tree, 1 as node, 0 as depth from slim,
        (select unnest(range({_TREES})) as tree) where tree in (select tree from nodes)"""}
    for d in range(8):
        out[f"w{d + 1}"] = f"""select event_id, x, w.tree, case when split is null then w.node else 2 * w.node
            + (x[f+1] >= split)::int end as node, depth + (split is not null)::int as depth
            from w{d} w join nodes using (tree, node)"""
    out["iso"] = f"""select event_id, pow(2.0, -avg(depth + {_path_sql('size')}) / (select {_path_sql('max(psi)')} from nodes))
        as isolation from w8 join nodes using (tree, node) group by event_id"""
    return out


@query("k5_forest_model", with_views(
    """select 'network' as source_type, tree, count(*)::bigint as nodes, count_if(split is null)::bigint as leaves,
         max(psi)::int as psi, round(sum(split), 4) as splits from nodes group by tree""", "net_conn",
    ctes=_forest_ctes("network")))
def forest_model(t: Inputs):
    """Nodes per tree of a forest trained on the connection features."""
    return IF.train(feature_table(t, "network"), C.NETWORK_FEATURES, trees=_TREES, sample_rows=_SAMPLE, seed=_SEED).groupBy(
        "source_type", "tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves"), F.max("psi").alias("psi"),
        F.round(F.sum(F.when(F.col("feature") >= 0, F.col("split"))), 4).alias("splits"))


@query("k6_forest_score", with_views("select event_id, round(isolation, 6) as isolation_score from iso", "net_conn",
                                     ctes=_score_ctes("network")))
def forest_score(t: Inputs):
    rows = feature_table(t, "network")
    scored = IF.score(rows, IF.train(rows, C.NETWORK_FEATURES, seed=_SEED), C.NETWORK_FEATURES)
    return scored.select("event_id", F.round("isolation_score", 6).alias("isolation_score"))


@query("k9_detect_with_forest", with_views(
    f"""select event_id, round(w, 6) as anomaly_score, w>=0.6 as is_anomaly, case when w>=0.95 then 'critical'
          when w>=0.8 then 'high' when w>=0.6 then 'medium' else 'low' end as severity,
          (stat_reasons + (isolation>0.5)::int + {_PATTERN_SQL['network'][1]})::bigint as reasons
        from (select feat.*, stat_reasons, isolation, stat*0.4+isolation*0.3+{_PATTERN_SQL['network'][0]}*0.2
            +(case when is_business_hours=0 then 0.2 else 0.0 end)*0.1 as w
          from feat join stat using (event_id) join iso using (event_id))""", "net_conn",
    ctes={**_score_ctes("network"), **{k: v for k, v in _ctes("network").items() if k != "feat"},
          "stat": _STAT.format(t="3.0::double")}))
def detect_with_forest(t: Inputs):
    """All four methods on connections."""
    joined = _joined(t, "network", True)
    scored = IF.score(joined, IF.train(joined, C.NETWORK_FEATURES, seed=_SEED), C.NETWORK_FEATURES)
    rows = A.detect(scored, "network", C.NETWORK_FEATURES)
    return rows.select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly",
                       F.col("anomaly_severity").alias("severity"), F.size("reasons").cast("long").alias("reasons"))
