"""Feature queries: text, time, address and the four feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosift import constants as C
from argosift.functions import net as N, severity as S, text as X, times as T
from argosift.operators import features as FX
from argosift.plans import sqltext as Q
from argosift.plans.registry import query
from argosift.plans.views import Inputs, with_views


def _round(df, key: str, names):
    return df.select(key, *[F.round(F.col(n).cast("double"), 9).alias(n) for n in names])


_TEXT = Q.log_features(message="text")
_DOC = ["message_length", "word_count", "uppercase_ratio", "digit_ratio", "special_char_ratio", "max_pattern_score",
        "avg_pattern_score", "pattern_count", "ip_count", "has_private_ip", "port_count", "has_unusual_port",
        "path_count", "has_sensitive_path", "entropy"]


@query("h1_text_counts", "select doc_id, " + Q.rounded({k: _TEXT[k] for k in _DOC[:5]}, 6) + " from documents")
def text_counts(t: Inputs):
    """Lengths, words and character ratios of whole documents (H1, H2)."""
    m = F.col("text")
    return t.documents().select(
        "doc_id", F.length(m).cast("double").alias("message_length"),
        X.word_count(m).cast("double").alias("word_count"), F.round(X.uppercase_ratio(m), 6).alias("uppercase_ratio"),
        F.round(X.digit_ratio(m), 6).alias("digit_ratio"),
        F.round(X.special_ratio(m), 6).alias("special_char_ratio"))


@query("h3_level_score", with_views(
    f"""select event_id, {Q.lookup('severity', C.SEVERITY_SCORES, '0.3::double')} as from_level,
        {Q.log_features()['severity_score']} as from_text from sec_log""", "sec_log"))
def level_score(t: Inputs):
    return t.sec_log().select("event_id", S.level_score(F.col("severity")).alias("from_level"),
                              S.text_score(F.col("message")).alias("from_text"))


@query("h6_extractions", f"""select doc_id, array_to_string({Q.extract_all('text', C.IP_ADDRESS)}, ',') as ips,
    array_to_string(list_sort({Q.ports('text')}), ',') as ports,
    array_to_string({Q.extract_all('text', C.PATH_MENTION)}, ',') as paths from documents""")
def extractions(t: Inputs):
    """Addresses, ports and paths written in documents (H6, H8, H9)."""
    m = F.col("text")
    return t.documents().select(
        "doc_id", F.array_join(X.ip_list(m), ",").alias("ips"),
        F.array_join(F.array_sort(X.port_list(m)), ",").alias("ports"),
        F.array_join(X.path_list(m), ",").alias("paths"))


@query("h7_private_ip", with_views(
    f"""select event_id, {Q.private_ip('remote_addr')} as remote_private, {Q.private_ip('local_addr')} as local_private
        from net_conn""", "net_conn"))
def private_ip(t: Inputs):
    return t.net_conn().select("event_id", N.is_private_ip(F.col("remote_addr")).alias("remote_private"),
                               N.is_private_ip(F.col("local_addr")).alias("local_private"))


@query("h11_entropy", f"select doc_id, round({_TEXT['entropy']}, 6) as entropy from documents")
def entropy(t: Inputs):
    return t.documents().select("doc_id", F.round(X.entropy(F.col("text")), 6).alias("entropy"))


@query("h12_ip_entropy", with_views(
    f"select event_id, round({Q.entropy_bits('remote_addr')}, 6) as bits from net_conn", "net_conn"))
def ip_entropy(t: Inputs):
    return t.net_conn().select("event_id", F.round(X.entropy_bits(F.col("remote_addr")), 6).alias("bits"))


@query("h5_document_features", "select doc_id, " + Q.rounded({k: _TEXT[k] for k in _DOC[5:]}) + " from documents")
def document_features(t: Inputs):
    """Pattern, address, port, path and entropy features over whole documents."""
    docs = t.documents().select("doc_id", "text", "source", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    return _round(FX.log_features(docs, message="text"), "doc_id", _DOC[5:])


@query("h5_pattern_flags", with_views("select event_id, " + ", ".join(
    Q.flag(" or ".join(f"regexp_matches(message, {Q.q(p)}, 'i')" for p, n, _ in C.SUSPICIOUS_PATTERNS
                       if f"pattern_{n}" == name)) + f" as {name}" for name in FX.pattern_flag_names())
    + " from sec_log", "sec_log"))
def pattern_flags(t: Inputs):
    return FX.log_features(t.sec_log()).select("event_id", *FX.pattern_flag_names())


@query("h31_time_features", """select event_id, round(hour(ts)/24.0::double,6) as hour_of_day,
    round((isodow(ts)-1)/7.0::double,6) as day_of_week, isodow(ts)>=6 as is_weekend,
    hour(ts) between 9 and 17 and isodow(ts)<6 as is_business_hours from events""")
def time_features(t: Inputs):
    ts = F.col("ts")
    return t.table("events").select(
        "event_id", F.round(T.hour_of_day(ts), 6).alias("hour_of_day"),
        F.round(T.day_of_week(ts), 6).alias("day_of_week"), T.is_weekend(ts).alias("is_weekend"),
        T.is_business_hours(ts).alias("is_business_hours"))


@query("h32_time_bucket", """select event_id, case when isodow(ts)>=6 then 'weekend' else 'weekday' end||'_h'||
    (hour(ts)//4) as bucket, 'h'||(hour(ts)//6) as plain_bucket from events""")
def time_bucket(t: Inputs):
    ts = F.col("ts")
    return t.table("events").select("event_id", T.time_bucket(ts).alias("bucket"),
                                    T.time_bucket(ts, 6, separate_weekends=False).alias("plain_bucket"))


@query("h36_process_features", with_views(
    f"select event_id, {Q.rounded(Q.process_features())} from proc", "proc"))
def process_features(t: Inputs):
    return _round(FX.process_features(t.proc()), "event_id", C.PROCESS_FEATURES)


@query("h37_network_features", with_views(
    f"select event_id, {Q.rounded(Q.network_features())} from net_conn", "net_conn"))
def network_features(t: Inputs):
    return _round(FX.network_features(t.net_conn()), "event_id", C.NETWORK_FEATURES)


@query("h38_metric_features", with_views(
    f"select event_id, {Q.rounded(Q.metric_features())} from host_metric", "host_metric"))
def metric_features(t: Inputs):
    return _round(FX.metric_features(t.host_metric()), "event_id", C.METRIC_FEATURES)


@query("h39_log_features", with_views(
    f"select event_id, {Q.rounded(Q.log_features('severity'))} from sec_log", "sec_log"))
def log_features(t: Inputs):
    return _round(FX.log_features(t.sec_log(), severity="severity"), "event_id", C.LOG_FEATURES)


@query("h27_command_flags", with_views(
    "select event_id, " + Q.plain({k: v for k, v in Q.process_features().items() if k.startswith(("has_", "is_r", "is_s"))})
    + " from proc", "proc"))
def command_flags(t: Inputs):
    """Name, user and command line predicates."""
    names = [n for n in C.PROCESS_FEATURES if n.startswith(("has_", "is_r", "is_s"))]
    return FX.process_features(t.proc()).select("event_id", *names)


@query("b19_feature_vector", with_views(
    "select event_id, round(" + " + ".join(f"{i + 1}*{n}" for i, n in enumerate(C.NETWORK_FEATURES))
    + ", 5) as weighted from (select event_id, " + Q.plain(Q.network_features()) + " from net_conn)", "net_conn"))
def feature_vector(t: Inputs):
    """Position-weighted sum of the ordered vector, so that order and values both count."""
    rows = FX.network_features(t.net_conn()).select("event_id", FX.feature_vector("network").alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("event_id", F.round(weighted, 5).alias("weighted"))


@query("b25_event_view", with_views(
    "select event_id, " + Q.rounded({k: Q.log_features()[k] for k in (
        "severity_score", "max_pattern_score", "pattern_count", "entropy", "ip_count", "has_sensitive_path")}, 6)
    + f", {Q.PATTERNS} as patterns from sec_log where event_id=137", "sec_log"))
def event_view(t: Inputs):
    one = FX.log_features(t.sec_log().where("event_id = 137"))
    names = ["severity_score", "max_pattern_score", "pattern_count", "entropy", "ip_count", "has_sensitive_path"]
    return one.select("event_id", *[F.round(n, 6).alias(n) for n in names],
                      F.array_join(S.matched_patterns(F.col("message")), ",").alias("patterns"))


@query("h10_source_sensitivity", with_views(
    f"select event_id, {Q.lookup('lower(source)', C.SOURCE_SENSITIVITY, '0.3::double')} as sensitivity from sec_log",
    "sec_log"))
def source_sensitivity(t: Inputs):
    return t.sec_log().select("event_id", X.lookup(F.lower("source"), C.SOURCE_SENSITIVITY,
                                                   C.SOURCE_SENSITIVITY_DEFAULT).alias("sensitivity"))
