"""SQL fragments for the DuckDB statements, built from the fixed word lists."""

from __future__ import annotations

from argosift import constants as C
from argosift.functions import text as X


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def contains_any(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def matches_any(col: str, patterns, ignore_case: bool = True) -> str:
    flag = ", 'i'" if ignore_case else ""
    return "(" + " or ".join(f"regexp_matches({col}, {q(p)}{flag})" for p in patterns) + ")"


def case(tests, default: str) -> str:
    return "case " + " ".join(f"when {t} then {v}" for t, v in tests) + f" else {default} end"


def joined(tests, sep: str = ",") -> str:
    """Labels of the tests that hold, joined; empty when none does."""
    return f"concat_ws({q(sep)}, " + ", ".join(f"case when {t} then {v} end" for t, v in tests) + ")"


def words_case(col: str, groups, default: str) -> str:
    return case(((contains_any(f"lower({col})", ws), q(n)) for n, ws in groups), q(default))


def lookup(col: str, table: dict, default: str) -> str:
    lit = (lambda k: q(k) if isinstance(k, str) else str(k))
    val = (lambda v: q(v) if isinstance(v, str) else f"{v}::double")
    return case(((f"{col} = {lit(k)}", val(v)) for k, v in table.items()), default)


def flag(test: str) -> str:
    return f"(case when {test} then 1.0 else 0.0 end)::double"


LEVEL = words_case("message", C.LEVEL_WORDS, "debug")
TRIAGE = words_case("message", C.TRIAGE_WORDS, "low")
PATTERNS = joined((f"regexp_matches(message, {q(p)}, 'i')", q(n)) for n, p, _ in C.LOG_PATTERNS)


def private_ip(col: str) -> str:
    return f"coalesce(regexp_full_match({col}, {q(C.PRIVATE_IPV4)}), false)"


def extract_all(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, {q(pattern)}, {group})"


def ports(col: str) -> str:
    both = f"list_concat({extract_all(col, C.PORT_MENTION, 1)}, {extract_all(col, C.PORT_MENTION, 2)})"
    return f"list_filter({both}, lambda x: x is not null and x <> '')"


def ratio(col: str, char_class: str) -> str:
    return f"length(regexp_replace({col}, {q('[^' + char_class + ']')}, '', 'g'))/greatest(length({col}),1)::double"


def entropy_bits(col: str) -> str:
    return (f"coalesce((select -sum(n/t*log2(n/t)) from (select count(*)::double as n, sum(count(*)) over ()::double "
            f"as t from (select unnest({extract_all(col, '(?s).')}) as c) group by c)), 0.0)")


HOUR = "hour(ts)/24.0::double"
BUSINESS = "(hour(ts) between 9 and 17 and isodow(ts)<6)"


def log_features(severity: str | None = None, message: str = "message") -> dict[str, str]:
    """Feature name -> expression over ``message``, ``source``, ``ts``."""
    m = message
    hits = [(f"regexp_matches({m}, {q(p)}, 'i')", n, s) for p, n, s in C.SUSPICIOUS_PATTERNS]
    total = "+".join(f"(case when {h} then {s} else 0 end)::double" for h, _, s in hits)
    count = "+".join(f"(case when {h} then 1 else 0 end)" for h, _, _ in hits)
    ranked = sorted(C.SEVERITY_SCORES.items(), key=lambda kv: -kv[1])
    text_score = case(((f"contains(lower({m}), {q(w)})", f"{s}::double") for w, s in ranked), "0.3::double")
    score = text_score if severity is None else lookup(f"lower({severity})", C.SEVERITY_SCORES, "0.3::double")
    safe = "[" + ",".join(q(str(p)) for p in C.SAFE_PORTS) + "]"
    return {
        "message_length": f"length({m})::double",
        "word_count": f"len({extract_all(m, '[^' + X.SPACE_CLASS + ']+')})::double",
        "uppercase_ratio": ratio(m, X.UPPER_CLASS),
        "digit_ratio": ratio(m, X.DIGIT_CLASS),
        "special_char_ratio":
            f"length(regexp_replace({m}, {q('[' + X.ALNUM_CLASS + ' ]')}, '', 'g'))/greatest(length({m}),1)::double",
        "severity_score": score,
        "hour_of_day": HOUR,
        "day_of_week": "(isodow(ts)-1)/7.0::double",
        "is_business_hours": flag(BUSINESS),
        "is_weekend": flag("isodow(ts)>=6"),
        "max_pattern_score": "greatest(" + ",".join(f"(case when {h} then {s} else 0 end)" for h, _, s in hits)
                             + ")::double",
        "avg_pattern_score": f"case when ({count})>0 then ({total})/({count}) else 0.0 end::double",
        "pattern_count": f"({count})::double",
        "ip_count": f"len({extract_all(m, C.IP_ADDRESS)})::double",
        "has_private_ip": flag(f"len(list_filter({extract_all(m, C.IP_ADDRESS)}, lambda x: "
                               f"regexp_full_match(x, {q(C.PRIVATE_IPV4)})))>0"),
        "port_count": f"len({ports(m)})::double",
        "has_unusual_port": flag(f"len(list_filter({ports(m)}, lambda x: not list_contains({safe}, "
                                 f"regexp_replace(x, '^0+([0-9])', '\\1'))))>0"),
        "path_count": f"len({extract_all(m, C.PATH_MENTION)})::double",
        "has_sensitive_path": flag(f"len(list_filter({extract_all(m, C.PATH_MENTION)}, lambda x: "
                                   f"{contains_any('lower(x)', C.SENSITIVE_PATHS)}))>0"),
        "source_sensitivity": lookup("lower(source)", C.SOURCE_SENSITIVITY, "0.3::double"),
        "entropy": f"least({entropy_bits(m)}/6.6, 1.0)::double",
    }


def process_features() -> dict[str, str]:
    cpu, mem = "least(cpu_percent/100.0,1.0)::double", "least(memory_percent/100.0,1.0)::double"
    tools = "(" + ",".join(q(n) for n in C.TOOL_NAMES) + ")"
    return {
        "cpu_percent": cpu, "memory_percent": mem, "resource_total": f"({cpu}+{mem})/2",
        "connection_count": "least(connections/100.0,1.0)::double",
        "open_files_count": "least(open_files/1000.0,1.0)::double",
        "children_count": "least(children/50.0,1.0)::double",
        "name_length": "length(name)/50.0::double", "cmdline_length": "length(cmdline)/500.0::double",
        "is_suspicious_name": flag(f"lower(name) in {tools}"),
        "has_suspicious_in_cmdline": flag(contains_any("lower(cmdline)", C.TOOL_NAMES)),
        "is_root": flag("username in ('root','SYSTEM','Administrator')"),
        "is_service_account": flag("regexp_matches(username, '^(_|sys|daemon)')"),
        "has_shell_operators": flag(contains_any("cmdline", C.SHELL_OPERATORS)),
        "has_redirection": flag(contains_any("cmdline", C.REDIRECTIONS)),
        "has_encoded_data": flag(contains_any("lower(cmdline)", C.ENCODED_MARKERS)),
        "has_network_args": flag(contains_any("lower(cmdline)", C.NETWORK_ARGS)),
        "hour_of_day": HOUR, "is_business_hours": flag(BUSINESS),
    }


def network_features() -> dict[str, str]:
    tools = "(" + ",".join(q(n) for n in C.TOOL_NAMES) + ")"
    safe = "(" + ",".join(str(p) for p in C.SAFE_PORTS) + ")"
    private, loop = private_ip("remote_addr"), "starts_with(remote_addr, '127.')"
    ratio_ = "(case when bytes_recv>0 then bytes_sent/greatest(bytes_recv,1)::double else 1.0 end)"
    return {
        "local_port_normalized": "least(local_port/65535.0::double,1.0)::double",
        "remote_port_normalized": "least(remote_port/65535.0::double,1.0)::double",
        "is_privileged_local": flag("local_port<1024"), "is_privileged_remote": flag("remote_port<1024"),
        "is_common_port": flag(f"remote_port in {safe}"), "is_high_port": flag("remote_port>10000"),
        "is_local_loopback": flag("starts_with(local_addr,'127.')"), "is_remote_loopback": flag(loop),
        "is_remote_private": flag(private), "is_remote_public": flag(f"not {private} and not {loop}"),
        "is_tcp": flag("upper(protocol)='TCP'"), "is_udp": flag("upper(protocol)='UDP'"),
        "status_score": lookup("lower(status)", C.STATUS_SCORES, "0.3::double"),
        "bytes_sent_normalized": "least(bytes_sent/1000000.0::double,1.0)::double",
        "bytes_recv_normalized": "least(bytes_recv/1000000.0::double,1.0)::double",
        "data_ratio_normalized": f"least({ratio_}/10.0::double,1.0)::double",
        "has_process": flag("coalesce(process_name,'')<>''"),
        "is_suspicious_process": flag(f"lower(process_name) in {tools}"),
        "hour_of_day": HOUR, "is_business_hours": flag(BUSINESS),
    }


def metric_features(counters: bool = True) -> dict[str, str]:
    high = {n: flag(f"{n}_percent>{b}") for n, b in (("cpu", 80), ("memory", 80), ("disk", 90))}
    sent = "least(net_bytes_sent/10485760.0::double,1.0)::double" if counters else "0.0::double"
    recv = "least(net_bytes_recv/10485760.0::double,1.0)::double" if counters else "0.0::double"
    return {
        "cpu_percent": "cpu_percent/100.0::double", "memory_percent": "memory_percent/100.0::double",
        "disk_percent": "disk_percent/100.0::double",
        "high_cpu": high["cpu"], "high_memory": high["memory"], "high_disk": high["disk"],
        "overall_stress": f"({high['cpu']}+{high['memory']}+{high['disk']})/3.0::double",
        "disk_io_read_normalized": "0.0::double", "disk_io_write_normalized": "0.0::double",
        "disk_io_total": "0.0::double",
        "net_bytes_sent_normalized": sent, "net_bytes_recv_normalized": recv, "net_total": f"({sent}+{recv})/2",
        "process_count_normalized": "least(process_count/500.0,1.0)::double",
        "high_process_count": flag("process_count>300"), "hour_of_day": HOUR, "is_business_hours": flag(BUSINESS),
    }


FEATURE_SQL = {"log": log_features, "process": process_features, "network": network_features,
               "metric": metric_features}


def rounded(features: dict[str, str], digits: int = 9) -> str:
    return ", ".join(f"round({e}, {digits}) as {n}" for n, e in features.items())


def plain(features: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in features.items())
