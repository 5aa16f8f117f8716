"""Rule matching and multi-event sequence detection."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from argosift import constants as C
from argosift.constants import Rule
from argosift.functions import net as N, severity as S, text as X
from argosift.operators.windows import arrivals_and_expiries, running_sums, trailing_sums


def _texts(rule: Rule, kind: str, columns: Sequence[str]) -> list[tuple[Column, Column]]:
    """(test, evidence) for one rule on one kind of event."""
    if kind == "log":
        return [(X.matches(F.col(columns[0]), p), F.lit(f"Log matches: {p}")) for p in rule.log_patterns]
    if kind == "process":
        return [(X.any_of(X.matches(F.col(c), p) for c in columns), F.lit(f"Process matches: {p}"))
                for p in rule.process_patterns]
    port, remote = F.col(columns[0]), F.col(columns[1])
    tests = [(port.between(a, b), F.format_string("Port %d in suspicious range", port)) for a, b in rule.port_ranges]
    if rule.ports:
        tests.append((port.isin(rule.ports), F.format_string("Connection to suspicious port %d", port)))
    if rule.public_ip:
        tests.append((~N.is_private_ip(remote), F.concat(F.lit("Connection to public IP "), remote)))
    return tests


def match_rules(df: DataFrame, kind: str, columns: Sequence[str], rules: Sequence[Rule] = C.RULES,
                keys: Sequence[str] = ("host_id",), ts: str = "ts", keep: Sequence[str] = ()) -> DataFrame:
    """One row per (event, rule) that fires, with confidence, evidence and rule fields.

    Rules are literal patterns, so all of them run in one pass over the events and
    only hits are expanded. Rules that need several occurrences count their own
    hits per key in the trailing window and drop events below the minimum.
    """
    active = [r for r in rules if _texts(r, kind, columns)]
    hits = []
    for r in active:
        tests = _texts(r, kind, columns)
        hits.append(F.when(X.any_of(t for t, _ in tests), F.struct(
            F.lit(r.rule_id).alias("rule_id"), X.labels(tests).alias("evidence"))))
    base = df.select(*dict.fromkeys(["event_id", ts, *keys, *keep]),
                     F.explode(F.array_compact(F.array(*hits))).alias("_r"))
    rows = base.select(*[c for c in base.columns if c != "_r"], "_r.rule_id", "_r.evidence")
    rows = rows.withColumns({
        "rule_name": X.lookup(F.col("rule_id"), {r.rule_id: r.name for r in active}, ""),
        "category": X.lookup(F.col("rule_id"), {r.rule_id: r.category for r in active}, ""),
        "rule_severity": X.lookup(F.col("rule_id"), {r.rule_id: r.severity for r in active}, 0.0),
        "techniques": X.lookup(F.col("rule_id"), {r.rule_id: ",".join(r.techniques) for r in active}, ""),
        "tactics": X.lookup(F.col("rule_id"), {r.rule_id: ",".join(r.tactics) for r in active}, ""),
        "confidence": F.lit(C.RULE_CONFIDENCE[kind]),
        "occurrences": F.lit(1).cast("long"),
    })
    windowed = [r for r in active if r.min_occurrences > 1]
    if not windowed:
        return rows
    parts = [rows.where(~F.col("rule_id").isin([r.rule_id for r in windowed]))]
    for r in windowed:
        mine = rows.where(F.col("rule_id") == r.rule_id).drop("occurrences")
        counted = trailing_sums(mine, keys, ts, r.window_seconds, {"occurrences": F.lit(1).cast("long")})
        enough = counted.where(F.col("occurrences") >= r.min_occurrences)
        parts.append(enough.withColumns({
            "confidence": F.least(F.col("confidence") + C.WINDOWED_BONUS, F.lit(1.0)),
            "evidence": F.concat("evidence", F.array(F.format_string(
                "Pattern occurred %d times in window", F.col("occurrences")))),
        }))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RULE_TABLE = "rule_id string, pattern string, rule_severity double, window_seconds int, min_occurrences int"


def required_literals(pattern: str, least: int = 3) -> frozenset[str] | None:
    """Words in small letters of which every match of ``pattern`` contains one; None if there are no such.

    Taken from the pattern's parts: a run of plain characters must occur as it stands, of alternatives one must, and a
    group or repetition that may be left out tells nothing. Of several candidates the one whose shortest word is longest
    is used. A pattern that Python's parser does not know has none.
    """
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, OverflowError):
        return None
    return _required(parsed, least)


def _required(parts, least: int) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run: list[str] = []

    def close() -> None:
        if len(run) >= least:
            found.append(frozenset(["".join(run)]))
        run.clear()

    for op, value in parts:
        name = str(op)
        # One-to-one small letters only: others could change a word's length.
        if name == "LITERAL" and len(chr(value).lower()) == 1:
            run.append(chr(value).lower())
            continue
        inner = None
        if name == "SUBPATTERN":
            inner = _required(value[3], least)
        elif name == "ATOMIC_GROUP":
            inner = _required(value, least)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            inner = _required(value[2], least)
        elif name == "BRANCH":
            branches = [_required(b, least) for b in value[1]]
            inner = frozenset().union(*branches) if all(branches) else None
        elif name == "AT":
            continue  # a place, no character
        close()
        if inner:
            found.append(inner)
    close()
    return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=None)


def rule_candidates(df: DataFrame, rules: Sequence[tuple[str, str]], line: str, into: str) -> DataFrame:
    """Adds ``into``, the places in ``rules`` (id, pattern) of those that may match; lines without any are dropped.

    One automaton over the literals of all patterns reads a line once, whatever the number of rules. Patterns without a
    literal are tested on every line, in one pass.
    """
    import ahocorasick

    places: dict[str, list[int]] = {}
    plain = []
    for k, (_, pattern) in enumerate(rules):
        words = required_literals(pattern)
        if words is None:
            plain.append(k)
        for word in words or ():
            places.setdefault(word, []).append(k)
    always = F.array_compact(F.array(*[F.when(_fires(F.col(line), F.lit(rules[k][1])), F.lit(k)) for k in plain])
                             ) if plain else F.array().cast("array<int>")
    marked = df.withColumn(into, always)
    if not places:
        return marked.where(F.size(into) > 0)
    shared = df.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word, own in shared.value.items():
            automaton.add_word(word, own)
        automaton.make_automaton()
        for batch in batches:
            texts, known = batch.column(line).to_pylist(), batch.column(into).to_pylist()
            found = []
            for text, own in zip(texts, known):
                hits = set(own or ())
                for _, some in automaton.iter((text or "").lower()):
                    hits.update(some)
                found.append(sorted(hits))
            keep = pa.array([bool(f) for f in found])
            columns = [pa.array(found, pa.list_(pa.int32())) if name == into else batch.column(k)
                       for k, name in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(keep)

    return marked.mapInArrow(run, marked.schema)


def _fires(line: Column, pattern: Column) -> Column:
    return F.rlike(line, F.concat(F.lit("(?i)"), pattern))


def match_rule_table(df: DataFrame, rules: DataFrame, line: str, keys: Sequence[str] = ("host_id",),
                     ts: str = "ts", tie: str = "event_id", part_rules: int = 20_000) -> DataFrame:
    """One row per (event, rule) of a rules table that fires.

    The rules are taken ``part_rules`` at a time, so what a task holds is bounded; a part's literals find the rules that
    a line may fire, and only those are tested with their pattern. Rules that need several occurrences count their own
    hits per key in their own trailing window.
    """
    listed = [tuple(r) for r in rules.select("rule_id", "pattern").orderBy("rule_id", "pattern").toLocalIterator()
              if r["pattern"] is not None]
    rows = df.select(tie, ts, *keys, line)
    hits = None
    for at in range(0, max(1, len(listed)), part_rules):
        part = listed[at:at + part_rules]
        if not part:
            break
        met = rule_candidates(rows, part, line, "_rules").withColumn("_rule", F.explode("_rules")).drop("_rules")
        table = df.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(part)],
                                                "_rule int, rule_id string, pattern string")
        # At most part_rules rows.
        tested = met.join(F.broadcast(table), "_rule").where(_fires(F.col(line), F.col("pattern"))).drop("_rule", line)
        hits = tested if hits is None else hits.unionByName(tested)
    if hits is None:
        hits = rows.drop(line).where("false").withColumns({"rule_id": F.lit(""), "pattern": F.lit("")})
    # A hit carries its rule's place in the table.
    hits = hits.join(rules.dropDuplicates(["rule_id", "pattern"]), ["rule_id", "pattern"]).drop("pattern")
    single = hits.where("min_occurrences <= 1").withColumn("occurrences", F.lit(1).cast("long"))
    # A hit counts for the rows of its rule up to the rule's own window later.
    several = hits.where("min_occurrences > 1")
    swept = arrivals_and_expiries(several, [*keys, "rule_id"], ts, F.col("window_seconds"),
                                  {"occurrences": F.lit(1).cast("long")})
    counted = running_sums(swept, [*keys, "rule_id"], ["t_us", "t_kind"], ["m_occurrences"]).where("t_kind = 0")
    enough = counted.withColumn("occurrences", F.col("run_m_occurrences")).where("occurrences >= min_occurrences")
    return single.unionByName(enough.select(single.columns))


def brute_force(df: DataFrame, keys: Sequence[str], window: str = "5 minutes", slide: str | None = None,
                message: str = "message", ts: str = "ts", minimum: int = 5) -> DataFrame:
    """Windows with at least ``minimum`` authentication failures per key."""
    fails = df.where(S.is_auth_failure(F.col(message)))
    grouped = fails.groupBy(*keys, _window(ts, window, slide)).agg(F.count(F.lit(1)).alias("failures"))
    n = F.col("failures")
    return _flat(grouped.where(n >= minimum)).withColumns({
        "rule_id": F.lit("SEQ-001"), "confidence": F.least(0.5 + n * 0.05, F.lit(0.95)), "rule_severity": F.lit(0.8)})


def port_scan(df: DataFrame, keys: Sequence[str] = ("remote_addr",), window: str = "5 minutes",
              slide: str | None = None, ts: str = "ts", minimum: int = 10, sample: int = 10) -> DataFrame:
    """Windows in which one remote address touches at least ``minimum`` local ports.

    The set of ports has at most 65,536 members, whatever the number of events.
    """
    seen = df.where(F.coalesce(F.col(keys[0]), F.lit("")) != "")
    grouped = seen.groupBy(*keys, _window(ts, window, slide)).agg(F.collect_set("local_port").alias("_ports"))
    n = F.size("_ports")
    return _flat(grouped.where(n >= minimum).withColumns({
        "ports": n.cast("long"), "sample_ports": F.slice(F.array_sort("_ports"), 1, sample),
        "rule_id": F.lit("SEQ-002"), "confidence": F.least(0.6 + n * 0.02, F.lit(0.95)),
        "rule_severity": F.lit(0.6)}).drop("_ports"))


def exfiltration(df: DataFrame, keys: Sequence[str], window: str = "5 minutes", slide: str | None = None,
                 ts: str = "ts", min_bytes: int = 100 * 1024 * 1024, min_destinations: int = 3) -> DataFrame:
    """Windows with more than ``min_bytes`` sent to more than ``min_destinations`` public addresses."""
    public = df.where(~N.is_private_ip(F.col("remote_addr")) & (F.coalesce(F.col("remote_addr"), F.lit("")) != ""))
    per_address = public.groupBy(*keys, "remote_addr", _window(ts, window, slide)).agg(
        F.sum("bytes_sent").alias("_sent"))
    grouped = per_address.groupBy(*keys, "window").agg(
        F.sum("_sent").alias("bytes_sent"), F.count(F.lit(1)).alias("destinations"))
    large = grouped.where((F.col("bytes_sent") > min_bytes) & (F.col("destinations") > min_destinations))
    return _flat(large).withColumns({"rule_id": F.lit("SEQ-003"), "confidence": F.lit(0.7),
                                     "rule_severity": F.lit(0.9)})


def _window(ts: str, window: str, slide: str | None) -> Column:
    return F.window(F.col(ts), window, slide).alias("window") if slide else F.window(F.col(ts), window).alias("window")


def _flat(df: DataFrame) -> DataFrame:
    """Window struct as naive start and end times."""
    return df.withColumns({"window_start": F.col("window.start").cast("timestamp_ntz"),
                           "window_end": F.col("window.end").cast("timestamp_ntz")}).drop("window")
