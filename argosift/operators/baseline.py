"""Behaviour profiles: learned statistics per key and feature.

A wide profile has one row per key with ``mean__f``, ``std__f``, ``min__f``,
``max__f`` columns; learning is one partial aggregation, so hot keys combine
before the shuffle. ``to_long`` converts to the stored layout.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from argosift.functions.severity import clamp
from argosift.operators.windows import number_rows
from argosift.session import cut

STATS = ("mean", "std", "min", "max")
STD_FLOOR = 0.01
SINGLE_SAMPLE_STD = 0.1


def learn(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("source_type",)) -> DataFrame:
    """Wide profile: sample mean, sample deviation, minimum and maximum of every feature."""
    aggs = ["count(1) as sample_count"]
    for f in features:
        v = f"cast({f} as double)"
        aggs += [f"avg({v}) as mean__{f}", f"coalesce(stddev_samp({v}), {SINGLE_SAMPLE_STD}D) as std__{f}",
                 f"min({v}) as min__{f}", f"max({v}) as max__{f}"]
    return df.groupBy(*keys).agg(*[F.expr(a) for a in aggs])


def to_long(profile: DataFrame, features: Sequence[str], keys: Sequence[str] = ("source_type",),
            min_samples: int = 100) -> DataFrame:
    """One row per key and feature, with variance and the stable flag."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"),
                                 *[F.col(f"{s}__{f}").alias(s) for s in STATS]) for f in features])
    rows = profile.select(*keys, "sample_count", F.explode(entries).alias("e")).select(*keys, "sample_count", "e.*")
    return rows.withColumns({"variance": F.col("std") * F.col("std"), "stable": F.col("sample_count") >= min_samples})


def with_profile(df: DataFrame, profile: DataFrame, keys: Sequence[str] = ("source_type",)) -> DataFrame:
    """Joins the profile of the row's keys. A profile read from a table is broadcast when its size allows."""
    return df.join(profile, list(keys), "left")


def in_force(df: DataFrame, versions: DataFrame, keys: Sequence[str], ts: str, valid_from: str) -> DataFrame:
    """Joins the newest profile version at or before the event time.

    Versions become half-open validity intervals, one row per day of validity, so an event meets the versions of
    its key and day only.
    """
    def day(c: Column) -> Column:
        return F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date"))

    nxt = F.lead(valid_from).over(W.partitionBy(*keys).orderBy(valid_from))
    spans = versions.withColumn("valid_to", nxt)
    # One row: an open version holds until the newest event.
    newest = df.agg(F.max(ts).alias("_newest"))
    last = F.greatest(day(F.coalesce("valid_to", "_newest", valid_from)), day(F.col(valid_from)))
    dated = spans.crossJoin(F.broadcast(newest)).withColumn(
        "_day", F.explode(F.sequence(day(F.col(valid_from)), last))).drop("_newest")
    left, right = df.withColumn("_day", day(F.col(ts))).alias("e"), dated.alias("v")
    same = reduce(lambda a, b: a & b, [F.col(f"e.{k}") == F.col(f"v.{k}") for k in [*keys, "_day"]])
    live = (F.col(f"e.{ts}") >= F.col(f"v.{valid_from}")) & (
        F.col("v.valid_to").isNull() | (F.col(f"e.{ts}") < F.col("v.valid_to")))
    joined = left.join(right, same & live, "left")
    return joined.select(*[F.col(f"e.{c}") for c in df.columns], *[F.col(f"v.{c}") for c in spans.columns
                                                                     if c not in keys])


def z_score(feature: str) -> Column:
    return (F.col(feature) - F.col(f"mean__{feature}")) / F.greatest(F.col(f"std__{feature}"), F.lit(STD_FLOOR))


def deviation_score(features: Sequence[str], weights: dict[str, float] | None = None,
                    min_samples: int = 100) -> Column:
    """Mean weighted |z| over the known features, divided by 3; 0 without a stable profile."""
    weights = weights or {}
    terms = [F.abs(z_score(f)) * F.lit(float(weights.get(f, 1.0))) for f in features]
    known = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in terms[1:]),
                F.when(terms[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))
    return F.when((F.col("sample_count") >= min_samples) & (known > 0), total / known / 3.0).otherwise(0.0)


def bounds(feature: str, k: float = 2.0) -> tuple[Column, Column]:
    """Expected range mean ± k·std inside [0, 1]; (0, 1) for an unknown feature."""
    mean, std = F.col(f"mean__{feature}"), F.col(f"std__{feature}")
    return (F.coalesce(F.greatest(F.lit(0.0), mean - k * std), F.lit(0.0)),
            F.coalesce(F.least(F.lit(1.0), mean + k * std), F.lit(1.0)))


def explain_sql(feature: str, z: str) -> str:
    """SQL text of the explanation of a deviating feature; ``z`` names its z-score."""
    def fixed(value: str) -> str:
        return f"format_number({value}, '0.000')"

    return (f"concat('{feature}: ', if({z} > 0, 'Higher', 'Lower'), ' than normal (value=', {fixed(feature)}, "
            f"', expected≈', {fixed(f'mean__{feature}')}, '±', "
            f"{fixed(f'greatest(std__{feature}, {STD_FLOOR}D)')}, ')')")


# --- moving-average profiles ---------------------------------------------------
#
# One update is  m' = (1-a) m + a x,  v' = (1-a) v + a (x - m')^2.
# A run of updates therefore acts on (m, v) as
#   m' = p m + b,   v' = p v + a (A - 2 B m + C m^2)
# with five numbers (p, b, A, B, C) that depend on the run only. Runs are cut
# into fixed segments, summarised in parallel, and the summaries are composed in
# order; composing is closed, so it repeats on groups of summaries.

_COEF = ("p", "b", "qa", "qb", "qc")


_RANGE = ("lows", "highs")


def _per_feature(n: int, body: str) -> str:
    """SQL array with ``body`` for every feature position ``i``."""
    return f"transform(sequence(0, {n - 1}), i -> {body})"


def _state(p: str, b: str, qa: str, qb: str, qc: str) -> str:
    return f"named_struct('p', {p}, 'b', {b}, 'qa', {qa}, 'qb', {qb}, 'qc', {qc})"


def _unpacked(names: list[str], extra: Sequence[str]) -> list[Column]:
    """Columns of the coefficient arrays held in ``s``."""
    return [*names, *extra, *[F.expr(f"transform(s, e -> e.{c})").alias(c) for c in _COEF], *_RANGE]


def segment_summaries(df: DataFrame, features: Sequence[str], keys: Sequence[str], ts: str, tie: str,
                      alpha: float, segment_rows: int, seed_rows: int = 0) -> DataFrame:
    """Numbers each key's rows in time order and summarises equal segments of them, in one pass.

    With ``seed_rows`` the first rows form segment -1, whose ``b`` and ``qa`` hold
    the plain mean and variance. A segment's rows are folded inside the JVM.
    """
    n, names = len(features), list(keys)
    vec = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    slim = df.select(*keys, ts, tie, vec.alias("x"))
    after = F.col("row_no") - 1 - seed_rows
    seg = F.when(after < 0, -1).otherwise(F.floor(after / F.lit(segment_rows))).cast("long")
    at = number_rows(slim, keys, ts, tie).withColumn("seg", seg)
    packed = at.groupBy(*keys, "seg").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "x"))).alias("r"), F.count(F.lit(1)).alias("rows"))
    keep = 1 - alpha
    b = f"({keep}D * s.b + {alpha}D * e.x[i])"
    fold = _per_feature(n, f"""aggregate(r, {_state('1D', '0D', '0D', '0D', '0D')}, (s, e) -> {_state(
        f'{keep}D * s.p', b, f'{keep}D * s.qa + pow(e.x[i] - {b}, 2)',
        f'{keep}D * s.qb + (e.x[i] - {b}) * {keep}D * s.p', f'{keep}D * s.qc + pow({keep}D * s.p, 2)')})""")
    mean = "aggregate(r, 0D, (a, e) -> a + e.x[i]) / rows"
    # The squares are summed around the mean, which one more fold carries along.
    spread = f"""aggregate(r, named_struct('m', {mean}, 'q', 0D), (a, e) -> named_struct('m', a.m, 'q',
        a.q + pow(e.x[i] - a.m, 2)), a -> if(rows > 1, a.q / (rows - 1), {SINGLE_SAMPLE_STD ** 2}D))"""
    plain = _per_feature(n, _state("0D", mean, spread, "0D", "0D"))
    return packed.select(
        *names, "seg", "rows", F.expr(f"if(seg < 0, {plain}, {fold})").alias("s"),
        F.expr(_per_feature(n, "array_min(transform(r, e -> e.x[i]))")).alias("lows"),
        F.expr(_per_feature(n, "array_max(transform(r, e -> e.x[i]))")).alias("highs")).select(
        *_unpacked(names, ["seg", "rows"]))


def compose_summaries(summaries: DataFrame, keys: Sequence[str], fan_in: int, levels: int) -> DataFrame:
    """Composes consecutive summaries, ``fan_in`` at a time, down to one row per key."""
    names = list(keys)
    # The summary of s followed by e, for feature i.
    chained = _state(
        "e.p[i] * s.p", "e.p[i] * s.b + e.b[i]",
        "e.p[i] * s.qa + e.qa[i] - 2 * e.qb[i] * s.b + e.qc[i] * s.b * s.b",
        "e.p[i] * s.qb + e.qb[i] * s.p - e.qc[i] * s.p * s.b", "e.p[i] * s.qc + e.qc[i] * s.p * s.p")

    def each(body: str) -> str:
        return f"transform(sequence(0, size(r[0].p) - 1), i -> {body})"

    level = summaries
    for k in range(levels):
        up = F.lit(0).cast("long") if k == levels - 1 else F.floor(F.col("seg") / F.lit(fan_in)).cast("long")
        packed = level.groupBy(*names, up.alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("seg", *_COEF, *_RANGE))).alias("r"), F.sum("rows").alias("rows"))
        level = packed.select(
            *names, F.col("up").alias("seg"), "rows",
            F.expr(each(f"aggregate(r, {_state('1D', '0D', '0D', '0D', '0D')}, (s, e) -> {chained})")).alias("s"),
            F.expr(each("array_min(transform(r, e -> e.lows[i]))")).alias("lows"),
            F.expr(each("array_max(transform(r, e -> e.highs[i]))")).alias("highs")).select(
            *_unpacked(names, ["seg", "rows"]))
    return level.drop("seg")


def apply_summary(state: DataFrame, summary: DataFrame, keys: Sequence[str], n_features: int,
                  alpha: float) -> DataFrame:
    """New ``means``/``variances`` arrays of each key after the summarised updates."""
    joined = state.join(summary, list(keys), "left")
    idx = F.sequence(F.lit(0), F.lit(n_features - 1))

    def pick(name: str, i: Column) -> Column:
        return F.col(name)[i]

    means = F.transform(idx, lambda i: pick("p", i) * pick("means", i) + pick("b", i))
    variances = F.transform(idx, lambda i: pick("p", i) * pick("variances", i) + alpha * (
        pick("qa", i) - 2 * pick("qb", i) * pick("means", i) + pick("qc", i) * pick("means", i) * pick("means", i)))
    has = F.col("p").isNotNull()
    # New names first: inside a lambda, a name would bind to its new alias of the same select.
    updated = joined.select(
        *keys, F.when(has, means).otherwise(F.col("means")).alias("new_means"),
        F.when(has, variances).otherwise(F.col("variances")).alias("new_variances"),
        (F.col("sample_count") + F.coalesce(F.col("rows"), F.lit(0))).alias("sample_count"))
    return updated.withColumnsRenamed({"new_means": "means", "new_variances": "variances"})


def _composed_state(segs: DataFrame, features: Sequence[str], keys: Sequence[str], alpha: float, segment_rows: int,
                    levels: int) -> DataFrame:
    state = segs.where("seg < 0").select(*keys, F.col("rows").alias("sample_count"), F.col("b").alias("means"),
                                         F.col("qa").alias("variances"))
    later = compose_summaries(segs.where("seg >= 0"), keys, segment_rows, levels)
    return apply_summary(state, later, keys, len(features), alpha)


def moving_state(df: DataFrame, features: Sequence[str], keys: Sequence[str], ts: str, tie: str, alpha: float,
                 seed_rows: int, segment_rows: int, levels: int) -> DataFrame:
    """Rows (keys, means, variances, sample_count) after a seed of ``seed_rows`` rows and the updates that follow."""
    segs = cut(segment_summaries(df, features, keys, ts, tie, alpha, segment_rows, seed_rows))
    return _composed_state(segs, features, keys, alpha, segment_rows, levels)


def learn_moving(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("source_type",), ts: str = "ts",
                 tie: str = "event_id", alpha: float = 0.1, seed_rows: int = 1000, segment_rows: int = 1000,
                 levels: int = 3) -> DataFrame:
    """Long profile: statistics of the first ``seed_rows`` rows, then ordered moving averages.

    Keys with fewer rows keep the plain statistics of what they have.
    """
    segs = cut(segment_summaries(df, features, keys, ts, tie, alpha, segment_rows, seed_rows))
    done = _composed_state(segs, features, keys, alpha, segment_rows, levels)
    ranges = segs.select(*keys, F.posexplode(F.arrays_zip("lows", "highs")).alias("pos", "r")).groupBy(
        *keys, "pos").agg(F.min("r.lows").alias("min"), F.max("r.highs").alias("max"))
    entry = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("means"), F.col("variances"))
    rows = done.select(*keys, "sample_count", F.posexplode(entry).alias("pos", "e")).join(ranges, [*keys, "pos"])
    return rows.select(*keys, "sample_count", F.col("e.feature").alias("feature"), F.col("e.means").alias("mean"),
                       F.sqrt("e.variances").alias("std"), "min", "max", F.col("e.variances").alias("variance"))


# --- per-host profiles ------------------------------------------------------------

def host_profile(df: DataFrame, columns: Sequence[str], host: str = "host_id") -> DataFrame:
    """Per-host mean and population deviation of each column."""
    return df.groupBy(host).agg(F.count(F.lit(1)).alias("samples"), *[
        a for c in columns for a in (F.avg(c).alias(f"mean__{c}"), F.stddev_pop(c).alias(f"std__{c}"))])


def standard_scale(df: DataFrame, columns: Sequence[str], host: str = "host_id") -> DataFrame:
    """Adds ``scaled_<column>``: (x - host mean) / host deviation; a zero deviation counts as 1."""
    stats = cut(host_profile(df, columns, host))
    joined = df.join(stats, host, "left")
    scaled = {f"scaled_{c}": (F.col(c) - F.col(f"mean__{c}")) / F.when(
        F.col(f"std__{c}") == 0, 1.0).otherwise(F.col(f"std__{c}")) for c in columns}
    return joined.withColumns(scaled).select(*df.columns, *scaled)


def clamp_settings(df: DataFrame) -> DataFrame:
    """Detector settings limited to their allowed ranges."""
    return df.withColumns({"anomaly_threshold": clamp(F.col("anomaly_threshold"), 0.1, 0.95),
                           "z_score_threshold": clamp(F.col("z_score_threshold"), 1.0, 5.0),
                           "learning_rate": clamp(F.col("learning_rate"), 0.01, 0.5)})
