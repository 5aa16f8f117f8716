"""Ordered per-key computations that split hot keys by time.

A plain ``Window.partitionBy(host)`` puts every row of a host in one task. The
functions here work inside (key, cell) groups and carry small per-cell totals
across cells, so a host that holds a third of all rows is still spread over as
many tasks as it has cells. Cells are cut by rows: the seconds of a key are
counted and put together, in order, until a cell has about ``CELL_ROWS`` rows, so
a burst makes more cells, not larger ones (one second is the smallest cell).
Sliding frames are replaced by running sums of arrivals and expiries, which cost
O(n log n) however many rows a frame spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from argosift.functions.times import micros

CELL_ROWS = 50_000


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds non-null text twins of the keys, so plain equality joins keep null keys."""
    names = [f"_k{i}" for i in range(len(keys))]
    twins = {n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null"))
             for n, k in zip(names, keys)}
    return df.withColumns(twins), names


def _with_cells(work: DataFrame, ks: Sequence[str], t: Column, cell_rows: int) -> DataFrame:
    """Adds ``_cell``, which grows with time inside a key; rows without a time come before all others."""
    timed = work.withColumn("_second", F.coalesce(F.floor(t / F.lit(1_000_000)).cast("long"), F.lit(-(2 ** 62))))
    counts = timed.groupBy(*ks, "_second").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*ks).orderBy("_second").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    cells = counts.select(*ks, "_second", F.floor(before / F.lit(cell_rows)).alias("_cell"))
    return timed.join(cells, [*ks, "_second"])


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Sequence[str],
                 cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``run_<measure>``: the sum over all rows of the key up to this order value.

    ``order[0]`` holds microseconds; rows with equal order values are all included.
    """
    work, ks = _keyed(df, keys)
    work = _with_cells(work, ks, F.col(order[0]), cell_rows)
    per_cell = work.groupBy(*ks, "_cell").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    earlier = W.partitionBy(*ks).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carried = per_cell.select(*ks, "_cell", *[
        F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_carry_{m}") for m in measures])
    inside = W.partitionBy(*ks, "_cell").orderBy(*order)
    local = work.withColumns({f"_run_{m}": F.sum(m).over(inside) for m in measures})
    joined = local.join(carried, [*ks, "_cell"])
    return _drop_helpers(joined.withColumns({
        f"run_{m}": F.coalesce(F.col(f"_run_{m}"), F.lit(0)) + F.col(f"_carry_{m}") for m in measures}))


def trailing_sums(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, measures: dict[str, Column],
                  cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds, per measure, its sum over the key's rows with ts in [ts - seconds, ts].

    Every row adds its measures at its own time and takes them back just after
    ``ts + seconds``; the running sum of both is the sum over the trailing window.
    """
    swept = arrivals_and_expiries(df, keys, ts, seconds, measures)
    summed = running_sums(swept, keys, ["t_us", "t_kind"], [f"m_{n}" for n in measures], cell_rows)
    kept = summed.where("t_kind = 0")
    return (kept.withColumns({name: F.col(f"run_m_{name}") for name in measures})
            .drop("t_us", "t_kind", *[f"m_{n}" for n in measures], *[f"run_m_{n}" for n in measures]))


def arrivals_and_expiries(df: DataFrame, keys: Sequence[str], ts: str, seconds: int | Column,
                          measures: dict[str, Column]) -> DataFrame:
    """Each row at its own time (kind 0) and, emptied but for its keys, just after its window (kind 1).

    ``m_<measure>`` holds the value that enters or leaves.
    """
    work = df.withColumns({"_us": micros(F.col(ts)), **{f"_m_{n}": e for n, e in measures.items()}})
    step = F.explode(F.array(F.lit(0), F.lit(1)))
    both = work.withColumn("t_kind", step)
    arrives = F.col("t_kind") == 0
    payload = [F.when(arrives, F.col(c)).alias(c) for c in df.columns if c not in keys]
    stay = seconds if isinstance(seconds, Column) else F.lit(seconds)
    time = F.when(arrives, F.col("_us")).otherwise(F.col("_us") + stay.cast("long") * 1_000_000)
    moved = [F.when(arrives, F.col(f"_m_{n}")).otherwise(-F.col(f"_m_{n}")).alias(f"m_{n}") for n in measures]
    return both.select(*keys, *payload, time.alias("t_us"), "t_kind", *moved)


def number_rows(df: DataFrame, keys: Sequence[str], ts: str, tie: str, out: str = "row_no",
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds the 1-based position of the row in its key, ordered by (ts, tie)."""
    work, ks = _keyed(df, keys)
    work = _with_cells(work, ks, micros(F.col(ts)), cell_rows)
    per_cell = work.groupBy(*ks, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*ks).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carried = per_cell.select(*ks, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = work.withColumn("_pos", F.row_number().over(W.partitionBy(*ks, "_cell").orderBy(ts, tie)))
    joined = local.join(carried, [*ks, "_cell"])
    return _drop_helpers(joined.withColumn(out, (F.col("_before") + F.col("_pos")).cast("long")))


def previous_row(df: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: Sequence[str],
                 cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``prev_<col>`` from the key's previous row in (ts, tie) order."""
    work, ks = _keyed(df, keys)
    work = _with_cells(work, ks, micros(F.col(ts)), cell_rows)
    payload = F.struct(*cols)
    last = work.groupBy(*ks, "_cell").agg(F.max_by(payload, F.struct(ts, tie)).alias("_last"))
    carried = last.select(*ks, "_cell", F.lag("_last").over(W.partitionBy(*ks).orderBy("_cell")).alias("_carry"))
    inside = W.partitionBy(*ks, "_cell").orderBy(ts, tie)
    local = work.withColumns({"_pos": F.row_number().over(inside), "_lag": F.lag(payload).over(inside)})
    joined = local.join(carried, [*ks, "_cell"])
    prev = F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return _drop_helpers(joined.withColumn("_prev", prev)
                         .withColumns({f"prev_{c}": F.col(f"_prev.{c}") for c in cols}))


def running_max(df: DataFrame, keys: Sequence[str], ts: str, values: dict[str, Column], strict: bool = False,
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds the largest of each value over the key's rows up to the row's time, or before it with ``strict``."""
    work, ks = _keyed(df, keys)
    work = work.withColumns({"_us": micros(F.col(ts)), **{f"_v_{n}": v for n, v in values.items()}})
    work = _with_cells(work, ks, F.col("_us"), cell_rows)
    per_cell = work.groupBy(*ks, "_cell").agg(*[F.max(f"_v_{n}").alias(f"_m_{n}") for n in values])
    earlier = W.partitionBy(*ks).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carried = per_cell.select(*ks, "_cell", *[F.max(f"_m_{n}").over(earlier).alias(f"_carry_{n}") for n in values])
    inside = W.partitionBy(*ks, "_cell").orderBy("_us").rangeBetween(W.unboundedPreceding, -1 if strict else 0)
    local = work.withColumns({f"_here_{n}": F.max(f"_v_{n}").over(inside) for n in values})
    joined = local.join(carried, [*ks, "_cell"])
    return _drop_helpers(joined.withColumns({n: F.greatest(f"_here_{n}", f"_carry_{n}") for n in values}))


def last_before(df: DataFrame, keys: Sequence[str], ts: str, tie: str, flag: Column, out: str,
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds the ``tie`` of the key's newest flagged row with a time not after the row's own."""
    work, ks = _keyed(df, keys)
    work = _with_cells(work, ks, micros(F.col(ts)), cell_rows).withColumn(
        "_flagged", F.when(flag, F.struct(ts, tie)))
    per_cell = work.groupBy(*ks, "_cell").agg(F.max("_flagged").alias("_top"))
    earlier = W.partitionBy(*ks).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carried = per_cell.select(*ks, "_cell", F.max("_top").over(earlier).alias("_carry"))
    local = work.withColumn("_here", F.max("_flagged").over(W.partitionBy(*ks, "_cell").orderBy(ts)))
    joined = local.join(carried, [*ks, "_cell"])
    return _drop_helpers(joined.withColumn(out, F.coalesce("_here", "_carry")[tie]))


def prior_rows(df: DataFrame, keys: Sequence[str], ts: str, tie: str, limit: int,
               segment_rows: int = 2_000, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``prior_count`` and ``prior_first``: how many of the key's last ``limit``
    earlier rows exist, and the time of the oldest of them.

    Rows are numbered, cut into equal segments, and the last ``limit`` rows of each
    segment are repeated in the next one, so no group exceeds a segment.
    """
    size = max(segment_rows, limit)
    numbered, ks = _keyed(number_rows(df, keys, ts, tie, "row_no", cell_rows), keys)
    seg = F.floor((F.col("row_no") - 1) / F.lit(size)).cast("long")
    near_end = (F.col("row_no") - 1) % size >= size - limit
    spread = numbered.withColumn("_home", seg).withColumn(
        "_seg", F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    w = W.partitionBy(*ks, "_seg").orderBy("row_no")
    oldest = F.when(F.col("row_no") > limit, F.lag(ts, limit).over(w)).when(
        F.col("row_no") > 1, F.first(ts).over(w))
    full = spread.withColumns({"prior_first": oldest,
                               "prior_count": F.least(F.col("row_no") - 1, F.lit(limit)).cast("long")})
    return _drop_helpers(full.where(F.col("_seg") == F.col("_home")))
