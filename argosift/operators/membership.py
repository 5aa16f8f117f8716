"""Which ids a history may hold: blocked Bloom filters kept as tables beside it.

A filter covers the ids of one day of one delivery. An id's hash picks one block of 512 bits, eight longs, and sets one
bit in each; a block is one row, and building is one aggregation with ``bit_or``. Blocks number a power of two, about 12
bits an id, so about one id in a hundred that is new seems known. An id is looked up in its block by an equality join;
the filters take about two bytes an id, and no row of the history is read for ids that they do not know. The ids they may
know are looked up in the history itself, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from argosift.session import cut

_WORDS = 8
_IDS_PER_BLOCK = 40


def _hash(record: str) -> Column:
    return F.xxhash64(record)


def _masks(record: str) -> list[Column]:
    """One bit in each word; six bits of a second hash per word."""
    other = F.xxhash64(F.lit("bits"), record)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * i).bitwiseAND(63).cast("int"))
            for i in range(_WORDS)]


def _block(record: str, blocks: Column) -> Column:
    return _hash(record).bitwiseAND(blocks - 1)


def build(rows: DataFrame, record: str = "record_id", day: str = "day") -> DataFrame:
    """Filter rows (day, blocks, block, w0 .. w7) of rows with an id and a day."""
    known = rows.where(F.col(record).isNotNull()).select(record, F.col(day).alias("day"))
    sizes = known.groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    # The next power of two of the blocks that the day's ids need.
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.ceil(F.col("_n") / _IDS_PER_BLOCK), F.lit(1))))).cast("long")
    sized = known.join(sizes.select("day", blocks.alias("blocks")), known["day"].eqNullSafe(sizes["day"])).drop(
        sizes["day"])
    words = [m.alias(f"w{i}") for i, m in enumerate(_masks(record))]
    spread = sized.select("day", "blocks", _block(record, F.col("blocks")).alias("block"), *words)
    return spread.groupBy("day", "blocks", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def may_hold(rows: DataFrame, filters: DataFrame, record: str = "record_id", day: str = "day") -> DataFrame:
    """The rows whose id the filters of its day may hold."""
    # One row per day and size of a filter.
    sizes = filters.select("day", "blocks").distinct()
    probes = rows.join(sizes.withColumnRenamed("day", "_day"), F.col(day) == F.col("_day")).select(
        *rows.columns, "blocks", _block(record, F.col("blocks")).alias("block"),
        *[m.alias(f"m{i}") for i, m in enumerate(_masks(record))])
    joined = probes.join(filters.withColumnRenamed("day", "_day"), (F.col(day) == F.col("_day")) & (
        probes["blocks"] == filters["blocks"]) & (probes["block"] == filters["block"]))
    held = F.lit(True)
    for i in range(_WORDS):
        held = held & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    return joined.where(held).select(*[F.col(c) for c in rows.columns]).distinct()


def append_new(history: DataFrame, filters: DataFrame, incoming: DataFrame, record: str = "record_id",
               day: str = "day") -> DataFrame:
    """Incoming rows whose (id, day) the history does not have; repeated ids inside the batch keep one row.

    ``history`` is stored by day. Only days of ids that the filters may hold are opened.
    """
    fresh = incoming.dropDuplicates([record])
    seen = cut(may_hold(fresh.select(record, day), filters, record, day).withColumn("probe", F.lit(1)))
    known = history.select(record, day).join(seen.where("probe > 0").drop("probe"), [record, day], "left_semi")
    return fresh.join(known, [record, day], "left_anti")
