"""Comparison of the mutable table with the backup by digests of ranges.

A range is a day and a bucket of ids. Its digest is the number of its records and four sums of 60-bit pieces of
SHA-256(id, content hash). Sums do not depend on order, add up over deliveries and partitions, and need no sort and no
shuffle of records: a scan gives one row per range and task. Ranges whose digests agree hold the same records. Only the
others are joined record by record; a record whose day was changed is in two of them.

The backup's digests are kept when it is written, so an audit scans the mutable table once, for its digests, and reads
records of the damaged ranges only. Tables are stored by day and bucket, so the damaged ranges are folders and the rest is
not opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from argosift.operators.audit import compare_hashes
from argosift.session import cut

BUCKETS = 16
_NO_DAY = "0001-01-01"
_SUMS = ["d0", "d1", "d2", "d3"]
RANGE = ["day", "bucket"]


def with_range(rows: DataFrame, record: str = "record_id", ts: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``day`` and ``bucket``; rows without a time are on the first day of all."""
    return rows.withColumns({"day": F.coalesce(F.to_date(ts), F.lit(_NO_DAY).cast("date")), "bucket": F.pmod(F.xxhash64(record), F.lit(buckets)).cast("int")})


def digests(rows: DataFrame, record: str = "record_id", content: str = "content_hash") -> DataFrame:
    """Rows (day, bucket, n, d0 .. d3) of rows that have a range."""
    whole = F.sha2(F.concat_ws(":", F.coalesce(F.col(record).cast("string"), F.lit("\u0000")),
                               F.coalesce(F.col(content), F.lit("\u0000"))), 256)
    hashed = rows.select(*RANGE, whole.alias("_h"))
    pieces = [F.conv(F.substring("_h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return hashed.groupBy(*RANGE).agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(p).cast("decimal(38,0)").alias(d) for p, d in zip(pieces, _SUMS)])


def added(rows: DataFrame) -> DataFrame:
    """Digests of several deliveries as one per range."""
    return rows.groupBy(*RANGE).agg(F.sum("n").alias("n"), *[F.sum(d).cast("decimal(38,0)").alias(d) for d in _SUMS])


def ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (day, bucket, left_n, right_n, damage) of all ranges of two digest tables; damage is 0 or 1."""
    a = left.select(*RANGE, F.struct("n", *_SUMS).alias("_a"))
    b = right.select(*RANGE, F.struct("n", *_SUMS).alias("_b"))
    return a.join(b, RANGE, "full").select(
        *RANGE, F.coalesce("_a.n", F.lit(0)).alias("left_n"), F.coalesce("_b.n", F.lit(0)).alias("right_n"),
        F.when(F.col("_a").eqNullSafe(F.col("_b")), 0).otherwise(1).alias("damage"))


def _within(rows: DataFrame, damaged: DataFrame, how: str) -> DataFrame:
    """Rows in, or with ``left_anti`` outside, the damaged ranges.

    The semi join is by the partition columns of stored tables, so the planner opens the damaged folders only.
    """
    return rows.join(damaged.select(*RANGE), RANGE, how)


def statuses(primary: DataFrame, backup: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (record_id, status) of all records of two tables of (record_id, content_hash, day, bucket).

    ``known`` are the stored digests of the backup. Records of equal ranges are valid without being joined.
    """
    checked = cut(ranges(digests(primary), digests(backup) if known is None else known))
    damaged = checked.where("damage > 0")
    sound = _within(primary, damaged, "left_anti").select("record_id", F.lit("valid").alias("status"))
    return sound.unionByName(damaged_statuses(primary, backup, damaged))


def damaged_statuses(primary: DataFrame, backup: DataFrame, damaged: DataFrame) -> DataFrame:
    """Rows (record_id, status) of the records of damaged ranges."""
    return compare_hashes(
        _within(primary, damaged, "left_semi").select("record_id", F.col("content_hash").alias("current_hash")),
        _within(backup, damaged, "left_semi").select("record_id", F.col("content_hash").alias("stored_hash")))


def summary(primary: DataFrame, backup: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row of counts by status as in an audit report; valid records of equal ranges are counted by their digests."""
    checked = cut(ranges(digests(primary), digests(backup) if known is None else known))
    found = damaged_statuses(primary, backup, checked.where("damage > 0")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))
    both = found.unionByName(checked.where("damage = 0").select(F.lit("valid").alias("status"), F.col("left_n").alias("n")))

    def total(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("n"))), F.lit(0)).cast("long")

    counts = both.agg(total("valid", "hash_mismatch").alias("checked"), total("valid").alias("valid"),
                      total("hash_mismatch").alias("tampered"), total("missing_in_primary").alias("missing"),
                      total("missing_in_backup").alias("orphans"))
    damage = checked.agg(F.count(F.lit(1)).alias("ranges"), F.count_if(F.col("damage") > 0).alias("damaged_ranges"))
    # One row each.
    return counts.crossJoin(F.broadcast(damage))


# --- stored tables --------------------------------------------------------------------------------------

def store(rows: DataFrame, path: str, batch: str, record: str = "record_id", ts: str = "ts", buckets: int = BUCKETS,
          digest_path: str | None = None) -> None:
    """Writes a delivery of (record, content_hash, ...) by day and bucket, and its digests; a repeated one replaces itself."""
    ranged = with_range(rows, record, ts, buckets)
    target = f"{path.rstrip('/')}/batch={batch}"
    ranged.repartition(*RANGE).write.mode("overwrite").partitionBy(*RANGE).parquet(target)
    if digest_path is not None:
        digests(read_stored(rows.sparkSession, target, ranged), record).write.mode("overwrite").parquet(
            f"{digest_path.rstrip('/')}/batch={batch}")


def read_stored(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """A table of :func:`store`, with its range columns."""
    reader = spark.read if like is None else spark.read.schema(like.schema)
    return reader.parquet(path)
