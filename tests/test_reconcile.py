"""Range digests against the full comparison; sound ranges are not opened."""

import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from argosift.operators import audit as A, reconcile as R
from argosift.session import new_path

T0 = datetime(2024, 1, 1)


def records(spark, n=400):
    rows = [(i, T0 + timedelta(hours=i // 4), f"m{i}") for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, ts timestamp_ntz, message string")


def hashed(df):
    return df.withColumn("content_hash", F.sha2(F.concat_ws("|", F.col("ts").cast("string"), "message"), 256))


def ranged(df):
    return R.with_range(hashed(df), buckets=4).select("record_id", "content_hash", *R.RANGE)


def full(primary, backup):
    return A.compare_hashes(primary.select("record_id", F.col("content_hash").alias("current_hash")),
                            backup.select("record_id", F.col("content_hash").alias("stored_hash")))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


DAMAGE = {
    "none": lambda df: df, "changed": lambda df: df.withColumn("message", F.when(F.col("record_id") == 17, "x").otherwise(
        F.col("message"))), "deleted": lambda df: df.where("record_id not in (3, 200)"),
    "moved to another day": lambda df: df.withColumn("ts", F.when(F.col("record_id") == 40, F.lit(
        datetime(2024, 3, 1))).otherwise(F.col("ts"))), "no time": lambda df: df.withColumn("ts", F.when(
            F.col("record_id") == 40, F.lit(None)).otherwise(F.col("ts"))),
    "all gone": lambda df: df.where("false"),
    "swapped contents": lambda df: df.withColumn("message", F.when(F.col("record_id") == 4, "m5").when(
        F.col("record_id") == 5, "m4").otherwise(F.col("message")))}


@pytest.mark.parametrize("name", DAMAGE)
def test_same_rows_as_the_full_comparison(spark, name):
    base = records(spark)
    primary, backup = ranged(DAMAGE[name](base)), ranged(base.where("record_id <> 77"))
    want = rows(full(primary, backup))
    assert rows(R.statuses(primary, backup)) == want
    got = R.summary(primary, backup, R.digests(backup)).first()
    count = lambda *s: sum(r[1] in s for r in want)
    assert (got.checked, got.valid, got.tampered, got.missing, got.orphans) == (
        count("valid", "hash_mismatch"), count("valid"), count("hash_mismatch"), count("missing_in_primary"),
        count("missing_in_backup"))


def test_digests_add_up_and_do_not_depend_on_order(spark):
    a = ranged(records(spark))
    whole = R.digests(a)
    parts = R.digests(a.where("record_id % 3 = 0")).unionByName(R.digests(a.where("record_id % 3 <> 0").orderBy(F.desc(
        "record_id"))))
    assert R.ranges(whole, R.added(parts)).where("damage > 0").count() == 0
    assert R.ranges(whole, R.digests(a.union(a.limit(1)))).where("damage > 0").count() == 1


def test_only_damaged_ranges_are_opened(spark):
    base = records(spark)
    backup, known = new_path(spark, "backup"), new_path(spark, "digests")
    R.store(hashed(base.where("record_id < 250")), backup, "a", buckets=4, digest_path=known)
    R.store(hashed(base.where("record_id >= 250")), backup, "b", buckets=4, digest_path=known)
    primary = ranged(base.where("record_id <> 100"))
    digests = R.added(spark.read.parquet(known))
    table = spark.read.parquet(backup).select("record_id", "content_hash", *R.RANGE)
    day, bucket = table.where("record_id = 100").select("day", "bucket").first()
    for path in glob.glob(f"{backup}/batch=*/day=*/bucket=*/*.parquet"):
        if f"day={day}/bucket={bucket}/" not in path:
            with open(path, "r+b") as f:  # such a file can't be read any more
                f.write(b"damaged")
                f.truncate(7)
    got = R.statuses(primary, table, digests)
    assert rows(got.where("status <> 'valid'")) == [(100, "missing_in_primary")] and got.count() == 400


def test_repeated_delivery_replaces_itself(spark):
    path, known = new_path(spark, "again"), new_path(spark, "again-digests")
    for _ in range(2):
        R.store(hashed(records(spark, 50)), path, "a", digest_path=known)
    assert spark.read.parquet(path).count() == 50 and R.added(spark.read.parquet(known)).agg(F.sum("n")).first()[0] == 50


def test_empty_tables(spark):
    none = ranged(records(spark, 1).where("false"))
    assert rows(R.statuses(none, none)) == [] and R.summary(none, none).first().checked == 0
