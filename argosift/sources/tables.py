"""Event, audit, profile, alert and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from argosift.operators.audit import event_hash
from argosift.session import cut


def write_both(events: DataFrame, primary_path: str, backup_path: str, batch: str) -> None:
    """Stores events in the mutable table and their hashes in the append-only table.

    Ids already in the backup are skipped; both writes carry the same content hash. Rows are kept by batch and day:
    a batch that is written again after a failure replaces its own folders, and only the days of its events are
    looked up. The backup goes first, so a primary row is never without its hash.
    """
    spark = events.sparkSession
    hashed = events.withColumns({"content_hash": event_hash(), "day": F.to_date("ts")})
    new = hashed.dropDuplicates(["event_id"])
    if table_exists(spark, backup_path):
        # One row per day.
        days = [r[0] for r in hashed.select("day").distinct().collect()]
        known = spark.read.parquet(backup_path).where((F.col("batch").cast("string") != batch) & F.col("day").isin(days))
        new = new.join(known.select("day", F.col("record_id").alias("event_id")), ["day", "event_id"], "left_anti")
    # One written batch feeds both tables, so they cannot differ.
    rows = cut(new)
    hashes = rows.select(F.col("event_id").alias("record_id"), "ts", "host_id", "event_type", "content_hash", "day")
    for table, path in ((hashes, backup_path), (rows, primary_path)):
        table.write.mode("overwrite").partitionBy("day").parquet(f"{path.rstrip('/')}/batch={batch}")


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def save_profiles(profile: DataFrame, path: str, key: str = "source_type") -> None:
    profile.write.mode("overwrite").partitionBy(key).parquet(path)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Adds rows to a history table (metrics, thresholds, alerts, actions)."""
    rows.write.mode("append").parquet(path)


def export_report(sections: dict[str, DataFrame], path: str, fmt: str = "json") -> list[str]:
    """Writes each report table below ``path``; returns the section folders."""
    out = []
    for name, df in sections.items():
        target = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(target)
        out.append(target)
    return out


def alert_history(spark: SparkSession, path: str, n: int = 10, severity: str | None = None,
                  columns: Sequence[str] = ("alert_id", "ts", "alert_type", "severity", "message")) -> DataFrame:
    rows = spark.read.parquet(path)
    kept = rows if severity is None else rows.where(F.col("severity") == severity)
    return kept.orderBy(F.desc("ts"), F.desc("alert_id")).limit(n).select(*columns)
