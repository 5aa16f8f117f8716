"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_SHARED_KEY = "spark.checkpoint.dir"
_written: list[str] = []


def build_session(app: str = "argosift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; extra settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on, applied to a session made elsewhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The JVM does not compile methods over 8000 bytecodes. Very wide projections and
    # aggregations run faster as separate small generated methods than as one such method.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Rows go to Python workers by at most ``rows``: texts may be long, and the JVM and the worker hold a batch whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    leaves it unset gets a folder of its own.
    """
    base = spark.conf.get(_SHARED_KEY, None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_SHARED_KEY} to a folder shared by all executors")
        base = os.path.join(tempfile.gettempdir(), f"argosift-{spark.sparkContext.applicationId}")
        spark.conf.set(_SHARED_KEY, base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def discard_tables(spark: SparkSession) -> int:
    """Deletes the folders that this process has named so far; for use when no result is read any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    done = 0
    while _written:
        path = hadoop(_written.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and continues from its files.

    Unlike an eager checkpoint this computes the last stage once, and the files
    carry a size that join planning can use.
    """
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fence(df: DataFrame, *columns: str) -> DataFrame:
    """Keeps filters on costly columns above the place where these are computed.

    The optimizer copies a filter on a computed column below it, expression and all.
    For a score built from dozens of columns the copy costs more than it saves, so
    the columns pass through a one-element generator, which filters do not cross.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(c) for c in rest], F.inline(F.array(F.struct(*columns))))
