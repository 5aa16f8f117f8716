"""Configured log sources and the readers behind them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from argosift import schemas
from argosift.operators.parse import filter_sources


@dataclass(frozen=True)
class SourceSpec:
    """One log source: where it is, how to read it and which lines to keep."""

    name: str
    path: str
    format: str = "text"
    category: str = "system_logs"
    enabled: bool = True
    priority: str = "medium"
    columns: dict[str, str] = field(default_factory=lambda: {"line": "value"})
    where: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)


def parse_config(data: dict) -> list[SourceSpec]:
    """Sources of the enabled categories; a source without ``enabled`` is on."""
    specs = []
    for category, body in data.items():
        if not isinstance(body, dict) or "sources" not in body or not body.get("enabled", False):
            continue
        for s in body["sources"]:
            if s.get("enabled", True):
                specs.append(SourceSpec(
                    name=s.get("name", "unknown"), path=s.get("path", ""), format=s.get("format", "text"),
                    category=category, priority=s.get("priority", "medium"),
                    columns=s.get("columns", {"line": "value"}), where=s.get("where"),
                    include=s.get("include_patterns", []), exclude=s.get("exclude_patterns", []),
                    options=s.get("options", {})))
    return specs


def tail_limit(data: dict, default: int = 500) -> int:
    """Entries to read back per source, as set at the top of a configuration."""
    return int(data.get("max_entries_per_source", default))


def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    raw = spark.read.format(spec.format).options(**spec.options).load(spec.path)
    kept = raw.where(spec.where) if spec.where else raw
    return kept.select(F.lit(spec.name).alias("source"),
                       *[F.expr(expr).alias(name) for name, expr in spec.columns.items()])


def read_all(spark: SparkSession, specs: Sequence[SourceSpec], line: str = "line") -> DataFrame:
    """Union of the enabled sources with their own include and exclude patterns applied."""
    active = [s for s in specs if s.enabled]
    frames = [read_source(spark, s) for s in active]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    rules = {s.name: {"include": s.include, "exclude": s.exclude} for s in active if s.include or s.exclude}
    return filter_sources(out, rules, line) if rules else out


def availability(spark: SparkSession, specs: Sequence[SourceSpec], observed: DataFrame,
                 source: str = "source") -> DataFrame:
    """Catalog of sources with a flag for those seen in ``observed``."""
    catalog = spark.createDataFrame([(s.name, s.category, s.enabled, s.priority) for s in specs],
                                    "name string, category string, enabled boolean, priority string")
    seen = observed.groupBy(F.col(source).alias("name")).agg(F.count(F.lit(1)).alias("lines"))
    joined = catalog.join(seen, "name", "left")
    return joined.withColumns({"lines": F.coalesce("lines", F.lit(0)),
                               "available": F.col("lines").isNotNull()})


def read_text_file(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (path, text), one row per file. Undecodable bytes become replacement marks."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, read in splits; for files too large to hold as one row."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.trim("value").alias("line")).where(
        F.col("line") != "")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Pushed log events: a folder of JSON files with the declared schema."""
    return spark.read.schema(schemas.SUBMISSION).json(path)
