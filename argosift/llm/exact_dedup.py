"""Exact deduplication with a heavy-hitter split.

Digests are counted in two ways. Misra-Gries summaries of the partitions, merged by digest, name at most
``capacity`` digests, among them every one that more than ``rows / (capacity + 1)`` rows share. Their exact counts
and smallest ids are then aggregated; those that truly are that frequent are broadcast (``capacity`` rows at most)
and their rows are settled where they are read. All other digests are grouped and joined by an ordinary shuffle, in
which no key can hold more than ``rows / (capacity + 1)`` rows.

Defined cases: null text counts as empty; texts of any length are digested whole; of rows with equal id and text one
is kept; a null id is larger than any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from argosift.llm.common import free_name, without_spaces
from argosift.session import cut


def digest(text: str = "text") -> Column:
    """SHA-256 of the text after every run of ASCII white space became one space."""
    return F.sha2(without_spaces(text), 256)


def frequent_candidates(keys: DataFrame, key: str, capacity: int = 256) -> DataFrame:
    """At most ``capacity`` keys that include every key of more than ``rows / (capacity + 1)`` rows."""

    def reduce(counts: dict) -> dict:
        if len(counts) <= capacity:
            return counts
        least = sorted(counts.values(), reverse=True)[capacity]
        return {k: n - least for k, n in counts.items() if n > least}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            for k, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist()):
                counts[k] = counts.get(k, 0) + n
            counts = reduce(counts)
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(counts), pa.string()),
                                          "n": pa.array(list(counts.values()), pa.int64())})

    summaries = keys.select(F.col(key).cast("string")).mapInArrow(run, "k string, n long")
    merged = summaries.groupBy("k").agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), "k").limit(capacity).select(F.col("k").alias(key))


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                     capacity: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = cut(docs.select(F.col(id_column).alias("doc_id"), digest(text).alias("text_sha256"),
                           F.monotonically_increasing_id().alias("row")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    total = rows.count()
    named = frequent_candidates(rows, "text_sha256", capacity)
    grouping = (F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    counted = rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(*grouping)
    heavy = cut(counted.where(F.col("group_size") * (capacity + 1) > total))

    marked = rows.join(F.broadcast(heavy), "text_sha256", "left")
    settled = marked.where(F.col("group_size").isNotNull())
    rare = marked.where(F.col("group_size").isNull()).select(*rows.columns)
    other = rare.join(rare.groupBy("text_sha256").agg(*grouping), "text_sha256")
    return settled.select(*other.columns).union(other).select(
        F.col("doc_id").alias(id_column), F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = 256) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id, all columns as they are.

    Which rows stay is settled with ids and digests; whole rows are shuffled once, by the key of id and digest, and rows
    that repeat it are dropped on the same partitioning. Of rows with equal id and text, whatever their other columns,
    the one that is met first stays.
    """
    own = free_name(docs, "own_key")

    def key(of: str, digested: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col(of).cast("string"), F.lit("null")), digested)

    kept = duplicate_groups(docs, id_column, text, capacity).where("kept").select(
        key(id_column, F.col("text_sha256")).alias(own))
    keyed = docs.withColumn(own, key(id_column, digest(text)))
    return keyed.join(kept, own, "left_semi").dropDuplicates([own]).select(*docs.columns)
