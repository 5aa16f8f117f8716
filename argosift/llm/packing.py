"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents are measured in words (or by a given size column). A document longer than a bin is cut into full pieces,
which fill bins of their own, and a remainder; nothing is dropped. Remainders are dealt by hash into packing groups
of about ``group_rows`` pieces, so the work per group is bounded whatever the key distribution, and each group is
packed by best fit, largest pieces first: open bins are ordered by what is left in them, each bin carries one bitmap
of the sources and one of the duplicate clusters it holds, and the search starts at the successor of the piece's size
and goes on to the next larger residual until a bin has neither the piece's source nor its cluster. That bin is the
tightest compatible one; without one a new bin is opened.

A hot source or a large cluster of copies costs bins, not time: the search inside a group visits at most its bins.

Defined cases: null or empty text has size 0 and is not packed (bin_id null, one row); null sources never conflict;
null ids are packed like others; repeated rows are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from argosift.llm.common import Words, map_arrow
from argosift.session import cut


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, n_words, cluster): sizes in words; the cluster is a hash of the word sequence."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [Words(t) for t in batch.column(2).to_pylist()]
        cluster = [int(w.hashes([0], [len(w) - 1])[0] >> 1) if len(w) else None for w in words]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()),
             pa.array(cluster, pa.int64())], names=["doc_id", "source", "n_words", "cluster"])

    chosen = docs.select(F.col(id_column).alias("doc_id"), F.col(source).cast("string").alias("source"), text)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return map_arrow(chosen, measure, f"doc_id {kind}, source string, n_words long, cluster long")


def best_fit(sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int) -> tuple[list, list]:
    """Bin number and start offset of each piece; pieces are placed in the given order."""
    source_bits: dict = {}
    cluster_bits: dict = {}

    def bit(known: dict, value) -> int:
        return 0 if value is None or value != value else 1 << known.setdefault(value, len(known))

    open_bins: list[tuple[int, int]] = []  # (residual, bin), ordered
    used: list[tuple[int, int]] = []  # bitmaps of sources and clusters by bin
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = bit(source_bits, source), bit(cluster_bits, cluster)
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (used[open_bins[at][1]][0] & s or used[open_bins[at][1]][1] & c):
            at += 1
        if at < len(open_bins):
            residual, chosen = open_bins.pop(at)
            used[chosen] = used[chosen][0] | s, used[chosen][1] | c
        else:
            residual, chosen = capacity, len(used)
            used.append((s, c))
        bins.append(chosen)
        offsets.append(capacity - residual)
        if residual > size:
            insort(open_bins, (residual - size, chosen))
    return bins, offsets


def pack(sized: DataFrame, capacity: int = 2048, group_rows: int = 4096) -> DataFrame:
    """Rows (doc_id, piece, first_word, n_words, bin_id, bin_offset) from rows of :func:`measured`."""
    kind = sized.schema["doc_id"].dataType.simpleString()
    rows = cut(sized.withColumn("row", F.monotonically_increasing_id()))
    size = F.col("n_words")
    full = rows.where(size >= capacity).select(
        "doc_id", "row", "n_words",
        F.explode(F.sequence(F.lit(0), (F.floor(size / capacity) - 1).cast("int"))).alias("piece"))
    whole = full.select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"),
        F.lit(capacity).cast("long").alias("n_words"),
        F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    empty = rows.where(size == 0).select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_word"), size,
        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    rest = rows.where(size % capacity > 0)
    groups = max(1, -(-rest.count() // group_rows))

    def place(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("n_words", "descending"), ("order", "ascending"), ("row", "ascending")])
        sizes, sources, clusters = (part[c].to_pylist() for c in ("n_words", "source", "cluster"))
        bins, offsets = best_fit(sizes, sources, clusters, capacity)
        group = key[0].as_py()
        return part.select(["doc_id", "piece", "first_word", "n_words"]).append_column(
            "bin_id", pa.array([f"{group}-{b}" for b in bins], pa.string())).append_column(
            "bin_offset", pa.array(offsets, pa.int64()))

    order = F.xxhash64("doc_id", "cluster", "n_words")
    pieces = rest.select(
        "doc_id", "row", "source", "cluster", order.alias("order"), F.floor(size / capacity).cast("int").alias("piece"),
        (size - size % capacity).alias("first_word"), (size % capacity).alias("n_words"),
        F.pmod(F.xxhash64("row", "doc_id"), F.lit(groups)).alias("packing_group"))
    placed = pieces.groupBy("packing_group").applyInArrow(
        place, f"doc_id {kind}, piece int, first_word long, n_words long, bin_id string, bin_offset long")
    return placed.union(whole).union(empty)
