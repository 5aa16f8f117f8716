"""Substring deduplication by relative Lempel-Ziv parsing over an index of reference blocks.

Every window of ``window`` words chooses one anchor, the word n-gram with the smallest hash in it. The windows that
share an anchor occurrence are consecutive; their union is a block. Blocks are content-defined, so equal passages are
cut into equal blocks in every document, and a document is a chain of overlapping blocks.

1. All documents' blocks are indexed by (anchor, block hash); the block of the smallest doc_id is the reference block.
2. Each document is parsed against the whole index: a block equal to a reference block of an earlier document is a
   phrase, and consecutive phrases join greedily to one factor. A phrase holds at least one whole window, so every
   factor is long enough.
3. A block whose anchor also occurs elsewhere, but in other surroundings, is where factors end. There, and only there,
   each window is looked up by itself: the first document of every block variant enters its windows, and a window
   that an earlier document has too extends the factor.

A window repeats an earlier one exactly if its block is a later copy (2) or an earlier document entered it (3), so
the result is exact. Anchors are about 2 in 42 word positions; all keys are counted with partial aggregates, so a
passage that a third of all documents share is one key with one row per task, and joins on it may be split.

Defined cases: null text has no words; documents shorter than a window are never touched; windows repeated inside one
document do not count; rows with a null id neither remove nor lose words; rows with equal ids do not remove each
other's words; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from argosift.llm.common import Words, free_name, map_arrow
from argosift.session import cut


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per block: anchor hash, block hash, first and last window start."""
    n = len(words)
    if n < window:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    at = np.arange(n - gram + 1)
    grams = words.hashes(at, at + gram - 1)
    wide = window - gram + 1
    starts = np.arange(n - window + 1)
    chosen = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(grams[i:i + (1 << 16) + wide - 1], wide)
        chosen[i:i + (1 << 16)] = part.argmin(axis=1) + starts[i:i + (1 << 16)]
    first = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
    last = np.concatenate((first[1:] - 1, [len(starts) - 1]))
    return grams[chosen[first]], words.hashes(first, last + window - 1), first, last


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def blocks(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (anchor, block, doc_id, text_hash, lo, hi) of all documents."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [anchors(Words(t), window, gram) for t in batch.column(2).to_pylist()]
        row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        anchor, block, lo, hi = (np.concatenate([f[i] for f in found]) for i in range(4))
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), batch.column(0).take(pa.array(row)),
             batch.column(1).take(pa.array(row)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
            names=["anchor", "block", "doc_id", "text_hash", "lo", "hi"])

    return map_arrow(keyed.where(F.col("doc_id").isNotNull()), run,
                     f"anchor long, block long, doc_id {kind}, text_hash long, lo int, hi int")


def boundary_windows(keyed: DataFrame, open_blocks: DataFrame, window: int) -> DataFrame:
    """Rows (digest, doc_id, text_hash, start) of every window in the given blocks."""
    kind = keyed.schema["doc_id"].dataType.simpleString()
    lists = open_blocks.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    # Repeated rows have the same windows; one of them is enough.
    texts = keyed.join(lists, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "parts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, row, starts = [], [], []
        parts = batch.column(3).to_pylist()
        for i, text in enumerate(batch.column(2).to_pylist()):
            words = Words(text)
            for start in sorted({s for p in parts[i] for s in range(p["lo"], p["hi"] + 1)}):
                digests.append(hashlib.blake2b(words.run(start, start + window - 1), digest_size=16).digest())
                row.append(i)
                starts.append(start)
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), batch.column(0).take(take), batch.column(1).take(take),
             pa.array(starts, pa.int32())], names=["digest", "doc_id", "text_hash", "start"])

    return map_arrow(texts, run, f"digest binary, doc_id {kind}, text_hash long, start int")


def factors(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = 50,
            gram: int = 10) -> DataFrame:
    """Rows (doc_id, text_hash, spans): word ranges [lo, hi) that repeat an earlier document; ranges may overlap."""
    keyed = _keyed(docs, id_column, text)
    index = cut(blocks(keyed, window, gram))
    # Written, so that the joins below deal both sides anew and a hot key can be split.
    shared = cut(index.groupBy("anchor").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        (F.min("block") == F.max("block")).alias("uniform")).where("first < last").drop("last"))
    met = cut(index.join(shared, "anchor"))

    varied = met.where("not uniform")
    reference = cut(varied.groupBy("anchor", "block").agg(F.min("doc_id").alias("block_first")))
    parsed = cut(varied.join(reference, ["anchor", "block"]).select(
        "doc_id", "text_hash", "lo", "hi", (F.col("doc_id") > F.col("block_first")).alias("phrase")))
    phrases = met.where("uniform and doc_id > first").select("doc_id", "text_hash", "lo", "hi").union(
        parsed.where("phrase").select("doc_id", "text_hash", "lo", "hi"))

    entered = cut(boundary_windows(keyed, parsed.where("not phrase"), window))
    repeated = cut(entered.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(
        "first < last").drop("last"))
    extended = entered.join(repeated, "digest").where("doc_id > first").select(
        "doc_id", "text_hash", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return phrases.union(extended).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("lo", (F.col("hi") + window).alias("hi"))).alias("spans"))


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the words that stay, joined by one space."""
    words = Words(text)
    if not spans:
        return len(words), 0, words.data
    stays, at, removed = [], 0, 0
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        # Overlapping phrases join to one factor.
        if lo > at:
            stays.append(words.run(at, lo - 1))
        removed += max(0, hi - max(lo, at))
        at = max(at, hi)
    if at < len(words):
        stays.append(words.run(at, len(words) - 1))
    return len(words), removed, b" ".join(stays)


def summaries(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256."""
    keyed = _keyed(docs, id_column, text)
    spans = factors(docs, id_column, text, window)
    joined = keyed.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [kept_words(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
             pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return map_arrow(joined, run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed(
        "doc_id", id_column)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: str | None = "n_chars",
                   window: int = 50) -> DataFrame:
    """``docs`` without repeated passages; texts that lose nothing stay as they are, ``length`` follows the text."""
    own_hash, own_spans = free_name(docs, "own_hash"), free_name(docs, "own_spans")
    spans = factors(docs, id_column, text, window).select(
        F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), F.col("spans").alias(own_spans))
    keyed = docs.withColumn(own_hash, F.xxhash64(text))
    same = (keyed[id_column] == spans["span_id"]) & (keyed[own_hash] == spans["span_hash"])
    joined = keyed.join(spans, same, "left").select(*docs.columns, own_spans)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, last = batch.schema.get_field_index(text), batch.num_columns - 1
        texts = [kept_words(t, s)[2].decode("utf-8", "surrogatepass") if s else t
                 for t, s in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist())]
        columns = [*batch.columns[:last]]
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = map_arrow(joined, run, kinds)
    if length and length in docs.columns:
        out = out.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
