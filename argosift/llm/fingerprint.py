"""Order-independent document fingerprints by homomorphic multiset hashing.

A text is a multiset of paragraphs (its non-blank lines). Each paragraph is hashed to a wide vector, and the
fingerprint is the sum of these vectors: ``EXACT`` lanes modulo 2^64 from a digest of the paragraph, and ``LANES``
lanes modulo 2^32 to which every run of three words adds 1 or -1 at a hashed place. Sums do not depend on order, and
a paragraph is inserted or deleted by adding or subtracting its vector, without the rest of the text.

The first part tells equal multisets apart. The second is a random projection of the word runs: its cosine estimates
the likeness of two texts whatever their length, with a standard error of about ``LANES ** -0.5``; negative values
count as 0 and equal fingerprints as 1.

Defined cases: null counts as empty and an empty text has the zero vector; likeness of two empty texts is 1, of an
empty and another 0; a paragraph with fewer than three words is one run; blank lines do not count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from argosift.llm.common import Words

EXACT, LANES, RUN = 8, 128, 3


class Fingerprint:
    """Sum of paragraph vectors; supports ``insert``, ``delete`` and ``likeness``."""

    def __init__(self, text: str | None = None):
        self.exact = np.zeros(EXACT, np.uint64)
        self.lanes = np.zeros(LANES, np.int64)
        if text:
            self._add(text, 1)

    def _add(self, text: str, sign: int) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        lengths = np.array([n for line in raw.split(b"\n") if (n := len(line.split()))], np.int64)
        if not len(lengths):
            return
        words = Words(raw)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        digests = b"".join(hashlib.blake2b(words.run(a, b - 1), digest_size=8 * EXACT).digest()
                           for a, b in zip(starts.tolist(), ends.tolist()))
        total = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
        self.exact = self.exact + total if sign > 0 else self.exact - total
        # A run ends at every word that has enough words of its line before it, or at the last word of a short line.
        begin = np.repeat(starts, lengths)
        last = np.arange(ends[-1])
        full = last - begin >= RUN - 1
        full[ends[lengths < RUN] - 1] = True
        last, begin = last[full], begin[full]
        codes = words.hashes(np.maximum(last - RUN + 1, begin), last)
        place = ((codes >> np.uint64(1)) % np.uint64(LANES)).astype(np.int64)
        # Odd codes subtract.
        odd = (codes & np.uint64(1)) == 1
        self.lanes += sign * (np.bincount(place, minlength=LANES) - 2 * np.bincount(place[odd], minlength=LANES))

    def insert(self, text: str) -> Fingerprint:
        self._add(text, 1)
        return self

    def delete(self, text: str) -> Fingerprint:
        self._add(text, -1)
        return self

    def wrapped(self) -> np.ndarray:
        return self.lanes.astype(np.uint32).astype(np.int32)

    def hex(self) -> str:
        return self.exact.astype("<u8").tobytes().hex() + self.wrapped().astype("<i4").tobytes().hex()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.hex() == other.hex()

    def likeness(self, other: Fingerprint) -> float:
        a, b = self.wrapped().astype(float), other.wrapped().astype(float)
        if (self.exact == other.exact).all() and (a == b).all():
            return 1.0
        size = np.sqrt((a @ a) * (b @ b))
        return float(np.clip(a @ b / size, 0, 1)) if size > 0 else 0.0


def edited_text(text: str, following: str) -> str:
    """The last half of a text replaced by as many code points of the following one, or all of them."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pieces(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Documents dealt to ranges of descending ids; each range ends with a copy of the next range's first document."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = rows.agg(F.expr(f"percentile_approx(doc_id, array({', '.join(str(i / ranges) for i in range(1, ranges))}), "
                           "100000)")).first()[0] if ranges > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    piece = F.lit(len(cuts))
    # Nulls come after all ids, with the smallest ones.
    found = F.expr(f"size(filter(array({', '.join(map(repr, cuts))}), c -> c > doc_id))") if cuts else F.lit(0)
    placed = rows.withColumn("piece", F.coalesce(F.when(F.col("doc_id").isNotNull(), found), piece))
    # One row per range, so bounded by the number of partitions.
    firsts = placed.groupBy("piece").agg(F.max("doc_id").alias("first")).orderBy("piece").collect()
    tail = F.lit(None).cast("int")
    for i, r in enumerate(firsts):
        before = firsts[i - 1]["piece"]
        tail = F.when(F.col("doc_id").eqNullSafe(F.lit(r["first"])) & (F.col("piece") == r["piece"]), before).otherwise(tail)
    copies = placed.withColumn("before", tail).select(
        "doc_id", "text", F.explode(F.expr(
            "if(before is null, array(struct(piece, false as tail)),"
            " array(struct(piece, false as tail), struct(before as piece, true as tail)))")).alias("at"))
    return copies.select("doc_id", "text", "at.*").repartitionByRange(ranges, "piece").sortWithinPartitions(
        "piece", "tail", F.desc_nulls_last("doc_id"), "text")


def with_following(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id; the largest id follows the smallest. Of rows with equal
    ids the smaller text comes first; null ids come last.
    """
    pieces = _pieces(docs, id_column, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.null(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out: list[tuple] = []
        before = None
        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            for doc_id, body, piece, is_tail in zip(*(c.to_pylist() for c in batch.columns)):
                own = Fingerprint(body)
                if before is not None and before[2] == piece and not before[4]:
                    old_id, old_body, _, old, _ = before
                    edited = edited_text(old_body, body)
                    changed = Fingerprint(edited)
                    out.append((old_id, len(old_body), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                old.hex(), changed.hex(), old.likeness(changed), old.likeness(own)))
                before = doc_id, body, piece, own, is_tail
                if len(out) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    sql = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.mapInArrow(run, f"doc_id {sql}, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double").withColumnRenamed(
        "doc_id", id_column)
