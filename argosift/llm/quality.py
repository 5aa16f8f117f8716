"""Quality selection by importance resampling.

Texts are bags of hashed words and word pairs. Two generative models count the buckets: the target model over texts
known to be good, the raw model over all texts. A text's weight is the sum over its n-grams of the logarithm of the
target's share over the raw share; adding Gumbel noise and taking the largest keys draws texts without replacement in
proportion to their weight. The noise comes from a hash of id and text, so a run can be repeated.

The raw counts cover every text whole, the target counts a bounded sample of the good ones. The driver gets one count
per bucket and a histogram per selection round.

Defined cases: null and empty texts have no n-grams and weight 0; without target texts all weights are 0; rows with
equal id and text have equal keys and stay or go together, also at the edge of the sample, where ties are all taken;
null ids are like any other value; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from argosift.llm.common import Words, map_arrow
from argosift.session import cut, small_batches


def buckets(text: str | None, n_buckets: int) -> np.ndarray:
    """Bucket of every word and word pair of the lower-cased text."""
    words = Words((text or "").lower())
    if not len(words):
        return np.zeros(0, np.int64)
    at = np.arange(len(words))
    codes = np.concatenate((words.hashes(at, at), words.hashes(at[:-1], at[1:])))
    return (codes % np.uint64(n_buckets)).astype(np.int64)


def models(texts: DataFrame, text: str = "text", good: str = "good", n_buckets: int = 10_000) -> np.ndarray:
    """Logarithms of the target share over the raw share of every bucket, with add-one smoothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for t, is_good in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = np.bincount(buckets(t, n_buckets), minlength=n_buckets)
                    raw += found
                    if is_good:
                        target += found
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_buckets)), pa.array(raw), pa.array(target)],
                                         names=["bucket", "raw", "target"])

    chosen = texts.select(text, F.coalesce(F.col(good), F.lit(False)).alias("good"))
    small_batches(texts.sparkSession)
    rows = chosen.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(n_buckets)
    return np.log((target + 1) / (target.sum() + n_buckets)) - np.log((raw + 1) / (raw.sum() + n_buckets))


def score(docs: DataFrame, ratio: np.ndarray, id_column: str = "doc_id", text: str = "text",
          seed: int = 7) -> DataFrame:
    """Rows (id, n_grams, log_weight, mean_log_ratio, gumbel_key)."""
    chosen = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [ratio[buckets(t, len(ratio))] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(f) for f in found], pa.int64()),
             pa.array([float(f.sum()) for f in found], pa.float64())], names=["doc_id", "noise", "n_grams", "log_weight"])

    noise = F.xxhash64("doc_id", "text", F.lit(seed)).alias("noise")
    scored = map_arrow(chosen.select("doc_id", "text", noise), run,
                       f"doc_id {kind}, noise long, n_grams long, log_weight double", rows=64)
    # The hash as a number strictly between 0 and 1.
    uniform = (F.shiftrightunsigned("noise", 12).cast("double") + 0.5) / float(1 << 52)
    return scored.select(
        F.col("doc_id").alias(id_column), "n_grams", "log_weight",
        F.coalesce(F.try_divide("log_weight", "n_grams"), F.lit(0.0)).alias("mean_log_ratio"),
        (F.col("log_weight") - F.log(-F.log(uniform))).alias("gumbel_key"))


def top_k(rows: DataFrame, key: str, k: int, steps: int = 1024) -> Column:
    """Condition that holds for the ``k`` rows with the largest keys, and all that tie with the last of them.

    The k-th largest key is found by counting rows in ever finer ranges; each round brings ``steps`` counts to the
    driver, and no row is moved.
    """
    if k <= 0:
        return F.lit(False)
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if n <= k:
        return F.lit(True)
    while low < high:
        width = (high - low) / steps
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(steps - 1))
        inside = rows.where(F.col(key).between(low, high)).groupBy(place.alias("place")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(inside, key=lambda r: -r["place"]):
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return F.col(key) >= F.lit(float(low))


def resample(docs: DataFrame, good: DataFrame, share: float = 0.25, id_column: str = "doc_id", text: str = "text",
             n_buckets: int = 10_000, good_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """Scores of all rows of ``docs`` and whether each is in the sample of ``share`` of them.

    ``good`` has the ids of target texts; the target model is fitted on the ``good_rows`` of them with the smallest
    hashes, so the ids can be broadcast whatever the size of the table, and texts are not shuffled.
    """
    ids = good.select(F.col(id_column).alias("good_id")).where(F.col("good_id").isNotNull()).distinct().orderBy(
        F.xxhash64("good_id"), "good_id").limit(good_rows)
    labelled = docs.select(id_column, text).join(
        F.broadcast(ids), F.col(id_column) == F.col("good_id"), "left").withColumn("good", F.col("good_id").isNotNull())
    ratio = models(labelled, text, "good", n_buckets)
    rows = cut(score(docs, ratio, id_column, text, seed))
    chosen = top_k(rows, "gumbel_key", int(round(share * rows.count())))
    return rows.withColumn("selected", chosen)
