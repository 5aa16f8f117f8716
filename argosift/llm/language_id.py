"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed letter 2-grams and 3-grams (UTF-8 bytes of the lower-cased text,
everything that is no letter as one space). Document frequencies come from all training rows. Each language gets
several centroids by spherical k-means over a bounded sample of distinct training texts (``per_language`` of them,
whole texts, chosen by hash). A text gets the language of the centroid with the largest cosine.

Rejection: cosines grow with the length of a text, so each language has a cut for each band of length (powers of two of
the number of n-grams). It is ``slack`` times the cosine that 99.7 % of all training texts of the language and band reach;
bands with fewer than 100 texts are judged with their neighbours. A text below the cut of its band is rejected.

Defined cases: a null text or one without a letter has language ``und``, score 0 and is rejected; a text with letters
but no known n-gram gets the first language, score 0 and is rejected; ties go to the first language in order; without
training rows every text is ``und``; equal texts get equal results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from argosift.llm.common import free_name, map_arrow
from argosift.session import small_batches

UNKNOWN = "und"
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_BANDS = 32  # bands of length
_STEPS = 1000  # cosines are counted in steps of a thousandth


def counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of the hashed 2-grams and 3-grams of a text; None without a letter."""
    if not text or not _LETTER.search(text):
        return None
    letters = text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()
    b = np.frombuffer(b" " + b" ".join(letters) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    found = np.bincount((two * np.uint32(2654435761)) >> np.uint32(16) & np.uint32(dims - 1), minlength=dims)
    found += np.bincount((three * np.uint32(2246822519)) >> np.uint32(16) & np.uint32(dims - 1), minlength=dims)
    return found


@dataclass
class Model:
    """``dims`` inverse document frequencies and the centroids of all languages."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    reach: np.ndarray  # low cosines of training texts by centroid and band of length

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of the texts, whether each has a letter, and bands of length."""
        out = np.zeros((len(texts), len(self.idf)), np.float32)
        some = np.zeros(len(texts), bool)
        band = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = counts(text, len(self.idf))
            if found is not None:
                some[i] = True
                out[i] = np.log1p(found) * self.idf
                band[i] = min(_BANDS, int(found.sum()).bit_length()) - 1
        # A few rows at a time, in place: the norm of all would hold a second copy.
        for part in (out[k:k + 64] for k in range(0, len(out), 64)):
            length = np.linalg.norm(part, axis=1, keepdims=True)
            part /= np.where(length > 0, length, 1)
        return out, some, band

    def predict(self, texts: list[str | None], slack: float) -> tuple[list[str], list[float], list[bool]]:
        vectors, some, band = self.vectors(texts)
        if not len(self.centroids):
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        cosine = vectors @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        refused = ~some | (top <= 0) | (top < slack * self.reach[best, band])
        return ([self.languages[k] if ok else UNKNOWN for k, ok in zip(best, some)],
                [float(x) if ok else 0.0 for x, ok in zip(top, some)], refused.tolist())


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Unit centroids, and the smallest cosine of a vector to the nearest of them.

    Starts from vectors that are far apart, but passes over the farthest tenth, which are often single odd texts.
    """
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argsort(nearest, kind="stable")[len(vectors) // 10]))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == j].sum(axis=0) if (own == j).any() else centroids[j]
                         for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids.astype(np.float32), float((vectors @ centroids.T).max(axis=1).min())


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", per_language: int = 1000, clusters: int = 4,
        dims: int = 8192) -> Model:
    """Learns from rows with a label; ``dims`` is a power of two.

    The driver gets ``dims`` frequencies, ``clusters`` centroids and a histogram of cosines per language, whatever the
    number of rows.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(dims, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = counts(t, dims)
                if found is not None:
                    seen += found > 0
                    total += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.append([total], seen))],
                                         names=["dim", "n"])

    summed = rows.select("text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    known = {r["dim"]: r["n"] for r in summed.collect()}
    total = known.pop(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + known.get(i, 0))) + 1 for i in range(dims)], np.float32)

    # The sample: the texts with the smallest hashes of each language, each distinct text once. Counts per leading
    # bits of the hash (at most 2^16 per language) tell how far to look, so that no task meets a whole language.
    hashes = rows.select("label", F.xxhash64("text").alias("order")).distinct().withColumn(
        "lead", F.shiftright("order", 48))
    upto = F.sum("n").over(W.partitionBy("label").orderBy("lead"))
    reached = hashes.groupBy("label", "lead").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    far = reached.groupBy("label").agg(F.coalesce(
        F.min(F.when(F.col("upto") >= per_language, F.col("lead"))), F.max("lead")).alias("far"))
    near = hashes.join(F.broadcast(far), "label").where(F.col("lead") <= F.col("far"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("order")))
    bounds = ranked.where(F.col("rank") <= per_language).groupBy("label").agg(F.max("order").alias("bound"))
    sample = rows.withColumn("order", F.xxhash64("text")).join(F.broadcast(bounds), "label").where(
        F.col("order") <= F.col("bound")).dropDuplicates(["label", "order"])
    plain = Model(idf, [], np.zeros((0, dims), np.float32), np.zeros((0, _BANDS)))

    def cluster(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("order")
        texts = part["text"].to_pylist()
        vectors, some, _ = plain.vectors(texts)
        if not some.any():
            return pa.table({"label": pa.array([], pa.string()), "centroid": pa.array([], pa.binary())})
        if not some.all():
            vectors = vectors[some]
        centroids, _ = spherical_kmeans(vectors, clusters)
        return pa.table({"label": pa.array([key[0].as_py()] * len(centroids), pa.string()),
                         "centroid": pa.array([c.tobytes() for c in centroids], pa.binary())})

    learned = sorted(sample.groupBy("label").applyInArrow(cluster, "label string, centroid binary").collect(),
                     key=lambda r: (r["label"], r["centroid"]))
    languages = [r["label"] for r in learned]
    centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in learned], np.float32).reshape(-1, dims)
    if not languages:
        return plain
    names = sorted(set(languages))
    number = np.array([names.index(x) for x in languages])

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(names), _BANDS, _STEPS + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = np.array([names.index(x) if x in names else -1 for x in part.column(0).to_pylist()], np.int64)
                vectors, some, band = plain.vectors(part.column(1).to_pylist())
                cosine = np.where(number[None, :] == own[:, None], vectors @ centroids.T, 0).max(axis=1)
                step = (np.clip(cosine, 0, 1) * _STEPS).astype(np.int64)
                use = some & (own >= 0)
                np.add.at(found, (own[use], band[use], step[use]), 1)
        at = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in at), pa.array(found[at])],
                                         names=["language", "band", "step", "n"])

    # At most languages x bands x steps rows, whatever the number of texts.
    histogram = np.zeros((len(names), _BANDS, _STEPS + 1), np.int64)
    for r in rows.mapInArrow(cosines, "language long, band long, step long, n long").groupBy(
            "language", "band", "step").agg(F.sum("n").alias("n")).collect():
        histogram[r["language"], r["band"], r["step"]] = r["n"]
    return Model(idf, languages, centroids, low_cosines(histogram)[number])


def low_cosines(histogram: np.ndarray, part: float = 0.003, least: int = 100) -> np.ndarray:
    """By language and band, the cosine that all but ``part`` of the counted texts reach.

    Bands with fewer than ``least`` texts take in their neighbours, as far as needed.
    """
    out = np.zeros(histogram.shape[:2])
    for k, counted in enumerate(histogram):
        for band in range(len(counted)):
            reach = 0
            while (own := counted[max(0, band - reach):band + reach + 1].sum(axis=0)).sum() < least and (
                    reach < len(counted)):
                reach += 1
            if own.any():
                out[k, band] = np.searchsorted(np.cumsum(own), part * own.sum(), side="right") / _STEPS
    return out


def classify(docs: DataFrame, model: Model, text: str = "text", slack: float = 0.5,
             keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and rejected."""
    chosen = docs.select(*keep, F.col(text).alias("__text"))
    kept = chosen.columns[:-1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        language, score, rejected = model.predict(batch.column(len(kept)).to_pylist(), slack)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(language, pa.string()), pa.array(score, pa.float64()),
             pa.array(rejected, pa.bool_())], names=[*kept, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_arrow(chosen, run, f"{kinds}, lang_pred string, score double, rejected boolean", rows=256)


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept out of learning: crc32 of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(id_column))


def keep_known(docs: DataFrame, model: Model, text: str = "text", slack: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, all columns as they are."""
    mark = free_name(docs, "own_refused")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rejected = model.predict(batch.column(batch.schema.get_field_index(text)).to_pylist(), slack)[2]
        return batch.append_column(mark, pa.array(rejected, pa.bool_()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, run, f"{kinds}, `{mark}` boolean", rows=256).where(~F.col(mark)).drop(mark)
