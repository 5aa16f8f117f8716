"""Hard negatives by exact inner products.

Vectors are rounded to integers, so every score is exact. A score is the inner product of an anchor and a candidate. An
anchor's positives are its best other rows of the same label; the negatives of a positive are the best rows of another
label whose score lies between ``low`` and ``high`` percent of the positive's.

Candidates are dealt by hash into blocks of at most about ``block_bytes``, anchors to every block. A task holds the
candidates of one block and streams the anchors past them in tiles. The scores of a tile are one matrix product, done by
Strassen's recursion on int64 matrices: sides are padded with zeros to even halves, seven products take the place of
eight, and below ``_LEAF`` the product is numpy's. Sums and differences of int64 are exact modulo 2^64, also between, so
the scores are exact whenever they fit; a tile whose scores might not fit is multiplied in integers of any length and
its scores are held to the range of a long.

Scores are never written. A task keeps, per anchor, the best ``positives`` rows of the label (first pass), then, per
anchor and positive, the best ``negatives`` rows inside the window (second pass). These heaps are merged over the parts
of a block in the task and over blocks by a window with a rank limit, which trims them before the shuffle as well. In the
first pass only rows of the anchor's label are multiplied.

Anchors are a stated query set; the work is their number times that of all rows. What is shuffled is the rows once and
the anchors once per block. No block depends on labels or ids, so a label with a third of all rows is spread evenly.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
different lengths are compared as if the shorter ended in zeros; rows with the anchor's own id are not its positives;
repeated rows count one by one, as anchors, positives and negatives; ties go to the smaller id; an anchor without
positives, and a positive without negatives, has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from argosift.session import cut

_LEAF = 24  # a side from which halving pays off
_TILE = 256  # anchors at a time
_PART = 8192  # candidates at a time
_TOP = 2**63 - 1


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = _LEAF) -> np.ndarray:
    """The product of two integer matrices."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        return strassen(_padded(a, n % 2, k % 2), _padded(b, k % 2, m % 2), leaf)[:n, :m]
    a11, a12, a21, a22 = _quarters(a)
    b11, b12, b21, b22 = _quarters(b)
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((n, m), a.dtype)
    out[:n // 2, :m // 2] = m1 + m4 - m5 + m7
    out[:n // 2, m // 2:] = m3 + m5
    out[n // 2:, :m // 2] = m2 + m4
    out[n // 2:, m // 2:] = m1 - m2 + m3 + m6
    return out


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return np.pad(x, ((0, rows), (0, columns))) if rows or columns else x


def _quarters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r, c = x.shape[0] // 2, x.shape[1] // 2
    return x[:r, :c], x[:r, c:], x[r:, :c], x[r:, c:]


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two int64 matrices, held to the range of a long."""
    width = max(anchors.shape[1], candidates.shape[1])
    a, c = (_padded(x, 0, width - x.shape[1]) for x in (anchors, candidates))
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), np.int64)
    most = [max(abs(int(x.min())), abs(int(x.max()))) for x in (a, c)]
    if most[0] * most[1] * width <= _TOP:
        return strassen(a, c.T)
    exact = strassen(a.astype(object), c.T.astype(object))
    return np.clip(exact, -_TOP, _TOP).astype(np.int64)


def _long(x: int) -> int:
    return max(-_TOP, min(_TOP, x))


def merged(one: list[tuple], other: list[tuple], size: int) -> list[tuple]:
    """The first ``size`` entries of two sorted lists of (-score, id)."""
    return sorted(one + other)[:size] if one and other else (one or other)[:size]


def _best(row: np.ndarray, ids: np.ndarray, size: int) -> list[tuple]:
    """The best ``size`` of a row of scores as (-score, id); ids are in ascending order."""
    kept = np.arange(len(row))
    if len(row) > size:
        kept = np.flatnonzero(row >= np.partition(row, len(row) - size)[len(row) - size])
    kept = kept[np.argsort(-row[kept], kind="stable")[:size]]
    return list(zip((-row[kept]).tolist(), ids[kept].tolist()))


def _inside(row: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], size: int) -> list[list[tuple]]:
    """Per window (least, most) the best ``size`` of a row of scores inside it; ids are in ascending order."""
    kept = np.flatnonzero((row >= min(w[0] for w in windows)) & (row <= max(w[1] for w in windows)))
    kept = kept[np.argsort(-row[kept], kind="stable")]
    falling = -row[kept]
    out = []
    for least, most in windows:
        first = int(np.searchsorted(falling, -most))
        last = min(first + size, int(np.searchsorted(falling, -least, side="right")))
        out.append(list(zip(falling[first:last].tolist(), ids[kept[first:last]].tolist())))
    return out


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of numbers as a matrix, short rows ending in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(ends - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _streamed(rows: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """Runs ``emit(candidates, anchors)`` for every tile of anchors of every block.

    ``rows`` are sorted by block, candidates first. Both arguments are tables; candidates of one block are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            keys = batch.column("block").to_numpy(zero_copy_only=False)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            for at, to in zip([0, *turns], [*turns, batch.num_rows]):
                if at == to:
                    continue
                if keys[at] != block:
                    block, held, ready = keys[at], [], None
                part = batch.slice(at, to - at)
                if kinds[at] == 0:
                    held.append(part)
                    continue
                if ready is None:
                    ready = _Candidates(held) if held else False
                    held = []
                for k in range(0, part.num_rows, _TILE):
                    if ready:
                        yield from emit(ready, part.slice(k, _TILE))

    return rows.mapInArrow(run, schema)


class _Candidates:
    """The candidates of a block in parts of one label each, ids ascending."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        vectors = _matrix(table.column("vector").chunk(0))
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        starts = np.flatnonzero(self.labels[1:] != self.labels[:-1]) + 1
        edges = [0, *starts.tolist(), len(order)]
        self.label_range = {label: (a, b) for label, a, b in zip(self.labels[edges[:-1]].tolist(), edges, edges[1:])}
        mixed = np.argsort(self.ids, kind="stable")
        self.parts = [mixed[k:k + _PART] for k in range(0, len(mixed), _PART)]


def _blocks(candidates: DataFrame, anchors: DataFrame, n_blocks: int) -> DataFrame:
    """Candidates in their block, anchors in all blocks, sorted by block and kind."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    own = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")
    left = candidates.withColumn("block", own).withColumn("kind", F.lit(0))
    right = anchors.withColumn("block", blocks).withColumn("kind", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartition(n_blocks, "block").sortWithinPartitions("block", "kind", "label")


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, size: int, rank: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= size)


def usable(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
           is_anchor: Column | None = None, scale: int = 256) -> DataFrame:
    """Rows (row, vec_id, label, vector, is_anchor) that take part, components as floor(scale * x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = rows.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    marked = F.lit(True) if is_anchor is None else F.coalesce(is_anchor, F.lit(False))
    return chosen.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"),
        F.col(label).alias("label"), marked.alias("is_anchor"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         block_bytes: int = 32 << 20) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows of :func:`usable`."""
    spark = rows.sparkSession
    rows = cut(rows)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    # Blocks are small enough for a task, and no fewer than the cores.
    n_blocks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n * 8 * max(1, width or 1) // block_bytes))
    candidates = rows.select("row", "vec_id", "label", "vector")
    anchors = rows.where("is_anchor").select("row", "vec_id", "label", "vector")

    def same_label(block: _Candidates, tile: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labels = tile.column("label").to_pylist()
        own = np.array(tile.column("vec_id").to_pylist(), np.int64)
        vectors = _matrix(tile.column("vector"))
        heaps: list[list[tuple]] = [[] for _ in labels]
        for label in set(labels) & set(block.label_range):
            at = np.flatnonzero([x == label for x in labels])
            first, last = block.label_range[label]
            for k in range(first, last, _PART):
                ids = block.ids[k:min(last, k + _PART)]
                found = scores(vectors[at], block.vectors[k:min(last, k + _PART)])
                for i, row in zip(at, found):
                    other = ids != own[i]
                    heaps[i] = merged(heaps[i], _best(row[other], ids[other], positives), positives)
        yield _rows(tile, [(i, []) for i in range(len(labels))], heaps, ["positive_score", "positive_id"], [])

    def in_windows(block: _Candidates, tile: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labels = np.array(tile.column("label").to_pylist())
        vectors = _matrix(tile.column("vector"))
        wanted = tile.column("positives").to_pylist()
        windows = [[(_long(-(-low * p["positive_score"] // 100)), _long(high * p["positive_score"] // 100)) for p in own]
                   for own in wanted]
        heaps: list[list[list[tuple]]] = [[[] for _ in own] for own in wanted]
        for part in block.parts:
            found = scores(vectors, block.vectors[part])
            for i, row in enumerate(found):
                other = block.labels[part] != labels[i]
                for j, best in enumerate(_inside(row[other], block.ids[part][other], windows[i], negatives)):
                    heaps[i][j] = merged(heaps[i][j], best, negatives)
        keys = [(i, [p["place"], p["positive_id"], p["positive_score"]]) for i, own in enumerate(wanted) for p in own]
        yield _rows(tile, keys, [h for own in heaps for h in own], ["negative_score", "negative_id"],
                    ["place", "positive_id", "positive_score"])

    kind = rows.schema["label"].dataType.simpleString()
    found = _streamed(_blocks(candidates, anchors, n_blocks), same_label, "row long, positive_score long, positive_id long")
    best = _first(found, ["row"], "positive_score", "positive_id", positives, "place")
    listed = best.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    armed = cut(anchors.join(listed, "row"))
    met = _streamed(_blocks(candidates, armed, n_blocks), in_windows,
                    "row long, place int, positive_id long, positive_score long, negative_score long, negative_id long")
    ranked = _first(met, ["row", "place"], "negative_score", "negative_id", negatives, "rank")
    names = armed.select("row", F.col("vec_id").alias("anchor_id"))
    return ranked.join(names, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                            "negative_score")


def _rows(tile: pa.RecordBatch, keys: list[tuple[int, list]], heaps: list[list[tuple]], names: list[str],
          key_names: list[str]) -> pa.RecordBatch:
    """One row per heap entry: the anchor's row, the heap's key and the entry."""
    own = tile.column("row").to_pylist()
    flat = [(own[i], *key, -score, other) for (i, key), heap in zip(keys, heaps) for score, other in heap]
    columns = list(zip(*flat)) if flat else [()] * (1 + len(key_names) + 2)
    types = [pa.int64(), *([pa.int32(), pa.int64(), pa.int64()][:len(key_names)]), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["row", *key_names, *names])
