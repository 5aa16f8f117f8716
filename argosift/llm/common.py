"""Word splitting, vectorised substring hashes, names and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from argosift.session import cut, small_batches

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without_spaces(text: str | Column) -> Column:
    """Text with every run of ASCII white space as one space; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
              rows: int = 512) -> DataFrame:
    """``mapInArrow`` with a function of one batch; batches are cut small because texts may be long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["pow"]) < n:
        size = max(n, 2 * len(_tables["pow"]), 1 << 16)
        for name, base in (("pow", _BASE), ("inv", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


class Words:
    """Words of one text, joined by one space, with constant-time hashes of word runs.

    ``data`` is the UTF-8 text, ``starts`` and ``ends`` are byte offsets of the words.
    """

    def __init__(self, text: str | bytes | None):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
        self.data = b" ".join(raw.split())
        self._bytes = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(self._bytes == 32)
        if self.data:
            self.starts = np.concatenate(([0], gaps + 1))
            self.ends = np.concatenate((gaps, [len(self.data)]))
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs of words ``first`` to ``last``, both included."""
        pow_, inv = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[self._bytes] * pow_[:len(self.data)], out=self._sums[1:])
        a, b = self.starts[first], self.ends[last]
        return mix((self._sums[b] - self._sums[a]) * inv[a])

    def run(self, first: int, last: int) -> bytes:
        return self.data[self.starts[first]:self.ends[last]]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge table as (node, root) rows; ``root`` is one node of each component.

    Nodes are ordered by a hash. Every round moves each node to the smallest of itself and its neighbours and
    contracts the edges: a star is done in two rounds, and any graph, long chains included, shrinks by a constant
    factor in expectation, as the order has nothing to do with the graph. Rounds write their mapping as a table; the
    mappings are then composed. Only edge counts reach the driver.
    """
    rest = cut(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    moves = []

    def ranked(c: str) -> Column:
        return F.struct(F.xxhash64(F.col(c)), F.col(c).alias("node"))

    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("node"), ranked("b").alias("to")).union(
            rest.select(F.col("b").alias("node"), ranked("a").alias("to")))
        best = both.groupBy("node").agg(F.min("to").alias("to"))
        move = cut(best.select("node", F.least("to", ranked("node"))["node"].alias("root")))
        moves.append(move)
        left = rest.join(move.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        both_moved = left.join(move.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        rest = cut(both_moved.where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not moves:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tree = moves[-1]
    for move in reversed(moves[:-1]):
        upper = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
        tree = move.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return tree
