"""Isolation forest: trees are built in parallel from independent samples.

Every row of the table is dealt to trees by a hash, and each tree keeps a fixed
number of its rows. The work after the sampling depends on the forest size. All
draws are md5 values of names, so any engine can build the same trees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from argosift import constants as C
from argosift.session import cut

NODE_SCHEMA = ("source_type string, tree int, node int, feature int, split double, left int, right int, size int, "
               "psi int")


def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + C.EULER) - 2.0 * (n - 1) / n


def uniform(text: Column) -> Column:
    """A number in [0, 1) that is drawn by the text: 52 bits of its md5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def drawn(source: str, tree: int, node: int, what: str, seed: int) -> float:
    """The same draw in Python, for a node of a tree."""
    return int(hashlib.md5(f"{seed}|{source}|{tree}|{node}|{what}".encode()).hexdigest()[:13], 16) / float(1 << 52)


def tree_samples(df: DataFrame, features: Sequence[str], tie: str, trees: int, sample_rows: int,
                 seed: int) -> DataFrame:
    """Rows (source_type, tree, r, x): each tree's own sample, drawn from the whole table.

    A seeded hash deals every row to a number of trees that gives each tree about four times its sample (one tree
    in a large table, all trees in a small one); the rows with the smallest second hashes are the sample. Each task
    keeps at most ``sample_rows`` rows per tree before the shuffle.
    """
    vec = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    slim = df.select("source_type", F.col(tie).alias("row_id"), vec.alias("x"))
    wanted = F.ceil(F.lit(4 * sample_rows * trees) / F.count(F.lit(1))).cast("int")
    # One row per source type.
    shares = slim.groupBy("source_type").agg(F.least(wanted, F.lit(trees)).alias("m"))
    key = F.col("row_id").cast("string")
    first = F.floor(uniform(F.concat(F.lit(f"{seed}|"), key)) * trees)
    dealt = slim.join(F.broadcast(shares), "source_type").withColumn("i", F.explode(F.sequence(
        F.lit(0), F.col("m") - 1))).withColumn("tree", ((first + F.col("i")) % trees).cast("int"))
    dealt = dealt.withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("tree").cast("string"), F.lit("|"), key)))
    order = W.partitionBy("source_type", "tree").orderBy("h", "row_id")
    ranked = dealt.withColumn("r", F.row_number().over(order))
    return ranked.where(F.col("r") <= sample_rows).select("source_type", "tree", "r", "x")


def train(df: DataFrame, features: Sequence[str], tie: str = "event_id", trees: int = 100, sample_rows: int = 256,
          seed: int = 7) -> DataFrame:
    """Node table of one forest per source type, written to the checkpoint folder.

    ``df`` holds feature rows with ``source_type``, a column of a few fixed values. A model has at most
    ``2 * sample_rows`` nodes per tree, whatever the table's size.
    """
    sampled = tree_samples(df, features, tie, trees, sample_rows, seed)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        source, tree = pdf["source_type"].iloc[0], int(pdf["tree"].iloc[0])
        nodes = grow(np.stack(pdf["x"].to_numpy()), lambda node, what: drawn(source, tree, node, what, seed))
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "size"])
        return out.assign(source_type=source, tree=tree, psi=len(pdf))[
            ["source_type", "tree", "node", "feature", "split", "left", "right", "size", "psi"]]

    return cut(sampled.groupBy("source_type", "tree").applyInPandas(build, NODE_SCHEMA))


def grow(x: np.ndarray, draw: Callable[[int, str], float]) -> list[tuple]:
    """Nodes (id, feature, split, left, right, size) of one tree; leaves have feature -1.

    The root is node 1 and the children of node n are 2n and 2n + 1; ``draw(node, what)`` gives a number in [0, 1).
    """
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple] = []
    pending = [(1, x, 0)]
    while pending:
        node, rows, depth = pending.pop()
        feature = int(draw(node, "feature") * x.shape[1])
        low, high = (rows[:, feature].min(), rows[:, feature].max()) if len(rows) else (0.0, 0.0)
        split = float(low + draw(node, "split") * (high - low))
        if depth >= limit or len(rows) <= 1 or split <= low:
            nodes.append((node, -1, 0.0, -1, -1, len(rows)))
            continue
        goes_left = rows[:, feature] < split
        nodes.append((node, feature, split, 2 * node, 2 * node + 1, len(rows)))
        pending += [(2 * node, rows[goes_left], depth + 1), (2 * node + 1, rows[~goes_left], depth + 1)]
    return nodes


def _model_arrays(model: DataFrame) -> dict[str, dict]:
    """Node arrays per source type. A model's size is set by its trees and their samples, not by the data."""
    pdf = model.toPandas().sort_values(["source_type", "tree", "node"])
    forests = {}
    for source, part in pdf.groupby("source_type"):
        at = {key: i for i, key in enumerate(zip(part["tree"], part["node"]))}
        leaf = part["feature"].to_numpy() < 0
        forests[source] = {
            "roots": np.array([at[(t, 1)] for t in part["tree"].unique()]),
            "feature": np.where(leaf, 0, part["feature"]), "split": part["split"].to_numpy(),
            "left": np.array([at.get(key, i) for i, key in enumerate(zip(part["tree"], part["left"]))]),
            "right": np.array([at.get(key, i) for i, key in enumerate(zip(part["tree"], part["right"]))]),
            "leaf": leaf, "extra": np.array([average_path(s) for s in part["size"]]),
            "psi": int(part["psi"].max()),
        }
    return forests


def path_lengths(x: np.ndarray, forest: dict) -> np.ndarray:
    """Mean path length of each row over the trees of one forest."""
    at = np.repeat(forest["roots"][None, :], len(x), axis=0)
    depth = np.zeros(at.shape)
    rows = np.arange(len(x))[:, None]
    while True:
        inner = ~forest["leaf"][at]
        if not inner.any():
            break
        goes_left = x[rows, forest["feature"][at]] < forest["split"][at]
        at = np.where(goes_left, forest["left"][at], forest["right"][at])
        depth += inner
    return (depth + forest["extra"][at]).mean(axis=1)


def score(df: DataFrame, model: DataFrame, features: Sequence[str], normalizer: str = "sample") -> DataFrame:
    """Adds ``isolation_score`` = 2^(-E[path] / c(n)); 0 for source types without a forest.

    ``normalizer`` is ``sample`` for c of the tree sample size, or a row count to
    use instead.
    """
    forests = df.sparkSession.sparkContext.broadcast(_model_arrays(model))
    fixed = None if normalizer == "sample" else average_path(float(normalizer))

    @F.pandas_udf("double")
    def isolation(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = forests.value
        for sources, vectors in batches:
            out = np.zeros(len(sources))
            for source in sources.unique():
                if source not in known:
                    continue
                mask = (sources == source).to_numpy()
                norm = fixed or average_path(known[source]["psi"])
                if norm:
                    x = np.stack(vectors[mask].to_numpy())
                    out[mask] = np.power(2.0, -path_lengths(x, known[source]) / norm)
            yield pd.Series(out)

    vec = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return df.withColumn("isolation_score", isolation(F.col("source_type"), vec))
