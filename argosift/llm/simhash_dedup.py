"""Near-duplicates by 64-bit fingerprints, linked exactly with vantage-point trees.

A fingerprint is the bitwise majority of the XXH64 values of a document's word shingles. Equal fingerprints are
merged first, so a group of copies is one node. A vantage-point tree, fitted on a bounded sample of fingerprints,
splits Hamming space into shards: inner nodes hold a vantage point and a radius, and a fingerprint lives in one leaf.
By the triangle inequality a partner within ``distance`` bits can live beyond a radius only if the fingerprint is that
close to it, so each fingerprint also visits the leaves on the far side of every such boundary, and only those with a
higher number, which sees each pair once. Inside a shard a second tree prunes in the same way down to small leaves.
The sample shapes the tree only; every fingerprint is placed and every link within the distance is found.

Shards report each linked fingerprint with one representative, never pairs, so a large group of near copies gives as
many rows as it has fingerprints. Components are then contracted round by round.

Scale: vantage points prune weakly in 64 bits when documents are unrelated (distances crowd around 32), so a node is
visited on both sides by about two thirds of the fingerprints and the work grows as n^1.77. See the README.

Defined cases: null, empty and white-space texts have fingerprint zero and are linked like any other; fewer words
than a shingle give one shingle of them all; null ids are larger than any other; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from argosift.llm.common import components, free_name, map_arrow
from argosift.session import cut

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # bits of each byte value


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of the ``words``-word shingles of a text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends, at = [], -1
    for t in tokens:
        at += len(t) + 1
        ends.append(at)
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1:] or ends[-1:]
    first = [0] + [e + 1 for e in ends[:n - 1]]
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(joined[a:b], seed) for a, b in zip(first, last)], np.uint64)
    octets = values.astype("<u8").view(np.uint8).reshape(n, 8)
    result = 0
    for i in range(8):
        ones = np.bincount(octets[:, i], minlength=256) @ _BITS
        for j in np.flatnonzero(ones * 2 > n):
            result |= 1 << (8 * i + int(j))
    return result


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4,
                 seed: int = 42) -> DataFrame:
    """Rows (doc_id, text_hash, fp); ``fp`` is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, words, seed) for t in batch.column(2).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))],
                                          names=["doc_id", "text_hash", "fp"])

    chosen = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return map_arrow(chosen, run, f"doc_id {kind}, text_hash long, fp long")


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances."""
    return np.bitwise_count(a ^ b).astype(np.int16)


@dataclass
class Tree:
    """Vantage-point tree; negative children are leaves (leaf k is child -1 - k)."""

    vantage: list[int] = field(default_factory=list)
    radius: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)  # positions of the fitted points
    root: int = 0


def grow(points: np.ndarray, leaf_size: int) -> Tree:
    """Splits ``points`` at median distances until leaves have at most ``leaf_size`` points or cannot be split."""
    tree = Tree()

    def split(own: np.ndarray) -> int:
        best = None
        if len(own) > leaf_size:
            # Of a few spread candidates the one whose distances differ most prunes best.
            for candidate in own[:: max(1, len(own) // 5)][:5]:
                d = far(points[own], points[candidate])
                cut_at = int(np.sort(d)[(len(d) - 1) // 2])
                inner = d <= cut_at
                if not inner.all() and (best is None or d.std() > best[0]):
                    best = (d.std(), candidate, cut_at, inner)
        if best is None:
            tree.leaves.append(own)
            return -len(tree.leaves)
        node = len(tree.vantage)
        tree.vantage.append(int(points[best[1]]))
        tree.radius.append(best[2])
        tree.inside.append(0)
        tree.outside.append(0)
        tree.inside[node] = split(own[best[3]])
        tree.outside[node] = split(own[~best[3]])
        return node

    tree.root = split(np.arange(len(points)))
    return tree


def visits(tree: Tree, queries: np.ndarray, distance: int):
    """Yields (leaf, positions of the queries within ``distance`` of its region, whether each lives in it)."""
    stack = [(tree.root, np.arange(len(queries)), np.ones(len(queries), bool))]
    while stack:
        node, own, home = stack.pop()
        if not len(own):
            continue
        if node < 0:
            yield -1 - node, own, home
            continue
        d = far(queries[own], np.uint64(tree.vantage[node]))
        r = tree.radius[node]
        near_in, near_out = d - distance <= r, d + distance > r
        stack.append((tree.inside[node], own[near_in], (home & (d <= r))[near_in]))
        stack.append((tree.outside[node], own[near_out], (home & (d > r))[near_out]))


def local_groups(points: np.ndarray, targets: int, queries: np.ndarray, distance: int,
                 leaf_size: int = 256) -> np.ndarray:
    """Group label of every point: points[queries] are linked with points[:targets] within the distance."""
    label = np.arange(len(points))
    parent = list(range(len(points)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = grow(points[:targets], leaf_size)
    for leaf, own, _ in visits(tree, points[queries], distance):
        members = tree.leaves[leaf]
        step = max(1, (1 << 20) // max(1, len(members)))
        for at in range(0, len(own), step):
            chunk = queries[own[at:at + step]]
            i, j = np.nonzero(far(points[chunk][:, None], points[members][None, :]) <= distance)
            a, b = label[chunk[i]], label[members[j]]
            apart = a != b
            if not apart.any():
                continue
            pairs = np.unique(a[apart] * np.int64(len(points)) + b[apart])
            changed = set()
            for code in pairs.tolist():
                x, y = (find(v) for v in divmod(code, len(points)))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    changed.add(max(x, y))
            renamed = np.arange(len(points))
            touched = np.unique(np.concatenate((a[apart], b[apart], np.fromiter(changed, np.int64))))
            renamed[touched] = [find(v) for v in touched.tolist()]
            label = renamed[label]
    return np.array([find(v) for v in label.tolist()])


def link_edges(distinct: DataFrame, distance: int = 4, shard_rows: int = 16384, sample_rows: int = 4096,
               block_rows: int = 65536) -> DataFrame:
    """Rows (a, b) that connect fingerprints ``fp`` of ``distinct`` exactly as links within ``distance`` do.

    ``sample_rows`` bounds the sample that shapes the tree, ``shard_rows`` is the usual number of fingerprints in a
    leaf and ``block_rows`` the number of lookups one task does in it.
    """
    total = distinct.count()
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).select("fp").collect()]
    points = np.array(sample, np.int64).view(np.uint64)
    shards = max(16, -(-total // shard_rows))
    tree = grow(points, max(1, len(points) // shards))

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        home_leaf = np.zeros(len(values), np.int32)
        met = list(visits(tree, values, distance))
        for leaf, own, home in met:
            home_leaf[own[home]] = leaf
        # A pair in two leaves is found in the higher one.
        rows = [(leaf, own[keep]) for leaf, own, _ in met if (keep := home_leaf[own] <= leaf).any()]
        leaf = np.concatenate([np.full(len(own), k, np.int32) for k, own in rows])
        which = np.concatenate([own for _, own in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array(leaf), pa.array(values[which].view(np.int64)), pa.array(home_leaf[which] == leaf)],
            names=["leaf", "fp", "home"])

    routed = cut(map_arrow(distinct.select("fp"), route, "leaf int, fp long, home boolean", rows=1 << 16))
    # One row per leaf, as many as the sample allows; conditions nested by leaf would be too deep to plan.
    load = cut(routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts")))
    dealt = routed.join(F.broadcast(load), "leaf").withColumn(
        "own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    as_query = dealt.select("leaf", F.col("own").alias("block"), "fp", "home", F.lit(True).alias("query"))
    as_target = dealt.where("home and parts > 1").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), "fp", "home", "own"
    ).where("block <> own").select("leaf", "block", "fp", "home", F.lit(False).alias("query"))

    def search(key: tuple, part: pa.Table) -> pa.Table:
        # Targets first, so that positions below ``n`` are the fingerprints that live here.
        part = part.sort_by([("home", "descending"), ("fp", "ascending")])
        values = part["fp"].to_numpy()
        home, query = part["home"].to_numpy(), part["query"].to_numpy()
        label = local_groups(values.view(np.uint64), int(home.sum()), np.flatnonzero(query), distance)
        linked = label != np.arange(len(values))
        return pa.table({"a": values[linked], "b": values[label[linked]]})

    split = not load.where("parts > 1").isEmpty()
    tasks = as_query.union(as_target) if split else as_query
    return tasks.groupBy("leaf", "block").applyInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42,
                distance: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id, text_hash, kept."""
    rows = cut(fingerprints(docs, id_column, text, words, seed))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    distinct = cut(rows.groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(link_edges(distinct, distance), "a", "b")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    classes = placed.join(best, "root").select("fp", "best")
    return rows.join(classes, "fp").select(
        F.col("doc_id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"), "text_hash", (order == F.col("best")).alias("kept"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest id of each component, all columns as they are."""
    own = free_name(docs, "own_hash")
    kept = near_groups(docs, id_column, text, **options).where("kept").select(
        F.col(id_column).alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    keyed = docs.withColumn(own, F.xxhash64(text))
    same = keyed[id_column].eqNullSafe(kept["kept_id"]) & (keyed[own] == kept["kept_hash"])
    return keyed.join(kept, same, "left_semi").dropDuplicates([id_column, own]).select(*docs.columns)
