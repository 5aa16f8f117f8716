"""Near copies by SimHash groups that are checked exactly, completed by an exact set-similarity join.

Two texts are linked if the Jaccard likeness of their sets of ``words``-word shingles is at least ``percent`` / 100;
the components of these links are the groups. Shingles are compared by 64-bit hashes.

Prefix filter: let all shingles have one order. Two sets of likeness t share a shingle among the first
n - ceil(t n) + 1 of each, so equality joins on these prefixes meet every linked pair; no link is left to chance, as it
would be with fingerprints. The order puts shingles that are frequent in a bounded sample of documents last, so common
passages rarely get into a prefix. The sample shapes the order only; any order gives the same links.

Equal sets are merged first. SimHash (``simhash_dedup``: majority fingerprints of the same shingles, vantage-point
trees, components of links within 4 bits) gives the first groups; each member is compared with the leader of its group.
A likeness of 0.8 is about 10 differing bits, so fingerprints miss links and the join completes them. Documents that
share a prefix shingle are compared with one leader of the shingle, in two rounds: first with the one that has the fewest
shingles before it, as the least edited member of a group is alike to most others, then with one at random. Then all
pairs that are still in different groups are compared if their positions allow a link: shingles before the first that
both have are not shared, so these count as differences. So a large group of near copies gives a few rows a document.
Bitmaps of parities bound the difference of two sets from below and drop most other pairs: first 1,024 bits a set, then
at least a bit a shingle, which tells long texts apart. The rest are counted on the whole sets, so every link is exact.

Defined cases: null, empty and white-space texts have the empty set and are one group; fewer words than a shingle give
one shingle of them all; null ids are larger than any other; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from argosift.llm import simhash_dedup
from argosift.llm.common import Words, components, free_name, map_arrow
from argosift.session import cut

_BITS = [f"b{i}" for i in range(16)]  # parities: bit k tells whether an odd number of shingles falls on k
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles of a text."""
    own = Words((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(own):
        return np.zeros(0, np.uint64)
    first = np.arange(max(1, len(own) - words + 1))
    return np.unique(own.hashes(first, np.minimum(first + words, len(own)) - 1))


def parities(own: np.ndarray) -> np.ndarray:
    """1,024 parities of a set of hashes as 16 words."""
    odd = np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fine_parities(own: np.ndarray) -> bytes:
    """Parities of a set of hashes, a power of two of them and at least one a hash; halves xored give half as many."""
    many = 1 << max(6, len(own).bit_length())
    odd = np.bincount((own & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """How many hashes two sets with these :func:`fine_parities` differ in at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows (key, shingles) of rows (key, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [shingles(t, words) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(values)], names=["key", "shingles"])

    return map_arrow(docs, run, "key long, shingles array<long>", rows=128)


def _frequent(docs: DataFrame, text: str, words: int, sample_rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` shingles that occur most often in a sample of documents, sorted, and their counts."""
    every = max(1, docs.count() // sample_rows)
    sample = docs.select(F.xxhash64(text).alias("key"), text).where(F.pmod("key", F.lit(every)) == 0)
    counted = _sets(sample, words).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("s").alias("n"))
    top = counted.where("n > 3").orderBy(F.desc("n"), "s").limit(most).collect()
    values, n = np.array([r["s"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(values)
    return values[order], n[order]


def _nodes(docs: DataFrame, id_column: str, text: str, words: int, percent: int,
           frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (doc_id, text_hash, key, n, prefix, fp, fine) and the parities; ``key`` is a hash of the whole set, ``n`` its
    size, ``fp`` its SimHash."""
    common, often = frequent

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, prefixes, bits, prints, fine = [], [], [], [], [], []
        for t in batch.column(2).to_pylist():
            own = shingles(t, words)
            keys.append(xxhash.xxh64_intdigest(own.tobytes()))
            sizes.append(len(own))
            bits.append(parities(own))
            prints.append(simhash_dedup.fingerprint(t, words))
            fine.append(fine_parities(own))
            rank = np.zeros(len(own), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                rank = np.where(common[at] == own, often[at], 0)
            prefixes.append(own[np.lexsort((own, rank))[:len(own) + (-percent * len(own) // 100) + 1]])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)),
             pa.array(sizes, pa.int32()), _lists(prefixes), pa.array(np.array(prints, np.uint64).view(np.int64)),
             pa.array(fine, pa.binary()), *(pa.array(x) for x in np.array(bits).T.copy())],
            names=["doc_id", "text_hash", "key", "n", "prefix", "fp", "fine", *_BITS])

    chosen = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return map_arrow(chosen, run, f"doc_id {kind}, text_hash long, key long, n int, prefix array<long>, "
                     "fp long, fine binary, "
                     + ", ".join(f"{b} long" for b in _BITS), rows=128)


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Rows (a, na, b, nb): every set of a SimHash group and the leader of the group."""
    sets = cut(nodes.select("key", "n", "fp").distinct())
    grouped = simhash_dedup.link_edges(cut(sets.select("fp").distinct()))
    roots = components(grouped, "a", "b").withColumnRenamed("node", "fp")
    placed = cut(sets.join(roots, "fp", "left").select("key", "n", F.coalesce("root", "fp").alias("group")))
    leaders = placed.groupBy("group").agg(F.min(F.struct("key", "n")).alias("led"))
    return placed.join(leaders, "group").where(F.col("key") != F.col("led.key")).select(
        F.col("key").alias("a"), F.col("n").alias("na"), F.col("led.key").alias("b"), F.col("led.n").alias("nb"))


def _few(apart: Column, na: Column, nb: Column, percent: int) -> Column:
    """Sets of likeness t differ in at most (1 - t) / (1 + t) of their sizes' sum."""
    return apart * (100 + percent) <= (na + nb) * (100 - percent)


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (a, na, ra, b, nb, rb) of the pairs that share a shingle, are in different groups and may be linked.

    ``rows`` are (shingle, pos, key, n, root). A pair's first common shingle has nothing common before it, so it differs
    in as many shingles as stand before that one, and behind it in as many as one has more than the other. The join is
    by shingle and position, so it meets only pairs whose positions add up to little enough. Members of the group of
    a shingle's first row, which is mostly the largest, are met by the others only.
    """
    place = W.partitionBy("shingle")
    first = F.min(F.struct("pos", "key", "root")).over(place)
    rows = cut(rows.withColumn("main", first["root"]).withColumn("places", F.collect_set("pos").over(place)))
    right = rows.select("shingle", F.col("pos").alias("pb"), F.col("key").alias("b"), F.col("n").alias("nb"),
                        F.col("root").alias("rb"))
    left = rows.where("root <> main").select(
        "shingle", "main", F.col("pos").alias("pa"), F.col("key").alias("a"), F.col("n").alias("na"),
        F.col("root").alias("ra"), F.explode("places").alias("pb"))
    # The same bound for the largest set that this one can be linked with.
    left = left.where((F.col("pa") + F.col("pb")) * percent <= F.col("na") * (100 - percent))
    apart = F.col("pa") + F.col("pb") + F.abs(F.col("na") - F.col("pa") - F.col("nb") + F.col("pb"))
    return left.join(right, ["shingle", "pb"]).where(
        (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b")))
        & _few(apart, F.col("na"), F.col("nb"), percent)).select("a", "na", "ra", "b", "nb", "rb")


def _links(docs: DataFrame, nodes: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Rows (node, root): the group of every set that has a link."""
    place = W.partitionBy("shingle")
    prefixes = nodes.select("key", "n", F.posexplode("prefix").alias("pos", "shingle"))
    shared = cut(prefixes.withColumn("of", F.count(F.lit(1)).over(place)).where("of > 1").drop("of").distinct())
    bitmaps = cut(nodes.join(shared.select("key").distinct(), "key", "left_semi").groupBy("key").agg(
        F.min("text_hash").alias("text_hash"), F.min("n").alias("n"), F.min("fine").alias("fine"),
        *(F.min(b).alias(b) for b in _BITS)))

    def not_far(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, na, nb, fa, fb = (c.to_pylist() for c in batch.columns)
        near = [least_difference(x, y) * (100 + percent) <= (m + n) * (100 - percent)
                for x, y, m, n in zip(fa, fb, na, nb)]
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def linked(batch: pa.RecordBatch) -> pa.RecordBatch:
        near, known = [], (None, None)
        for x, b, y in zip(*(batch.column(c).to_pylist() for c in ("ta", "b", "tb"))):
            # Rows of one leader mostly stand together.
            known = known if known[0] == b else (b, shingles(y, words))
            own, other = shingles(x, words), known[1]
            met = len(np.intersect1d(own, other, assume_unique=True))
            near.append(met * 100 >= (len(own) + len(other) - met) * percent)
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are alike."""
        x, y = (bitmaps.select(F.col("key").alias(k), F.struct("n", *_BITS).alias(f"of_{k}")) for k in ("a", "b"))
        apart = sum((F.bit_count(F.col(f"of_a.{b}").bitwiseXOR(F.col(f"of_b.{b}"))) for b in _BITS), F.lit(0))
        near = _few(apart, F.col("of_a.n"), F.col("of_b.n"), percent)
        close = cut(pairs.join(x, "a").join(y, "b").where(near).select("a", "b"))
        fa, fb = (bitmaps.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("fine").alias(f"f{k}"))
                  for k in ("a", "b"))
        close = cut(map_arrow(close.join(fa, "a").join(fb, "b").select("a", "b", "na", "nb", "fa", "fb"), not_far,
                              "a long, b long", rows=4096))
        keys = close.select(F.col("a").alias("key")).union(close.select(F.col("b").alias("key"))).distinct()
        wanted = cut(bitmaps.join(keys, "key", "left_semi").select("key", "text_hash"))
        texts = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(
            wanted, "text_hash").dropDuplicates(["key"])
        # Texts take less room in a shuffle than their sets.
        both = close.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(
            texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        return map_arrow(both.select("a", "b", "ta", "tb"), linked, "a long, b long", rows=128)

    edges, roots = None, None
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    def join_in(pairs: DataFrame) -> None:
        nonlocal edges, roots
        found = cut(alike(pairs.where(sized).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        edges = found if edges is None else edges.union(found)
        roots = cut(components(edges, "a", "b"))

    join_in(fingerprint_pairs(nodes))
    for order in (F.struct("pos", F.xxhash64("key", F.lit(1)).alias("h")),
                  F.struct(F.xxhash64("key", F.lit(2)).alias("h")), None):
        rows = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
            "root", F.coalesce("root", "key"))
        # Prefix shingles of one group only have nothing left to tell.
        rows = rows.withColumn("low", F.min("root").over(place)).withColumn("high", F.max("root").over(place)).where(
            "low <> high").drop("low", "high")
        if order is not None:
            led = F.min(F.struct(order.alias("order"), "key", "n", "root")).over(place)
            met = rows.withColumn("led", led).select(
                F.col("key").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("led.key").alias("b"),
                F.col("led.n").alias("nb"), F.col("led.root").alias("rb")).where("a <> b")
        else:
            met = _possible(rows, percent)
        join_in(met.where(F.col("ra") != F.col("rb")))
    return roots


def near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                sample_rows: int = 8192, most_frequent: int = 32768) -> DataFrame:
    """One row per input row: id, component_id, text_hash, kept."""
    frequent = _frequent(docs, text, words, sample_rows, most_frequent)
    rows = cut(_nodes(docs, id_column, text, words, percent, frequent))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    distinct = rows.groupBy("key").agg(F.min(order).alias("first"))
    roots = _links(docs, rows, text, words, percent)
    placed = cut(distinct.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "first", F.coalesce("root", "key").alias("root")))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    classes = placed.join(best, "root").select("key", "best")
    return rows.join(classes, "key").select(
        F.col("doc_id").alias(id_column), F.col("best.doc_id").alias("component_id"), "text_hash",
        (order == F.col("best")).alias("kept"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest id of each group, all columns as they are."""
    own = free_name(docs, "own_hash")
    groups = cut(near_groups(docs, id_column, text, **options).select(
        F.col(id_column).alias("group_id"), F.col("text_hash").alias("group_hash"), "kept"))
    keyed = docs.withColumn(own, F.xxhash64(text))

    def among(rows: DataFrame):
        return keyed[id_column].eqNullSafe(rows["group_id"]) & (keyed[own] == rows["group_hash"])

    # Rows that go and rows that repeat are few, so the others are not shuffled.
    dropped = cut(groups.where("not kept").select("group_id", "group_hash").distinct())
    again = cut(groups.where("kept").groupBy("group_id", "group_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if again.isEmpty():
        return keyed.join(dropped, among(dropped), "left_anti").select(*docs.columns)
    others = dropped.union(again.drop("n"))
    once = keyed.join(others, among(others), "left_anti")
    twice = keyed.join(again, among(again), "left_semi").dropDuplicates([id_column, own])
    return once.union(twice).select(*docs.columns)
