"""Merkle mountain ranges over hash chains: heads that grow with a batch and proofs of single records.

Record number n of a chain is leaf n - 1. A node of level k covers 2^k leaves that stand side by side; it exists once all
of them do. A chain of n records has one peak per 1 in the binary form of n, the full trees from left to right, and its
root is the peaks folded from the right together with n. Appending never changes a node, so the peaks (at most 63 rows a
chain) and the new records are all it takes to get the new nodes and the new root, and a record is proved by the sibling
at each level up to its peak and by the other peaks: rows in proportion to the logarithm of the chain.

Nodes are built ``_BITS`` levels at a time: new nodes and the peaks to their left are grouped by the tree they fall into,
and a fold over the levels pairs them up inside the JVM. A group holds at most 2^_BITS rows whatever the length of a
chain, so a host with a third of all records is spread like any other; ten million records take three shuffles, of which
the second has one row in 512.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from argosift.session import cut

_BITS = 9
_NODES = "array<struct<idx:bigint,hash:string>>"
_OUT = "array<struct<level:int,idx:bigint,hash:string>>"


def leaf_hash(seq: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf:"), seq.cast("string"), F.lit(":"), content), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("node:"), left, F.lit(":"), right), 256)


def _let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _parents(nodes: Column) -> Column:
    """Parents of the neighbours among nodes of one level, which are sorted and without gaps."""
    pairs = F.transform(nodes, lambda x, i: F.struct(
        F.shiftright(x["idx"], 1).alias("idx"),
        F.when(x["idx"] % 2 == 0, node_hash(x["hash"], F.get(nodes, i + 1)["hash"])).alias("hash")))
    return F.filter(pairs, lambda p: p["hash"].isNotNull()).cast(_NODES)


def _tier(new: DataFrame, peaks: DataFrame | None, base: int, chain: str, only_peaks: bool) -> DataFrame:
    """Nodes of the levels above ``base``, up to ``base + _BITS``, that new nodes of level ``base`` complete.

    With ``only_peaks``, of each level from ``base`` on only the last node without a neighbour, and all of the top level.
    """
    own = new.select(chain, F.shiftright("idx", _BITS).alias("tree"), F.lit(base).alias("level"), "idx", "hash")
    if peaks is not None:
        inside = peaks.where(F.col("level").between(base, base + _BITS - 1))
        tree = F.expr(f"shiftright(idx, {base + _BITS} - level)")
        own = own.unionByName(inside.select(chain, tree.alias("tree"), "level", "idx", "hash"))
    lowest = F.col("level") == base
    packed = own.groupBy(chain, "tree").agg(
        F.sort_array(F.collect_list(F.when(lowest, F.struct("idx", "hash")))).cast(_NODES).alias("_low"),
        F.collect_list(F.when(~lowest, F.struct("level", "idx", "hash"))).alias("_high"))

    def at_level(nodes: Column, level: Column) -> Column:
        return F.transform(nodes, lambda p: F.struct(level.cast("int").alias("level"), p["idx"].alias("idx"),
                                                     p["hash"].alias("hash")))

    def climb(acc: Column, step: Column) -> Column:
        here = F.transform(F.filter("_high", lambda r: (r["level"] == step + base)), lambda r: F.struct(
            r["idx"].alias("idx"), r["hash"].alias("hash"))).cast(_NODES)

        def kept(cur: Column, up: Column) -> Column:
            if not only_peaks:
                return at_level(up, step + base + 1)
            alone = F.filter(F.slice(cur, -1, 1), lambda p: p["idx"] % 2 == 0)
            top = F.when(step == _BITS - 1, up).otherwise(F.array().cast(_NODES))
            return F.concat(at_level(alone, step + base), at_level(top, step + base + 1))

        # A peak stands to the left of what the batch has added at its level.
        return _let(F.concat(here, acc["up"]), lambda cur: _let(_parents(cur), lambda up: F.struct(
            up.alias("up"), F.concat(acc["out"], kept(cur, up)).cast(_OUT).alias("out"))))

    start = F.struct(F.col("_low").alias("up"), F.array().cast(_OUT).alias("out"))
    folded = F.aggregate(F.sequence(F.lit(0), F.lit(_BITS - 1)), start, climb, lambda acc: acc["out"])
    return packed.select(chain, F.inline(folded))


def grow(records: DataFrame, chain: str = "host_id", seq: str = "sequence_number", content: str = "content_hash",
         peaks: DataFrame | None = None, store: Callable[[DataFrame], DataFrame] = cut,
         only_peaks: bool = False) -> DataFrame:
    """The nodes (chain, level, idx, hash) that new records add, leaves included.

    ``records`` continue each chain without gaps; ``peaks`` are the nodes of :func:`peaks_of` before them. Each part of
    the nodes is written once, by ``store``, which gives rows to continue from that include the part. With
    ``only_peaks`` the result holds every peak of the grown chains that is not among ``peaks`` and few other nodes; it
    may have a node twice, and the leaves are not written.
    """
    at = F.col(seq).cast("long")
    leaves = records.select(chain, F.lit(0).alias("level"), (at - 1).alias("idx"), leaf_hash(at, F.col(content)).alias(
        "hash"))
    nodes = level = leaves if only_peaks else store(leaves).where("level = 0")
    longest, base = records.agg(F.max(at)).first()[0], 0
    while longest is not None and longest >> base > 1:
        found = store(_tier(level, peaks, base, chain, only_peaks))
        if only_peaks:
            nodes = nodes.unionByName(found) if base else found
        else:
            found = found.where(F.col("level").between(base + 1, base + _BITS))
            nodes = nodes.unionByName(found)
        base += _BITS
        level = found.where(F.col("level") == base)
    return nodes


def sizes(records: DataFrame, chain: str = "host_id", seq: str = "sequence_number") -> DataFrame:
    return records.groupBy(chain).agg(F.max(seq).cast("long").alias("last_sequence"))


def peaks_of(nodes: DataFrame, lengths: DataFrame, chain: str = "host_id", last: str = "last_sequence") -> DataFrame:
    """The peaks (chain, level, idx, hash) of chains with the given numbers of records."""
    joined = nodes.join(lengths.select(chain, F.col(last).alias("_n")), chain)
    place = F.expr("shiftright(_n, level)")
    return joined.where((place % 2 == 1) & (F.col("idx") == place - 1)).select(chain, "level", "idx", "hash")


def roots(peaks: DataFrame, lengths: DataFrame, chain: str = "host_id", last: str = "last_sequence") -> DataFrame:
    """Rows (chain, last_sequence, peaks, root)."""
    listed = peaks.groupBy(chain).agg(F.array_sort(F.collect_list(F.struct("level", "idx", "hash"))).alias("peaks"))
    return lengths.select(chain, F.col(last)).join(listed, chain).withColumn("root", _root(F.col(last), F.col("peaks")))


def _root(n: Column, peaks: Column) -> Column:
    """The peaks, lowest first, folded and bound to the number of records."""
    hashes = F.transform(peaks, lambda p: p["hash"])
    folded = F.aggregate(F.slice(hashes, 2, F.lit(64)), F.element_at(hashes, 1), lambda acc, h: node_hash(h, acc))
    return F.sha2(F.concat(F.lit("root:"), n.cast("string"), F.lit(":"), folded), 256)


def exploded_peaks(heads: DataFrame, chain: str = "host_id") -> DataFrame:
    """Peak rows of head rows with a ``peaks`` array."""
    return heads.select(chain, F.inline("peaks"))


def advance(heads: DataFrame | None, batch: DataFrame, chain: str = "host_id", seq: str = "sequence_number",
            content: str = "content_hash", store: Callable[[DataFrame], DataFrame] = cut,
            only_peaks: bool = False) -> tuple[DataFrame, DataFrame]:
    """New nodes and the heads after a batch of linked records; reads the batch and the heads only.

    ``store`` and ``only_peaks`` are those of :func:`grow`.
    """
    old = None if heads is None else cut(exploded_peaks(heads, chain))
    nodes = grow(batch, chain, seq, content, old, store, only_peaks)
    grown = sizes(batch, chain, seq)
    known = nodes if old is None else nodes.unionByName(old)
    tops = peaks_of(known, grown, chain)
    if only_peaks:
        tops = tops.dropDuplicates([chain, "level", "idx"])
    return nodes, roots(tops, grown, chain)


def audit_growth(before: DataFrame | None, batch: DataFrame, after: DataFrame, chain: str = "host_id",
                 seq: str = "sequence_number", content: str = "content_hash") -> DataFrame:
    """Per chain of the batch, whether the new head follows from the old one and the batch: (chain, grown_valid).

    A chain whose earlier part was rewritten, whose batch has a gap or whose stored root is another is not valid.
    """
    _, now = advance(before, batch, chain, seq, content, only_peaks=True)
    start = F.coalesce("_before", F.lit(0).cast("long"))
    lengths = batch.groupBy(chain).agg(F.count(F.lit(1)).alias("_rows"), F.min(seq).alias("_first"),
                                       F.max(seq).alias("_last"), F.count_distinct(seq).alias("_numbers"))
    old = (lengths.select(chain, F.lit(None).cast("long").alias("_before")) if before is None else
           before.select(chain, F.col("last_sequence").alias("_before")))
    shown = after.select(chain, F.col("root").alias("_root"), F.col("last_sequence").alias("_to"))
    whole = (F.col("_first") == start + 1) & (F.col("_last") == start + F.col("_rows")) & (
        F.col("_numbers") == F.col("_rows"))
    joined = lengths.join(old, chain, "left").join(now.select(chain, "root"), chain, "left").join(shown, chain, "left")
    valid = whole & (F.col("root") == F.col("_root")) & (F.col("_to") == F.col("_last"))
    return joined.select(chain, F.coalesce(valid, F.lit(False)).alias("grown_valid"))


# --- proofs ---------------------------------------------------------------------------------------

def proofs(requests: DataFrame, nodes: DataFrame, heads: DataFrame, chain: str = "host_id",
           seq: str = "sequence_number") -> DataFrame:
    """Adds ``path`` (siblings from the leaf upwards) and ``peaks`` to rows that name a record by chain and number.

    A request is turned into the keys of the nodes that it needs, so the node table is met by equality and never read
    for a whole chain. Numbers beyond the chain have no path.
    """
    keyed = requests.join(heads.select(chain, F.col("last_sequence").alias("_n"), "peaks"), chain, "left")
    leaf = F.col(seq).cast("long") - 1
    # The peak over a leaf stands at the highest binary place in which leaf and number of records differ.
    differ = F.length(F.bin(F.col("_leaf").bitwiseXOR(F.col("_n")))) - 1
    placed = cut(keyed.withColumn("_leaf", leaf).withColumn("_top", F.when(
        F.col("_leaf").between(0, F.col("_n") - 1), differ)).withColumn("_row", F.monotonically_increasing_id()))
    steps = placed.where(F.col("_top") > 0).select(
        "_row", chain, "_leaf", F.explode(F.sequence(F.lit(0), F.col("_top") - 1)).alias("level"))
    keys = steps.select("_row", chain, "level", F.expr("shiftright(_leaf, level) ^ 1").alias("idx"))
    met = keys.join(nodes.select(chain, "level", "idx", "hash"), [chain, "level", "idx"])
    paths = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("level", "idx", "hash"))).alias("path"))
    return placed.join(paths, "_row", "left").withColumn("path", F.coalesce(
        "path", F.when(F.col("_top") == 0, F.array().cast(_OUT)))).drop("_row", "_leaf", "_top", "_n")


def proved(rows: DataFrame, heads: DataFrame, chain: str = "host_id", seq: str = "sequence_number",
           content: str = "content_hash") -> DataFrame:
    """Adds ``proved``: whether the record's own hash, its path and the other peaks give the stored root."""
    at = F.col(seq).cast("long")
    climbed = F.aggregate("path", leaf_hash(at, F.col(content)), lambda acc, p: F.when(
        p["idx"] % 2 == 1, node_hash(acc, p["hash"])).otherwise(node_hash(p["hash"], acc)))
    stored = heads.select(chain, F.col("root").alias("_root"), F.col("last_sequence").alias("_n"))
    level = F.size("path")
    # The peak of the record's own tree is replaced by what its path gives.
    own = F.transform("peaks", lambda p: F.struct(p["level"].alias("level"), p["idx"].alias("idx"), F.when(
        p["level"] == level, climbed).otherwise(p["hash"]).alias("hash")))
    under = F.exists("peaks", lambda p: (p["level"] == level) & (F.expr(f"shiftright({seq} - 1, size(path))") == p["idx"]))
    good = under & (_root(F.col("_n"), own) == F.col("_root"))
    return rows.join(stored, chain, "left").withColumn("proved", F.coalesce(good, F.lit(False))).drop("_root", "_n")
