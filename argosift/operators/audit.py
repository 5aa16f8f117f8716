"""Hash-chained audit tables and their comparison with the mutable table.

A chain is linked in fixed-size segments. Inside a segment every record hash
depends on the one before it; segment heads are linked the same way, level by
level, up to one head per chain. Any edit changes the head, yet segments are
built and verified in parallel and none is larger than ``segment_rows``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from argosift import constants as C
from argosift.functions import hashing as H, text as X
from argosift.operators.windows import number_rows

SEGMENT_ROWS = 512
LEVELS = 4
CONTENT_FIELDS = ["event_id", "ts", "source", "event_type", "severity", "host_id", "message"]


def event_hash(fields: Sequence[str] = CONTENT_FIELDS) -> Column:
    return H.content_hash(*[F.col(f) for f in fields])


def sequence(df: DataFrame, chain: str = "host_id", ts: str = "ts", tie: str = "event_id",
             heads: DataFrame | None = None) -> DataFrame:
    """Adds ``sequence_number`` per chain, continuing after the last number in ``heads``."""
    numbered = number_rows(df, [chain], ts, tie, "sequence_number")
    if heads is None:
        return numbered
    last = heads.select(chain, F.col("last_sequence").alias("_last"))
    joined = numbered.join(last, chain, "left")
    return joined.withColumn("sequence_number", F.col("sequence_number") + F.coalesce("_last", F.lit(0))).drop("_last")


def link_records(df: DataFrame, chain: str = "host_id", seq: str = "sequence_number", content: str = "content_hash",
                 record: str = "record_id", segment_rows: int = SEGMENT_ROWS,
                 heads: DataFrame | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Record links: chain, segment, sequence number, record, content, previous and chain hash, and columns ``also``.

    ``heads`` (chain, last_sequence, last_hash) continues the chains of an earlier batch.
    """
    seg = F.floor((F.col(seq) - 1) / F.lit(segment_rows)).cast("long")
    rows = df.select(chain, seg.alias("segment"), F.col(seq).alias("sequence_number"), record, content, *also)
    if heads is None:
        placed = rows.withColumn("_start", F.lit(None).cast("string"))
    else:
        open_seg = F.floor(F.col("last_sequence") / F.lit(segment_rows)).cast("long")
        inside = F.col("last_sequence") % segment_rows != 0
        start = heads.where(inside).select(chain, open_seg.alias("segment"), F.col("last_hash").alias("_start"))
        placed = rows.join(start, [chain, "segment"], "left")
    # The rows of a segment follow each other, so a task holds one hash and no segment.
    ordered = placed.repartition(chain, "segment").sortWithinPartitions(chain, "segment", "sequence_number", record, content)
    names = [chain, "segment", "sequence_number", record, content]
    first = hashlib.sha256(C.GENESIS.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = None, None
        for batch in batches:
            previous, hashes = [], []
            columns = (batch.column(c).to_pylist() for c in (chain, "segment", content, "_start"))
            for of, segment, value, begin in zip(*columns):
                if (of, segment) != here:
                    here, last = (of, segment), first if begin is None else begin
                previous.append(last)
                last = None if last is None or value is None else H.link_text(last, value)
                hashes.append(last)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(previous, pa.string()), pa.array(hashes, pa.string()),
                 *(batch.column(c) for c in also)], names=[*names, "previous_hash", "chain_hash", *also])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields} | {"previous_hash": "string", "chain_hash": "string"}
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "previous_hash", "chain_hash", *also]))


def segment_heads(links: DataFrame, chain: str = "host_id") -> DataFrame:
    """Last hash of every segment."""
    return links.groupBy(chain, "segment").agg(F.max_by("chain_hash", "sequence_number").alias("head"))


def chain_heads(links: DataFrame, chain: str = "host_id", segment_rows: int = SEGMENT_ROWS,
                levels: int = LEVELS) -> DataFrame:
    """One head per chain: segment heads linked in order, ``segment_rows`` at a time."""
    level = segment_heads(links, chain).select(chain, F.col("segment").alias("n"), "head")
    for i in range(levels):
        up = F.lit(0).cast("long") if i == levels - 1 else F.floor(F.col("n") / F.lit(segment_rows)).cast("long")
        packed = level.groupBy(chain, up.alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("n", "head"))).alias("_r"))
        head = F.aggregate("_r", H.genesis(), lambda acc, r: H.link(acc, r["head"]))
        level = packed.select(chain, F.col("up").alias("n"), head.alias("head"))
    sizes = links.groupBy(chain).agg(F.count(F.lit(1)).alias("records"), F.max("segment").alias("last_segment"))
    return level.drop("n").join(sizes, chain)


def last_links(links: DataFrame, chain: str = "host_id") -> DataFrame:
    """Per chain the last sequence number and hash: where the next batch continues."""
    return links.groupBy(chain).agg(F.max("sequence_number").alias("last_sequence"),
                                    F.max_by("chain_hash", "sequence_number").alias("last_hash"))


def check_links(links: DataFrame, chain: str = "host_id", content: str = "content_hash",
                payload_hash: Column | None = None) -> DataFrame:
    """Adds ``broken`` to every record link.

    A link is broken when its previous hash is not the hash before it (genesis at a
    segment start), when its hash does not follow from both, or, with
    ``payload_hash``, when the stored content hash no longer fits the payload.
    """
    w = W.partitionBy(chain, "segment").orderBy("sequence_number")
    expected = F.coalesce(F.lag("chain_hash").over(w), H.genesis())
    bad = ((F.col("previous_hash") != expected)
           | (F.col("chain_hash") != H.link(F.col("previous_hash"), F.col(content))))
    if payload_hash is not None:
        bad = bad | (payload_hash != F.col(content))
    return links.withColumn("broken", F.coalesce(bad, F.lit(True)))


def stored_heads(links: DataFrame, chain: str = "host_id", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Head rows (chain, last_sequence, root) to keep apart from the links, for a later ``verify``."""
    last = links.groupBy(chain).agg(F.max("sequence_number").alias("last_sequence"))
    return chain_heads(links, chain, segment_rows).select(chain, F.col("head").alias("root")).join(last, chain)


def gaps(links: DataFrame, chain: str = "host_id", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per chain the first sequence number that is missing or stands twice, found from counts per segment."""
    seg = F.floor((F.col("sequence_number") - 1) / F.lit(segment_rows)).cast("long")
    w = W.partitionBy(chain, "_seg").orderBy("sequence_number")
    expected = F.coalesce(F.lag("sequence_number").over(w) + 1, F.col("_seg") * segment_rows + 1)
    odd = links.select(chain, "sequence_number", seg.alias("_seg")).withColumn("_want", expected)
    inside = odd.groupBy(chain, "_seg").agg(
        F.min(F.when(F.col("_want") != F.col("sequence_number"), F.least("_want", "sequence_number"))).alias("gap"),
        F.max("sequence_number").alias("last"))
    # One row per segment: a segment must be full and be followed by the next one, but for the last of a chain.
    by_chain = W.partitionBy(chain).orderBy("_seg")
    following = F.lead("_seg").over(by_chain)
    short = F.when(following.isNotNull() & (F.col("last") != (F.col("_seg") + 1) * segment_rows), F.col("last") + 1)
    skipped = F.when(following.isNotNull() & (following != F.col("_seg") + 1), (F.col("_seg") + 1) * segment_rows + 1)
    begins = F.when(F.lag("_seg").over(by_chain).isNull() & (F.col("_seg") > 0), F.lit(1).cast("long"))
    return inside.withColumn("gap", F.least("gap", short, skipped, begins)).groupBy(chain).agg(
        F.min("gap").alias("first_gap"), F.max("last").alias("last_sequence"))


def verify(links: DataFrame, chain: str = "host_id", content: str = "content_hash",
           payload_hash: Column | None = None, heads: DataFrame | None = None,
           segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per chain: records, valid flag and first broken sequence number.

    A chain is broken where a link does not follow from the one before, where a sequence number is missing or
    stands twice, and, with stored ``heads``, where the chain ends before its head or has another root. Chains
    that only the heads know are reported with 0 records.
    """
    checked = check_links(links, chain, content, payload_hash)
    found = checked.groupBy(chain).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(F.when(F.col("broken"), F.col("sequence_number"))).alias("first_broken"))
    found = found.join(gaps(links, chain, segment_rows), chain).withColumn(
        "first_broken", F.least("first_broken", "first_gap")).drop("first_gap")
    if heads is not None:
        now = found.join(chain_heads(links, chain, segment_rows).select(chain, "head"), chain)
        known = heads.select(chain, F.col("last_sequence").alias("_stored_last"), F.col("root").alias("_stored_root"))
        both = now.join(known, chain, "full")
        here, stored = F.coalesce("last_sequence", F.lit(0)), F.coalesce("_stored_last", F.lit(0))
        # Past the shorter of both ends; a chain of the right length with another root is wrong from its start on.
        ends = F.when(here != stored, F.least(here, stored) + 1).when(
            ~F.col("head").eqNullSafe(F.col("_stored_root")), F.coalesce("first_broken", F.lit(1)))
        found = both.withColumn("records", F.coalesce("records", F.lit(0))).withColumn(
            "first_broken", F.least("first_broken", ends))
    return found.select(chain, "records", "first_broken").withColumn("chain_valid", F.col("first_broken").isNull())


# --- primary against backup ----------------------------------------------------------

def compare(primary: DataFrame, backup: DataFrame, fields: Sequence[str] = CONTENT_FIELDS) -> DataFrame:
    """One row per id with its status; the content hash is recomputed from the primary.

    Only ids and hashes are shuffled.
    """
    p = primary.select(F.col("event_id").alias("record_id"), event_hash(fields).alias("current_hash"))
    return compare_hashes(p, backup.select("record_id", F.col("content_hash").alias("stored_hash")))


def compare_hashes(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """Status per id of rows (record_id, current_hash) against rows (record_id, stored_hash)."""
    p = primary.select(F.col("record_id").alias("event_id"), "current_hash")
    status = (F.when(F.col("event_id").isNull(), "missing_in_primary")
              .when(F.col("record_id").isNull(), "missing_in_backup")
              .when(F.col("current_hash") != F.col("stored_hash"), "hash_mismatch").otherwise("valid"))
    joined = p.join(backup, F.col("event_id") == F.col("record_id"), "full")
    return joined.select(F.coalesce("event_id", "record_id").alias("record_id"), status.alias("status"))


def deleted(primary: DataFrame, backup: DataFrame) -> DataFrame:
    return backup.join(primary.select(F.col("event_id").alias("record_id")), "record_id", "left_anti")


def orphans(primary: DataFrame, backup: DataFrame) -> DataFrame:
    return primary.join(backup.select(F.col("record_id").alias("event_id")), "event_id", "left_anti")


def common(primary: DataFrame, backup: DataFrame) -> DataFrame:
    return primary.join(backup.select(F.col("record_id").alias("event_id")), "event_id", "left_semi")


def inconsistent_writes(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """Ids present in exactly one of the tables."""
    p = primary.select(F.col("event_id"), F.lit(True).alias("in_primary"))
    b = backup.select(F.col("record_id").alias("event_id"), F.lit(True).alias("in_backup"))
    both = p.join(b, "event_id", "full")
    return both.where(F.col("in_primary").isNull() != F.col("in_backup").isNull()).select(
        "event_id", F.coalesce("in_primary", F.lit(False)).alias("in_primary"),
        F.coalesce("in_backup", F.lit(False)).alias("in_backup"))


def issues(statuses: DataFrame) -> DataFrame:
    """One row per finding with its type, severity and message."""
    s, rid = F.col("status"), F.col("record_id").cast("string")
    found = statuses.where(s != "valid")
    return found.select("record_id", X.lookup(s, {
        "missing_in_primary": "deleted_from_primary", "missing_in_backup": "missing_from_backup",
        "hash_mismatch": "content_modified"}, "").alias("issue_type"), X.lookup(s, {
            "missing_in_primary": "high", "missing_in_backup": "medium", "hash_mismatch": "critical"}, "")
        .alias("severity"), F.concat(F.lit("Record "), rid, X.lookup(s, {
            "missing_in_primary": " was deleted from primary database",
            "missing_in_backup": " exists in primary but not backup",
            "hash_mismatch": " content was modified in primary"}, "")).alias("message"))


def report(statuses: DataFrame, chain_checks: DataFrame | None = None) -> DataFrame:
    """One-row audit report. A broken chain reports zero checked records and a critical status."""
    s = F.col("status")
    totals = statuses.agg(
        F.count_if(s.isin("valid", "hash_mismatch")).alias("checked"), F.count_if(s == "valid").alias("valid"),
        F.count_if(s == "hash_mismatch").alias("tampered"), F.count_if(s == "missing_in_primary").alias("missing"),
        F.count_if(s == "missing_in_backup").alias("orphans"))
    return graded(totals, chain_checks)


def graded(totals: DataFrame, chain_checks: DataFrame | None = None) -> DataFrame:
    """The report row of one row of counts (checked, valid, tampered, missing, orphans)."""
    if chain_checks is None:
        full = totals.withColumns({"chain_valid": F.lit(True), "broken_at": F.lit(None).cast("long")})
    else:
        chain = chain_checks.agg(F.coalesce(F.bool_and("chain_valid"), F.lit(True)).alias("chain_valid"),
                                 F.min("first_broken").alias("broken_at"))
        both = totals.unionByName(chain, allowMissingColumns=True)
        full = both.agg(*[F.max(c).alias(c) for c in both.columns])
    ok = F.col("chain_valid")
    counts = {c: F.when(ok, F.col(c)).otherwise(F.lit(0)) for c in ("checked", "valid", "tampered", "missing",
                                                                       "orphans")}
    status = (F.when(~ok, "CRITICAL: Backup chain compromised")
              .when((F.col("tampered") > 0) | (F.col("missing") > 0), "ALERT: Tampering Detected")
              .when(F.col("orphans") > 0, "WARNING: Issues Found").otherwise("OK: All records verified"))
    return full.withColumns(counts).withColumn("overall_status", status)


def should_alert(rep: DataFrame) -> DataFrame:
    return rep.where((F.col("tampered") > 0) | (F.col("missing") > 0) | ~F.col("chain_valid"))


def recommendations(rep: DataFrame) -> DataFrame:
    """Adds the ordered ``actions`` array of a report row."""
    def block(test: Column, name: str) -> Column:
        texts = F.array(*[F.lit(t) for t in C.INTEGRITY_ACTIONS[name]])
        return F.when(test, texts).otherwise(F.array().cast("array<string>"))

    return rep.withColumn("actions", F.concat(
        block(~F.col("chain_valid"), "chain"), block(F.col("tampered") > 0, "tampered"),
        block(F.col("missing") > 0, "missing"), block(F.lit(True), "always")))


def forensics(statuses: DataFrame, original: DataFrame, primary: DataFrame,
              fields: Sequence[str] = CONTENT_FIELDS[1:]) -> DataFrame:
    """Deleted and modified records with original and current values and the changed fields.

    ``original`` is the audit copy with its payload, keyed by event_id.
    """
    bad = statuses.where(F.col("status").isin("missing_in_primary", "hash_mismatch"))
    o = original.select(F.col("event_id").alias("record_id"), *[F.col(f).alias(f"original_{f}") for f in fields])
    p = primary.select(F.col("event_id").alias("record_id"), F.lit(True).alias("_present"),
                       *[F.col(f).alias(f"current_{f}") for f in fields])
    joined = bad.join(o, "record_id").join(p, "record_id", "left")
    changed = X.labels((F.col("_present") & ~F.col(f"original_{f}").eqNullSafe(F.col(f"current_{f}")), f)
                       for f in fields)
    return joined.withColumn("changed_fields", changed).drop("_present")


# --- writes ----------------------------------------------------------------------------

def append_new(existing: DataFrame, incoming: DataFrame, key: str = "record_id") -> DataFrame:
    """Incoming rows whose id is new; repeated ids inside the batch keep one row."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def apply_changes(table: DataFrame, updates: DataFrame, deletes: DataFrame, columns: Sequence[str],
                  key: str = "event_id") -> DataFrame:
    """Copy-on-write update and delete by id; a null in ``updates`` leaves the value as it is."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    kept = table.join(deletes.select(key), key, "left_anti").join(new, key, "left")
    changed = kept.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns})
    return changed.select(*table.columns)
