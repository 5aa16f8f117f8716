"""Chains and integrity comparison: golden cases and properties."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from argosift.operators import audit as A

FIELDS = "event_id long, ts timestamp_ntz, host_id string, source string, event_type string, severity string, " \
         "message string"


@pytest.fixture(scope="module")
def three(spark):
    rows = [(i, datetime(2024, 1, 1, 0, i), "h1", "auth", "login", "info", f"m{i}") for i in (1, 2, 3)]
    return spark.createDataFrame(rows, FIELDS)


def backup_of(df):
    return df.select(F.col("event_id").alias("record_id"), "ts", "host_id", A.event_hash().alias("content_hash"))


def one(df):
    return df.collect()[0].asDict()


def test_clean_then_edit_then_delete(three):
    backup = backup_of(three)
    clean = one(A.report(A.compare(three, backup)))
    assert (clean["checked"], clean["valid"], clean["overall_status"]) == (3, 3, "OK: All records verified")
    edited = three.withColumn("severity", F.when(F.col("event_id") == 2, "debug").otherwise(F.col("severity")))
    rep = one(A.report(A.compare(edited, backup)))
    assert (rep["tampered"], rep["missing"], rep["chain_valid"]) == (1, 0, True)
    rep = one(A.report(A.compare(edited.where("event_id <> 3"), backup)))
    assert (rep["tampered"], rep["missing"], rep["overall_status"]) == (1, 1, "ALERT: Tampering Detected")
    changed = A.forensics(A.compare(edited, backup), three, edited).collect()
    assert [r["changed_fields"] for r in changed] == [["severity"]]


def test_null_and_empty_hash_differently(spark):
    df = spark.createDataFrame([(None,), ("",)], "a string")
    assert df.select(F.sha2(F.lit("x"), 256), A.H.content_hash(F.col("a")).alias("h")).select("h").distinct().count() == 2


@pytest.fixture(scope="module")
def chain(spark):
    rows = spark.range(1, 41).selectExpr("id as record_id", "if(id % 4 = 0, 'b', 'a') as host_id",
                                         "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts",
                                         "sha2(cast(id as string), 256) as content_hash")
    return A.sequence(rows, "host_id", "ts", "record_id").cache()


def test_links_follow_definition(chain):
    rows = A.link_records(chain, segment_rows=8).where("host_id = 'a'").orderBy("sequence_number").collect()
    genesis = hashlib.sha256(b"genesis-v1").hexdigest()
    before = genesis
    for r in rows:
        if (r["sequence_number"] - 1) % 8 == 0:
            before = genesis
        want = hashlib.sha256(f"{before}:{r['content_hash']}".encode()).hexdigest()
        assert (r["previous_hash"], r["chain_hash"]) == (before, want)
        before = want
    assert [r["sequence_number"] for r in rows] == list(range(1, 31))


@pytest.mark.parametrize("bad", [1, 8, 9, 23])
def test_first_broken_record_is_found(chain, bad):
    links = A.link_records(chain, segment_rows=8)
    forged = links.withColumn("content_hash", F.when(
        (F.col("host_id") == "a") & (F.col("sequence_number") == bad), "x").otherwise(F.col("content_hash")))
    rows = {r["host_id"]: r for r in A.verify(forged).collect()}
    assert rows["a"]["first_broken"] == bad and not rows["a"]["chain_valid"] and rows["b"]["chain_valid"]


def test_relinked_edit_changes_the_head(chain):
    links = A.link_records(chain, segment_rows=8)
    other = A.link_records(chain.withColumn("content_hash", F.when(
        F.col("record_id") == 5, "x").otherwise(F.col("content_hash"))), segment_rows=8)
    heads = [{r["host_id"]: r["head"] for r in A.chain_heads(x, segment_rows=8).collect()} for x in (links, other)]
    assert heads[0]["a"] != heads[1]["a"] and heads[0]["b"] == heads[1]["b"]


def test_payload_check_finds_edited_payload(chain):
    links = A.link_records(chain, segment_rows=8).withColumn("payload", F.col("record_id"))
    hashed = F.sha2(F.when(F.col("record_id") == 6, "forged").otherwise(F.col("payload").cast("string")), 256)
    rows = {r["host_id"]: r["chain_valid"] for r in A.verify(links, payload_hash=hashed).collect()}
    assert rows == {"a": False, "b": True}


def test_broken_chain_stops_the_report(three):
    checks = three.selectExpr("host_id", "cast(2 as long) as first_broken", "false as chain_valid").limit(1)
    rep = one(A.report(A.compare(three, backup_of(three)), checks))
    assert (rep["checked"], rep["broken_at"], rep["overall_status"]) == (0, 2, "CRITICAL: Backup chain compromised")
    assert one(A.recommendations(A.report(A.compare(three, backup_of(three)), checks)))["actions"][0].startswith("CRIT")


def test_continued_chain_equals_whole_chain(chain):
    whole = A.link_records(chain, segment_rows=8)
    first = A.link_records(chain.where("record_id <= 21"), segment_rows=8)
    heads = A.last_links(first)
    rest = chain.where("record_id > 21").drop("sequence_number")
    second = A.link_records(A.sequence(rest, "host_id", "ts", "record_id", heads), segment_rows=8, heads=heads)
    cols = ["host_id", "record_id", "sequence_number", "chain_hash"]
    assert sorted(map(tuple, first.select(cols).unionByName(second.select(cols)).collect())) == sorted(
        map(tuple, whole.select(cols).collect()))


@pytest.mark.parametrize("keep,first", [
    ("sequence_number <> 8", 8), ("sequence_number not between 9 and 16", 9), ("sequence_number <= 27", 28),
    ("sequence_number <> 5", 5), ("sequence_number > 8", 1), ("false", 1)])
def test_removed_records_are_found(chain, keep, first):
    links = A.link_records(chain, segment_rows=8)
    heads = A.stored_heads(links, segment_rows=8)
    damaged = links.where(f"host_id = 'b' or ({keep})")
    rows = {r["host_id"]: r for r in A.verify(damaged, heads=heads, segment_rows=8).collect()}
    assert (rows["a"]["first_broken"], rows["a"]["chain_valid"]) == (first, False)
    assert (rows["b"]["first_broken"], rows["b"]["chain_valid"]) == (None, True)


def test_replaced_chain_has_another_root(chain):
    heads = A.stored_heads(A.link_records(chain, segment_rows=8), segment_rows=8)
    other = A.link_records(chain.withColumn("content_hash", F.when(F.col("record_id") == 5, "x").otherwise(
        F.col("content_hash"))), segment_rows=8)
    rows = {r["host_id"]: r["chain_valid"] for r in A.verify(other, heads=heads, segment_rows=8).collect()}
    assert rows == {"a": False, "b": True}
