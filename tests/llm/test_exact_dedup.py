import hashlib
import re

from argosift.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(key, []).append(doc_id)
    return sorted((d, min(g), len(g), d == min(g), k) for k, g in groups.items() for d in g)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_brute_force_at_every_capacity(corpus):
    df, rows = corpus
    want = brute([(r.doc_id, r.text) for r in rows])
    for capacity in (1, 3, 256):
        assert result(exact_dedup.duplicate_groups(df, capacity=capacity)) == want


def test_hot_text_nulls_and_spaces(documents):
    rows = [(i, "hot  text") for i in range(40)] + [(50, None), (51, ""), (52, " "), (53, "\t\n"), (54, "a b"),
                                                    (55, "x" * 300_000), (56, "x" * 300_000)]
    got = exact_dedup.duplicate_groups(documents(rows), capacity=2)
    assert result(got) == brute(rows)
    assert exact_dedup.deduplicate(documents(rows), capacity=2).count() == 5


def test_repeated_rows_null_ids_and_empty_table(documents, spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    got = exact_dedup.duplicate_groups(documents(rows)).where("kept")
    assert sorted((r.doc_id or 0, r.group_size) for r in got.collect()) == [(0, 2), (1, 3)]
    assert exact_dedup.deduplicate(documents(rows)).count() == 2
    assert exact_dedup.duplicate_groups(documents([])).count() == 0


def test_other_columns_survive(documents):
    from pyspark.sql import functions as F
    df = documents([(1, "a"), (2, "a")]).withColumn("keep_id", F.lit(7)).withColumn("own_digest", F.lit("z"))
    got = exact_dedup.deduplicate(df)
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == [1]


def test_candidates_hold_every_frequent_key(spark):
    keys = ["a"] * 30 + ["b"] * 25 + [f"k{i}" for i in range(45)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    named = {r.k for r in exact_dedup.frequent_candidates(df, "k", 4).collect()}
    assert {"a", "b"} <= named and len(named) <= 4
