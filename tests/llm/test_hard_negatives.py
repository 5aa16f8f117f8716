"""Hard negatives against a search over all pairs, and Strassen's product against the plain one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosift.llm import hard_negatives as H

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("label", T.IntegerType())])


def brute(rows, positives=5, negatives=5, low=80, high=100, every=100):
    """(anchor, positive, rank, negative, positive score, negative score) by comparing everything with everything."""
    used = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, label in used:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in used)
        for s, p, _ in [(s, j, o) for s, j, o in scored if o == label and j != i][:positives]:
            fit = [(n, j) for n, j, o in scored if o != label and low * -s <= 100 * -n <= high * -s]
            out += [(i, p, r, j, -s, -n) for r, (n, j) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    every = options.pop("every", 100)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    return sorted(map(tuple, H.mine(H.usable(df, is_anchor=F.col("vec_id") % every == 0), **options).collect()))


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (65, 64, 130), (31, 100, 57), (128, 33, 64), (0, 4, 3), (4, 0, 3)])
def test_strassen_is_exact(shape):
    n, k, m = shape
    draw = np.random.default_rng(1)
    a, b = draw.integers(-2**28, 2**28, (n, k)), draw.integers(-2**28, 2**28, (k, m))
    for leaf in (1, 8, 24):
        assert (H.strassen(a, b, leaf) == a @ b).all()


def test_sums_between_may_leave_the_range():
    a, b = np.full((64, 64), 2**28), np.full((64, 64), 2**28)
    a[::2] *= -1
    assert (H.strassen(a, b, 2) == a @ b).all()


def test_scores_beyond_a_long_are_held_to_its_range():
    big = np.array([[2**62, 1], [-2**62, 0]])
    assert H.scores(big, np.array([[4, 0], [0, 5]])).tolist() == [[2**63 - 1, 5], [1 - 2**63, 0]]


def test_matches_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert mined(spark, rows, every=10) == brute(rows, every=10)
    assert mined(spark, rows, every=7, positives=3, negatives=9, low=50, high=130, block_bytes=9000) == brute(
        rows, 3, 9, 50, 130, 7)


def test_query_with_its_turned_labels(spark, sf_dir):
    from argosift.llm import queries
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.QUERIES["op13_hard_negatives"](spark, sf_dir)
    assert dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_nulls_ties_odd_vectors_and_hot_label(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 6) / 2], int(draw.integers(0, 3)) if i % 3 else 1)
            for i in range(300)]
    rows += [(400, None, 1), (401, [1.0, None, 0.0], 1), (500, [float("nan")] * 6, 1), (402, [float("inf")] * 6, 2),
             (403, [1.0] * 6, None), (None, [1.0] * 6, 1), (600, [], 1), (601, [1.0, 2.0], 1), (602, [0.5] * 9, 2),
             (700, [0.0] * 6, 7), (800, [2.0] * 6, 1), (801, [2.0] * 6, 1), (802, [2.0] * 6, 2), (803, [-2.0] * 6, 2)]
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows_count_one_by_one(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.75], 2),
            (2, [1.0, 0.75], 2)]
    got = mined(spark, rows)
    assert len(got) == 2 * 2 * 2 and {r[:2] + r[3:4] for r in got} == {(0, 1, 2)}


def test_empty_table_and_other_columns(spark):
    assert mined(spark, []) == []
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], ROWS).withColumn("row", F.lit("x")).withColumn(
        "block", F.lit(None).cast("int"))
    assert [r.negative_id for r in H.mine(H.usable(df, is_anchor=F.col("vec_id") == 0)).collect()] == [2]


def test_text_labels(spark):
    df = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.9], "b")], "vec_id int, embedding array<float>, label string")
    assert [tuple(r)[:4] for r in H.mine(H.usable(df, is_anchor=F.col("vec_id") == 0)).collect()] == [(0, 1, 1, 2)]
