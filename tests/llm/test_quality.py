import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from argosift.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_weights_match_plain_counts(documents):
    rows = [(1, "good text here"), (2, "bad | bad | bad"), (3, "good text"), (4, None), (5, "")]
    df = documents(rows)
    good = df.where("doc_id in (1, 3)").select("doc_id")
    got = {r.doc_id: r for r in Q.resample(df, good, n_buckets=97).collect()}
    bags = {d: Counter(Q.buckets(t, 97).tolist()) for d, t in rows}
    raw, target = sum(bags.values(), Counter()), bags[1] + bags[3]
    for d, bag in bags.items():
        want = sum(n * (math.log((target[b] + 1) / (target.total() + 97)) - math.log((raw[b] + 1) / (raw.total() + 97)))
                   for b, n in bag.items())
        assert abs(got[d].log_weight - want) < 1e-9 and got[d].n_grams == bag.total()


def test_labels_are_told_apart(spark):
    df, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 0").select("doc_id")
    rows = Q.resample(df, learn).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = np.array([r.mean_log_ratio for r in rows if r.quality])
    bad = np.array([r.mean_log_ratio for r in rows if not r.quality])
    auc = (good[:, None] > bad[None, :]).mean()
    assert auc > 0.85, auc


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in rng.normal(size=3000)] + [5.0] * 7 + [1e6, -1e6]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 1, 3, 9, 500, 2999, 3009, 9999):
        got = df.where(Q.top_k(df, "v", k, steps=8)).count()
        want = min(k, len(values)) if k not in (3,) else 8
        assert got == want, (k, got)


def test_gumbel_sampling_follows_the_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("text"))
    ratio = np.zeros(97)
    ratio[Q.buckets("a", 97)] = math.log(3)
    scored = Q.score(df, ratio).cache()
    drawn = scored.where(Q.top_k(scored, "gumbel_key", 400)).join(df, "doc_id").groupBy("text").count().collect()
    share = {r["text"]: r["count"] for r in drawn}
    assert 0.68 < share["a"] / 400 < 0.82


def test_edge_cases(documents):
    rows = [(1, None), (1, None), (None, "x"), (2, "w " * 200_000)]
    got = Q.resample(documents(rows).withColumn("good", F.lit(5)), documents([]).select("doc_id"), share=1.0).collect()
    assert len(got) == 4 and all(r.selected and r.log_weight == 0 for r in got)
    assert Q.resample(documents([]), documents([]).select("doc_id")).count() == 0


def test_both_passes_over_the_texts_take_small_batches(spark, documents):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    rows = [(i, "good text" if i % 2 else "bad | text") for i in range(300)]
    ratio = Q.models(documents(rows).withColumn("good", F.col("doc_id") % 2 == 1), n_buckets=97)
    assert int(spark.conf.get(key)) <= 2048
    pairs = [np.bincount(Q.buckets(t, 97), minlength=97) * 150 for t in ("good text", "bad | text")]
    raw, target = pairs[0] + pairs[1], pairs[0]
    want = np.log((target + 1) / (target.sum() + 97)) - np.log((raw + 1) / (raw.sum() + 97))
    assert np.allclose(ratio, want)
