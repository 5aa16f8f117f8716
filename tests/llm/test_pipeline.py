"""The pipeline against a plain Python version of its stages."""

import pytest

import corpus_pipeline as C
from argosift.llm import language_id
from test_exact_dedup import brute as exact
from test_near_copies import plain_groups
from test_packing import check
from test_substring_dedup import brute as repeats


def staged(spark, docs, folder="/nowhere"):
    from argosift.session import cut
    out = []
    for name, stage in C.STAGES:
        docs = cut(stage(spark, docs, folder))
        out.append((name, docs))
    return out


def test_stages_match_plain_versions(spark, corpus):
    df, rows = corpus
    steps = dict(staged(spark, df))
    assert [n for n, _ in C.STAGES] == list(steps)
    for name in list(steps)[:-1]:
        assert steps[name].columns == df.columns and steps[name].dtypes == df.dtypes

    def texts(name):
        return {r.doc_id: r.text for r in steps[name].collect()}

    model = language_id.fit(language_id.training_rows(df))
    want = {r.doc_id: r.text for r in rows if not model.predict([r.text], 0.5)[2][0]}
    assert texts("language_id") == want
    want = {d: want[d] for d, _, _, kept, _ in exact(want.items()) if kept}
    assert texts("exact_dedup") == want
    roots = plain_groups(want.items())
    want = {d: t for d, t in want.items() if roots[d] == d}
    assert texts("simhash_dedup") == want
    got = texts("substring_dedup")
    for d, n, removed, _ in repeats(want.items()):
        assert len((got[d] or "").split()) == n - removed
        assert removed or got[d] == want[d]
    final = steps["packing"].collect()
    check([(r.doc_id, r.text, r.source) for r in steps["substring_dedup"].collect()], final, 2048)
    assert sorted(map(tuple, C.run(spark, "/root/testdata/sf0.001").collect()), key=str) == sorted(map(tuple, final), key=str)


def test_odd_rows_pass_through(spark, documents):
    from pyspark.sql import functions as F
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "the of and to", "en", None), (3, "the of and to", "en", None),
            (None, "the of and in", "en", "s"), (5, "the of and to", "en", "s"), (6, "the of and to in " * 10_000, "en", "s")]
    df = documents([]).union(spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], documents([]).schema))
    df = df.withColumn("keep_id", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("lo", F.lit(2))
    steps = dict(staged(spark, df))
    assert steps["substring_dedup"].columns == df.columns
    # The model learns one language from a few words; texts without a letter go.
    assert sorted(r.doc_id or 0 for r in steps["exact_dedup"].collect()) == [0, 3, 6]
    assert steps["packing"].where("bin_id is null").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_every_stage_takes_an_empty_table(spark, documents, k):
    assert C.STAGES[k][1](spark, documents([]), "/nowhere").count() == 0
