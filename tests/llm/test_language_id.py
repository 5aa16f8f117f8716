from pyspark.sql import functions as F

from argosift.llm import language_id as L


def test_held_out_accuracy_and_rejection(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(L.training_rows(df))
    got = L.classify(df, model, keep=("doc_id", "lang", L.held_out().alias("held_out")))
    rows = got.where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right / len(rows) > 0.97
    assert got.where("rejected").count() == 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_labels_of_held_out_rows_do_not_matter(corpus):
    df, _ = corpus
    changed = df.withColumn("lang", F.when(L.held_out(), "xx").otherwise(F.col("lang")))
    assert L.fit(L.training_rows(changed)).languages == L.fit(L.training_rows(df)).languages


def test_edge_cases(corpus, documents):
    df, _ = corpus
    model = L.fit(L.training_rows(df), per_language=50, clusters=2)
    rows = [(1, None), (2, ""), (3, "123 .. !!"), (4, "the"), (None, "the"), (5, "привет мир как дела сегодня"),
            (6, "the of and with " * 60_000), (7, "漢字 かな")]
    got = {r.doc_id: r for r in L.classify(documents(rows), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected for i in (1, 2, 3, 5, 7))
    assert got[4].lang_pred == got[6].lang_pred == "en" and not got[6].rejected
    kept = L.keep_known(documents(rows), model)
    assert kept.columns == df.columns and 6 in {r.doc_id for r in kept.collect()}
    empty = L.fit(documents([]))
    assert {r.lang_pred for r in L.classify(documents(rows), empty).collect()} == {"und"}
    assert L.classify(documents([]), model).count() == 0


def test_null_labels_are_not_learned(documents):
    assert L.fit(documents([(1, "the of and", None, "s"), (2, "und der die", "de", "s")])).languages == ["de"]


def test_kmeans_finds_separate_clusters():
    import numpy as np
    v = np.eye(4, dtype=np.float32)[[0, 0, 1, 1, 2, 2]]
    centroids, reach = L.spherical_kmeans(v, 3)
    assert sorted(centroids.argmax(axis=1)) == [0, 1, 2] and reach > 0.99


POLISH = ("wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i "
          "sumieniem i powinni postępować wobec innych w duchu braterstwa ").split()
FINNISH = ("kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja "
           "omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä ").split()


def test_other_languages_and_noise_are_rejected(spark, documents):
    import base64
    import random
    import string

    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.fit(L.training_rows(df))
    rng = random.Random(5)
    noise = {
        "hex": lambda n: ["%016x" % rng.getrandbits(64) for _ in range(n)],
        "base64": lambda n: [base64.b64encode(rng.randbytes(9)).decode() for _ in range(n)],
        "letters": lambda n: ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(n)],
        "polish": lambda n: (POLISH * 100)[:n], "finnish": lambda n: (FINNISH * 100)[:n]}
    rows = [(i, " ".join(make(n))) for i, (make, n) in enumerate((m, n) for m in noise.values() for n in (50, 200, 1000))]
    got = sorted((r.doc_id, r.rejected, round(r.score, 3), r.lang_pred) for r in L.classify(documents(rows), model).collect())
    assert [r for r in got if not r[1]] == []
    assert L.keep_known(df, model).count() == df.count()


def test_cuts_follow_the_length_of_texts():
    import numpy as np
    histogram = np.zeros((1, 8, 1001), np.int64)
    histogram[0, 2, 100] = 30
    histogram[0, 5, 500] = 2
    histogram[0, 5, 800] = 998
    histogram[0, 6, 700] = 1
    cuts = L.low_cosines(histogram)[0]
    assert cuts[2] == 0.1 and cuts[5] == 0.8 and cuts[6] == 0.8 and cuts[0] == 0.1


def test_python_gets_small_batches(spark, corpus):
    from argosift.llm.common import map_arrow
    import pyarrow as pa

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.range(0, 9000, 1, 1)
    sizes = map_arrow(df, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]), "n long", rows=10_000)
    assert sizes.agg(F.max("n")).first()[0] <= 2048
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    L.fit(L.training_rows(corpus[0]), per_language=20, clusters=1)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2048


def test_vectors_are_not_copied():
    import tracemalloc

    import numpy as np

    plain = L.Model(np.ones(8192, np.float32), [], np.zeros((0, 8192), np.float32), np.zeros((0, 32)))
    texts = ["the cat and the dog"] * 500
    tracemalloc.start()
    vectors = plain.vectors(texts)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * vectors.nbytes
