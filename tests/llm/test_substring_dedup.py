import hashlib
import random

from pyspark.sql import functions as F

from argosift.llm import substring_dedup as D


def brute(rows, window=50):
    """Smallest document of every window, then the words of windows that an earlier document has."""
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    return sorted((tuple(r) for r in D.summaries(df, **options).collect()), key=str)


def test_matches_brute_force(corpus, spark):
    df, rows = corpus
    assert result(df) == brute([(r.doc_id, r.text) for r in rows])
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert sum(w[2] for w in want) > 1000 and result(df) == want


def test_spliced_passages(documents):
    """Passages of many lengths in changing surroundings, few distinct words, so that anchors repeat everywhere."""
    for seed in range(4):
        rng = random.Random(seed)
        vocabulary = [f"w{i}" for i in range(6 if seed % 2 else 400)]
        passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 60))] for _ in range(8)]
        rows = []
        for d in range(60):
            words = []
            for _ in range(rng.randint(0, 6)):
                words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
                p = rng.choice(passages)
                lo = rng.randint(0, 5)
                words += p[lo:]
            rows.append((rng.randint(-40, 40), rng.choice([" ", "\n", " \t"]).join(words)))
        df = documents(rows)
        assert result(df, window=12) == brute_options(rows, 12), seed


def brute_options(rows, window):
    return brute(rows, window)


def test_edge_cases(documents):
    long = " ".join(f"t{i % 977}" for i in range(60_000))
    p = " ".join(f"p{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, p), (4, p), (4, p), (5, " ".join(p.split()[:49])), (None, p), (6, long), (7, long),
            (8, "a b " + p + " tail"), (9, (p + " ") * 4)]
    got = result(documents(rows))
    assert got == brute(rows)
    assert result(documents([])) == []


def test_pipeline_form_keeps_columns(documents):
    p = " ".join(f"p{i}" for i in range(50))
    df = documents([(1, p), (2, f"x  {p} y"), (3, "a  b")]).withColumn("lo", F.lit(1)).withColumn("own_hash", F.lit("k"))
    got = D.remove_repeats(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: (p, len(p)), 2: ("x y", 3), 3: ("a  b", 4)}


def test_shared_passage_gives_rows_in_proportion(documents):
    p = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"l{i} m{i} {p} r{i} s{i}") for i in range(200)]
    got = result(documents(rows))
    assert got == brute(rows) and sum(r[2] for r in got) == 199 * 55
