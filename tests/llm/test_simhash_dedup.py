import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from argosift.llm import common, simhash_dedup as S


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(pairs):
    """Smallest id reachable over links of at most 4 bits; pairs are (id, fingerprint)."""
    root = {d: d for d, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, fa) in enumerate(pairs):
        for b, fb in pairs[:i]:
            if (fa ^ fb).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in pairs}


def test_matches_brute_force(corpus):
    df, rows = corpus
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_groups(df).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in prints}


def test_xxh64_is_the_one_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("of the old word")).alias("h")).first()
    assert row.h & (2 ** 64 - 1) == xxhash.xxh64_intdigest("of the old word".encode(), 42)


def planted(seed, n, clusters):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(clusters):
        x = rng.getrandbits(64)
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            values.add(x)
    return sorted(values)


def test_all_links_of_random_and_chained_fingerprints(spark):
    values = planted(3, 1500, 40)
    want = plain_components([(v, v) for v in values])
    df = spark.createDataFrame([(v - 2 ** 64 if v >= 2 ** 63 else v,) for v in values], "fp long")
    for options in ({"shard_rows": 50, "sample_rows": 300}, {"block_rows": 40}, {"sample_rows": 3}):
        edges = S.link_edges(df, **options)
        tree = {r.node: r.root for r in common.components(edges, "a", "b").collect()}
        got = {}
        for v in values:
            s = v - 2 ** 64 if v >= 2 ** 63 else v
            got.setdefault(tree.get(s, s), []).append(v)
        assert {min(g): sorted(g) for g in got.values()} == {
            r: sorted(v for v in values if want[v] == r) for r in set(want.values())}


def test_many_leaves_of_several_blocks(spark):
    values = planted(5, 1500, 40)
    want = plain_components([(v, v) for v in values])
    df = spark.createDataFrame([(v - 2 ** 64 if v >= 2 ** 63 else v,) for v in values], "fp long")
    # About 1,000 leaves, nearly all of several blocks, are more than conditions nested by leaf could be planned for.
    edges = S.link_edges(df, shard_rows=2, block_rows=40)
    tree = {r.node: r.root for r in common.components(edges, "a", "b").collect()}
    got = {}
    for v in values:
        s = v - 2 ** 64 if v >= 2 ** 63 else v
        got.setdefault(tree.get(s, s), []).append(v)
    assert {min(g): sorted(g) for g in got.values()} == {
        r: sorted(v for v in values if want[v] == r) for r in set(want.values())}


def test_group_of_near_copies_gives_one_row_each(spark):
    centre = 0x0123456789ABCDEF
    values = [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    df = spark.createDataFrame([(v,) for v in values if v < 2 ** 63], "fp long")
    edges = S.link_edges(df, block_rows=500)
    assert edges.count() <= 12 * df.count()
    assert common.components(edges, "a", "b").select("root").distinct().count() == 1


def test_long_chain_contracts(spark):
    n = 3000
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.components(edges, "a", "b")
    assert got.count() == n + 1 and got.select("root").distinct().count() == 1


def test_edge_cases(documents):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "Word"), (9, "word"), (10, "word"), (10, "word"), (None, "word"),
            (11, "Ä b c d e " * 50_000)]
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_groups(documents(rows)).collect())
    assert got == [(-1, 8), (5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (10, 8), (10, 8), (11, 11)]
    assert sorted(r.doc_id for r in S.deduplicate(documents(rows)).collect()) == [5, 8, 11]
    assert S.near_groups(documents([])).count() == 0
    assert S.fingerprint("ÀB c") != S.fingerprint("àb c") and S.fingerprint("AB") == S.fingerprint("ab")


def test_extra_columns(documents):
    df = documents([(1, "a b"), (2, "a b")]).withColumn("fp", F.lit(1)).withColumn("kept", F.lit(2))
    got = S.deduplicate(df)
    assert got.columns == df.columns and got.count() == 1


def test_hash_of_word_runs_depends_on_content_only():
    a, b = common.Words("x y z the same words"), common.Words("the  same\twords here")
    assert a.hashes(np.array([3]), np.array([5]))[0] == b.hashes(np.array([0]), np.array([2]))[0]
