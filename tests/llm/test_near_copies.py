import random

import pytest

import corpus_pipeline as C
from argosift.llm import near_copies as N


def plain_set(text, words=5):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def plain_groups(pairs):
    """Smallest id reachable over links of likeness 0.8; pairs are (id, text)."""
    sets = [(d, plain_set(t)) for d, t in pairs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if 5 * min(len(sa), len(sb)) >= 4 * max(len(sa), len(sb)) and 5 * len(sa & sb) >= 4 * len(sa | sb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in sets}


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"x{rng.getrandbits(40)}"
    return out


def planted(seed):
    """Texts with near copies on both sides of 0.8, chains of copies, and one passage in all of them."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    texts = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 200))]
        for changes in (0, 1, 2, 3, 4, 5):
            texts.append(common + edited(rng, base, min(changes, len(base) // 8)))
        for _ in range(4):
            base = edited(rng, base, 2)
            texts.append(common + base)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"sample_rows": 20, "most_frequent": 5}, {"most_frequent": 0}])
def test_matches_brute_force(documents, options):
    rows = planted(7)
    want = plain_groups(rows)
    assert 40 < len(set(want.values())) < len(rows)
    got = {r.doc_id: (r.component_id, r.kept) for r in N.near_groups(documents(rows), **options).collect()}
    assert got == {d: (root, root == d) for d, root in want.items()}


def test_stage_keeps_one_of_each_group_of_the_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_groups([(r.doc_id, r.text) for r in df.collect()])
    stage = dict(C.STAGES)["simhash_dedup"]
    got = stage(spark, df, "/nowhere")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_large_group_of_near_copies(documents):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(600)]
    assert {r.component_id for r in N.near_groups(documents(rows)).collect()} == {0}


def test_edge_cases(documents):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "Word"), (9, "word"), (10, "word"), (10, "word"), (None, "word"),
            (11, "Ä b c d e " * 50_000)]
    got = sorted((r.doc_id or -1, r.component_id) for r in N.near_groups(documents(rows)).collect())
    assert got == [(-1, 8), (5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (10, 8), (10, 8), (11, 11)]
    assert sorted(r.doc_id for r in N.deduplicate(documents(rows)).collect()) == [5, 8, 11]
    assert N.near_groups(documents([])).count() == 0


def test_groups_of_fingerprints_come_first(documents, monkeypatch):
    """Near copies reach their group through SimHash."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(6)] + [(9, " ".join(f"z{i}" for i in range(300)))]
    docs = documents(rows)
    seen, plain = [], N.simhash_dedup.link_edges

    def links(distinct, *rest):
        seen.append(distinct.count())
        return plain(distinct, *rest)

    monkeypatch.setattr(N.simhash_dedup, "link_edges", links)
    nodes = N._nodes(docs, "doc_id", "text", 5, 80, N._frequent(docs, "text", 5, 100, 10))
    near = {frozenset((r.a, r.b)) for r in N.fingerprint_pairs(nodes).collect()}
    assert 0 < len(near) <= 5 and seen
    kept = dict(C.STAGES)["simhash_dedup"](docs.sparkSession, docs, "/nowhere")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9] and len(seen) == 2


def test_fine_parities_bound_the_difference():
    import numpy as np
    rng = np.random.default_rng(3)
    for n, extra in ((0, 3), (50, 20), (1000, 100), (1000, 500), (5000, 40)):
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[extra // 2:], rng.integers(0, 2 ** 63, extra).astype(np.uint64))))
        bound = N.least_difference(N.fine_parities(a), N.fine_parities(b))
        assert bound <= len(np.setxor1d(a, b)) and bound == N.least_difference(N.fine_parities(b), N.fine_parities(a))
        if extra <= 100:
            assert bound > len(np.setxor1d(a, b)) * 0.5
    far = [np.unique(rng.integers(0, 2 ** 63, 5000).astype(np.uint64)) for _ in range(2)]
    assert N.least_difference(*map(N.fine_parities, far)) * 180 > 10_000 * 20


def test_last_round_meets_every_link_and_few_other_pairs(spark):
    """Copies with many edits of one text share its shingles, but only those with few edits can be linked with them."""
    rng = random.Random(11)
    base = list(range(1000, 1100))
    sets = {}
    for key in range(240):
        gone = set(rng.sample(base, 4 if key < 80 else 8 if key < 160 else 16))
        sets[key] = [key * 10_000 + 10_000_000 + i for i in range(len(gone))] + [x for x in base if x not in gone]
    sets[240] = [1] + sets[100][1:]
    # Rare shingles first, as in a prefix; members with few edits are one group already.
    rows = [(s, pos, key, len(own), 0 if key < 80 else key) for key, own in sets.items()
            for pos, s in enumerate(own[:len(own) // 5 + 1])]
    df = spark.createDataFrame(rows, "shingle long, pos int, key long, n int, root long")
    got = {frozenset((r.a, r.b)) for r in N._possible(df, 80).collect()}
    want, met = set(), set()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and (a >= 80 or b >= 80):
                if 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)):
                    want.add(frozenset((a, b)))
                if set(x[:len(x) // 5 + 1]) & set(y[:len(y) // 5 + 1]):
                    met.add(frozenset((a, b)))
    assert {100, 240} in want and len(want) > 50
    assert want <= got <= met and len(got - want) < (len(met) - len(want)) / 2
