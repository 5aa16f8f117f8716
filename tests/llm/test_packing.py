import random
from collections import defaultdict

from argosift.llm import packing


def check(rows, placed, capacity):
    """Every word has one place, bins hold no conflict and are not overfull."""
    bins, pieces = defaultdict(list), defaultdict(list)
    source = {d: s for d, _, s in rows}
    text = {d: " ".join((t or "").split()) for d, t, _ in rows}
    for r in placed:
        pieces[r.doc_id].append((r.first_word, r.n_words))
        if r.bin_id is not None:
            bins[r.bin_id].append((r.bin_offset, r.n_words, r.doc_id))
    for d in text:
        at = 0
        for first, n in sorted(pieces[d]):
            assert first == at
            at += n
        assert at == len(text[d].split())
    for content in bins.values():
        at = 0
        for offset, n, _ in sorted(content):
            assert offset == at
            at += n
        assert at <= capacity
        sources = [source[d] for _, _, d in content if source[d] is not None]
        assert len(sources) == len(set(sources))
        assert len({text[d] for _, _, d in content}) == len(content)
    return bins


def test_best_fit_equals_plain_search():
    rng = random.Random(5)
    for _ in range(50):
        n, capacity = 60, 100
        sizes = sorted((rng.randint(1, 99) for _ in range(n)), reverse=True)
        sources = [rng.choice(["a", "a", "b", "c", None]) for _ in range(n)]
        clusters = [rng.randint(0, 20) for _ in range(n)]
        want, state = [], []
        for size, s, c in zip(sizes, sources, clusters):
            fits = [(left, b) for b, (left, ss, cs) in enumerate(state)
                    if left >= size and (s is None or s not in ss) and c not in cs]
            if fits:
                b = min(fits)[1]
            else:
                state.append((capacity, set(), set()))
                b = len(state) - 1
            left, ss, cs = state[b]
            state[b] = (left - size, ss | {s}, cs | {c})
            want.append(b)
        assert packing.best_fit(sizes, sources, clusters, capacity)[0] == want


def test_whole_corpus_is_placed(corpus):
    df, rows = corpus
    for capacity, group in ((64, 20), (2048, 4096)):
        placed = packing.pack(packing.measured(df), capacity, group).collect()
        check([(r.doc_id, r.text, r.source) for r in rows], placed, capacity)


def test_hot_source_copies_nulls_and_long_texts(documents):
    rows = [(i, f"w{i} x y", "en", "hot") for i in range(30)] + [(100 + i, "same words here", "en", f"s{i}") for i in range(9)]
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "long " * 1000, "en", None), (203, "p q", None, None),
             (204, "exactly four words here", "en", "b")]
    placed = packing.pack(packing.measured(documents(rows)), capacity=4, group_rows=10).collect()
    bins = check([(r[0], r[1], r[3]) for r in rows], placed, 4)
    assert sorted(r.doc_id for r in placed if r.bin_id is None) == [200, 201]
    assert len(bins) >= 30 + 250


def test_empty_table_null_ids_and_repeated_rows(documents):
    assert packing.pack(packing.measured(documents([]))).count() == 0
    placed = packing.pack(packing.measured(documents([(None, "a b"), (None, "a b"), (1, "c")]))).collect()
    assert len(placed) == 3 and len({r.bin_id for r in placed}) == 3


def test_large_ids_stay_exact(documents):
    big = 2 ** 62 + 1
    assert [r.doc_id for r in packing.pack(packing.measured(documents([(big, "a"), ]))).collect()] == [big]
