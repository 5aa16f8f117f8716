import pytest
import sentencepiece
from pyspark.sql import functions as F

from argosift.llm import sentencepiece_lattice as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def fields(data):
    """(offset of the value, number, wire type, value) of a protobuf message."""
    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if not data[at - 1] & 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        start = at
        if key & 7 == 2:
            size, at = varint(at)
            start, at = at, at + size
        elif key & 7 == 0:
            _, at = varint(at)
        else:
            at += 8 if key & 7 == 1 else 4
        yield start, key >> 3, key & 7, data[start:at]


@pytest.fixture(scope="module")
def unigram():
    """The library's own unigram encoder over the same piece table: the model type is one byte of the file."""
    data = bytearray(open(MODEL, "rb").read())
    for start, number, wire, value in fields(bytes(data)):
        if number == 2 and wire == 2:
            for inner, n, w, v in fields(bytes(value)):
                if n == 3 and w == 0:
                    data[start + inner] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


@pytest.fixture(scope="module")
def pieces():
    return P.load(MODEL)


@pytest.fixture(scope="module")
def plain(pieces):
    """Plain Viterbi over one word; ties go to the smallest start."""
    table = {p: (i, s) for p, i, s in pieces.usable}

    def best(word):
        ends = [(0.0, 0, 0)]
        for e in range(1, len(word) + 1):
            ends.append(None)
            for s in range(max(0, e - pieces.longest), e):
                i, score = table.get(word[s:e], (-1, pieces.unknown_score if e == s + 1 else None))
                if score is not None and (ends[e] is None or ends[s][0] + score > ends[e][0]):
                    ends[e] = ends[s][0] + score, s, i
        out, at = [], len(word)
        while at:
            _, s, i = ends[at]
            out[:0] = [i] if i >= 0 else [pieces.byte_ids[b] for b in word[s:at].encode()]
            at = s
        return out

    known = {}

    def encode(text):
        found = P.words(text)
        known.update((w, best(w)) for w in set(found) - set(known))
        return [x for w in found for x in known[w]]

    return encode


def assembled(df, pieces, **options):
    return {r.doc_id: (r.ids, r.text) for r in P.assemble(P.encode(df, pieces, **options), pieces).collect()}


def test_equals_plain_viterbi_on_the_corpus(corpus, pieces, plain):
    df, rows = corpus
    got = assembled(df, pieces, frequent=500)
    for r in rows:
        assert got[r.doc_id] == (plain(r.text), r.text)


def test_scores_equal_the_lattice_of_the_library(plain, unigram):
    """The library's n-best search; its faster search adds scores that differ by 10^9 in 32-bit floats."""
    for w in ("the", "hehe", "ontion", "theand", "Words"):
        want = unigram.nbest_encode(w, nbest_size=2)[0]
        assert sum(map(unigram.get_score, plain(w))) == sum(map(unigram.get_score, want)), w


def test_any_bound_of_frequent_words_gives_the_same(documents, pieces):
    df = documents([(1, "the cat and the dog"), (2, "rareword the xyzzy")])
    assert assembled(df, pieces, frequent=1) == assembled(df, pieces, frequent=0) == assembled(df, pieces)


def test_edge_cases(documents, pieces, plain):
    texts = {1: "a  b", 2: " lead and trail ", 3: "new\n\nline", 4: "tab\there", 5: "漢字 emoji 🙂 ½", 6: "▁x", 7: "   ",
             8: "<s> <0x0A> </s>", 9: "é" * 300, 10: "long words here " * 20_000, 11: "\n"}
    rows = [(k, v) for k, v in texts.items()] + [(20, None), (21, ""), (None, "the end")]
    got = assembled(documents(rows).withColumn("ids", F.lit(1)).withColumn("word", F.lit("w")), pieces)
    assert set(got) == {*texts, None}
    for k, t in texts.items():
        assert got[k][0] == plain(t), t
        assert got[k][1] == t.replace("▁", " ")
    assert P.encode(documents([]), pieces).count() == 0


def test_runs_cover_the_words(corpus, pieces):
    df, rows = corpus
    covered = {}
    for r in P.encode(df, pieces, frequent=300).collect():
        covered.setdefault(r.doc_id, []).append((r.first_word, r.n_words))
    for r in rows:
        at = 0
        for first, n in sorted(covered.get(r.doc_id, [])):
            assert first == at
            at += n
        assert at == len(P.words(r.text))


def test_decode_odd_rows_in_small_batches(spark, documents, pieces):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    a, byte = pieces.texts.index(b"a"), pieces.byte_ids
    rows = [(1, [a, a]), (2, None), (3, []), (4, [byte[0xC3]]), (5, [byte[0xA9], a]), (6, [byte[0xC3], byte[0xA9]]), (7, [0])]
    df = spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1)
    got = {r.k: r.text for r in P.decode(df, pieces).collect()}
    assert got == {1: "aa", 2: "", 3: "", 4: "�", 5: "�a", 6: "é", 7: ""}
    assert P.decode(df.where("k < 0"), pieces).count() == 0
    P.encode(documents([(1, "a b")]), pieces)
    assert int(spark.conf.get(key)) <= 2048


def test_many_lattices_are_folded_at_once(spark, pieces, plain, monkeypatch):
    """Words that end in any batch, and one longer than all that is folded together."""
    monkeypatch.setattr(P, "_EDGES", 50)
    texts = ["the", "▁thing", "▁ontion", "x", "漢字", "é🙂", "▁" + "abcd" * 300, "\n", "▁and"]
    found = spark.createDataFrame([(w, i) for i, w in enumerate(texts)], "word string, n long").coalesce(1)
    monkeypatch.setattr(P, "words", lambda text: [text])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.word: (r.n, r.ids) for r in P.encode_words(found, pieces).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2048)
    assert got == {w: (i, plain(w)) for i, w in enumerate(texts)}


def test_edges_of_a_word_must_stand_together(pieces):
    import numpy as np
    import pyarrow as pa
    rows = [("ab", 1, 0, 1, 5), ("c", 2, 0, 1, 6), (None, None, 1, 2, 7)]
    edges = pa.table([pa.array(c, t) for c, t in zip(
        zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["word", "n", "start", "end", "id"])
    scores = np.zeros(len(pieces.texts) + 1)
    with pytest.raises(RuntimeError):
        P.best_paths(edges, scores, np.array(pieces.byte_ids))
    got = P.best_paths(edges.take([0, 2, 1]).combine_chunks(), scores, np.array(pieces.byte_ids))
    assert got.to_pylist() == [{"word": "ab", "n": 1, "ids": [5, 7]}, {"word": "c", "n": 2, "ids": [6]}]
