"""Encoding and decoding by the trie against the tokenizers library."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from argosift.llm import bpe_trie as B

FILES = ["/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.json"]
ODD = [None, "", " ", "\t\n\x0b\x0c ", "it's they'll IT'S", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|><|endoftext|",
       "ΑΣ ΣΑΣ ΟΔΥΣΣΕΥΣ", "İstanbul ǅ ẞ", "éà ́x", "日本語 テスト 한국어", "👩‍👩‍👧 🏳️‍🌈", "  x y　z",
       "x" * 5000, "ab" * 3000 + "!", "1234567 3.14", "</w> a</w>b", "foo_bar-baz...", "\x00\x01\x7f\x85", "�￿\U0010ffff",
       "Ġ Ċ ▁ ##", " ".join("Aa aA") * 50]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    return B.load(request.param), Tokenizer.from_file(request.param)


def library(tokenizer, texts):
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [tokenizer.decode(i, skip_special_tokens=False) for i in ids]


def lists(encoder, texts):
    flat, first = encoder.texts(texts)
    return [flat[a:b].tolist() for a, b in zip(first, first[1:])]


def test_odd_texts(spark, documents, pair):
    source, tokenizer = pair
    want, decoded = library(tokenizer, ODD)
    got = B.decode(B.encode(documents(list(enumerate(ODD))), source, rows=5), source).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == want
    assert [r.decoded for r in got] == decoded


def test_corpus(corpus, pair):
    source, tokenizer = pair
    df, rows = corpus
    want, decoded = library(tokenizer, [r.text for r in rows])
    got = {r.doc_id: r for r in B.decode(B.encode(df, source), source).collect()}
    assert [list(got[r.doc_id].ids) for r in rows] == want
    assert [got[r.doc_id].decoded for r in rows] == decoded


def test_random_words_and_forgetting(pair, monkeypatch):
    source, tokenizer = pair
    draw = random.Random(3)
    texts = ["".join(draw.choice("aabcdest'’ éñß.,-_09 \n") for _ in range(draw.randrange(60))) for _ in range(800)]
    want = library(tokenizer, texts)[0]
    monkeypatch.setattr(B, "_REMEMBERED", 3)
    encoder = B.Encoder(B.Tokens(source))
    got = [ids for at in range(0, len(texts), 50) for ids in lists(encoder, texts[at:at + 50])]
    assert got == want


def test_shared_prefixes_are_walked_once(pair):
    encoder = B.Encoder(B.Tokens(pair[0]))
    steps = []
    last = encoder._last
    encoder._last = lambda path, end, *more: steps.append((path[:end], end < len(path))) or last(path, end, *more)
    words = ["transform", "transformation", "transformer", "transit"]
    encoder.words(words)
    inner = [prefix for prefix, inside in steps if inside]
    assert len(inner) == len(set(inner)) == len({w[:k] for w in words for k in range(1, len(w))})


def test_very_long_word_in_linear_time(pair):
    encoder = B.Encoder(B.Tokens(pair[0]))
    text = "ab" * 100_000
    assert lists(encoder, [text])[0] == pair[1].encode(text, add_special_tokens=False).ids


def test_repeated_rows_null_ids_and_other_columns(spark, documents, pair):
    df = documents([(1, "a b"), (1, "a b"), (None, "c")]).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    got = B.decode(B.encode(df, pair[0]), pair[0])
    assert got.columns == ["doc_id", "ids", "decoded"] and got.where("doc_id = 1").distinct().count() == 1
    assert got.count() == 3 and B.encode(documents([]), pair[0]).count() == 0


def test_decoding_of_unknown_ids_and_nulls(spark, pair):
    rows = spark.createDataFrame([(1, [5, -1, None, 999_999, 6]), (2, None), (3, [])], "n int, ids array<int>")
    got = {r.n: r.decoded for r in B.decode(rows, pair[0]).collect()}
    assert got == {1: pair[1].decode([5, 6], skip_special_tokens=False), 2: "", 3: ""}


def test_digests_of_the_query(spark, sf_dir):
    import hashlib

    from argosift.llm import queries
    tokenizer = Tokenizer.from_file(FILES[0])
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids, decoded = library(tokenizer, [r.text for r in rows])
    want = sorted((r.doc_id, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                   hashlib.sha256(d.encode()).hexdigest()) for r, i, d in zip(rows, ids, decoded))
    got = queries.QUERIES["op11_bpe_trie"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == want
