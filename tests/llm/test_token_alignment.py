"""Token alignment against a plain version that compares byte offsets document by document."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from argosift.llm import token_alignment as A

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
ODD = [None, "", " ", "  two  spaces ", "plain words here", "a▁b", "<|endoftext|> <s> </s> <unk>", "don't it's we'll",
       "日本語 テスト 한국어", "👩‍👩‍👧 é ß İ", "\t\n\r tabs\n\nand lines \n", "x" * 3000, " " * 500 + "end", "\x00\x01 \x7f",
       "foo_bar(baz)==1234567.89;", "ends with space ", "naïve café — “quoted”", "the the the the"]


@pytest.fixture(scope="module")
def plain():
    """Function that returns (A ids, B ids, byte ends of both) of a text."""
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = byte_of_characters()

    def run(text):
        if not text:
            return [], [], [], []
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        a_bytes = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            p = model.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode())
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return [], [], [], []
        return a, b, *(list(accumulate(map(len, parts))) for parts in (a_bytes, b_bytes))

    return run


def byte_of_characters():
    """Byte of every character of the library's byte-level alphabet."""
    step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    table = {}
    for text in map(chr, [*range(0x800), *range(0x800, 0xD800, 0x40), *range(0x10000, 0x110000, 0x1000)]):
        table.update(zip(step.pre_tokenize_str(text)[0][0], text.encode()))
    return table


def brute(plain, rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b, ends_a, ends_b = plain(text)
        shared = sorted(set(ends_a) & set(ends_b))
        groups, links, i, j = [], [], 0, 0
        for e in shared:
            i2, j2 = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append((a[i:i2], b[j:j2]))
            links.append((a[i2 - 1], b[j2 - 1]))
            i, j = i2, j2
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for doc_id, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, docs


@pytest.fixture(scope="module")
def models():
    return A.load(BYTES, PIECES)


def key(row):
    return tuple((x is None, x) for x in row)


def test_odd_texts(spark, documents, models, plain):
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, "  two  spaces "), (99, "a▁b c")]
    want, docs = brute(plain, rows)
    got = A.scored(documents(rows).repartition(3), models, rows=2, block_links=20)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert (want[5][1], want[5][-1]) == (0, "")
    full = {r.doc_id: r for r in A.groups(documents(rows[:len(ODD)]), models, rows=4).collect()}
    for doc_id, a, b, parts, _ in docs[:len(ODD)]:
        r = full[doc_id]
        cuts = list(zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends))
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [(r.a_ids[i:j], r.b_ids[k:m]) for i, j, k, m in cuts] == parts


def test_corpus_and_query(spark, sf_dir, models, plain):
    from argosift.llm import queries
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted(brute(plain, rows)[0])
    got = queries.QUERIES["op12_token_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == want


def test_small_blocks_batches_and_forgetting(spark, corpus, models, plain, monkeypatch):
    df, rows = corpus
    some = df.where("doc_id < 60")
    want = sorted(brute(plain, [(r.doc_id, r.text) for r in rows if r.doc_id < 60])[0])
    assert sorted(map(tuple, A.scored(some.repartition(4), models, rows=3, block_links=50).collect())) == want
    monkeypatch.setattr(A, "_REMEMBERED", 5)
    aligner = A.Aligner(models)
    for r in rows[:20]:
        found = aligner.batch([r.text, None, r.text])
        assert len(found.group_ends()[0]) == 2 * next(w[3] for w in brute(plain, [(0, r.text)])[0])


def test_windows_are_worked_out_once(models):
    aligner = A.Aligner(models)
    aligner.batch(["the cat and the dog and the cat"])
    known = len(aligner._texts)
    aligner.batch(["and the cat and the dog"])
    assert known <= 5 and len(aligner._texts) <= known + 1


def test_random_texts(models, plain):
    draw = random.Random(11)
    aligner = A.Aligner(models)
    for _ in range(150):
        text = "".join(draw.choice("ab ei  n'.,-1\nß漢😀▁tTh") for _ in range(draw.randrange(1, 40)))
        a, b, ends_a, ends_b = plain(text)
        got = aligner.batch([text]).group_ends()
        assert got[0].tolist() == [ends_a.index(e) + 1 for e in sorted(set(ends_a) & set(ends_b))]


def test_empty_table_and_other_columns(spark, documents, models):
    assert A.scored(documents([]), models).count() == 0
    df = documents([(1, "a b")]).withColumn("block", F.lit("x")).withColumn("links", F.lit(1))
    assert [r.n_groups for r in A.scored(df, models).collect()] == [2]
    assert A.groups(df, models).columns == ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"]


def test_known_words_are_not_tokenized_again(models):
    aligner = A.Aligner(models)
    aligner.batch(["the cat and the dog", None])
    seen = []
    tokens = aligner.tokens
    aligner.tokens = lambda texts: seen.extend(texts) or tokens(texts)
    found = aligner.batch(["dog and cat", "the bird"])
    assert "".join(seen).split() in (["bird"], ["dog", "bird"])  # the first word of a text is a window like any other
    assert len(found.group_ends()[0]) and found.window_range().tolist() == [0, 3, 5]


def test_windows_do_not_depend_on_what_surrounds_them(models):
    split, whole = A.Aligner(models), A.Aligner(models)
    whole._split = False
    points = [*map(chr, [*range(1, 0x3100), *range(0x3100, 0xD800, 0x61), *range(0xE000, 0x110000, 0x301)])]
    texts = [f"a{c} b{c}  {c}c {c} {c} '{c}s {c}" for c in points] + [None, "", " ", "a ", " a", "▁", "a ▁ b", "a▁b c"]
    for at in range(0, len(texts), 500):
        one, other = (x.batch(texts[at:at + 500]) for x in (split, whole))
        for name in ("a", "b", "first_a", "first_b"):
            assert getattr(one, name).tolist() == getattr(other, name).tolist(), at
        for k in (0, 1):
            assert one.group_ends()[k].tolist() == other.group_ends()[k].tolist(), at
        joined = [[";".join(x.texts[i:j]) for i, j in zip(x.window_range(), x.window_range()[1:])] for x in (one, other)]
        assert joined[0] == joined[1], at
