import hashlib
import random

import pytest

from argosift.llm import fingerprint as P


def brute(rows):
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        edited = P.edited_text(t, following)
        a, b, c = P.Fingerprint(t), P.Fingerprint(edited), P.Fingerprint(following)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), a.likeness(b), a.likeness(c)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in P.with_following(df).collect()), key=str)


@pytest.mark.parametrize("parts", ["1", "8", "31"])
def test_matches_brute_force(corpus, spark, parts):
    df, rows = corpus
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert result(df.repartition(5)) == brute([(r.doc_id, r.text) for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edge_cases(documents):
    long = "é ü 漢 " * 60_000
    for rows in ([(7, "only one")], [(1, None), (2, "")], [(3, "a"), (3, "a"), (3, "b"), (5, long), (-1, "x\ny")],
                 [(None, "n"), (None, "m"), (4, "four")], []):
        assert result(documents(rows)) == brute(rows)


def test_order_of_paragraphs_does_not_matter():
    parts = [f"paragraph {i} with some words" for i in range(9)] * 2
    mixed = random.Random(1).sample(parts, len(parts))
    assert P.Fingerprint("\n".join(parts)) == P.Fingerprint("\n\n".join(mixed))
    assert P.Fingerprint("\n".join(parts)) != P.Fingerprint("\n".join(parts[:-1]))


def test_insertion_and_deletion():
    a = P.Fingerprint("one two three four\nfive six seven").insert("eight nine ten").delete("one two three four")
    assert a == P.Fingerprint("eight nine ten\nfive six seven") and a.delete("eight nine ten\nfive six seven").hex().strip("0") == ""


def test_likeness_follows_the_edit(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 500")
    rows = P.with_following(df).collect()
    edited = sum(r.near_edited for r in rows) / len(rows)
    following = sum(r.near_next for r in rows) / len(rows)
    assert 0.35 < edited < 0.7 and following < 0.15
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
