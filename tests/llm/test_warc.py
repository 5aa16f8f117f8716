import gzip
import hashlib

import pytest
from pyspark.sql import types as T

from argosift.llm import warc
from argosift.session import new_path

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("html", T.StringType()), T.StructField("record_type", T.StringType())])


def brute(rows):
    best = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        original = best.get(data)
        revisit = original is not None and original != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                    original if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_round_trip_matches_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    copies = df.union(df.where("page_id % 3 = 0").selectExpr("page_id + 100000", "url", "html"))
    rows = [tuple(r) for r in copies.collect()]
    assert result(warc.round_trip(copies)) == brute(rows)


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_edge_cases_in_any_chunk_size(spark, chunk):
    long = "é<p>\r\n\r\nWARC/1.1\r\n" * 400
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, None), (4, "x\r\ny z%41", ""), (5, "u", "kurz"),
            (6, "u", "kurz"), (7, "u", long + "!"), (None, "u", long), (9, "", "x" * 999), (10, "", "x" * 999)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    assert result(warc.round_trip(df, chunk_bytes=chunk)) == brute(rows)
    manifest = warc.write(df, new_path(spark, "warc-test"), chunk_bytes=chunk)
    chunks = {}
    for r in warc.read(manifest, chunk_bytes=chunk).collect():
        if r.record_type == "response":
            assert len(r.chunk) <= chunk
            chunks.setdefault((r.page_id, r.url), {})[r.chunk_no] = r.chunk
    texts = {k: b"".join(v[i] for i in sorted(v)).decode() for k, v in chunks.items()}
    assert texts[("2", "http://a/2")] == long and texts[("4", "x\r\ny z%41")] == "" and texts[("7", "u")] == long + "!"


def test_archives_are_plain_warc(spark):
    df = spark.createDataFrame([(1, "http://a", "<p>x</p>", None)], PAGES)
    manifest = warc.write(df, new_path(spark, "warc-test")).collect()
    system, path = warc.opened(manifest[0].archive)
    data = gzip.decompress(system.open_input_file(path).read())
    head, _, block = data.partition(b"\r\n\r\n")
    size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b":")[1])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and len(block) == size + 4
    assert block.endswith(b"\r\n\r\n<p>x</p>\r\n\r\n")


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "http://a", "<p>hello</p>", None)], PAGES)
    manifest = warc.write(df, new_path(spark, "warc-test"))
    system, path = warc.opened(manifest.first().archive)
    data = gzip.decompress(system.open_input_file(path).read()).replace(b"hello", b"hallo")
    with system.open_output_stream(path, compression=None) as out:
        out.write(gzip.compress(data))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(manifest).collect()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
