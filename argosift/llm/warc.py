"""WARC archives written and read as chunk rows.

A payload is never handled as one value once it has left its row: it is cut into rows of (record, chunk number) of at
most ``chunk_bytes``, which the writer streams into a gzip member while it carries the SHA-1 of what has passed, and
the reader gives back chunk by chunk with running length and digest. Equal payloads of ``least`` bytes or more are
stored once: the record with the largest page_id is the response, the others are revisits that refer to it.

Tasks write archives of their own under names that no other attempt uses, and report them in a manifest table that
Spark commits; a file of a lost or repeated attempt is in no manifest and is never read. Files are opened through
``pyarrow.fs`` below the shared folder, so the folder may be local to all machines, HDFS or an object store.

Defined cases: null html is an empty payload; repeated rows give repeated records, all responses if their id is the
largest; a null page_id is smaller than any other; control characters in urls are percent-encoded in headers; an empty
table gives an empty manifest; other columns are not read. A damaged payload raises an error when it is read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from argosift.session import cut, new_path

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_URN = "urn:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file name with or without a scheme."""
    name = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)


def payload_rows(pages: DataFrame, least: int = 1000, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows (page_id, url, refers_to, payload_bytes, payload_digest, chunk_no, chunk), a record's rows in order."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    equal = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    chunk = F.expr(f"""explode(transform(sequence(0, greatest(cast(ceil(payload_bytes / {chunk_bytes}) as int), 1) - 1),
        i -> struct(i as chunk_no, substring(payload, i * {chunk_bytes} + 1, {chunk_bytes}) as chunk)))""")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return rows.join(equal, ["payload_digest", "payload_bytes"], "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", refers.cast("string").alias("refers_to"),
        "payload_bytes", "payload_digest", chunk.alias("part")).select(
        "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "part.*")


def _head(page_id, url, refers_to, n_bytes, digest) -> bytes:
    def urn(value) -> str:
        return f"<{_URN}{quote(value or '', safe='')}>"

    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {_DATE}",
             "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: quote(m[0], safe=""), url or ""),
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {_REVISIT}"]
    size = len(_HTTP) + (n_bytes if refers_to is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _HTTP


def write(pages: DataFrame, folder: str, least: int = 1000, chunk_bytes: int = CHUNK) -> DataFrame:
    """Writes archives below ``folder``; returns the manifest (archive, records), already written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records, path = None, 0, ""
        pack = sha = None
        want = ""

        def close() -> None:
            if pack is not None:
                if sha is not None and sha.hexdigest() != want:
                    raise ValueError("payload chunks do not add up to their digest")
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            chunks = batch.column(6)
            for i, (page_id, url, refers_to, n_bytes, digest, chunk_no) in enumerate(zip(*columns)):
                if out is None:
                    system, base = opened(folder)
                    system.create_dir(base, recursive=True)
                    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(opened(path)[1], compression=None)
                if chunk_no == 0:
                    close()
                    # One gzip member per record, so that records can be read alone.
                    pack, records, want = zlib.compressobj(6, zlib.DEFLATED, 31), records + 1, digest
                    sha = hashlib.sha1() if refers_to is None else None
                    out.write(pack.compress(_head(page_id, url, refers_to, n_bytes, digest)))
                if sha is not None:
                    part = chunks[i].as_buffer()
                    sha.update(part)
                    out.write(pack.compress(part))
        if out is not None:
            close()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": pa.array([records], pa.int64())})

    return cut(payload_rows(pages, least, chunk_bytes).mapInArrow(run, "archive string, records long"))


def _records(stream: io.BufferedReader, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of an archive: the last row of a record has its whole length and digest."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.lower()] = value.strip()

        def named(field: str) -> str | None:
            value = head.get(field)
            return None if value is None else unquote(value.strip("<>").removeprefix(_URN)) or None

        left = int(head["content-length"])
        while (line := stream.readline()) not in (b"\r\n", b""):
            left -= len(line)
        left -= len(line)
        kind, declared = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        common = named("warc-record-id"), unquote(head["warc-target-uri"]), kind, named("warc-refers-to")
        if kind == "revisit":
            yield *common, 0, None, int(head["x-payload-length"]), declared, True
        else:
            sha, seen, number = hashlib.sha1(), 0, 0
            while True:
                part = stream.read(min(chunk_bytes, left))
                sha.update(part)
                left, seen = left - len(part), seen + len(part)
                last = left == 0 or not part
                if last and (left or sha.hexdigest() != declared):
                    raise ValueError(f"damaged payload of record {common[0]}")
                yield *common, number, part, seen, sha.hexdigest(), last
                number += 1
                if last:
                    break
        stream.read(4)


def read(manifest: DataFrame, payloads: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives: page_id, url, record_type, refers_to, chunk_no, chunk, payload_bytes and
    payload_digest up to and with this chunk, last. Without ``payloads`` only the last row of a record, without chunk.
    """
    kinds = [("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
             ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("last", pa.bool_())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)],
                                          names=[name for name, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = opened(archive)
                rows, held = [], 0
                with system.open_input_file(path) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for row in _records(io.BufferedReader(plain, 1 << 16), chunk_bytes):
                        if not payloads:
                            if not row[-1]:
                                continue
                            row = (*row[:5], None, *row[6:])
                        rows.append(row)
                        held += len(row[5] or b"") + 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    archives = manifest.select("archive")
    return archives.repartition(max(1, archives.count()), "archive").mapInArrow(
        run, "page_id string, url string, record_type string, refers_to string, chunk_no int, chunk binary, "
             "payload_bytes long, payload_digest string, last boolean")


def round_trip(pages: DataFrame, least: int = 1000, chunk_bytes: int = CHUNK) -> DataFrame:
    """Writes archives in the shared folder, reads them back and returns one row per record."""
    folder = new_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    found = read(write(pages, folder, least, chunk_bytes), payloads=False)
    return found.where("last").select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
