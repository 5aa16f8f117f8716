"""Data source ``growing_lines``: lines of text files that others append to, rotate and truncate.

As a stream, its position is a byte per file. Only whole lines are taken, so a line that is being written waits for its
end. New bytes are read in ranges of ``split_bytes`` side by side; a range owns the lines that begin in it. A file is
known by a digest of its first bytes, not by its name: a rotated file goes on under its new name (which ``path`` must
cover, as in ``app.log*``) and the new file of the old name begins at its start, as does a truncated one. Each line comes
once; a restart reads the same ranges again by these digests.

As a batch source it gives the last ``lines`` lines of every file, found backwards from its end, or all lines.

Files are listed on the driver, one entry per file, and opened with Arrow's file systems, so ``path`` may be local to all
machines or on HDFS, S3 or GCS. Lines are decoded as UTF-8 with replacement marks; blank lines are kept. What was never
read from a file that is deleted is lost.
"""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, position long, line string"
_HEAD = 256
_CHUNK = 1 << 16


def _resolved(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str):
    """The file system, and the files that a path with wild cards in its last part stands for."""
    from pyarrow import fs
    system, where = _resolved(path)
    folder, name = posixpath.split(where)
    if system.get_file_info(where).type == fs.FileType.Directory:
        folder, name = where, "*"
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return system, sorted((f.path, f.size) for f in found
                          if f.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(f.path), name))


def _read(system, path: str, at: int, size: int) -> bytes:
    with system.open_input_file(path) as f:
        f.seek(at)
        return f.read(size)


def _digest(head: bytes) -> str:
    return hashlib.sha256(head).hexdigest()[:32]


def _whole(system, path: str, size: int, least: int = 0) -> int:
    """End of the last whole line of a file, looked for backwards; ``least`` if there is none after it."""
    at = size
    while at > least:
        start = max(least, at - _CHUNK)
        found = _read(system, path, start, at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return least


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of the file whose first ``head_size`` bytes have the digest ``head``."""

    path: str
    head: str
    head_size: int
    first: int  # where the unread part of the file begins: a line starts here
    start: int
    end: int


class GrowingStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self._known: list[dict] = []

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        system, files = _files(self.path)
        now = []
        for path, size in files:
            head = _read(system, path, 0, min(size, _HEAD))
            before = next((k for k in self._known if k["head_size"] <= len(head)
                           and _digest(head[:k["head_size"]]) == k["head"] and k["end"] <= size), None)
            end = _whole(system, path, size, before["end"] if before else 0)
            if end:
                kept = head[:min(end, _HEAD)]
                now.append({"path": path, "head": _digest(kept), "head_size": len(kept), "end": end})
        self._known = now
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # After a restart the position comes from the stream's own log.
        self._known = self._known or end["files"]
        system, _ = _files(self.path)
        out = []
        for file in end["files"]:
            first = 0
            for k in start["files"]:
                if k["end"] <= file["end"] and k["head_size"] <= file["head_size"]:
                    where = _locate(system, self.path, file["path"], file["head"], file["head_size"])
                    if where and _digest(_read(system, where, 0, k["head_size"])) == k["head"]:
                        first = max(first, k["end"])
            for at in range(first, file["end"], self.split_bytes):
                out.append(Range(file["path"], file["head"], file["head_size"], first, at,
                                 min(at + self.split_bytes, file["end"])))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = _files(self.path)
        where = _locate(system, self.path, partition.path, partition.head, partition.head_size)
        return _lines(system, where, partition) if where else iter(())

    def commit(self, end: dict) -> None:
        pass


def _locate(system, pattern: str, path: str, head: str, head_size: int) -> str | None:
    """Where the file with this head is now: at its place, or under another name after a rotation."""
    others = [p for p, size in _files(pattern)[1] if p != path and size >= head_size]
    for candidate in [path, *others]:
        try:
            if _digest(_read(system, candidate, 0, head_size)) == head:
                return candidate
        except FileNotFoundError:
            continue
    return None


def _lines(system, path: str, part: Range) -> Iterator[tuple]:
    """The lines that begin in a range."""
    with system.open_input_file(path) as f:
        at = part.start
        f.seek(at if at == part.first else at - 1)
        rest = b""
        if at != part.first:
            # A line begins here only if the byte before ends one.
            at -= 1
            while True:
                chunk = f.read(_CHUNK)
                found = chunk.find(b"\n")
                if found >= 0:
                    at += found + 1
                    rest = chunk[found + 1:]
                    break
                if not chunk:
                    return
                at += len(chunk)
        while at < part.end:
            found = rest.find(b"\n")
            if found < 0:
                chunk = f.read(_CHUNK)
                if not chunk:
                    return
                rest += chunk
                continue
            yield path, at, rest[:found].rstrip(b"\r").decode("utf-8", "replace")
            at += found + 1
            rest = rest[found + 1:]


class LastLines(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.lines = int(options["lines"]) if "lines" in options else None

    def partitions(self) -> list[InputPartition]:
        _, files = _files(self.path)
        return [Range(path, "", 0, 0, 0, size) for path, size in files if size] or [Range("", "", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.end:
            return
        system, _ = _files(self.path)
        first = 0 if self.lines is None else self._start(system, partition)
        end = partition.end
        last = _read(system, partition.path, end - 1, 1)
        yield from _lines(system, partition.path, Range(partition.path, "", 0, first, first, end))
        if last != b"\n" and self.lines != 0:
            # The last line has no end yet.
            begin = _whole(system, partition.path, end, first)
            yield partition.path, begin, _read(system, partition.path, begin, end - begin).decode("utf-8", "replace")

    def _start(self, system, part: Range) -> int:
        """Where the last ``lines`` lines of a file begin; reads backwards no further than there."""
        wanted, at = self.lines, part.end
        if wanted <= 0:
            return part.end
        # The end of the last line is not the start of another one.
        skip = _read(system, part.path, part.end - 1, 1) == b"\n"
        while at > 0:
            start = max(0, at - _CHUNK)
            chunk = _read(system, part.path, start, at - start)
            stop = len(chunk)
            if skip:
                stop, skip = stop - 1, False
            while (found := chunk.rfind(b"\n", 0, stop)) >= 0:
                wanted -= 1
                if not wanted:
                    return start + found + 1
                stop = found
            at = start
        return 0


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LastLines(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingStream(dict(self.options))


def follow(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """A stream of (path, position, line) of files that grow."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", path).option("split_bytes", split_bytes).load()


def last_lines(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """The last lines of every file as (path, position, line)."""
    spark.dataSource.register(GrowingLines)
    return spark.read.format("growing_lines").option("path", path).option("lines", lines).load()


def append_files(folder: str, path: str) -> None:
    """Appends the text files of a folder to one file, as the writer of a log does; bytes are copied in pieces."""
    system, files = _files(folder)
    _, where = _resolved(path)
    system.create_dir(posixpath.dirname(where), recursive=True)
    with system.open_append_stream(where) as out:
        for name, size in files:
            if posixpath.basename(name)[0] in "._":
                continue
            for at in range(0, size, _CHUNK):
                out.write(_read(system, name, at, _CHUNK))


def rotate(path: str, to: str) -> None:
    """Renames a log file; its writer goes on with a new one."""
    (system, where), (_, target) = _resolved(path), _resolved(to)
    system.move(where, target)
