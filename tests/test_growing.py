"""Files that grow, are rotated and truncated: every line once; last lines from the end."""

import os

import pytest

from argosift.session import new_path
from argosift.sources import growing as G
from argosift.streaming import jobs as J


def lines_of(k, n):
    return "".join(f"delivery {k} line {i} é\n" for i in range(n)).encode()


def collected(spark, out):
    return sorted(r[0] for r in spark.read.parquet(out).select("line").collect())


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_growing_and_rotated_file_gives_each_line_once(spark, tmp_path, split):
    log, out, cp = tmp_path / "app.log", new_path(spark, "out"), new_path(spark, "cp")
    want = []

    def read():
        J.append_to(G.follow(spark, f"{tmp_path}/app.log*", split), out, cp)
        assert collected(spark, out) == sorted(want)

    def add(raw, *lines):
        with open(log, "ab") as f:
            f.write(raw)
        want.extend(lines)

    add(lines_of(1, 20), *lines_of(1, 20).decode().splitlines())
    read()
    add(b"begun but not", )
    read()
    add(b" ended\r\n\n" + lines_of(2, 5), "begun but not ended", "", *lines_of(2, 5).decode().splitlines())
    read()
    add(lines_of(3, 7), *lines_of(3, 7).decode().splitlines())
    os.rename(log, f"{log}.1")  # with lines that were not read yet
    add(b"new file\n" * 2, "new file", "new file")
    read()
    log.write_bytes(b"truncated and begun anew \xff\n")
    want.append("truncated and begun anew �")
    read()
    read()


def test_positions_tell_lines_apart(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x\nx\nyy\n")
    out = new_path(spark, "out")
    J.append_to(G.follow(spark, f"{tmp_path}/*.log", 3), out, new_path(spark, "cp"))
    assert sorted(tuple(r)[1:] for r in spark.read.parquet(out).collect()) == [(0, "x"), (2, "x"), (4, "yy")]


@pytest.mark.parametrize("n", [0, 1, 3, 100, 5000])
def test_last_lines(spark, tmp_path, n):
    files = {"a.log": lines_of(1, 3000), "b.log": b"one\ntwo\nopen end", "c.log": b"", "d.log": b"\n\nz\n"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {}
    for r in G.last_lines(spark, f"{tmp_path}/*.log", n).orderBy("path", "position").collect():
        got.setdefault(os.path.basename(r["path"]), []).append(r["line"])
    want = {name: raw.decode().removesuffix("\n").split("\n")[-n:] if n else [] for name, raw in files.items() if raw}
    assert got == {k: v for k, v in want.items() if v}


def test_no_files(spark, tmp_path):
    assert G.last_lines(spark, f"{tmp_path}/*.log", 5).count() == 0
