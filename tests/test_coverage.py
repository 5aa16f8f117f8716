"""The README names a query for every operator and only queries that exist."""

import os
import re

import __spark_entry__ as E

README = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")


def test_readme_names_existing_queries():
    table = open(README).read().split("## Queries by operator")[1]
    names = set(re.findall(r"`([a-z]\d+_\w+\*?)`", table))
    known = {k for k in E.queries() if re.match(r"[a-z]\d", k)}
    for n in names:
        assert any(k.startswith(n[:-1]) for k in known) if n.endswith("*") else n in known, n
    listed = {k for k in known if k in names or any(n.endswith("*") and k.startswith(n[:-1]) for n in names)}
    assert known - listed <= {"k11_rules_log_default_window"}


def test_every_operator_is_named():
    table = open(README).read().split("## Queries by operator")[1]
    ids = set(re.findall(r"\b([A-K]\d+)\b", table)) | {f"H{i}" for i in range(13, 18)}
    want = {f"{c}{i}" for c, n in (("A", 16), ("B", 26), ("C", 19), ("D", 24), ("E", 11), ("F", 10), ("G", 5),
                                   ("H", 48), ("I", 13), ("K", 24)) for i in range(1, n + 1)}
    assert want <= ids, sorted(want - ids)
