"""Rule tables against testing every line with every pattern; process trees of any depth."""

import random
import re

import pytest

from argosift.operators import detect as D, snapshots as N


@pytest.mark.parametrize("pattern,words", [
    ("failed password", {"failed password"}), ("(error|warning): disk", {": disk"}), ("(error|warning)", {"error", "warning"}),
    ("a?b*retry+x", {"retr"}), (r"\d+\.\d+", None), ("(session)?", None), ("(?:ab|session)", None), ("x{2,}timeout", {"timeout"}),
    ("[Ff]ailed", {"ailed"}), (r"\buser\b.*root", {"user", "root"}), ("(unclosed", None), (r"\p{L}+abc", None), ("İstanbul", {"stanbul"})])
def test_required_literals(pattern, words):
    got = D.required_literals(pattern)
    assert (got is None) == (words is None) and (words is None or got <= words and got)


def rows(spark, lines):
    return spark.createDataFrame([(i, "h", t) for i, t in enumerate(lines)], "event_id long, host_id string, line string").selectExpr(
        "*", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, event_id) as ts")


def test_two_thousand_patterns_equal_the_theta_join(spark):
    draw = random.Random(4)
    syllables = ["ses", "sion", "err", "or", "fail", "ed", "pass", "word", "root", "10", "4444", "ssh", "kernel", "é"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))
    patterns = [draw.choice([word(), f"{word()} {word()}", f"({word()}|{word()})", f"{word()}[0-9]+", f"^{word()}.*{word()}$",
                             f"({word()})?{word()}"]) for _ in range(1990)] + [r"[0-9]{4}", r"\bor\b", "s{2}", "[a-f]{3}", ".",
                                                                                "^$", "(fail|ed)", "é+", r"\S+ \S+ \S+", "x"]
    lines = [" ".join(word() for _ in range(draw.randrange(0, 6))) for _ in range(60)] + ["", "SESSION Error ROOT", None]
    rules = spark.createDataFrame([(f"r{k}", p, 0.5, 0, 1) for k, p in enumerate(patterns)], D.RULE_TABLE)
    got = D.match_rule_table(rows(spark, lines), rules, "line", part_rules=700)
    want = sorted((i, f"r{k}") for i, t in enumerate(lines) if t is not None for k, p in enumerate(patterns)
                  if re.search(p, t, re.I | re.A))
    assert sorted((r["event_id"], r["rule_id"]) for r in got.collect()) == want


def test_no_rules_and_repeated_occurrences(spark):
    df = rows(spark, ["refused", "ok", "Refused", "refused"])
    assert D.match_rule_table(df, spark.createDataFrame([], D.RULE_TABLE), "line").count() == 0
    rules = spark.createDataFrame([("n", "refused", 0.5, 2, 2)], D.RULE_TABLE)
    got = D.match_rule_table(df, rules, "line").select("event_id", "occurrences")
    assert sorted(map(tuple, got.collect())) == [(2, 2), (3, 2)]


def test_deep_path_and_cycle_end_in_few_rounds(spark, monkeypatch):
    n = 10_000
    path = [("a", i, i - 1 if i else None, f"p{i}") for i in range(n)]
    ring = [("b", i, (i + 1) % 500, "r") for i in range(500)]
    df = spark.createDataFrame(path + ring, "host_id string, pid long, ppid long, name string")
    rounds = []
    cut = N.cut
    monkeypatch.setattr(N, "cut", lambda x: rounds.append(1) or cut(x))
    got = N.descendants(df, 3)
    assert {(r["host_id"], r["pid"], r["depth"]) for r in got.collect()} == {("a", i, i - 3) for i in range(3, n)} | {
        ("b", i, (3 - i) % 500) for i in range(500)}
    assert len(rounds) < 20


def test_trees_with_missing_parents_and_shared_pids(spark):
    df = spark.createDataFrame([("a", 1, None, "init"), ("a", 2, 1, "x"), ("a", 3, 99, "orphan"), ("a", 4, 3, "below"),
                                ("b", 1, 7, "init"), ("b", 2, 1, "y"), ("b", 2, 1, "y again"), ("c", 5, 5, "self")],
                               "host_id string, pid long, ppid long, name string")
    got = sorted((r["host_id"], r["pid"], r["name"], r["depth"]) for r in N.descendants(df, 1).collect())
    assert got == [("a", 1, "init", 0), ("a", 2, "x", 1), ("b", 1, "init", 0), ("b", 2, "y", 1), ("b", 2, "y again", 1)]
    assert N.descendants(df.where("false"), 1).count() == 0
