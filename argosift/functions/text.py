"""Text columns: keyword tests, counts, ratios, extractions, entropy."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from argosift import constants as C

# Unicode white space, written so that Java and RE2 agree.
SPACE_CLASS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
# Letters and digits as Unicode properties (upper case and digits include the
# circled, Roman and superscript forms).
UPPER_CLASS = (r"\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}"
               r"\x{1F170}-\x{1F189}")
DIGIT_CLASS = (r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
               r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
               r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
               r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}")
ALNUM_CLASS = r"\p{L}\p{N}"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True when any of the words occurs (a byte search per word, the fastest test)."""
    return any_of(col.contains(w) for w in words)


def contains_any_once(col: Column, words: Iterable[str]) -> Column:
    """The same test as one pattern: for filters that are pushed below a costly column."""
    return col.rlike("|".join(re.escape(w) for w in words))


def _alternatives(pattern: str) -> list[str]:
    """The pattern split at its top-level ``|``."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def _leading_text(pattern: str) -> str:
    """The plain characters a match of the pattern must begin with."""
    n = re.match(r"[A-Za-z0-9 _/\-]*", pattern).end()
    if n < len(pattern) and pattern[n] in "?*+{":
        n -= 1
    return pattern[:n]


def matches(col: Column, pattern: str, lowered: Column | None = None) -> Column:
    """Case-insensitive pattern test.

    Plain alternatives become byte searches; others run only where the text holds
    their leading characters, which a byte search rules out far more cheaply.
    """
    low = F.lower(col) if lowered is None else lowered
    tests = []
    for alt in _alternatives(pattern):
        head = _leading_text(alt)
        if head == alt:
            tests.append(low.contains(alt.lower()))
        elif len(head) > 2:
            tests.append(low.contains(head.lower()) & col.rlike("(?i)" + alt))
        else:
            tests.append(col.rlike("(?i)" + alt))
    return any_of(tests)


def matches_any(col: Column, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    if ignore_case:
        return any_of(matches(col, p) for p in patterns)
    return any_of(col.rlike(p) for p in patterns)


def first_label(tests: Iterable[tuple[Column, object]], default: object) -> Column:
    """Value of the first test that holds, else ``default``."""
    chain = None
    for test, value in tests:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    otherwise = default if isinstance(default, Column) else F.lit(default)
    return otherwise if chain is None else chain.otherwise(otherwise)


def labels(tests: Iterable[tuple[Column, object]]) -> Column:
    """Array of the values of every test that holds, in order."""
    items = [F.when(t, v if isinstance(v, Column) else F.lit(v)) for t, v in tests]
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def lookup(key: Column, table: dict, default) -> Column:
    """Constant table lookup with a default."""
    return first_label(((key == F.lit(k), v) for k, v in table.items()), default)


def flag(test: Column) -> Column:
    """1.0 where the test holds, else 0.0 (null counts as not holding)."""
    return F.when(test, 1.0).otherwise(0.0)


def word_count(col: Column) -> Column:
    """Runs of non-space characters; each becomes one mark and the marks are counted."""
    marks = F.regexp_replace(F.regexp_replace(col, f"[^{SPACE_CLASS}]+", "x"), f"[{SPACE_CLASS}]+", "")
    return F.length(marks)


def _share_kept(col: Column, dropped: str, dropped_ascii: str) -> Column:
    """Share of characters left after dropping runs of a character class.

    Plain ASCII text (as many bytes as characters) takes a class without Unicode tables.
    """
    n = F.length(col)
    plain = F.octet_length(col) == n
    kept = F.when(plain, F.length(F.regexp_replace(col, f"{dropped_ascii}+", ""))).otherwise(
        F.length(F.regexp_replace(col, f"{dropped}+", "")))
    return kept / F.greatest(n, F.lit(1))


def uppercase_ratio(col: Column) -> Column:
    return _share_kept(col, f"[^{UPPER_CLASS}]", "[^A-Z]")


def digit_ratio(col: Column) -> Column:
    return _share_kept(col, f"[^{DIGIT_CLASS}]", "[^0-9]")


def special_ratio(col: Column) -> Column:
    return _share_kept(col, f"[{ALNUM_CLASS} ]", "[A-Za-z0-9 ]")


def entropy_bits(col: Column) -> Column:
    """Shannon entropy of the characters, in bits.

    log2(n) - sum(c log2 c) / n over the character counts c. Sorting the characters
    turns counts into run lengths; characters that occur once add nothing.
    """
    n = F.length(col)
    in_order = F.array_join(F.sort_array(F.split(col, "")), "")
    runs = F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1+"), F.lit(0))
    total = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * F.log2(F.length(r)))
    return F.when(n < 2, 0.0).otherwise(F.log2(n) - total / n)


def entropy(col: Column) -> Column:
    """Entropy scaled by 6.6 bits and capped at 1."""
    return F.least(entropy_bits(col) / F.lit(C.ENTROPY_BITS), F.lit(1.0))


def ip_list(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(C.IP_ADDRESS), F.lit(0))


def port_list(col: Column) -> Column:
    """Ports written as ``port N`` or ``:NN``, as text."""
    mentions = F.regexp_extract_all(col, F.lit(C.PORT_MENTION), F.lit(0))
    return F.regexp_extract_all(F.array_join(mentions, " "), F.lit(r"\d+"), F.lit(0))


def path_list(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(C.PATH_MENTION), F.lit(0))


def fenced_json(col: Column) -> Column:
    """Body of the first fenced block, or the text itself when there is none."""
    block = F.regexp_extract(col, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(col.contains("```"), F.trim(block)).otherwise(F.trim(col))


def fixed(value: Column, digits: int) -> Column:
    """Number with fixed decimals, ties to even and without digit grouping."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value, F.lit(pattern))
