"""Canonical content hashes and chain links."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from argosift import constants as C

# Stands for null inside a joined text, so that null and empty differ.
NULL_MARK = "\u0000"


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields as text, in the given order, joined with ``|``."""
    parts = [F.coalesce(f.cast("string"), F.lit(NULL_MARK)) for f in fields]
    return F.sha2(F.concat_ws("|", *parts), 256)


def map_hash(payload: Column) -> Column:
    """SHA-256 of a map written as JSON with its keys in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(payload)))
    return F.sha2(F.to_json(ordered), 256)


def canonical_json(payload: Column) -> Column:
    """JSON text with the keys in order at every level, whatever their order in ``payload`` (JSON text).

    A variant keeps the fields of an object sorted, also inside lists and other objects. Null for text that is no JSON.
    """
    return F.to_json(F.try_parse_json(payload))


def payload_hash(payload: Column) -> Column:
    """SHA-256 of nested JSON text that does not depend on the order of its keys; other text is hashed as it is."""
    return F.sha2(F.coalesce(canonical_json(payload), F.concat(F.lit("text:"), payload), F.lit(NULL_MARK)), 256)


def genesis() -> Column:
    return F.sha2(F.lit(C.GENESIS), 256)


def link(previous: Column, content: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit(":"), content), 256)


def link_text(previous: str, content: str) -> str:
    """:func:`link` of two texts."""
    return hashlib.sha256(f"{previous}:{content}".encode()).hexdigest()
