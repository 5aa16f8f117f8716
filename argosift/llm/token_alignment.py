"""Alignment of the tokens of two tokenizers over the same text.

A text is tokenised whole by both: byte-level BPE (A) over a space and the text, and a piece model (B), which adds the
space itself. Both token rows spell the same bytes. Byte offsets where tokens of both end cut them into groups, and the
two tokens that end there are linked.

Words start alike in both vocabularies, with a token that begins with a space. So the alignment is anchored there: a
single space between two characters that are no white space splits the text into windows, a word long. A's pattern
starts a new match at such a space, and no piece of B holds the mark behind another character (a model that has such
pieces gets whole texts as windows), so both tokenizers end a token before it whatever stands around. The tokens and
groups of a window then depend on its own characters only: they are worked out once and remembered by its text, and
groups never cross a window's border, as the border is a shared end. Texts are taken in batches, whose new windows are
tokenized together; token rows are laid end to end, and offsets and sums are arrays over the batch.

``groups`` returns the tokens and where their groups end. ``scored`` counts links over the corpus. Documents are read
once: a block of documents (about ``block_links`` links) is written with its links as numbers into the block's table of
distinct id pairs. Pairs are summed over blocks, each pair learns its count and whether its B id has no greater one, and
that comes back to the block by a join, so no pair is repeated per occurrence. The pair that a third of all links share
is one row per block; the join on pairs may be split where blocks are many.

A task holds one batch, one block and at most ``_REMEMBERED`` windows; forgetting them changes no result.

Defined cases: null and empty texts, and texts that one of the tokenizers does not spell as they are (the piece model's
own space mark, for one), have no tokens: zeros and an empty digest; strings of special tokens are plain text; repeated
rows give repeated results, and their links count each time; null ids are kept; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from argosift.llm.bpe_trie import _bytes
from argosift.session import cut

#: Fixed value: the pattern by which byte-level BPE of this kind splits text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MARK = "▁"
#: Python's white space includes all of the pattern's.
_BORDER = re.compile(r"(?<=\S) (?=\S)")
_REMEMBERED = 1 << 18  # windows, of 64 characters on average at most
_NONE = np.zeros(0, np.uint32)


@dataclass
class Models:
    """The two tokenizer files as they are shipped to tasks."""

    byte_json: str
    piece_model: bytes


def load(byte_tokenizer: str, piece_model: str) -> Models:
    """Reads both files; the first must hold byte-level BPE whose ids are in order of its merges."""
    with open(byte_tokenizer, encoding="utf-8") as f:
        source = f.read()
    with open(piece_model, "rb") as f:
        models = Models(source, f.read())
    spec = json.loads(source)
    vocab = spec["model"]["vocab"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
    split = spec["pre_tokenizer"]
    if (split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or spec["normalizer"]
            or spec["model"].get("end_of_word_suffix") or merged != sorted(merged)):
        raise ValueError("the first tokenizer must be byte-level BPE with ids in order of its merges")
    return models


class Aligner:
    """Both tokenizers and the windows met so far, in one task."""

    def __init__(self, models: Models):
        vocab = json.loads(models.byte_json)["model"]["vocab"]
        ranks = {_bytes(t): i for t, i in vocab.items()}
        self.a = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=models.piece_model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self._sizes = [np.array(list(map(len, table)), np.int64) for table in (self.a_bytes, self.b_bytes)]
        decimal = [str(i).encode() for i in range(max(map(len, self._sizes)))]
        self._digits = np.frombuffer(b"".join(d.ljust(8, b"\0") for d in decimal), "<u8")
        self._n_digits = np.array(list(map(len, decimal)), np.int64)
        crossing = re.compile(f"[^{_MARK}]{_MARK}")
        self._split = not any(crossing.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self._known: dict[str, int] = {}  # windows by their text, in order of their numbers
        self._length = 0  # characters of the windows known
        self._texts: list[str] = []
        # Per window, as 32-bit numbers: tokens of A, tokens of B, tokens of both up to the end of each group in turn.
        self._rows: list[list[bytes]] = [[], [], []]
        self._uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the windows met more than once since the last time, unless they fill most of the room."""
        keys = list(self._known)
        kept = np.flatnonzero(self._uses > 1).tolist()
        length = sum(len(keys[k]) for k in kept)
        if len(kept) >= _REMEMBERED // 2 or length >= 32 * _REMEMBERED:
            kept, length = [], 0
        self._known, self._length = {keys[k]: n for n, k in enumerate(kept)}, length
        self._texts = [self._texts[k] for k in kept]
        self._rows = [[rows[k] for k in kept] for rows in self._rows]
        self._uses = np.zeros(len(kept), np.int64)

    def tokens(self, batch: list[str | None]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Token ids of both tokenizers; none where the tokens do not spell the text."""
        texts = [t or "" for t in batch]
        rows_a = [self.a.encode_to_numpy(" " + t, disallowed_special=()) if t else _NONE for t in texts]
        rows_b = self.b.encode(texts, num_threads=1) if texts else []
        for i, t in enumerate(texts):
            spelled = (" " + t).encode() if t else b""
            # Byte-level tokens are made of the text's own bytes; their length tells whether all are there.
            if (b"".join(map(self.b_bytes.__getitem__, rows_b[i])) != spelled
                    or self._sizes[0][rows_a[i]].sum() != len(spelled)):
                rows_a[i], rows_b[i] = _NONE, []
        return rows_a, rows_b

    def _learn(self, windows: list[str], a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> None:
        """Works out the groups of new windows whose tokens lie end to end; a window that is not spelled has none."""
        ends_a, ends_b = (np.cumsum(size[ids]) for size, ids in zip(self._sizes, (a, b)))
        at = np.searchsorted(ends_b, ends_a)
        shared = np.flatnonzero(ends_b[np.minimum(at, len(b) - 1)] == ends_a) if len(b) else at
        to_a, to_b = shared + 1, at[shared] + 1
        from_a, from_b = (np.concatenate(([0], to[:-1])) if len(to) else to for to in (to_a, to_b))
        # Tokens with what follows them, each in eight bytes: those of A in a group, then those of B.
        places = [np.arange(len(a)) + np.repeat(from_b, to_a - from_a), np.arange(len(b)) + np.repeat(to_a, to_b - from_b)]
        written, length = np.zeros(len(a) + len(b), "<u8"), np.zeros(len(a) + len(b) + 1, np.int64)
        for place, ids, to, last in zip(places, (a, b), (to_a, to_b), b"|;"):
            mark = np.full(len(ids), ord(","), "<u8")
            mark[to - 1] = last
            written[place] = self._digits[ids] | mark << np.uint64(56)
            length[place + 1] = self._n_digits[ids] + 1
        text = written.tobytes().translate(None, b"\0").decode()
        upto = np.cumsum(length)[cuts_a + cuts_b].tolist()
        first = np.searchsorted(to_a, cuts_a, side="right")
        own = np.diff(first)
        ends = np.stack([to_a - np.repeat(cuts_a[:-1], own), to_b - np.repeat(cuts_b[:-1], own)], axis=1)
        number = len(self._texts)
        self._known.update(zip(windows, range(number, number + len(windows))))
        self._length += sum(map(len, windows))
        self._texts += [text[i:max(i, j - 1)] for i, j in zip(upto, upto[1:])]
        for rows, values, cuts in zip(self._rows, (a, b, ends), (4 * cuts_a, 4 * cuts_b, 8 * first)):
            raw, cuts = values.astype(np.int32).tobytes(), cuts.tolist()
            rows += [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def _learn_all(self, windows: list[str]) -> None:
        """New windows; those that may stand side by side in a text are tokenized as one."""
        alone, joined = ([], []) if self._split else (windows, [])
        if self._split:
            for w in windows:
                (alone if _MARK in w or w[0].isspace() or w[-1].isspace() else joined).append(w)
        if joined:
            (a,), (b,) = self.tokens([" ".join(joined)])
            if len(a):
                a, b = a.astype(np.int64), np.array(b, np.int64)
                starts = np.cumsum([0] + [len(w.encode()) + 1 for w in joined])
                self._learn(joined, a, b, *(np.searchsorted(np.cumsum(size[ids]), starts, side="right")
                                            for size, ids in zip(self._sizes, (a, b))))
            else:
                alone = windows
        if alone:
            rows = self.tokens(alone)
            self._learn(alone, *(np.fromiter(chain.from_iterable(x), np.int64) for x in rows),
                        *(np.cumsum([0] + [len(ids) for ids in x]) for x in rows))

    def batch(self, texts: list[str | None]) -> Batch:
        """Tokens, windows and groups of a batch of texts."""
        if len(self._known) > _REMEMBERED or self._length > 64 * _REMEMBERED:
            self.forget()
        split = _BORDER.split if self._split else lambda t: [t]
        parts = [split(t) if t else [] for t in texts]
        known = self._known
        self._learn_all([w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in known])
        numbers = [list(map(known.__getitem__, p)) for p in parts]
        uses = np.bincount(np.fromiter(chain.from_iterable(numbers), np.int64), minlength=len(self._texts))
        uses[:len(self._uses)] += self._uses
        self._uses = uses
        # A text with a window that is not spelled as it is has no tokens.
        spelled = self._rows[0]
        numbers = [row if all(map(spelled.__getitem__, row)) else [] for row in numbers]
        first = np.cumsum([0] + [len(row) for row in numbers])
        own = list(chain.from_iterable(numbers))
        (a, cuts_a), (b, cuts_b), (ends, cuts) = (_end_to_end([rows[n] for n in own]) for rows in self._rows)
        return Batch(a, b, cuts_a[first], cuts_b[first], cuts_a[:-1], cuts_b[:-1], first, [self._texts[n] for n in own],
                     ends.reshape(-1, 2), cuts // 2)


def _end_to_end(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 32-bit numbers laid end to end: all numbers, and where each row begins with the end."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    return np.frombuffer(b"".join(rows), np.int32), np.concatenate(([0], np.cumsum(sizes)))


@dataclass
class Batch:
    """Token rows of several texts laid end to end, with the windows that start at ``cuts_a`` and ``cuts_b``."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray  # first token of each text, and the end
    first_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    windows: np.ndarray  # first window of each text, and the end
    texts: list[str]  # groups of each window
    ends: np.ndarray  # per group, tokens of A and of B up to its end in its window
    first_group: np.ndarray  # first group of each window, and the end

    def window_range(self) -> np.ndarray:
        """First window of each text, and the end."""
        return self.windows

    def group_ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A and of B up to the end of every group, and the first group of every window with the end."""
        of_window = np.diff(self.first_group)
        return (self.ends[:, 0] + np.repeat(self.cuts_a, of_window), self.ends[:, 1] + np.repeat(self.cuts_b, of_window),
                self.first_group)


_made: dict[int, Aligner] = {}


def _aligner(models: Models) -> Aligner:
    """The tokenizers of a Python worker; built once."""
    key = hash((models.byte_json, models.piece_model))
    if key not in _made:
        _made.clear()
        _made[key] = Aligner(models)
    return _made[key]


def _lists(flat: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _chosen(docs: DataFrame, id_column: str, text: str) -> tuple[DataFrame, str]:
    chosen = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return chosen, chosen.schema["doc_id"].dataType.simpleString()


def groups(docs: DataFrame, models: Models, id_column: str = "doc_id", text: str = "text", rows: int = 128) -> DataFrame:
    """Rows (id, a_ids, b_ids, a_ends, b_ends): group k holds the tokens up to a_ends[k] and b_ends[k], from the last ends."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    chosen, kind = _chosen(docs, id_column, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        for part in (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)):
            found = aligner.batch(part.column(1).to_pylist())
            ends_a, ends_b, first = found.group_ends()
            of_text = first[found.window_range()]
            texts = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _lists(found.a, found.first_a), _lists(found.b, found.first_b),
                 _lists(ends_a - found.first_a[texts], of_text), _lists(ends_b - found.first_b[texts], of_text)],
                names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_ends", "b_ends"))
    return chosen.mapInArrow(run, f"doc_id {kind}, {lists}").withColumnRenamed("doc_id", id_column)


class _Block:
    """Documents gathered until they have enough links; a link is a number into the block's distinct pairs."""

    def __init__(self, number: int):
        self.number, self.parts, self.codes, self.links = number, [], [], 0

    def add(self, ids: pa.Array, found: Batch) -> None:
        ends_a, ends_b, first = found.group_ends()
        windows = found.window_range()
        digests = [hashlib.sha256(";".join(found.texts[i:j]).encode()).hexdigest() if j > i else ""
                   for i, j in zip(windows.tolist(), windows[1:].tolist())]
        self.codes.append(found.a[ends_a - 1].astype(np.int64) << 32 | found.b[ends_b - 1])
        self.parts.append((ids, np.diff(found.first_a), np.diff(found.first_b), np.diff(first[windows]), digests))
        self.links += len(ends_a)

    def row_batch(self) -> pa.RecordBatch:
        links, pairs = pd.factorize(np.concatenate(self.codes))
        n = np.bincount(links, minlength=len(pairs))
        ids = pa.concat_arrays([p[0] for p in self.parts])
        n_a, n_b, n_groups = (np.concatenate([p[k] for p in self.parts]).astype(np.int64) for k in (1, 2, 3))
        first = np.concatenate(([0], np.cumsum(n_groups)))
        last = np.concatenate((np.zeros(len(ids), np.int32), [len(pairs)]))  # the last row carries the table of pairs
        table = [_lists(x, last) for x in (pairs >> 32, pairs & 0xFFFFFFFF, n)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), self.number)), ids, pa.array(n_a), pa.array(n_b), pa.array(n_groups),
             pa.array([d for p in self.parts for d in p[4]], pa.string()), _lists(links, first), *table],
            names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pair_a", "pair_b", "pair_n"])


def _blocks(docs: DataFrame, models: Models, id_column: str, text: str, rows: int, block_links: int) -> DataFrame:
    """One row per document with its counts, digest and links; the last row of a block holds the block's pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    chosen, kind = _chosen(docs, id_column, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for part in (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)):
            block.add(part.column(0), aligner.batch(part.column(1).to_pylist()))
            if block.links >= block_links:
                yield block.row_batch()
                number += 1
                block = _Block(number)
        if block.parts:
            yield block.row_batch()

    return chosen.mapInArrow(run, f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
                                  "links array<int>, pair_a array<int>, pair_b array<int>, pair_n array<int>")


def pair_counts(block_pairs: DataFrame) -> DataFrame:
    """Rows (a, b, total, best): links of each id pair over all blocks, and whether no pair of its B id has more."""
    counts = cut(block_pairs.groupBy("a", "b").agg(F.sum("n").alias("total")))
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    return counts.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def scored(docs: DataFrame, models: Models, id_column: str = "doc_id", text: str = "text", rows: int = 128,
           block_links: int = 1 << 20) -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per document.

    ``n_best`` are links whose pair is the most frequent of its B id, ``count_sum`` sums the pair's count over links.
    """
    blocks = cut(_blocks(docs, models, id_column, text, rows, block_links))
    pairs = blocks.where(F.size("pair_a") > 0).select("block", F.posexplode(
        F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("place", "pair")).select(
        "block", "place", F.col("pair.pair_a").alias("a"), F.col("pair.pair_b").alias("b"), F.col("pair.pair_n").alias("n"))
    told = pairs.join(pair_counts(pairs), ["a", "b"]).select(
        F.col("block").alias("of_block"), "place", "total", "best")
    kept = blocks.drop("pair_a", "pair_b", "pair_n")
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def summed(documents: pa.Table, table: pa.Table) -> pa.Table:
        total = np.zeros(table.num_rows, np.int64)
        best = np.zeros(table.num_rows, np.int64)
        place = table.column("place").to_numpy()
        total[place] = table.column("total").to_numpy()
        best[place] = table.column("best").to_numpy()
        links = documents.column("links").combine_chunks()
        flat = links.flatten().to_numpy()
        first = np.concatenate(([0], np.cumsum(documents.column("n_groups").to_numpy())))
        sums = [np.concatenate(([0], np.cumsum(x[flat])))[first] for x in (total, best)]
        out = documents.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
        return out.append_column("n_links", pa.array(np.diff(first))).append_column(
            "count_sum", pa.array(np.diff(sums[0]))).append_column("n_best", pa.array(np.diff(sums[1])))

    joined = kept.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(
        summed, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, count_sum long, "
                "n_best long")
    return joined.select(F.col("doc_id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                         "groups_sha256")
