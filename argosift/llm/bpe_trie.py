"""BPE encoding and decoding by a trie of words.

Merging a word's symbols by rank gives tokens t1 ... tk. Such a row of tokens is the encoding of its symbols exactly if
every two neighbours are what merging gives for their own symbols alone, as no merge crosses a border unless it would
cross it between these two tokens. So the encoding of a prefix without its last token is the encoding of the shorter
prefix, and one token per prefix, its last one, holds the encodings of all prefixes: it is the only token that ends
there and may follow the last token of the prefix before it.

Texts are cut into words by the tokenizer's own normaliser and splitter. The distinct words of a batch of texts are
inserted into a trie, and a depth-first walk carries the last tokens along the current path: entering a node finds the
last token of that prefix from the states above it, leaving it drops the state. Words with a common prefix share its
states, and a word's encoding is read off by stepping back from its end. The walk visits the words in sorted order, in
which the branches of a trie follow each other, so only one path is held in memory. Whether two tokens may be neighbours
is decided once by merging their symbols and remembered.

Every text is encoded where it is read: nothing is shuffled, and a lost executor costs the texts of its tasks. Memory
per task is bounded by the batch (``rows`` texts) and by remembered words and neighbours (``_REMEMBERED`` of each, words
of at most 64 bytes); forgetting them changes no result. A word of any length takes time in proportion to its length.

Defined cases: null and empty texts, and those of white space only where the tokenizer drops it, have no tokens and
decode to the empty text; strings of special tokens inside a text are these tokens; repeated rows give repeated results;
null ids are kept; ids outside the vocabulary decode to nothing, null lists to the empty text; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

_REMEMBERED = 1 << 19
_SHORT = 64
_SHORT_SIZES = (2, 1)


class Tokens:
    """Vocabulary, merges and special tokens of a tokenizer file; built from its JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get(
                "continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("the file must hold a plain BPE model")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        # Tokens that end a word carry the suffix; they are looked up without it.
        self.inner = {t: i for t, i in vocab.items() if not self.suffix or not t.endswith(self.suffix)}
        self.final = {t[:-len(self.suffix)]: i for t, i in vocab.items() if t.endswith(self.suffix)
                      } if self.suffix else self.inner
        # Lengths of the tokens with the same last three symbols, longest first; shorter ones are always tried.
        self.inner_sizes, self.final_sizes = _sizes_by_end(self.inner), _sizes_by_end(self.final)
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        listed = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(listed)}
        self.products = [*(c for _, _, c in listed), -1]
        self.symbols = {i: [self.inner[c] for c in t] for t, i in self.inner.items() if all(c in self.inner for c in t)}
        if self.suffix:
            self.symbols |= {i: [*(self.inner[c] for c in t[:-1]), self.final[t[-1]]] for t, i in self.final.items()
                             if t and t[-1] in self.final and all(c in self.inner for c in t[:-1])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in chain(vocab.items(), self.special.items())}
        library = Tokenizer.from_str(source)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                 ) if self.special else None
        self.drops_space = all(not re.search(r"[\sĠ]", w) for w in self.split(" a \t\n b\x0b\x0c"))
        # Whether a run of ASCII letters is always one word, in small letters.
        probes = [string.ascii_letters, string.ascii_letters[::-1], *string.ascii_letters]
        self.plain_letters = self.drops_space and all(self.split(p) == [p.lower()] for p in probes)
        self.byte_level = bool(spec["decoder"]) and spec["decoder"]["type"] == "ByteLevel"
        if spec["decoder"] and not self.byte_level:
            raise ValueError("the file must have no decoder or one of bytes")

    def _words(self, text: str) -> list[str]:
        plain = self.normalizer.normalize_str(text) if self.normalizer else text
        return [w for w, _ in self.splitter.pre_tokenize_str(plain)] if plain else []

    def split(self, text: str) -> list[str]:
        """Words of a normalised text; special tokens are words of their own."""
        if self._marks is None or not self._marks.search(text):
            return self._words(text)
        return [w for part in self._marks.split(text) if part
                for w in ([part] if part in self.special else self._words(part))]

    def split_all(self, texts: list[str]) -> list[list[str]]:
        """Words of texts without ASCII white space, for a tokenizer that drops it: one call for all of them."""
        out: list[list[str]] = [[] for _ in texts]
        together = []
        for k, text in enumerate(texts):
            if self.plain_letters and text.isalpha() and text.isascii():
                out[k].append(text.lower())
                continue
            # White space of any kind is not printable, so it can't be taken for a border.
            if text.isprintable() and not (self._marks and self._marks.search(text)):
                together.append(k)
            else:
                out[k] = self.split(text)
        plain = " ".join(texts[k] for k in together)
        plain = self.normalizer.normalize_str(plain) if self.normalizer else plain
        borders = [k - 1 for k in accumulate(len(part) + 1 for part in plain.split(" "))][:-1]
        if len(borders) != len(together) - 1:  # the normaliser adds or takes spaces
            return [self.split(text) for text in texts]
        at = 0
        for word, (start, _) in self.splitter.pre_tokenize_str(plain) if plain else ():
            while at < len(borders) and start > borders[at]:
                at += 1
            out[together[at]].append(word)
        return out

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges neighbours of the lowest rank, the leftmost first, as long as there are any."""
        row, rank_of, none = list(symbols), self.ranks, len(self.products) - 1
        ranks = [rank_of.get(pair, none) for pair in zip(row, row[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            row[k:k + 2] = [self.products[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of.get((row[k - 1], row[k]), none)
            if k < len(ranks):
                ranks[k] = rank_of.get((row[k], row[k + 1]), none)
        return row


def _sizes_by_end(table: dict[str, int]) -> dict[str, tuple[int, ...]]:
    found: dict[str, set[int]] = {}
    for token in table:
        if len(token) > 2:
            found.setdefault(token[-3:], set()).add(len(token))
    return {end: (*sorted(sizes, reverse=True), 2, 1) for end, sizes in found.items()}


class Encoder:
    """Encodes texts of one task; remembers words and neighbours."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self._follows: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}
        self._chunks: dict[bytes, tuple[int, ...]] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def _stands_alone(self, token: int) -> bool:
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.tokens.merged(self.tokens.symbols.get(token, [])) == [token]
        return known

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        both = [s for token in pair for s in self.tokens.symbols.get(token, ())]
        known = self._follows[pair] = self.tokens.merged(both) == list(pair)
        return known

    def _last(self, path: str, end: int, inside: bool, last: list[int]) -> tuple[int, int]:
        """The last token of the first ``end`` symbols of ``path`` and its length, from the states before."""
        tokens = self.tokens
        table, sizes = (tokens.inner, tokens.inner_sizes) if inside else (tokens.final, tokens.final_sizes)
        follows = self._follows
        for size in sizes.get(path[end - 3:end], _SHORT_SIZES) if end > 2 else _SHORT_SIZES:
            if size < end:
                token = table.get(path[end - size:end])
                if token is not None:
                    pair = last[end - size - 1], token
                    if follows[pair] if pair in follows else self._may_follow(pair):
                        return token, size
            elif size == end:
                token = table.get(path[:end])
                if token is not None and self._stands_alone(token):
                    return token, size
        raise ValueError(f"no token for {path[end - 1]!r}")

    def words(self, distinct: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words: a depth-first walk over their trie."""
        out = {}
        last: list[int] = []  # last token of each prefix on the path, and its length in symbols
        size: list[int] = []
        path = ""
        step = self._last
        for word in sorted(distinct):
            length = len(word)
            shared, most = 0, min(len(path), length - 1, len(last))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared:], size[shared:]
            path = word
            for end in range(shared + 1, length):
                token, n = step(word, end, True, last)
                last.append(token)
                size.append(n)
            token, n = step(word, length, False, last)
            ids, at = [token], length - n
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            ids.reverse()
            out[word] = tuple(ids)
        return out

    def texts(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a batch of texts laid end to end, and where each text's begin, with the end."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch]
        # Where white space is dropped it can't be inside a word, so the runs between are looked up as they are.
        rows = [r.split() for r in raw] if self.tokens.drops_space else [[r] if r else [] for r in raw]
        for table in (self._chunks, self._words, self._follows):
            if len(table) > _REMEMBERED:
                table.clear()
        known, met, special = self._chunks, self._words, self.tokens.special
        fresh = [c for c in set(chain.from_iterable(rows)) if c not in known]
        texts = [c.decode("utf-8", "replace") for c in fresh]
        words = self.tokens.split_all(texts) if self.tokens.drops_space else list(map(self.tokens.split, texts))
        distinct = set(chain.from_iterable(words)) - special.keys()
        new = {w: np.array(i, np.int32).tobytes() for w, i in self.words(distinct - met.keys()).items()}
        ids = {w: np.int32(i).tobytes() for w, i in special.items()} | {w: met[w] for w in distinct & met.keys()} | new
        met.update((w, i) for w, i in new.items() if len(w) <= _SHORT)
        known.update((c, ids[own[0]] if len(own) == 1 else b"".join(map(ids.__getitem__, own)))
                     for c, own in zip(fresh, words))
        out = [b"".join(map(known.__getitem__, row)) for row in rows]
        for c in fresh:
            if len(c) > _SHORT:
                del known[c]
        return np.frombuffer(b"".join(out), np.int32), np.cumsum([0] + [len(r) // 4 for r in out])


_built: dict[str, Tokens] = {}


def _tokens(source: str) -> Tokens:
    """The tables of a tokenizer; built once in a Python worker."""
    if source not in _built:
        _built.clear()
        _built[source] = Tokens(source)
    return _built[source]


def load(tokenizer_file: str) -> str:
    """JSON text of a tokenizer file, checked."""
    with open(tokenizer_file, encoding="utf-8") as f:
        source = f.read()
    _tokens(source)
    return source


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", rows: int = 256) -> DataFrame:
    """Rows (id, ids array<int>) of the texts; ``tokenizer`` is what ``load`` returned."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    chosen = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_tokens(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                flat, first = encoder.texts(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return chosen.mapInArrow(run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", id_column)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded", rows: int = 256) -> DataFrame:
    """Adds the text that the token ids stand for, special tokens included."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared.value)
        size = max(tokens.by_id) + 1
        strings = [tokens.by_id.get(i) for i in range(size)]
        raw = None if not tokens.byte_level else [b"" if s is None else _bytes(s) for s in strings]
        table = pa.array(strings, pa.string())
        for batch in (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)):
            at = batch.schema.get_field_index(ids)
            lists = batch.column(at).to_pylist() if raw else None
            if raw:
                texts = [b"".join(raw[i] for i in own or () if i is not None and 0 <= i < size).decode("utf-8", "replace")
                         for own in lists]
                decoded = pa.array(texts, pa.string())
            else:
                decoded = _joined(batch.column(at), table)
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, into])

    return encoded.mapInArrow(run, encoded.selectExpr("*", f"cast(null as string) as `{into}`").schema)


def _joined(lists: pa.ListArray, table: pa.StringArray) -> pa.Array:
    """Strings of the ids, joined by one space; unknown ids are left out."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    values = lists.flatten()
    known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(table)))
    strings = table.take(pc.if_else(known, values, None))
    keep = pc.is_valid(strings)
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    if strings.null_count:
        kept = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))
        ends, strings = kept[ends], strings.filter(keep)
    rows = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), strings.cast(pa.large_string()))
    return pc.binary_join(rows, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _alphabet() -> dict[str, int]:
    """Byte of every character that stands for one: printable bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_BYTE_OF = _alphabet()


def _bytes(token: str) -> bytes:
    """Bytes of a token of byte characters; one with other characters stands for itself."""
    return bytes(_BYTE_OF[c] for c in token) if all(c in _BYTE_OF for c in token) else token.encode()
