"""SentencePiece encoding and decoding over a relational lattice.

The piece table comes from a public model file. Text is normalised as that model asks (a leading space, spaces as the
piece mark) and cut into words, where no piece can cross: before a run of marks, around line breaks, and between letters
and other characters (``load`` makes sure of it). Each distinct word of the corpus is encoded once:

1. its substrings of at most the length of the longest piece with the same beginning are exploded and joined with the
   piece table by equality (the table is broadcast; its size is the model's, not the data's);
2. the matches are the edges of the word's lattice; a start without a one-character piece gets an edge for an unknown
   character. The edges of a word stand together, on the partitioning that the distinct words already have;
3. many lattices at once are folded in order of the edges' ends to the best score of every position (Viterbi), and
   walked back. Ties go to the edge with the smallest start. Unknown characters become byte pieces.

Texts are then written as rows of word runs: the ``frequent`` most frequent words (a fixed bound) are looked up where
the text is read, all others are joined with the dictionary by word. Rows of one text, in order of ``first_word``,
hold its pieces.

The result is the segmentation with the largest sum of scores, as for unigram models. The public model is a BPE model,
whose own encoder merges pairs in order of rank, so its segmentation of a word may differ; decoding is the same.

Defined cases: null and empty texts have no rows; runs of spaces are marks; characters outside the table are bytes;
a word costs time in proportion to the square of its length, so very long texts should have spaces; repeated rows
give repeated results; null ids are like any other; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from argosift.session import cut, small_batches

MARK = "▁"
# Everything but letters and marks of words: ASCII, Latin-1, general and CJK punctuation, digits and symbols.
_OTHERS = (r"\x00-\x09\x0b-@\[-`{-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7"
           r"\u2000-\u2580\u2582-\u2bff\u3000-\u303f")
_WORD = re.compile(rf"{MARK}*[^{_OTHERS}\n{MARK}]+|{MARK}*[{_OTHERS}]+|{MARK}+|\n")
_UNKNOWN_PENALTY = 10.0
_BEGIN = 4  # characters
_EDGES = 1 << 17  # folded together, and those of one longer word


@dataclass
class Pieces:
    """Piece table of a model: ``usable`` are (piece, id, score), ``byte_ids`` the ids of the 256 byte pieces."""

    usable: list[tuple[str, int, float]]
    byte_ids: list[int]
    texts: list[bytes]

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.usable)

    @cached_property
    def unknown_score(self) -> float:
        return min(s for _, _, s in self.usable) - _UNKNOWN_PENALTY


def load(model_file: str) -> Pieces:
    """Reads the piece table; the model must have byte pieces and none that would cross words."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usable, byte_ids, texts = [], [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"")
        else:
            usable.append((piece, i, model.get_score(i)))
            texts.append(piece.replace(MARK, " ").encode())
    if not any(byte_ids) or any(len(_WORD.findall(p)) != 1 for p, _, _ in usable):
        raise ValueError("the model needs byte pieces and pieces that do not cross words")
    return Pieces(usable, byte_ids, texts)


def words(text: str | None) -> list[str]:
    """The words of the normalised text."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def positions(values: list, wanted: object) -> list[int]:
    """Where ``wanted`` stands in ``values``."""
    found, at = [], -1
    try:
        while True:
            at = values.index(wanted, at + 1)
            found.append(at)
    except ValueError:
        return found


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (word, n) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for t in batch.column(0).slice(at, 64).to_pylist():
                    seen.update(words(t))
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    small_batches(docs.sparkSession)
    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(found: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows (word, n, ids) from rows (word, n) that are partitioned by word."""
    spark = found.sparkSession
    # Looked up by 64-bit hashes, which is cheaper than by strings; the piece itself is compared after that.
    table = F.broadcast(spark.createDataFrame(pieces.usable, "found string, id int, score double").select(
        F.xxhash64("found").alias("key"), "found", "id"))
    longest: dict[str, int] = {}
    for p, _, _ in pieces.usable:
        if len(p) >= _BEGIN:
            longest[p[:_BEGIN]] = max(longest.get(p[:_BEGIN], 0), len(p))
    # How long a piece with this beginning can be; equal hashes of two beginnings only give spans that match nothing.
    reach = F.broadcast(spark.createDataFrame([*longest.items()], "begin string, reach int").groupBy(
        F.xxhash64("begin").alias("begin")).agg(F.max("reach").alias("reach")))
    starts = found.select("word", "n", F.explode(F.expr("sequence(0, char_length(word) - 1)")).alias("start")).withColumn(
        "rest", F.expr(f"substring(word, start + 1, {pieces.longest})")).withColumn(
        "begin", F.expr(f"xxhash64(left(rest, {_BEGIN}))")).join(reach, "begin", "left")
    spans = starts.select("word", "n", "start", "rest", F.explode(
        F.expr(f"sequence(1, least(char_length(rest), coalesce(reach, {_BEGIN - 1})))")).alias("size"))
    edges = spans.select("word", "n", "start", F.expr("start + size").alias("end"), F.expr("left(rest, size)").alias(
        "piece")).withColumn("key", F.xxhash64("piece")).join(table, "key", "left").withColumn(
        "id", F.expr("if(found = piece, id, null)")).where("id is not null or end = start + 1")
    # A word's edges follow each other; the first goes from 0 to 1 and alone has the word.
    head = F.expr("start = 0 and end = 1")
    lattice = edges.select(F.when(head, F.col("word")).alias("word"), F.when(head, F.col("n")).alias("n"), "start",
                           "end", F.coalesce("id", F.lit(-1)).alias("id"))
    scores = np.full(len(pieces.texts) + 1, pieces.unknown_score)  # of id -1, the last
    for _, i, score in pieces.usable:
        scores[i] = score
    byte_ids = np.array(pieces.byte_ids, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            heads = np.flatnonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            if size + batch.num_rows >= _EDGES and len(heads):
                whole = pa.Table.from_batches([*waiting, batch.slice(0, int(heads[-1]))])
                if whole.num_rows:
                    yield best_paths(whole.combine_chunks(), scores, byte_ids)
                batch = batch.slice(int(heads[-1]))
                waiting, size = [], 0
            waiting.append(batch)
            size += batch.num_rows
        if size:
            yield best_paths(pa.Table.from_batches(waiting).combine_chunks(), scores, byte_ids)

    small_batches(spark)
    return lattice.mapInArrow(run, "word string, n long, ids array<int>")


def best_paths(edges: pa.Table, scores: np.ndarray, byte_ids: np.ndarray) -> pa.RecordBatch:
    """Rows (word, n, ids) of the lattices (word, n, start, end, id), whose edges are in order of word and start."""
    start, end, ids = (edges[c].to_numpy() for c in ("start", "end", "id"))
    is_head = pc.is_valid(edges["word"]).to_numpy()
    which = np.cumsum(is_head) - 1
    heads = edges.filter(pc.is_valid(edges["word"])).select(["word", "n"]).combine_chunks()
    words_ = heads["word"].to_pylist()
    lengths = np.array(list(map(len, words_)), np.int64)
    if not is_head[0] or (np.bincount(which[end == start + 1], minlength=len(words_)) != lengths).any():
        raise RuntimeError("the edges of a word do not stand together")
    base = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    # Stable, so that edges with one end stay in order of word and start.
    order = np.argsort(end.astype(np.uint16) if end.max() < 1 << 16 else end, kind="stable")
    start, which, ids = start[order], which[order], ids[order]
    source, score = base[which] + start, scores[ids]
    target = base[which] + end[order]
    new = np.concatenate(([True], target[1:] != target[:-1]))
    node, first = np.cumsum(new) - 1, np.flatnonzero(new)  # one node for each end of a word
    levels = np.concatenate(([0], np.cumsum(np.bincount(end))))
    best, via = np.zeros(int(base[-1] + lengths[-1] + 1)), np.zeros(int(base[-1] + lengths[-1] + 1), np.int64)
    for lo, hi in zip(levels[1:-1].tolist(), levels[2:].tolist()):
        reached = best[source[lo:hi]] + score[lo:hi]
        own = first[node[lo]:node[hi - 1] + 1]
        top = np.maximum.reduceat(reached, own - lo)
        at = np.flatnonzero(reached == top[node[lo:hi] - node[lo]])
        of = node[lo + at]
        at = at[np.concatenate(([True], of[1:] != of[:-1]))]
        best[target[own]], via[target[own]] = top, lo + at
    walked, active, here = [], np.arange(len(words_)), base + lengths
    while len(active):
        step = via[here]
        walked.append(step)
        here = source[step]
        more = here != base[active]
        active, here = active[more], here[more]
    path = np.concatenate(walked)
    path = path[np.lexsort((start[path], which[path]))]
    found, many = ids[path], np.ones(len(path), np.int64)
    unknown = {int(i): words_[which[path[i]]][start[path[i]]].encode() for i in np.flatnonzero(found < 0)}
    for i, raw in unknown.items():
        many[i] = len(raw)
    upto = np.concatenate(([0], np.cumsum(many)))
    values = np.repeat(found, many).astype(np.int32)
    for i, raw in unknown.items():
        values[upto[i]:upto[i + 1]] = byte_ids[list(raw)]
    pieces_of = np.bincount(which[path], minlength=len(words_))
    ends = upto[np.concatenate(([0], np.cumsum(pieces_of)))].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [heads["word"].combine_chunks(), heads["n"].combine_chunks(),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["word", "n", "ids"])


def encode(docs: DataFrame, pieces: Pieces, id_column: str = "doc_id", text: str = "text",
           frequent: int = 1 << 17) -> DataFrame:
    """Rows (id, first_word, n_words, ids); the rows of a text cover its words without gap or overlap."""
    spark = docs.sparkSession
    dictionary = cut(encode_words(distinct_words(docs, text), pieces))
    # At most ``frequent`` words reach the driver and the tasks.
    common = {r["word"]: np.array(r["ids"], "<i4").tobytes() for r in dictionary.orderBy(F.desc("n"), "word").limit(frequent).collect()}
    known = spark.sparkContext.broadcast(common)
    chosen = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def frequent_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                row, first, count, ids = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    coded = list(map(table.get, words(t)))
                    begin = 0
                    for j in [*positions(coded, None), len(coded)]:
                        if j > begin:
                            row.append(i)
                            first.append(begin)
                            count.append(j - begin)
                            ids.append(b"".join(coded[begin:j]))
                        begin = j + 1
                ends = np.cumsum([0, *(len(b) // 4 for b in ids)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(first, pa.int32()),
                     pa.array(count, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), values)],
                    names=["doc_id", "first_word", "n_words", "ids"])

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                count, first, rare = [], [], []
                for t in part.column(1).to_pylist():
                    found = words(t)
                    places = positions(list(map(table.__contains__, found)), False)
                    count.append(len(places))
                    first += places
                    rare += [found[k] for k in places]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(len(count)), count))), pa.array(first, pa.int32()),
                     pa.array(rare, pa.string())], names=["doc_id", "first_word", "word"])

    # Either pass gives the rows that it needs only: most of the cost of a row is its way between Python and the JVM.
    runs = chosen.mapInArrow(frequent_runs, f"doc_id {kind}, first_word int, n_words int, ids array<int>")
    rest = chosen.mapInArrow(rare_words, f"doc_id {kind}, first_word int, word string")
    looked_up = rest.join(dictionary.select("word", "ids"), "word")
    return runs.union(looked_up.select("doc_id", "first_word", F.lit(1).alias("n_words"), "ids")).withColumnRenamed(
        "doc_id", id_column)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of the pieces; the mark that the first run of a text begins with is kept as a space."""
    known = rows.sparkSession.sparkContext.broadcast(pieces.texts)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        pieces_of = pa.array(table, pa.large_binary())
        sizes = np.array(list(map(len, table)), np.int64)
        for batch in batches:
            lists = batch.column(at)
            own = lists.flatten()
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(
                zero_copy_only=False)))).astype(np.int64)
            # The bytes of all pieces laid end to end, and where each row's begin.
            raw = memoryview(pieces_of.take(own).buffers()[2] or b"")
            upto = np.concatenate(([0], np.cumsum(sizes[own.to_numpy(zero_copy_only=False)])))
            cuts = upto[ends]
            texts = pa.StringArray.from_buffers(
                batch.num_rows, pa.py_buffer((cuts - cuts[0]).astype(np.int32)), pa.py_buffer(raw[cuts[0]:cuts[-1]]))
            try:
                texts.validate(full=True)
            except pa.ArrowInvalid:  # bytes that are no text
                cuts = cuts.tolist()
                texts = pa.array([str(raw[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])], pa.string())
            yield batch.append_column(out, texts)

    return rows.mapInArrow(run, f"{kinds}, `{out}` string")


def assemble(rows: DataFrame, pieces: Pieces, id_column: str = "doc_id") -> DataFrame:
    """Rows (id, ids, text): all pieces of each text in order, and the text they stand for."""
    whole = rows.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("first_word", "ids"))).alias("runs")).select(
        id_column, F.flatten(F.col("runs.ids")).alias("ids"))
    return decode(whole, pieces).withColumn("text", F.expr("substring(text, 2)"))
