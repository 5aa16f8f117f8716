"""The operators over the given tables, with DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from argosift.llm import (bpe_trie, exact_dedup, fingerprint, hard_negatives, html_text, language_id, packing, quality,
                          sentencepiece_lattice, simhash_dedup, substring_dedup, token_alignment, warc)

#: Public piece table; see the tokenizers' own README.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Public tokenizers of words and of bytes.
WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(table: str, sql: str | None = None):
    """Registers ``fn(spark, rows of the table, folder)`` under its name."""

    def register(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(spark, spark.read.parquet(f"{folder}/{table}.parquet"), folder)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query("documents")
def op1_best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Bins of 2048 words without two documents of a source or of a cluster of copies."""
    return packing.pack(packing.measured(docs))


@query("documents")
def op2_substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Words left after passages of 50 words that an earlier document has are removed."""
    return substring_dedup.summaries(docs)


@query("documents", sql=r"""
    with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
               from documents)
    select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
           doc_id = min(doc_id) over w as kept, text_sha256
    from t window w as (partition by text_sha256)""")
def op3_exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Groups of equal texts; the smallest id stays."""
    return exact_dedup.duplicate_groups(docs)


@query("documents")
def op4_simhash_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Fingerprints and their components at 4 or fewer differing bits."""
    return simhash_dedup.near_groups(docs).drop("text_hash", "kept")


@query("documents")
def op5_sentencepiece(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all texts as rows of word runs, with the text that they decode to."""
    pieces = sentencepiece_lattice.load(PIECE_MODEL)
    return sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, pieces), pieces)


@query("documents")
def op6_language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of the labelled ones."""
    model = language_id.fit(language_id.training_rows(docs))
    return language_id.classify(docs, model, keep=("doc_id", language_id.held_out().alias("held_out")))


@query("documents")
def op7_quality_resampling(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A quarter of the documents drawn by their likeness to texts labelled good and not toxic."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.resample(docs, labels.where("quality = 1 and toxic = 0").select("doc_id"))


@query("documents")
def op8_multiset_fingerprints(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Fingerprints of all texts and of their edited forms."""
    return fingerprint.with_following(docs)


@query("pages")
def op9_html_text(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(pages)


@query("pages")
def op10_warc(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Pages written to archives and read back."""
    return warc.round_trip(pages)


@query("documents")
def op11_bpe_trie(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Tokens of all texts, and the texts that they decode to, as digests."""
    tokenizer = bpe_trie.load(WORD_TOKENIZER)
    rows = bpe_trie.decode(bpe_trie.encode(docs, tokenizer), tokenizer)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("documents")
def op12_token_alignment(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Groups and links of the tokens of a byte-level and a piece tokenizer."""
    return token_alignment.scored(docs, token_alignment.load(BYTE_TOKENIZER, PIECE_MODEL))


@query("embeddings", sql="""
    with e as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
      where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as materialized (
      select a.vec_id as anchor_id, a.label as anchor_label, e.vec_id, e.label, list_inner_product(a.v, e.v)::bigint as score
      from e as a, e where a.vec_id % 100 = 0),
    p as (
      select anchor_id, vec_id as positive_id, score as positive_score from s
      where label = anchor_label and vec_id <> anchor_id
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select anchor_id, positive_id,
      (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
      vec_id as negative_id, positive_score, score as negative_score
    from p join s using (anchor_id)
    where label <> anchor_label and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
    qualify rank <= 5""")
def op13_hard_negatives(spark: SparkSession, vectors: DataFrame, folder: str) -> DataFrame:
    """Negatives of the best five rows of each anchor's label; every seventh label is turned into the next."""
    turned = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(
        F.col("label")))
    return hard_negatives.mine(hard_negatives.usable(turned, is_anchor=F.col("vec_id") % 100 == 0))
