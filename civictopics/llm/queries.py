"""One query per operator of this package, over the whole of its table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civictopics.llm import (
    bpe,
    digest,
    exact_dedup,
    importance,
    langid,
    linededup,
    mixing,
    prefixtrie,
    repetition,
    rollup,
    simhash,
    tokenfile,
    warc,
)
from civictopics.llm.common import tokenizer_path


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_langid(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every text, learned from the labelled documents that are not held out."""
    docs = documents(spark, sf)
    found = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", "rejected")


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How often the mix of sources takes each document."""
    return mixing.mix(documents(spark, sf), keep=["doc_id", "source"]).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate"
    )


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup.exact_groups(documents(spark, sf))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by source, language and tokenizer after inserts, deletes and revised counts."""
    return rollup.document_totals(documents(spark, sf), tokenizer_path("byte_bpe_50k.json"), "byte_bpe_50k")


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicate_groups(documents(spark, sf))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document that are similar to an earlier one."""
    return linededup.line_report(documents(spark, sf))


def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded and decoded with the byte-level file."""
    return bpe.round_trip(documents(spark, sf), tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"])


def op8_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of every text, of its edited text, and their likeness."""
    return digest.fingerprints(documents(spark, sf))


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.archived_pages(spark.read.parquet(f"{sf}/pages.parquet"))


def op10_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all documents written to coded files in order and read back."""
    return tokenfile.token_files(documents(spark, sf), tokenizer_path("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefixtrie.prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet")).drop("key", "parent")


def op12_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return repetition.quality(documents(spark, sf), keep=["doc_id"]).drop("longest_repeat", "n_repeats")


def op13_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Weight, score and rank of every document drawn towards the benchmark texts."""
    found = importance.scored(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id").drop("n_words")


QUERIES = {
    query.__name__: query
    for query in (
        op1_langid, op2_mixing, op3_exact_dedup, op4_token_counts, op5_simhash, op6_line_dedup, op7_bpe, op8_digest, op9_warc,
        op10_token_ids, op11_prefix_trie, op12_quality, op13_importance,
    )
}
