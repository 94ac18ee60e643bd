"""A training corpus from raw documents: each stage takes what the one before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civictopics.llm import bpe, langid, linededup, mixing, simhash
from civictopics.llm.common import tokenizer_path
from civictopics.storage import settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language the model is too unsure of, go.

    A null or empty text has no letter.  Repeated rows share their fate; an empty table stays empty.
    """
    found = langid.identify(docs, langid.fit(docs))
    return found.filter("not rejected").select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one leave their texts; no document goes.

    ``n_chars`` counts what is left, null for a null text.  A null id comes first; different texts of one
    id keep their own lines; rows equal in id and text have the same lines left.
    """
    left = linededup.line_dedup(docs).select(*COLUMNS)
    return left.withColumn("n_chars", F.char_length("text").cast("long"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash (three words, two bits) the document with the smallest id stays.

    Null and empty texts are one group.  Documents without an id stay where none of their group has one;
    rows equal in id and text share their fate.
    """
    return simhash.near_dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix of sources takes it, not at all to three times.

    A null source is one of its own; a document without words comes once.
    """
    mixed = mixing.mix(docs, keep=list(COLUMNS))
    return mixed.filter("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them.

    A null text counts as empty and has no ids.
    """
    kept = ["doc_id", "lang", "source", "n_chars"]
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), keep=kept, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", remove_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Training, similarity joins and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage writes besides goes when it ends, and its result when the next one is written.
    """

    def upto(n: int) -> DataFrame:
        if n == 0:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        name, stage = STAGES[n - 1]
        return settled(spark, f"pipeline-{name}", lambda: stage(spark, upto(n - 1), sf_dir))

    return upto(len(STAGES))
