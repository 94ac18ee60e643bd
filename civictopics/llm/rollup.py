"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A change to a document has its count before and after: none before is an insert, none after a
delete, both a revised count.  A batch of changes is summed to one signed delta for each group and
added to the totals, so maintaining them costs what the changes cost, never a recount.

Every applied batch leaves a version of the totals in a folder ``<number>-<batch>`` of the shared
folder.  A version counts once its ``_SUCCESS`` file is there, which Spark writes last; a batch
whose version counts is not applied again.  So a batch that was cut off or sent twice is safe.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictopics.llm import bpe
from civictopics.llm.common import add_columns, n_words
from civictopics.storage import cut, new_path

GROUPS = ("source", "lang", "tokenizer")
TOTALS = T.StructType([
    *[T.StructField(g, T.StringType()) for g in GROUPS],
    T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType()),
])


def deltas(changes: DataFrame) -> DataFrame:
    """One signed row per group from ``changes (source, lang, tokenizer, before, after)``.

    Spark sums within each task first, so a group with most of the changes is a row per task.
    Null groups are groups of their own.  A change with neither count does nothing.
    """
    docs = F.col("after").isNotNull().cast("long") - F.col("before").isNotNull().cast("long")
    tokens = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    return changes.groupBy(*[F.col(g).cast("string").alias(g) for g in GROUPS]).agg(
        F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens")
    )


class TokenRollup:
    """Totals below ``path``, for one writer at a time and any number of readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[tuple[int, str, str]]:
        """``(number, batch, folder)`` of the versions that count, in order."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(conf)
        if not store.exists(root):
            return []
        found = []
        for entry in store.listStatus(root):
            match = re.fullmatch(r"(\d{12})-([\w.-]+)", entry.getPath().getName())
            if match and store.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                found.append((int(match[1]), match[2], entry.getPath().toString()))
        return sorted(found)

    def batches(self) -> list[str]:
        return [batch for _, batch, _ in self._versions()]

    def _read(self, versions: list[tuple[int, str, str]]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(versions[-1][2])

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)``; groups without documents are left out."""
        return self._read(self._versions())

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; ``False`` when it was applied before.  Names are letters, digits, ``.-_``."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        versions = self._versions()
        if batch in (known for _, known, _ in versions):
            return False
        names = TOTALS.names
        both = self._read(versions).select(names).unionByName(deltas(changes).select(names))
        summed = both.groupBy(*GROUPS).agg(
            F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")
        ).filter("docs <> 0 or tokens <> 0")
        number = versions[-1][0] + 1 if versions else 0
        # What a cut-off attempt has left under this name is overwritten.
        summed.write.mode("overwrite").parquet(f"{self.path}/{number:012d}-{batch}")
        return True

    def follow(self, stream: DataFrame, name: str, checkpoint: str):
        """Apply each micro-batch of a stream of changes; repeated ones are known by their number."""
        return stream.writeStream.foreachBatch(lambda df, i: self.apply(f"{name}-{i}", df)).option(
            "checkpointLocation", checkpoint
        ).start()


def with_counts(df: DataFrame, path: str, text_col: str = "text", count_col: str = "tokens",
                keep: list[str] | None = None) -> DataFrame:
    """Adds the number of byte-level BPE tokens of each whole text, 0 for null."""

    def compute(texts):
        encoder = bpe.load(path)
        return [[len(ids) // 4 for ids in encoder.encode_many([t or "" for t in texts])]]

    return add_columns(df, text_col, [(count_col, T.LongType())], compute, keep, bpe.unload)


def changed(df: DataFrame, tokenizer: str, before: str | None, after: str | None) -> DataFrame:
    """Changes of ``df (source, lang)`` from the columns that hold the counts."""
    count = lambda name: F.col(name) if name else F.lit(None).cast("long")
    return df.select("source", "lang", F.lit(tokenizer).alias("tokenizer"),
                     count(before).cast("long").alias("before"), count(after).cast("long").alias("after"))


def document_totals(df: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Totals of a corpus as it goes through its life in the rollup.

    Every document enters with an estimate of its tokens, a quarter of its characters, and with
    its words counted by single spaces.  The tokenizer then counts it under its own name and the
    estimates are deleted; word counts are revised to those of whole runs of non-spaces.  Each
    batch is sent twice.  What stays are documents, tokens and words of all of ``df``.
    """
    text = F.coalesce(df["text"].cast("string"), F.lit(""))
    spaces = F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    rows = df.select(
        df["source"], df["lang"], text.alias("text"), F.ceil(F.char_length(text) / 4).cast("long").alias("estimate"),
        (spaces + 1).cast("long").alias("roughly"), n_words(text).alias("words"),
    )
    counted = cut(with_counts(rows, path, keep=["source", "lang", "estimate", "roughly", "words"]), "token-counts")
    rollup = TokenRollup(df.sparkSession, new_path(df.sparkSession, "token-totals"))
    life = [
        ("arrived", changed(counted, "estimate", None, "estimate").unionByName(changed(counted, "words", None, "roughly"))),
        ("counted", changed(counted, tokenizer, None, "tokens")),
        ("settled", changed(counted, "estimate", "estimate", None).unionByName(changed(counted, "words", "roughly", "words"))),
    ]
    for batch, changes in life:
        for _ in range(2):
            rollup.apply(batch, changes)
    return rollup.totals()
