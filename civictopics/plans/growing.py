"""A topic model that grows: batches add texts and take texts away, and nothing is fitted twice.

The model is two additive tables: texts and coordinate sums per grid cell, and words per grid cell.  A batch
is a table of signed changes to both, so the tables after any order of batches are those of a fit on the texts
that are left.  Coordinates are summed as whole millionths, so they agree to the last digit as well.
Topics are found on the cells, as everywhere, and keep their numbers from one batch to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civictopics.operators import density, embed, vocabulary
from civictopics.plans.model import Settings
from civictopics.storage import committed, cut, delete

# Texts without a vector have no cell; their words are kept under this key.
OUTSIDE = -1
MILLIONTHS = 10**6
# Texts whose words a task adds up at a time.
TEXTS_AT_A_TIME = 4096


def placed(docs: DataFrame, settings: Settings, idf: np.ndarray | None = None) -> DataFrame:
    """Adds ``reduced`` and ``cell`` to ``docs (tokens, ...)``, row by row.

    A text must get the same cell whenever it comes, so word weights are given (``idf``, for example those of
    a first corpus) or all 1, and dimensions are reduced by the fixed projection.  Null words are dropped, and
    null tokens become an empty list.
    """
    weights = np.ones(1) if idf is None else idf
    words = F.array_compact(F.coalesce("tokens", F.array().cast("array<string>")))
    embedded = embed.embed_docs(docs.withColumn("tokens", words), dim=settings.dim, idf=weights, salt=settings.salt)
    reduced = embed.reduce_dims(embedded, settings.k, "projection", settings.salt, dim=settings.dim)
    return density.with_cells(reduced.drop("embedding"), settings.k, settings.width)


def signed_counts(docs: DataFrame, settings: Settings, idf: np.ndarray | None = None) -> DataFrame:
    """``(cell, word, cnt, sum_0, ...)``: what ``docs (tokens, sign)`` change.

    ``sign`` is 1 for a text that comes and -1 for one that leaves; rows with a null sign are ignored.  The row
    with a null word counts the texts of a cell and sums their coordinates.
    Tasks add up the words of some texts by themselves, and both tables come out of one aggregation.
    """
    rows = placed(docs.select("tokens", F.col("sign").cast("long").alias("sign")), settings, idf)
    unit = density.unit_coordinates("reduced", settings.k)
    sums = [f"sum_{i}" for i in range(settings.k)]
    parts = rows.filter("sign is not null").select(
        F.coalesce("cell", F.lit(OUTSIDE)).alias("cell"), "sign",
        *[F.coalesce(F.round(u * MILLIONTHS).cast("long"), F.lit(0)).alias(s) for s, u in zip(sums, unit)], "tokens",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_A_TIME):
                batch = whole.slice(at, TEXTS_AT_A_TIME)
                cell, sign, *coordinates = (batch.column(i).to_numpy() for i in range(batch.num_columns - 1))
                tokens = batch.column(batch.num_columns - 1)
                values, number = np.unique(cell, return_inverse=True)
                # The row of a cell itself.
                by_cell = np.argsort(number, kind="stable")
                first = np.searchsorted(number[by_cell], np.arange(len(values)))
                added = [np.add.reduceat(x[by_cell], first) for x in (sign, *(c * sign for c in coordinates))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.nulls(len(values), pa.string()), *map(pa.array, added)], names=["cell", "word", "cnt", *sums]
                )
                coded = tokens.flatten().dictionary_encode()
                if not len(coded):
                    continue
                row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                key = number[row] * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                cnt = np.add.reduceat(sign[row[order]], first)
                of, word = np.divmod(key[first], len(coded.dictionary))
                none = pa.array(np.zeros(len(first), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[of]), coded.dictionary.take(pa.array(word)), pa.array(cnt), *[none] * len(sums)], names=["cell", "word", "cnt", *sums]
                )

    counted = parts.mapInArrow(run, _schema(sums))
    return _not_empty(counted.groupBy("cell", "word").agg(*[F.sum(c).alias(c) for c in ("cnt", *sums)]), sums)


def _schema(sums: list[str]) -> str:
    return "cell long, word string, cnt long, " + ", ".join(f"{s} long" for s in sums)


def _not_empty(counts: DataFrame, sums: list[str]) -> DataFrame:
    return counts.filter(reduce(Column.__or__, [F.col(c) != 0 for c in ("cnt", *sums)]))


def keep_numbers(found: DataFrame, before: DataFrame, cells: DataFrame, highest: int) -> DataFrame:
    """``(cell, topic)``: the topics ``found (cell, topic)`` under the numbers they had ``before``.

    A topic inherits the number of the earlier topic with which it shares most texts (``cells (cell, cnt)``), if
    it is also the one that shares most with that one; ties go to the smaller number.  So of two topics that
    merge the larger share's number stays, and of the parts of a topic the largest keeps it.  All others get
    new numbers above ``highest``, in their order.
    """
    shared = cut(
        found.join(before.select("cell", F.col("topic").alias("old")), "cell").join(cells.select("cell", "cnt"), "cell")
        .groupBy("topic", "old").agg(F.sum("cnt").alias("cnt")),
        "shared",
    )
    most = shared.groupBy("topic").agg(F.max_by("old", F.struct(F.col("cnt"), -F.col("old"))).alias("old"))
    heirs = shared.groupBy("old").agg(F.max_by("topic", F.struct(F.col("cnt"), -F.col("topic"))).alias("topic"))
    kept = most.join(heirs, ["topic", "old"])
    every = found.select("topic").distinct().join(kept, "topic", "left")
    order = Window.partitionBy(F.col("old").isNull()).orderBy("topic")
    named = every.select("topic", F.coalesce("old", F.row_number().over(order) + highest).cast("long").alias("number"))
    return found.join(named, "topic").select("cell", F.col("number").alias("topic"))


@dataclass(frozen=True)
class GrowingModel:
    """A model in ``folder``, which all executors share.

    ``settings`` use the hashed vectors and the fixed projection; of them ``dim``, ``salt``, ``k`` and ``width`` must
    stay as they were at the first batch.  Batches have ascending numbers, as those of a stream do, and one
    writer.  A batch is one Parquet write and counts once it is finished; a batch that is sent again is skipped.
    """

    folder: str
    settings: Settings = Settings(reducer="projection")
    idf: np.ndarray | None = field(default=None, repr=False)
    compact_after: int = 16

    def __post_init__(self):
        if self.settings.method != "hash" or self.settings.reducer != "projection":
            raise ValueError("a growing model needs method='hash' and reducer='projection'")

    def apply(self, docs: DataFrame, batch_id: int) -> None:
        """Take in ``docs (tokens, sign)``; fits ``writeStream.foreachBatch``.

        A text may leave in the batch in which it came.  Texts that leave must have been there: counts below
        zero are kept, so that a later batch can make up for them, but are no part of any topic.
        """
        spark = docs.sparkSession
        if batch_id <= max([-1, *self._base(spark), *committed(spark, self.folder, "batch")]):
            return
        signed_counts(docs, self.settings, self.idf).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        if len(self._open_batches(spark)) >= self.compact_after:
            self.compact(spark)

    def _base(self, spark: SparkSession) -> list[int]:
        return committed(spark, self.folder, "base")[-1:]

    def _open_batches(self, spark: SparkSession) -> list[int]:
        covered = max([-1, *self._base(spark)])
        return [n for n in committed(spark, self.folder, "batch") if n > covered]

    def last_batch(self, spark: SparkSession) -> int:
        """The highest batch taken in; -1 for none."""
        return max([-1, *self._base(spark), *self._open_batches(spark)])

    def compact(self, spark: SparkSession) -> None:
        """Add up all batches so far into one table; what the table before it covered is deleted.

        That table and its later batches stay, for readers who began with them.
        """
        batches, before = self._open_batches(spark), self._base(spark)
        if not batches:
            return
        self.state(spark).write.mode("overwrite").parquet(f"{self.folder}/base={batches[-1]}")
        for covered in before:
            for name in ("base", "batch"):
                for n in committed(spark, self.folder, name):
                    if n < covered or (n == covered and name == "batch"):
                        delete(spark, f"{self.folder}/{name}={n}")

    def _sums(self) -> list[str]:
        return [f"sum_{i}" for i in range(self.settings.k)]

    def _changes(self, spark: SparkSession) -> DataFrame:
        """What the batches changed, those that were added up before as one."""
        schema = _schema(self._sums())
        paths = [f"{self.folder}/base={n}" for n in self._base(spark)]
        paths += [f"{self.folder}/batch={n}" for n in self._open_batches(spark)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def state(self, spark: SparkSession) -> DataFrame:
        """``(cell, word, cnt, sum_0, ...)`` of all batches; see ``signed_counts``."""
        sums = self._sums()
        added = self._changes(spark).groupBy("cell", "word").agg(*[F.sum(c).alias(c) for c in ("cnt", *sums)])
        return _not_empty(added, sums)

    def cells(self, spark: SparkSession) -> DataFrame:
        """``(cell, cnt, first_row, sum_0, ...)`` of the cells with texts; the key stands for the first row."""
        sums = [F.col(f"sum_{i}").cast("double").alias(f"sum_{i}") for i in range(self.settings.k)]
        held = self.state(spark).filter(F.col("word").isNull() & (F.col("cnt") > 0) & (F.col("cell") != OUTSIDE))
        return held.select("cell", "cnt", F.col("cell").alias("first_row"), *sums)

    def words(self, spark: SparkSession) -> DataFrame:
        """``(cell, word, cnt)``; the words of texts without a vector have cell -1."""
        # Only the row of a cell has sums.
        words = self._changes(spark).filter("word is not null").groupBy("cell", "word").agg(F.sum("cnt").alias("cnt"))
        return words.filter("cnt > 0")

    def _settled(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.schema("cell long, topic long").parquet(f"{self.folder}/topics={version}")

    def topics(self, spark: SparkSession) -> DataFrame:
        """``(cell, topic)`` after the last batch; found once per batch and written beside the model.

        Numbers are kept from the last time topics were asked for.  At first they go by size, equal sizes by the
        smallest cell.  Numbers of topics that are gone do not come back.
        """
        version, known = self.last_batch(spark), committed(spark, self.folder, "topics")
        if version not in known:
            s = self.settings
            cells = cut(self.cells(spark), "cells")
            links = cut(density.similar_cells(cells, s.k, s.width, s.sim), "links")
            found = cut(
                density.cell_topics(cells, links, s.min_pts or s.min_topic_size, s.min_topic_size), "cell-topics"
            )
            highest = -1
            if known:
                before = self._settled(spark, known[-1])
                highest = before.agg(F.max("topic")).first()[0]
                found = cut(keep_numbers(found, before.filter("cell is not null"), cells, highest), "cell-topics")
            # The row without a cell holds the highest number ever given.
            top = found.agg(F.greatest(F.max("topic"), F.lit(highest).cast("long")).alias("topic"))
            held = found.select("cell", "topic").unionByName(top.select(F.lit(None).cast("long").alias("cell"), "topic"))
            held.write.mode("overwrite").parquet(f"{self.folder}/topics={version}")
        return self._settled(spark, version).filter("cell is not null")

    def top_words(self, spark: SparkSession) -> DataFrame:
        """``(topic, rank, word, weight)`` by class TF-IDF; words of outliers count as topic -1."""
        by_topic = self.words(spark).join(self.topics(spark), "cell", "left").groupBy(
            F.coalesce("topic", F.lit(-1).cast("long")).alias("topic"), "word"
        ).agg(F.sum("cnt").alias("cnt"))
        weights = vocabulary.class_tfidf(cut(by_topic, "counts"))
        return vocabulary.top_words(weights, self.settings.words_per_topic)

    def assign(self, docs: DataFrame) -> DataFrame:
        """Adds ``topic`` to ``docs (tokens, ...)``, -1 for texts whose cell belongs to none."""
        columns = [c for c in docs.columns if c not in ("reduced", "cell", "topic")]
        rows = placed(docs.select(*columns), self.settings, self.idf)
        return rows.join(self.topics(docs.sparkSession), "cell", "left").select(
            *columns, F.coalesce("topic", F.lit(-1).cast("long")).alias("topic")
        )
