"""Reading large CSV files with quoted line breaks in many tasks.

Spark's reader of plain lines splits a file at byte ranges, and a line belongs to the range where it
begins.  Whether a line begins inside quotes depends on everything before it in the file, but only on
whether the number of quotes is even, as a doubled quote counts twice.  So the quotes of each range are
counted first; a prefix sum over the ranges of a file gives the state in which each one begins; and each
range then cuts its lines into records from its first true one.  A record that goes on beyond its range
is put together from the pieces that the ranges give for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civictopics.storage import cut

BYTE_ORDER_MARK = "﻿"
# A record, or a piece of one: ``open`` says that it goes on in the next range.
RECORDS = "file string, block long, number long, text string, head boolean, open boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def range_states(lines: DataFrame) -> tuple[dict[tuple[str, int], bool], set[str]]:
    """Whether each range ``(file, block)`` begins inside quotes, and the files whose header ends with CR LF.

    There are as many rows as ranges.
    """
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    numbered = lines.withColumns({"place": F.monotonically_increasing_id(), "return": F.endswith("value", F.lit("\r"))})
    counted = numbered.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"), F.min_by("return", "place").alias("return"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    rows = counted.select("file", "block", begun, "return").collect()
    return {(file, block): inside for file, block, inside, _ in rows}, {r[0] for r in rows if r[1] == 0 and r[3]}


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, number, text)``: every record of the files, header included, with its line breaks.

    ``number`` counts the records that begin in a range.  Lines end at a line feed; in files whose header
    ends with CR LF every such pair becomes a line feed, inside quotes too.  Quotes must stand as in
    RFC 4180: around a field, or doubled inside one.  Ranges must not change while a file is read; if they
    do, this is an error.
    """
    lines = _lines(spark, path)
    states, with_returns = range_states(lines)
    known = spark.sparkContext.broadcast((states, with_returns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, with_returns = known.value
        place, inside, number, held, returns = None, False, 0, [], False

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            names = [field.split()[0] for field in RECORDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def piece(is_open: bool) -> tuple:
            # Piece 0 of a range that begins inside quotes ends a record from before.
            head = number == 0 and states[place]
            return *place, number, "\n".join(held), head, is_open

        for batch in batches:
            files, blocks = batch.column(0), batch.column(1).to_numpy()
            new = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            if pc.count_distinct(files).as_py() > 1:
                names = np.array(files.to_pylist(), dtype=object)
                new = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])]))
            values, rows = batch.column(2), []
            quotes = pc.count_substring(values, '"').to_numpy() % 2 == 1
            lines = values.to_pylist()
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(blocks)]):
                here = (files[lo].as_py(), int(blocks[lo]))
                if here != place:
                    if held:
                        rows.append(piece(True))
                    if here not in states:
                        raise RuntimeError(f"the ranges of {here[0]} changed while it was read")
                    place, inside, held, returns = here, states[here], [], here[0] in with_returns
                    number = 0 if inside else 1
                for k in range(lo, hi):
                    held.append(lines[k].removesuffix("\r") if returns else lines[k])
                    inside ^= bool(quotes[k])
                    if not inside:
                        rows.append(piece(False))
                        held, number = [], number + 1
            if rows:
                yield made(rows)
        if held:
            yield made([piece(True)])

    found = cut(lines.mapInArrow(run, RECORDS), "csv-records")
    whole = found.filter("not head and not open").select("file", "block", "number", "text")
    # The pieces of a record: where it begins, and then the first piece of each range up to its end.
    split = found.filter("head or open")
    order = Window.partitionBy("file").orderBy("block", "number")
    placed = split.withColumn("begun", F.count_if(~F.col("head")).over(order))
    together = placed.groupBy("file", "begun").agg(
        F.min(F.struct("block", "number")).alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "number", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    return whole.unionByName(together.select("file", "first.block", "first.number", "text"))


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The rows of CSV files with one header, all columns as text, as Spark's own reader gives them.

    A byte order mark is skipped, and empty lines are left out.
    """
    options = {"sep": sep, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    columns = spark.read.csv(path, header=True, multiLine=True, **options).columns
    found = records(spark, path)
    rows = found.filter("not (block = 0 and number = 1)").filter(F.col("text") != "")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    parsed = rows.select(F.from_csv("text", F.lit(schema), {**options, "multiLine": "true"}).alias("row"))
    return parsed.select(*[F.col("row").getField(c).alias(c) for c in columns])
