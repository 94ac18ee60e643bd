"""Reading proposals and embeddings, writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictopics.sources.csv_records import read_records
from civictopics.storage import cut

PROPOSALS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("proposal_text", T.StringType()),
])
LABELLED_PROPOSALS = T.StructType([
    *PROPOSALS.fields,
    T.StructField("VCGE_N1", T.StringType()),
    T.StructField("VCGE_N2", T.StringType()),
])
BYTE_ORDER_MARK = "\ufeff"


def read_proposals(
    spark: SparkSession, path: str, schema: T.StructType | None = PROPOSALS, sep: str = ",", strict: bool = True
) -> DataFrame:
    """Read a UTF-8 CSV with a header and quoted texts that may span lines.

    A byte order mark is skipped.  The header names the columns: those of ``schema`` are taken by
    name, in any order, and cast; one that the header lacks is an error.  ``schema=None`` keeps all
    columns as text.  Many tasks read one file, also when its texts have line breaks; ``strict=False``
    takes files whose quotes do not stand as they should, one task for a file.
    """
    if strict:
        found = read_records(spark, path, sep)
    else:
        found = spark.read.csv(
            path, header=True, sep=sep, multiLine=True, quote='"', escape='"', encoding="UTF-8"
        )
    if schema is None:
        return found
    missing = [name for name in schema.names if name not in found.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def with_row_ids(df: DataFrame) -> DataFrame:
    """Add ``row_id`` to rows that have none, growing with the order of files and lines.

    The ids depend on how the input is split, so they are written once and read from there.
    """
    return cut(df.withColumn("row_id", F.monotonically_increasing_id()), "numbered")


def read_embeddings(spark: SparkSession, path: str, id_col: str, vector_col: str) -> DataFrame:
    """``(row_id, embedding)`` from a Parquet table of precomputed vectors."""
    return spark.read.parquet(path).select(
        F.col(id_col).cast("long").alias("row_id"),
        F.col(vector_col).cast("array<double>").alias("embedding"),
    )


def write_csv(df: DataFrame, path: str, bom: bool = False, mode: str = "error") -> None:
    """Write a CSV with a header and doubled quotes.

    ``bom=True`` puts a byte order mark in front of the header of each part, for spreadsheet
    programs that look for one.
    """
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    df.write.mode(mode).csv(path, header=True, escape='"', encoding="UTF-8")


def decimal_text(df: DataFrame, decimal: str = ",") -> DataFrame:
    """Doubles as plain digits with the given decimal sign; other columns are unchanged.

    Numbers keep their shortest form, without an exponent.  NaN and infinities keep their names.
    """

    def plain(name: str) -> Column:
        value = F.col(name)
        # The shortest form with its exponent written out; 38 digits hold it unless it is beyond
        # 10^28 or below 10^-20, where the exponent stays.
        short = value.cast("string")
        size = F.abs(value)
        wide = F.when(size >= 1, short.try_cast("decimal(38,10)").cast("string")).when(
            size >= 1e-20, short.try_cast("decimal(38,37)").cast("string")
        )
        trimmed = F.regexp_replace(F.regexp_replace(wide, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
        return F.regexp_replace(F.when(short.contains("E"), F.coalesce(trimmed, short)).otherwise(short), r"\.", decimal)

    texts = {
        field.name: plain(field.name)
        for field in df.schema.fields
        if isinstance(field.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(texts) if texts else df


def write_results(
    df: DataFrame, path: str, sep: str = ";", decimal: str = ",", mode: str = "error"
) -> None:
    """Write a result table with the separators of a Portuguese spreadsheet."""
    decimal_text(df, decimal).write.mode(mode).csv(
        path, header=True, sep=sep, escape='"', encoding="UTF-8"
    )
