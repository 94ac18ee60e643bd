"""What several operators share: columns added batch by batch, words, and the tokenizer files."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
# Texts that a task holds as Python strings at a time.
ROWS_AT_A_TIME = 1000


def n_words(text: Column) -> Column:
    """Number of words of a text as a long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end at white space, so that no word is cut."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + size)
        end = space.end() if space else len(data)
        yield data[at:end]
        at = end


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns whose names are taken by ``names``, in any case."""
    taken = {name.lower() for name in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken])


def parts(
    batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_A_TIME, done: Callable[[], None] | None = None
) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of a bounded number of rows, and at the end the memory given back.

    Python workers outlive their tasks, and what their allocators keep counts against the executor.
    A piece is a copy, so that whoever still holds the last one does not keep its whole batch beside
    the next.  ``done`` is called first, to let go of what the task remembers.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.take(pa.array(range(at, min(at + rows, whole.num_rows)))) if whole.num_rows > rows else whole
        del whole
    if done is not None:
        done()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def add_columns(
    df: DataFrame,
    text_col: str,
    fields: Sequence[tuple[str, T.DataType]],
    compute: Callable[[list[str | None]], Sequence[Sequence]],
    keep: Sequence[str] | None = None,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """``df`` with columns computed from whole texts, one Arrow batch at a time, without a shuffle.

    ``compute`` takes the texts of a batch and returns one list for each field.  ``keep`` names
    the columns of ``df`` that stay (default: all).  An input column with the name of an added
    one is replaced.  ``done`` is called at the end of each task.
    """
    added = T.StructType([T.StructField(name, kind) for name, kind in fields])
    taken = {name.lower() for name in added.names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    types = to_arrow_schema(added)

    # A text that stays is sent to the function once, not a second time to be read.
    read = text_col if text_col in kept and schema[text_col].dataType == T.StringType() else None
    place = kept.index(read) if read else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, done=done):
            columns = [batch.column(i) for i in range(len(kept))]
            values = compute(batch.column(place).to_pylist())
            columns += [pa.array(v, type=f.type) for v, f in zip(values, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    more = [] if read else [F.col(text_col).cast("string").alias("text to read")]
    return df.select(*[df[c] for c in kept], *more).mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; Spark's own function does it for texts that are all ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
