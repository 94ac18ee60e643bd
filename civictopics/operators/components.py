"""Principal components of wide sparse vectors, without a covariance matrix.

A range finder starts from a random basis of ``k + extra`` directions over the columns and improves it
by passes over the rows: each task multiplies its rows with the basis and back, and Spark adds the
products by column.  The basis (columns x directions) has the size of the model and does not grow with
the rows.  At the end the rows times the basis, a tall and narrow matrix that stays in Spark, is factored
by a tree of QR steps: each task factors its own rows, and factors are stacked and factored again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictopics.operators.embed import FREQUENCY_BUCKETS, inverse_frequencies
from civictopics.storage import cut

ENTRIES = "array<struct<slot:bigint,value:double>>"
# Numbers in the basis that the tasks receive: 2^18 columns times 64 directions, 128 MB.
MOST_BASIS = 1 << 24
# Factors that are stacked in one step of the tree.
STACKED = 32
# Rows that a task works on at a time, and words whose slots it remembers before it starts anew.
ROWS_AT_A_TIME = 2048
REMEMBERED = 200_000


@dataclass(frozen=True)
class Components:
    """``loadings`` (columns x k) with orthonormal columns, the ``mean`` of the rows, and ``deviations``,
    the standard deviation of the rows along each component, largest first."""

    loadings: np.ndarray
    mean: np.ndarray
    deviations: np.ndarray


def sparse_vectors(df: DataFrame, idf: np.ndarray | None = None, width: int = FREQUENCY_BUCKETS) -> DataFrame:
    """Adds ``entries``: the hashed TF-IDF vector of ``tokens``, of length 1, its zeros left out.

    The weights are those of ``embed_docs``; every word has its own slot but for collisions of the hash.
    A text without tokens, null included, has no entries.  Texts stay where they are.
    """
    weights = inverse_frequencies(df) if idf is None else idf
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def weigh(tokens: pa.Array) -> pa.Array:
        import hashlib

        known = shared.value
        seen: dict[str, tuple[int, float]] = {}
        ends, places, values = [np.zeros(1, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for lo in range(0, len(tokens), ROWS_AT_A_TIME):
            place, value, end = [], [], []
            for words in tokens.slice(lo, ROWS_AT_A_TIME).to_pylist():
                slots: dict[int, float] = {}
                for word in words or ():
                    if word not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        digest = hashlib.md5(word.encode()).hexdigest()
                        sign = 1.0 if digest[16] < "8" else -1.0
                        seen[word] = int(digest[8:16], 16) % width, sign * known[int(digest[:8], 16) % len(known)]
                    slot, weight = seen[word]
                    slots[slot] = slots.get(slot, 0.0) + weight
                norm = sum(v * v for v in slots.values()) ** 0.5
                for slot, v in sorted(slots.items()) if norm else ():
                    if v:
                        place.append(slot)
                        value.append(v / norm)
                end.append(len(place))
            ends.append(np.array(end, dtype=np.int32) + ends[-1][-1])
            places.append(np.array(place, dtype=np.int64))
            values.append(np.array(value))
        entries = pa.StructArray.from_arrays([np.concatenate(places), np.concatenate(values)], ["slot", "value"])
        return pa.ListArray.from_arrays(np.concatenate(ends), entries)

    return df.withColumn("entries", F.arrow_udf(weigh, returnType=ENTRIES)(F.col("tokens")))


def _slices(columns: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """Columns in pieces of a bounded number of rows, without empty ones."""
    for column in columns:
        for lo in range(0, len(column), ROWS_AT_A_TIME):
            yield column.slice(lo, ROWS_AT_A_TIME)


def _times(entries: pa.Array, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows times ``matrix``, and the row, slot and value of every entry."""
    import pyarrow.compute as pc

    flat = entries.flatten()
    slots = flat.field("slot").to_numpy(zero_copy_only=False)
    values = flat.field("value").to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(entries), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(entries)), lengths)
    product = np.zeros((len(entries), matrix.shape[1]))
    filled = np.flatnonzero(lengths)
    if len(filled):
        starts = (np.cumsum(lengths) - lengths)[filled]
        for column in range(matrix.shape[1]):
            product[filled, column] = np.add.reduceat(matrix[slots, column] * values, starts)
    return product, rows, slots, values


def _column_sums(df: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """The number of rows, and the sum of each column; at most ``width + 1`` rows reach the driver."""
    every = F.concat(
        F.array(F.struct(F.lit(-1).cast("long").alias("slot"), F.lit(1.0).alias("value"))),
        F.coalesce("entries", F.array().cast(ENTRIES)),
    )
    found = df.select(F.inline(every)).groupBy("slot").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    sums, rows = np.zeros(width), 0
    for slot, value in zip(found["slot"], found["value"]):
        if slot < 0:
            rows = int(value)
        else:
            sums[slot] = value
    return rows, sums


def _there_and_back(df: DataFrame, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The centred rows, transposed, times the centred rows times ``basis``: one pass over the rows."""
    width, directions = basis.shape
    shared = df.sparkSession.sparkContext.broadcast((basis, mean @ basis))
    names = [f"c{i}" for i in range(directions)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, middle = shared.value
        total = np.zeros((width, directions))
        for entries in _slices(batch.column(0) for batch in batches):
            product, rows, slots, values = _times(entries, matrix)
            product -= middle
            for column in range(directions):
                total[:, column] += np.bincount(slots, values * product[rows, column], minlength=width)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, i]) for i in range(directions))], ["slot", *names])

    schema = ", ".join(["slot bigint", *(f"{n} double" for n in names)])
    parts = df.select("entries").mapInArrow(multiply, schema)
    found = parts.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    shared.unpersist()
    out = np.zeros((width, directions))
    out[found["slot"].to_numpy()] = np.column_stack([found[n].to_numpy() for n in names])
    # The rows less their mean times what sums to zero over the rows: the mean drops out.
    return out


def stacked(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """``(rows, mean, factor)`` of rows of which ``parts`` have those of disjoint shares.

    ``factor`` is the triangular factor of the rows less their mean.  The shares have their own means;
    a row for each of them, its distance from the common mean, makes up the difference.
    """
    parts = [p for p in parts if p[0]]
    if not parts:
        return 0, np.zeros(0), np.zeros((0, 0))
    rows = sum(n for n, _, _ in parts)
    mean = sum(n * m for n, m, _ in parts) / rows
    rest = [np.sqrt(n) * (m - mean)[None, :] for n, m, _ in parts]
    return rows, mean, np.linalg.qr(np.vstack([f for _, _, f in parts] + rest), mode="r")


FACTOR = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("factor", T.ArrayType(T.DoubleType())),
])


def _one_factor(part: int, parts: list[tuple[int, np.ndarray, np.ndarray]], width: int) -> pd.DataFrame:
    rows, mean, factor = stacked(parts)
    square = np.zeros((width, width))
    square[: len(factor)] = factor[:width] if len(factor) else 0
    return pd.DataFrame({
        "part": [part], "n": [rows], "mean": [(mean if rows else np.zeros(width)).tolist()], "factor": [square.ravel().tolist()],
    })


def tall_factor(df: DataFrame, basis: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """``(rows, mean, factor)`` of the rows times ``basis``, by a tree of QR steps."""
    directions = basis.shape[1]
    shared = df.sparkSession.sparkContext.broadcast(basis)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        matrix, held = shared.value, (0, np.zeros(directions), np.zeros((0, directions)))
        for entries in _slices(batch.column(0) for batch in batches):
            product = _times(entries, matrix)[0]
            mean = product.mean(axis=0)
            held = stacked([held, (len(product), mean, np.linalg.qr(product - mean, mode="r"))])
        out = _one_factor(TaskContext.get().partitionId(), [held], directions)
        yield pa.RecordBatch.from_pandas(out[out["n"] > 0], preserve_index=False)

    def join_up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        shape = (directions, directions)
        parts = [
            (int(n), np.asarray(m), np.asarray(f).reshape(shape)) for n, m, f in zip(group["n"], group["mean"], group["factor"])
        ]
        return _one_factor(int(key[0]), parts, directions)

    level = cut(df.select("entries").mapInArrow(factors, FACTOR), "factors")
    most = level.agg(F.max("part")).first()[0]
    while most is not None and most > 0:
        level = cut(level.groupBy(F.floor(F.col("part") / STACKED).alias("part_of")).applyInPandas(join_up, FACTOR), "factors")
        most //= STACKED
    last = level.collect()
    if not last:
        return 0, np.zeros(directions), np.zeros((0, directions))
    return last[0]["n"], np.array(last[0]["mean"]), np.array(last[0]["factor"]).reshape(directions, directions)


def fit_components(
    df: DataFrame, k: int = 5, width: int = FREQUENCY_BUCKETS, extra: int = 10, passes: int = 6, seed: int = 0,
) -> Components:
    """The first ``k`` principal components of ``entries``, sparse rows of ``width`` columns.

    Rows without entries, null included, are zero vectors and count.  ``extra`` directions and more
    ``passes`` bring the result closer to the exact components; the error falls with each pass by the
    squared ratio of the deviation past the last direction to the ``k``-th one.  Each component points so
    that its largest loading (the first of equals) is positive.  Fewer than ``k`` directions with any
    deviation leave the others with deviation 0.  The rows are read ``passes + 2`` times; write them
    first if they are dear to make.
    """
    directions = min(k + extra, width)
    if k > width:
        raise ValueError(f"{k} components of {width} columns")
    if width * directions > MOST_BASIS:
        raise ValueError(f"a basis of {width} x {directions} numbers is over {MOST_BASIS}; take fewer columns or components")
    rows, sums = _column_sums(df, width)
    mean = sums / max(rows, 1)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, directions)))[0]
    for _ in range(passes if rows else 0):
        product = _there_and_back(df, basis, mean)
        if not product.any():
            break
        basis = np.linalg.qr(product)[0]
    n, _, factor = tall_factor(df, basis)
    if not n:
        return Components(basis[:, :k], mean, np.zeros(k))
    _, lengths, turned = np.linalg.svd(factor)
    loadings = basis @ turned[:k].T
    largest = np.abs(loadings).argmax(axis=0)
    signs = np.where(loadings[largest, np.arange(k)] < 0, -1.0, 1.0)
    return Components(loadings * signs, mean, lengths[:k] / np.sqrt(max(n - 1, 1)))


def project_sparse(df: DataFrame, components: Components) -> DataFrame:
    """Adds ``reduced ARRAY<DOUBLE>``: ``entries`` along the components, the mean left in, as dense
    principal components have it."""
    shared, k = df.sparkSession.sparkContext.broadcast(components.loadings), components.loadings.shape[1]

    def project(entries: pa.Array) -> pa.Array:
        product = np.concatenate([np.zeros((0, k)), *(_times(part, shared.value)[0] for part in _slices([entries]))])
        return pa.ListArray.from_arrays(np.arange(0, len(product) * k + 1, k, dtype=np.int32), product.ravel())

    along: Column = F.arrow_udf(project, returnType="array<double>")(F.col("entries"))
    return df.withColumn("reduced", along)

