"""Document vectors: hashed TF-IDF, precomputed or user-made vectors, dimension reduction."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictopics.functions import vectors as vx

# Document frequencies are kept per hash bucket, so the table has a fixed size at any scale.
FREQUENCY_BUCKETS = 1 << 18


def bucket_frequencies(df: DataFrame, buckets: int = FREQUENCY_BUCKETS) -> DataFrame:
    """``(bucket, df)``: in how many texts a word of the bucket occurs.

    Bucket -1 holds the number of all texts, so one pass gives both.  A task hashes the distinct words of
    a batch and counts by itself, so that it sends at most one row for a bucket.
    """
    step = vx.ROWS_AT_A_TIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        rows = 0
        for batch in batches:
            tokens = batch.column(0)
            rows += len(tokens)
            coded = tokens.flatten().dictionary_encode()
            # The number that ``hash_number`` gives.
            bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in coded.dictionary.to_pylist()], dtype=np.int64) % buckets
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths, dtype=np.int64)
            for lo in range(0, len(tokens), step):
                size = lengths[lo : lo + step]
                code = coded.indices[ends[lo] - lengths[lo] : ends[lo + len(size) - 1]].drop_null().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                if coded.null_count:
                    row = row[coded.indices[ends[lo] - lengths[lo] : ends[lo + len(size) - 1]].is_valid().to_numpy(zero_copy_only=False)]
                counts += np.bincount(np.unique(row * buckets + bucket[code]) % buckets, minlength=buckets)
        if rows:
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([np.append(used, -1), np.append(counts[used], rows)], names=["bucket", "df"])

    parts = df.select("tokens").mapInArrow(run, "bucket long, df long")
    return parts.groupBy("bucket").agg(F.sum("df").alias("df"))


def inverse_frequencies(df: DataFrame, buckets: int = FREQUENCY_BUCKETS) -> np.ndarray:
    """``ln((1 + N) / (1 + df))`` per bucket.  At most ``buckets + 1`` rows reach the driver."""
    counts = bucket_frequencies(df, buckets).toPandas()
    total = int(counts.loc[counts["bucket"] == -1, "df"].sum())
    counts = counts[counts["bucket"] >= 0]
    frequency = np.zeros(buckets)
    frequency[counts["bucket"].to_numpy()] = counts["df"].to_numpy()
    return np.log((1 + total) / (1 + frequency))


def embed_docs(
    df: DataFrame,
    method: str | Callable[[Column], Column] = "hash",
    dim: int = 256,
    idf: np.ndarray | None = None,
    salt: str = "",
    vectors: DataFrame | None = None,
    text_col: str = "clean_text",
) -> DataFrame:
    """Adds ``embedding ARRAY<DOUBLE>``.

    ``'hash'`` needs ``tokens`` and takes the word weights of ``idf``, or of ``df`` itself.  Every
    text is embedded where it lies: no shuffle, and the weights have a fixed size.
    ``'precomputed'`` joins ``vectors (row_id, embedding)``.  A callable maps the text column to a
    vector column, for example a pandas function around the user's own encoder.
    """
    if callable(method):
        return df.withColumn("embedding", method(F.col(text_col)).cast("array<double>"))
    if method == "precomputed":
        if vectors is None:
            raise ValueError("method='precomputed' needs vectors")
        return df.join(vectors.select("row_id", "embedding"), "row_id")
    if method != "hash":
        raise ValueError("method must be 'hash', 'precomputed' or a callable")
    weights = inverse_frequencies(df) if idf is None else idf
    embed = vx.hashed_vectors(df.sparkSession, weights, dim, salt)
    return df.withColumn("embedding", embed(F.col("tokens")))


def sign_matrix(dim: int, k: int, salt: str = "") -> np.ndarray:
    """A ``dim x k`` matrix of +1/sqrt(k) and -1/sqrt(k), read off the MD5 of ``salt:row:column``."""
    signs = [
        [1.0 if hashlib.md5(f"{salt}:{i}:{j}".encode()).hexdigest()[0] < "8" else -1.0
         for j in range(k)]
        for i in range(dim)
    ]
    return np.array(signs) / np.sqrt(k)


def second_moments(df: DataFrame, dim: int, vector_col: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of the outer products of the vectors of ``df``, in one pass.

    A task adds up its products by itself and sends one row for a number of the vector.
    """
    step = vx.ROWS_AT_A_TIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.column(0).slice(lo, step)
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
                n, total = n + len(x), total + x.sum(axis=0)
                products += x.T @ x
        if n:
            values = pa.ListArray.from_arrays(np.arange(0, dim * (dim + 2) + 1, dim, dtype=np.int32), np.concatenate([products.ravel(), total, np.full(dim, float(n))]))
            yield pa.RecordBatch.from_arrays([np.arange(dim + 2, dtype=np.int32), values], names=["place", "numbers"])

    def add(group: pa.Table) -> pa.Table:
        numbers = group.column("numbers").combine_chunks().flatten().to_numpy().reshape(-1, dim).sum(axis=0)
        return pa.table({"place": group.column("place").slice(0, 1), "numbers": pa.array([numbers], pa.list_(pa.float64()))})

    schema = "place int, numbers array<double>"
    rows = dict(df.select(vector_col).mapInArrow(run, schema).groupBy("place").applyInArrow(add, schema).collect())
    if not rows:
        return 0, np.zeros(dim), np.zeros((dim, dim))
    return round(rows[dim + 1][0]), np.array(rows[dim]), np.array([rows[i] for i in range(dim)])


def component_matrix(df: DataFrame, k: int, dim: int, vector_col: str = "embedding") -> np.ndarray:
    """The ``dim x k`` matrix of Spark's principal components of ``df``, whose vectors are read once and written nowhere.

    Spark fits them on ``2 * dim`` rows that have the covariances of all rows.
    """
    n, total, products = second_moments(df, dim, vector_col)
    if n < 2:
        raise ValueError("principal components need at least two rows")
    values, directions = np.linalg.eigh((products - np.outer(total, total) / n) / (n - 1))
    rows = np.sqrt(np.maximum(values, 0) * (2 * dim - 1) / 2)[:, None] * directions.T
    alike = df.sparkSession.createDataFrame([(x.tolist(),) for x in (*rows, *-rows)], "vector array<double>")
    packed = alike.select(array_to_vector("vector").alias("_packed"))
    return PCA(k=k, inputCol="_packed", outputCol="_components").fit(packed).pc.toArray()


def reduce_dims(
    df: DataFrame,
    k: int = 5,
    method: str = "pca",
    salt: str = "",
    vector_col: str = "embedding",
    dim: int | None = None,
) -> DataFrame:
    """Adds ``reduced ARRAY<DOUBLE>`` of ``k`` numbers.

    ``'pca'`` fits Spark's principal components on ``df``.  ``'projection'`` multiplies with a
    fixed sign matrix; it needs no fit, and ``dim`` saves looking the vector length up.
    """
    if method == "pca":
        packed = df.withColumn("_packed", array_to_vector(F.col(vector_col)))
        model = PCA(k=k, inputCol="_packed", outputCol="_components").fit(packed)
        return (
            model.transform(packed)
            .withColumn("reduced", vector_to_array("_components"))
            .drop("_packed", "_components")
        )
    if method != "projection":
        raise ValueError("method must be 'pca' or 'projection'")
    if dim is None:
        first = df.select(F.size(vector_col)).first()
        dim = first[0] if first else k
    project = vx.projected(sign_matrix(dim, k, salt))
    return df.withColumn("reduced", project(F.col(vector_col)))
