"""Exact de-duplication with an extendible-hash index on shared files.

Texts are hashed to 64 bits.  The leading bits address a directory; a bucket that would hold more
than its capacity is split by doubling the directory, that is by one more bit, as often as needed.
A bucket is thus a range of hash values.  An owner task takes whole buckets, compares the bytes of
the texts in them, and chains texts that differ behind one hash.  A hash that alone overfills a
bucket cannot be split by more bits: it gets overflow pages, each compared by itself, and the few
texts the pages leave are compared once more.

The directory has at most 2^16 entries and there are at most 2^16 overfull hashes, at any size of
the input, because the capacity grows with it; so both are broadcast.  Texts move once.  The
index of the buckets is a Parquet table in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictopics.llm.common import ascii_lower
from civictopics.storage import cut

BUCKET_ROWS = 512
MAX_DEPTH = 16


def directory(per_hash: DataFrame, capacity: int, depth: int) -> DataFrame:
    """``(prefix, bucket)`` for each used address of ``depth`` bits.

    ``per_hash (h, n)`` counts rows by hash.  Row counts of all doublings come from one grouping;
    an address gets the bucket of the first doubling at which that bucket holds no more than
    ``capacity`` rows.  Buckets are numbered by their bits behind a leading 1.
    """
    held = F.when(F.col("n") > capacity, 1).otherwise(F.col("n"))
    prefix = F.shiftrightunsigned("h", 64 - depth)
    addresses = cut(
        per_hash.select(prefix.alias("prefix"), held.alias("n")).groupBy("prefix").agg(F.sum("n").alias("n")),
        "addresses",
    )
    bucket = F.expr(f"shiftleft(1L, bits) + shiftright(prefix, {depth} - bits)")
    doublings = addresses.select("prefix", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
    doublings = doublings.select("prefix", "n", "bits", bucket.alias("bucket"))
    fits = doublings.groupBy("bits", "bucket").agg(F.sum("n").alias("rows")).filter(
        (F.col("rows") <= capacity) | (F.col("bits") == depth)
    )
    return doublings.join(fits, ["bits", "bucket"]).groupBy("prefix").agg(
        F.min(F.struct("bits", "bucket"))["bucket"].alias("bucket")
    )


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
    hash_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``df``.

    Texts are equal when they are the same bytes after lower-casing A-Z; null counts as empty, so
    null and empty texts are one group.  The row with the largest id of a group stays.  A null id
    is smaller than any other; of rows that repeat the largest id, one is kept.  Texts of any
    length are compared whole.  An empty table gives an empty result.  Other columns of ``df``
    are not read, so their names do not matter.
    """
    text = ascii_lower(F.coalesce(df[text_col].cast("string"), F.lit("")))
    texts = df.select(df[id_col].alias("doc_id"), text.alias("norm")).withColumn("h", hash_of(F.col("norm")))
    keys = cut(
        texts.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"),
                     F.monotonically_increasing_id().alias("row")),
        "dedup-keys",
    )
    rows = keys.count()
    capacity = max(bucket_rows, math.ceil(rows / (1 << MAX_DEPTH)))
    depth = min(MAX_DEPTH, 4 + max(1, rows // capacity).bit_length())
    per_hash = cut(keys.groupBy("h").agg(F.count("*").alias("n")), "dedup-hashes")
    buckets = cut(directory(per_hash, capacity, depth), "dedup-directory")
    overfull = cut(
        per_hash.filter(F.col("n") > capacity).select("h", F.ceil(F.col("n") / capacity).alias("pages")),
        "dedup-overfull",
    )
    owned = (
        texts.withColumn("prefix", F.shiftrightunsigned("h", 64 - depth))
        .join(F.broadcast(buckets), "prefix")
        .join(F.broadcast(overfull), "h", "left")
        .withColumn("page", F.coalesce(F.pmod(F.xxhash64("doc_id"), "pages"), F.lit(0)))
        .repartition("bucket", "page")
    )
    index = cut(
        owned.groupBy("bucket", "page", "pages", "h", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("bucket", "h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size",
                F.when(F.col("pages").isNotNull(), F.col("norm")).alias("bytes")),
        "dedup-index",
    )
    paged = index.filter(F.col("bytes").isNotNull()).groupBy("h", "bytes").agg(
        F.first("text_sha256").alias("text_sha256"), F.max("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
    )
    names = ["h", "text_sha256", "keep_id", "group_size"]
    groups = index.filter(F.col("bytes").isNull()).select(names).unionByName(paged.select(names))
    # Which row stays where the largest id is repeated.
    last = keys.groupBy("h", "text_sha256").agg(F.max(F.struct("doc_id", "row"))["row"].alias("keep_row"))
    found = cut(groups.join(last, ["h", "text_sha256"]), "dedup-groups")
    # The groups have one row for each text, so Spark can split a group's rows among tasks here.
    return keys.join(found, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.  ``id_col`` must be a key of ``df``."""
    kept = exact_groups(df, id_col, text_col).filter("kept").select(F.col("doc_id").alias("kept id"))
    return df.join(kept, df[id_col].eqNullSafe(kept["kept id"]), "left_semi")
