import hashlib

import pytest
from pyspark.sql import functions as F

from civictopics.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, norm string, page int, Bytes string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda i: (i is not None, i or 0)):
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, **more):
    return sorted((tuple(r) for r in ed.exact_groups(df, **more).collect()), key=repr)


ROWS = [(i, t, "x", 1, "y") for i, t in [
    (1, "Abc"), (2, "aBC"), (3, "ÉTÉ"), (4, "été"), (5, None), (6, ""), (7, " "), (8, "É" * 40_000), (9, "É" * 40_000),
    (9, "É" * 40_000), (None, "n"), (None, "n"), (11, "abd"), (12, "İ"), (13, "i̇"),
]]


def test_odd_rows_by_brute_force(spark):
    assert got(spark.createDataFrame(ROWS, SCHEMA)) == brute(ROWS)
    assert got(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(7).cast("long")])
def test_chains_pages_and_splits(spark, hash_of):
    """A hot text, and hashes that many different texts share."""
    rows = [(i, "Hot text", "x", 1, "y") for i in range(300)]
    rows += [(1000 + i, f"text {i % 60}" * (i % 3 + 1), "x", 1, "y") for i in range(240)]
    assert got(spark.createDataFrame(rows, SCHEMA), bucket_rows=16, hash_of=hash_of) == brute(rows)


def test_directory_splits_overfull_buckets(spark):
    per_hash = spark.range(0, 2000).select(F.xxhash64("id").alias("h"), F.lit(1).cast("long").alias("n"))
    prefix = F.shiftrightunsigned("h", 64 - 12).alias("prefix")
    buckets = per_hash.select(prefix).join(ed.directory(per_hash, 32, 12), "prefix").groupBy("bucket").count()
    sizes = [r["count"] for r in buckets.collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 32


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(1, "a", "k"), (2, "A", "l"), (3, "b", "m")], "doc_id long, text string, extra string")
    assert sorted(tuple(r) for r in ed.exact_dedup(df).collect()) == [(2, "A", "l"), (3, "b", "m")]
