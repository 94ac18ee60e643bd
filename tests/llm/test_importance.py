import hashlib
import math
import re
import zlib

import pytest

from civictopics.llm.importance import feature_buckets, n_gram_pattern, resample, scored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, longest=3, buckets=10_000, min_words=20, share=(5, 100), seed=42):
    def counts(texts):
        out = [0] * buckets
        for text in texts:
            for gram in features(text, longest)[1]:
                out[zlib.crc32(gram.encode()) % buckets] += 1
        return out

    raw, goal = counts(t for _, t in rows), counts(target)
    size, goal_size = sum(raw), sum(goal)
    gain = [math.floor(1000 * math.log((t + 1) * (size + buckets) / ((s + 1) * (goal_size + buckets)))) for s, t in zip(raw, goal)]
    out, able = [], []
    for doc_id, text in rows:
        words, grams = features(text, longest)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams)
        h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(words), len(grams), weight, score, None])
        if len(words) >= min_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[4], r[0]))
    for rank, row in enumerate(able[: len(able) * share[0] // share[1]], 1):
        row[5] = rank
    return sorted(map(tuple, out))


def test_equal_to_brute_force(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("needs the test tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    goal = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text")
    rows, target = [tuple(r) for r in docs.collect()], [r[0] for r in goal.collect()]
    got = sorted(tuple(r) for r in scored(docs.repartition(7), goal).collect())
    assert got == brute(rows, target)
    assert sum(r[5] is not None for r in got) == sum(r[1] >= 20 for r in got) * 5 // 100


@pytest.mark.parametrize("share", [(1, 2), (1, 1), (0, 1)])
def test_ranks_over_many_ranges(spark, share):
    rows = [(i * 37 % 400, " ".join(f"w{i * j % 9}" for j in range(i % 5))) for i in range(400)]
    target = ["w1 w2 w3", "w2 w4", None]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(9),
                     spark.createDataFrame([(t,) for t in target], "text string"), min_words=2, share=share, buckets=97)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, target, min_words=2, share=share, buckets=97)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_of_odd_texts(longest):
    pattern = n_gram_pattern(longest)
    for text in [None, "", " .,; ", "One", "ONE  two\x00three", "É é_é 9a b", "a" * 100, "x\x7fy\x80z", "a b " * 70_000]:
        words, grams = features(text, longest)
        n, found = feature_buckets(text, pattern)
        assert n == len(words)
        assert sorted(found.tolist()) == sorted(zlib.crc32(g.encode()) % 10_000 for g in grams)


def test_odd_tables(spark):
    schema = "doc_id long, text string, score string, ABLE int"
    rows = [(None, "a b c", "s", 1), (1, None, "s", 1), (1, "", None, 1), (2, "a b c", "s", None), (2, "a b c", "s", None)]
    df, goal = spark.createDataFrame(rows, schema), spark.createDataFrame([("b c",)], "text string")
    got = scored(df, goal, min_words=1, share=(1, 1)).collect()
    assert len(got) == 5
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert {r["weight"] for r in got if r["n_words"] == 0} == {0}
    assert scored(df.limit(0), goal).collect() == []
    assert len(scored(df, goal.limit(0)).collect()) == 5
    assert resample(df, goal, min_words=1, share=(1, 1)).columns == df.columns
    assert sorted((r[0] is None, r[0]) for r in resample(df, goal, min_words=1, share=(1, 1)).collect())[0] == (False, 2)
