"""A model that grows by batches against one fitted on the texts that are left."""

import random

import pytest
from pyspark.sql import functions as F

from civictopics.plans.growing import OUTSIDE, GrowingModel, keep_numbers, signed_counts
from civictopics.plans.model import Settings
from civictopics.storage import committed, new_path

SETTINGS = Settings(reducer="projection", dim=16, k=3, min_topic_size=4, min_pts=3)
SCHEMA = "row_id long, tokens array<string>, sign int"


def texts(n, seed=1):
    rng = random.Random(seed)
    pools = [[f"{name}{i}" for i in range(4)] for name in ("tax", "park", "bus")]
    return [(i, rng.choices(pools[i % 3], k=6)) for i in range(n)]


def signed(spark, rows, sign=1):
    return spark.createDataFrame([(i, tokens, sign) for i, tokens in rows], SCHEMA)


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def model_of(spark, *batches, **options):
    model = GrowingModel(new_path(spark, "growing"), SETTINGS, **options)
    for n, batch in enumerate(batches):
        model.apply(batch, n)
    return model


def test_batches_add_up_to_one_fit(spark):
    rows = texts(60)
    first, second, gone = rows[:25], rows[25:], rows[10:35]
    left = rows[:10] + rows[35:]
    grown = model_of(spark, signed(spark, first), signed(spark, second).unionByName(signed(spark, gone, -1)))
    whole = model_of(spark, signed(spark, left))
    assert as_set(grown.state(spark)) == as_set(whole.state(spark))
    assert sum(r["cnt"] for r in whole.cells(spark).collect()) == len(left)
    plain = {}
    for _, tokens in left:
        for word in tokens:
            plain[word] = plain.get(word, 0) + 1
    counted = {r["word"]: r["n"] for r in grown.words(spark).groupBy("word").agg(F.sum("cnt").alias("n")).collect()}
    assert counted == plain


def test_all_texts_leave(spark):
    rows = signed(spark, texts(12))
    model = model_of(spark, rows, rows.withColumn("sign", F.lit(-1)))
    assert model.state(spark).isEmpty() and model.topics(spark).isEmpty() and model.top_words(spark).isEmpty()


def test_a_batch_sent_again_counts_once(spark):
    rows = signed(spark, texts(12))
    model = model_of(spark, rows)
    before = as_set(model.state(spark))
    model.apply(rows, 0)
    assert as_set(model.state(spark)) == before


def test_half_written_batch_is_no_batch(spark):
    rows = signed(spark, texts(12))
    model = model_of(spark, rows)
    before = as_set(model.state(spark))
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        signed_counts(rows, SETTINGS).write.parquet(f"{model.folder}/batch=1")
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert committed(spark, model.folder, "batch") == [0]
    assert as_set(model.state(spark)) == before
    model.apply(rows.withColumn("sign", F.lit(-1)), 1)
    assert model.state(spark).isEmpty()


def test_compacting_changes_nothing(spark):
    rows = texts(40)
    parts = [signed(spark, rows[i::4]) for i in range(4)]
    plain, compacted = model_of(spark, *parts), model_of(spark, *parts, compact_after=2)
    assert committed(spark, compacted.folder, "base") == [1, 3]
    assert committed(spark, compacted.folder, "batch") == [2, 3]
    assert as_set(plain.state(spark)) == as_set(compacted.state(spark))
    compacted.apply(parts[0], 0)
    compacted.apply(parts[3], 3)
    assert as_set(plain.state(spark)) == as_set(compacted.state(spark))
    assert compacted.last_batch(spark) == 3


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, [], 1), (None, ["a", None, "a"], 1), (4, ["b"], None), (5, ["c"], 1), (5, ["c"], 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"cell": F.lit("x"), "reduced": F.lit(0), "topic": F.lit(7)})
    model = model_of(spark, docs)
    assert {(r["word"], r["cnt"]) for r in model.words(spark).collect()} == {("a", 2), ("c", 2)}
    outside = [tuple(r) for r in model.state(spark).filter(F.col("cell") == OUTSIDE).collect()]
    assert outside == [(OUTSIDE, None, 2, 0, 0, 0)]
    assert [r["topic"] for r in model.assign(docs).collect()] == [-1] * 6
    empty = model_of(spark, docs.limit(0))
    assert empty.state(spark).isEmpty() and empty.topics(spark).isEmpty()


def test_negative_counts_are_in_no_topic_and_can_be_made_up_for(spark):
    rows = signed(spark, texts(12))
    model = model_of(spark, rows.withColumn("sign", F.lit(-1)))
    assert model.cells(spark).isEmpty() and model.words(spark).isEmpty()
    model.apply(rows, 1)
    assert model.state(spark).isEmpty()


def test_numbers_stay(spark):
    def table(rows, names):
        return spark.createDataFrame(rows, names)

    before = table([(1, 0), (2, 0), (3, 1), (4, 2), (5, 2)], "cell long, topic long")
    cells = table([(c, n) for c, n in [(1, 10), (2, 9), (3, 5), (4, 4), (5, 4), (6, 3)]], "cell long, cnt long")
    # Topic 0 splits (10 against 9 texts), 1 and a part of 2 merge, 6 is new; 2's other part, of equal size, goes on.
    found = table([(1, 1), (2, 0), (3, 2), (4, 2), (5, 3), (6, 4)], "cell long, topic long")
    kept = {r["cell"]: r["topic"] for r in keep_numbers(found, before, cells, 6).collect()}
    assert kept == {1: 0, 2: 7, 3: 1, 4: 1, 5: 8, 6: 9}


def test_topics_keep_numbers_and_gone_ones_do_not_come_back(spark):
    rows = texts(60)
    kinds = [[r for r in rows if r[1][0].startswith(name)] for name in ("tax", "park", "bus")]
    first = [*kinds[0], *kinds[1][:10]]
    model = model_of(spark, signed(spark, first))
    one = {tuple(r) for r in model.topics(spark).collect()}
    assert {t for _, t in one} and model.topics(spark).count() == len(one)
    top = max(t for _, t in one)
    model.apply(signed(spark, first, -1).unionByName(signed(spark, kinds[2])), 1)
    model.topics(spark)
    model.apply(signed(spark, kinds[2], -1), 2)
    assert model.topics(spark).isEmpty()
    model.apply(signed(spark, first), 3)
    again = {tuple(r) for r in model.topics(spark).collect()}
    assert {c for c, _ in again} == {c for c, _ in one}
    assert min(t for _, t in again) > top
    # Asked again without a batch in between, they are the same.
    assert {tuple(r) for r in model.topics(spark).collect()} == again
    assigned = model.assign(signed(spark, first)).groupBy("topic").count()
    assert {r["topic"] for r in assigned.collect()} - {-1} == {t for _, t in again}
    assert {r["topic"] for r in model.top_words(spark).collect()} - {-1} == {t for _, t in again}


def test_as_sink_of_a_stream(spark):
    rows, source = texts(30), new_path(spark, "arriving")
    for i in range(3):
        signed(spark, rows[i::3]).coalesce(1).write.mode("append").parquet(source)
    model = GrowingModel(new_path(spark, "growing"), SETTINGS)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream.writeStream.foreachBatch(model.apply).trigger(availableNow=True)
        .option("checkpointLocation", new_path(spark, "stream-state")).start()
    )
    query.awaitTermination(120)
    assert model.last_batch(spark) == 2
    assert as_set(model.state(spark)) == as_set(model_of(spark, signed(spark, rows)).state(spark))


def test_settings_that_cannot_grow(spark):
    with pytest.raises(ValueError):
        GrowingModel("x", Settings())


def test_tasks_add_up_words_before_they_leave(spark, monkeypatch):
    monkeypatch.setattr("civictopics.plans.growing.TEXTS_AT_A_TIME", 50)
    rows = [(i, ["hot", "hot", None, f"w{i % 3}"], None if i == 0 else 1) for i in range(200)]
    rows += [(500, None, 1), (501, [], 1), (502, ["gone"], 1), (502, ["gone"], -1)]
    counts = signed_counts(spark.createDataFrame(rows, SCHEMA).coalesce(1), SETTINGS)
    found = {}
    for r in counts.collect():
        found[r.word] = found.get(r.word, 0) + r.cnt
    assert found == {None: 201, "hot": 398, "w0": 66, "w1": 67, "w2": 66}
    # No row for each word goes on: the plan has no generator.
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
