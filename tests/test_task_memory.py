"""What a task holds at a time does not follow the size of its Arrow batches."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from civictopics.functions import vectors as vx
from civictopics.operators import components as cp
from civictopics.operators import embed as em
from civictopics.operators import phrases as ph


class Table:
    """As much of a DataFrame and its session as the functions need to hand out their work."""

    def __init__(self):
        self.sparkContext = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
        self.sparkSession = self

    def withColumn(self, name, function):
        return function


@pytest.fixture
def bare(monkeypatch):
    """The function of one batch, without Spark."""
    for module in (vx, cp):
        monkeypatch.setattr(module.F, "arrow_udf", lambda function, returnType=None: lambda column: function)
    monkeypatch.setattr(cp.F, "col", lambda name: name)
    return Table()


def peak(function, *given):
    tracemalloc.start()
    out = function(*given)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most / 1e6


def batch(rows=10_000, words=40):
    rng = np.random.default_rng(1)
    known = [f"word{i}" for i in range(5000)]
    return pa.array([[known[k] for k in rng.integers(0, 5000, words)] for _ in range(rows - 2)] + [None, []], pa.list_(pa.string()))


def test_hashed_vectors(bare):
    tokens = batch()
    embed = vx.hashed_vectors(bare, np.ones(1 << 10), 256)("tokens")
    whole, most = peak(embed, tokens)
    assert len(whole) == 10_000 and most < 35  # the result itself has 20
    assert embed(tokens.slice(700, 300)).equals(whole.slice(700, 300))
    best = vx.nearest_of(bare, (np.arange(200), np.random.default_rng(2).normal(size=(200, 256))))("embedding")
    found, most = peak(best, whole)
    assert most < 15 and best(whole.slice(600, 50)).equals(found.slice(600, 50))


def test_sparse_vectors(bare):
    tokens = batch(6000)
    weigh = cp.sparse_vectors(bare, np.linspace(1, 2, 1 << 10))
    whole, most = peak(weigh, tokens)
    assert most < 40 and len(whole) == 6000 and whole[-1].as_py() == whole[-2].as_py() == []
    assert weigh(tokens.slice(2000, 100)).to_pylist() == whole.slice(2000, 100).to_pylist()
    sums = [sum(e["value"] ** 2 for e in row) for row in whole.slice(0, 50).to_pylist()]
    assert np.allclose(sums, 1)


def test_words_remembered_are_bounded(bare, monkeypatch):
    tokens = batch(100)
    weigh = cp.sparse_vectors(bare, np.linspace(1, 2, 1 << 10))
    want = weigh(tokens).to_pylist()
    monkeypatch.setattr(cp, "REMEMBERED", 50)
    assert weigh(tokens).to_pylist() == want


def test_phrases_come_in_pieces(spark):
    rows = [(i, ["a", "b", "c"] * (i % 3)) for i in range(1500)] + [(9999, None)]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>").coalesce(1)
    known = spark.createDataFrame([("a b", ["a", "b"])], "word string, words array<string>")
    found = {r.row_id: r.phrases for r in ph.find_phrases(df, known).collect()}
    assert found == {i: None if t is None else ["a b"] * (len(t) // 3) for i, t in rows}


def test_bucket_frequencies_are_counted_in_the_tasks(spark):
    """Equal to the expression of each word, with a row for a bucket and task instead of one for each word of a text."""
    rows = [(i, [f"w{i % 7}", f"w{i % 11}", "all", "all"]) for i in range(1300)] + [(5000, None), (5001, []), (5002, ["all", None])]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>").coalesce(2)
    number = vx.F.expr("conv(substring(md5(word), 1, 8), 16, 10) % 8").cast("long").alias("bucket")
    words = df.select("row_id", vx.F.explode("tokens").alias("word")).select("row_id", number).distinct()
    want = {r[0]: r[1] for r in words.filter("bucket is not null").groupBy("bucket").count().collect()} | {-1: 1303}
    found = em.bucket_frequencies(df, 8)
    assert {r.bucket: r.df for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert em.bucket_frequencies(df.limit(0), 8).collect() == []
