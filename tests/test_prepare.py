import random

import pandas as pd
from pyspark.sql import functions as F

from civictopics.functions import text as tx
from civictopics.operators import prepare as pr


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id long, proposal_text string")


def column(spark, values, expression):
    df = texts(spark, values).select("row_id", expression(F.col("proposal_text")).alias("x"))
    return [row["x"] for row in df.orderBy("row_id").collect()]


def test_literal_nulls_are_one_document(spark):
    rows = texts(spark, ["a", None, "  ", "a ", None, "A"])
    kept = pr.clean_and_prepare(rows, null_policy="literal", words=[]).orderBy("row_id").collect()
    assert [(r.row_id, r.original_text) for r in kept] == [(0, "a"), (1, "nan"), (5, "A")]


def test_nulls_are_dropped_by_default(spark):
    rows = texts(spark, ["a", None, "  ", "a ", None, "A"])
    kept = pr.clean_and_prepare(rows, words=[]).orderBy("row_id").collect()
    assert [(r.row_id, r.original_text) for r in kept] == [(0, "a"), (5, "A")]


def test_strip_matches_python(spark):
    samples = ["  olá　", "\x1c\x85x\x1f", " \t\r\n", "a​b", "​", "  x  y  "]
    assert column(spark, samples, tx.strip_text) == [s.strip() for s in samples]


def test_dedup_keeps_the_smallest_id_whatever_the_partitions(spark):
    rows = [(i, random.Random(i).choice("abc")) for i in range(300)]
    expected = pd.DataFrame(rows, columns=["row_id", "t"]).drop_duplicates("t")["row_id"].tolist()
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], "row_id long, original_text string").repartition(parts)
        found = sorted(r.row_id for r in pr.first_of_each_text(df).collect())
        assert found == sorted(expected)


def test_simple_tokens(spark):
    samples = ["Água 12 é_bom _x _ 3D a bc " + "y" * 15 + " " + "z" * 16, "x²y IV", ""]
    assert column(spark, samples, tx.simple_tokens) == [
        ["água", "é_bom", "bc", "y" * 15], ["x²y", "iv"], []
    ]


def test_stop_words_keep_repeats(spark):
    got = column(spark, ["de casa de casa"], lambda c: tx.without_words(F.split(c, " "), ["de"]))
    assert got == [["casa", "casa"]]
    assert "não" in pr.stop_words("portuguese")


def test_text_of_stop_words_stays(spark):
    kept = pr.clean_and_prepare(texts(spark, ["de para com"])).collect()
    assert [(r.original_text, r.clean_text, r.tokens) for r in kept] == [("de para com", "", [])]


def test_model_tokens(spark):
    samples = ["A\tbc\n12 x", "", "ÁGUA_1-é2"]
    assert column(spark, samples, tx.model_tokens) == [["bc", "12"], ["emptydoc"], ["água_1", "é2"]]


def test_ngrams(spark):
    got = column(spark, ["a b c", "a", ""], lambda c: tx.ngrams(F.filter(F.split(c, " "), lambda w: w != ""), 1, 2))
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_clean_text(spark):
    sample = "O artigo: 5 do PARÁGRAFO único\n\nitens Item: a  b itemizado"
    assert column(spark, [sample], tx.clean_text) == ["O  5 do  único itens  a b itemizado"]
    assert column(spark, ["xé" * 5], lambda c: tx.clean_text(c, max_chars=3)) == ["xéx"]
    assert column(spark, ["é" * 5000], tx.clean_text) == ["é" * 5000]


def test_lemmatise_keeps_order_and_repeats(spark):
    df = spark.createDataFrame(
        [(1, ["casas", "verdes", "casas"]), (2, [])], "row_id long, tokens array<string>"
    )
    lexicon = spark.createDataFrame([("casas", "casa")], "token string, lemma string")
    got = {r.row_id: r.tokens for r in pr.lemmatise(df, lexicon).collect()}
    assert got == {1: ["casa", "verdes", "casa"], 2: []}


def test_lemmatise_moves_only_words_that_change(spark):
    rows = [(i, ["stay"] * 50 + ["casas", "casas", None]) for i in range(40)] + [(100, None), (None, ["casas"])]
    rows += [(200, ["casas", "b"]), (200, ["c"])]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>")
    lexicon = spark.createDataFrame([("casas", "casa"), (None, "x"), ("b", None)], "token string, lemma string")
    done = pr.lemmatise(df.filter("row_id < 200"), lexicon)
    assert "posexplode" not in done._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((-1 if r.row_id is None else r.row_id, r.tokens) for r in pr.lemmatise(df, lexicon).collect())
    assert got[0] == (-1, []) and got[1] == (0, ["stay"] * 50 + ["casa", "casa", None]) and got[41] == (100, [])
    assert len(got) == 44 and all(i == 200 and sorted(t) == ["b", "c", "casa"] for i, t in got[42:])


def test_copies_collapse_before_the_shuffle(spark):
    df = spark.range(20000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "cópia").otherwise(F.col("id").cast("string")).alias("proposal_text"),
    )
    prepared = pr.clean_and_prepare(df, words=[])
    plan = prepared._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "SortAggregate" not in plan
    assert prepared.count() == 20000 - 6667 + 1


def test_columns_to_keep_come_from_the_row_that_stays(spark):
    rows = [(3, "a b", 30, "x"), (1, " a b", None, "y"), (2, "c d", 20, None), (4, None, 1, "z")]
    df = spark.createDataFrame(rows, "row_id long, proposal_text string, source long, tokens_of string")
    kept = pr.clean_and_prepare(df, words=[], min_len=1, keep=["source", "tokens_of"])
    assert {(r["row_id"], r["clean_text"], r["source"], r["tokens_of"]) for r in kept.collect()} == {
        (1, "a b", None, "y"), (2, "c d", 20, None),
    }
    plan = pr.clean_and_prepare(df, words=[], keep=["source"])._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
