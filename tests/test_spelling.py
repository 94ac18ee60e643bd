"""Labels by similarity of spelling, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from civictopics.operators import spelling as sp
from civictopics.operators.labelling import NO_CHILDREN


def grams(word):
    marked = "^" + word.lower().translate(str.maketrans(sp.ACCENTED, sp.PLAIN)) + "$"
    return {marked[i:i + 3] for i in range(len(marked) - 2)}


def cosine(a, b):
    a, b = grams(a), grams(b)
    return round(len(a & b) / math.sqrt(len(a) * len(b)), 9)


def words_of(spark, column, words):
    return spark.createDataFrame([(w,) for w in words], f"{column} string")


@pytest.mark.parametrize("alike", [0.3, 0.6, 0.85, 1.0])
def test_similar_words_by_brute_force(spark, alike):
    random.seed(5)
    words = ["".join(random.choices("abcé", k=random.randint(1, 9))) for _ in range(300)]
    names = ["".join(random.choices("abcé", k=random.randint(1, 9))) for _ in range(40)] + ["saúde", "educação"]
    words += ["Saude", "saudes", "educacao", "educaçoes", "ab" * 40]
    found = sp.similar_words(words_of(spark, "word", [*words, *words, None, ""]), words_of(spark, "name_word", [*names, None, ""]), alike)
    expected = {(w, n, cosine(w, n)) for w in words for n in names if cosine(w, n) >= alike}
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_thresholds(spark):
    one = words_of(spark, "word", ["abc"])
    for wrong in (0, -1, 1.01):
        with pytest.raises(ValueError):
            sp.similar_words(one, one.withColumnRenamed("word", "name_word"), wrong)


TAX = [
    (0, "Saúde", 0, "Vigilância sanitária"), (0, "Saúde", 1, "Atendimento básico"),
    (1, "Educação", 0, "Ensino superior"), (2, "Cultura", None, None),
]
TEXTS = [
    (1, "Saude publica", "x"), (2, "mais saude e vigilancia sanitarias", "x"), (3, "na educacao o ensino superiores", "x"),
    (4, "culturas populares", "x"), (5, "nada disso aqui", "x"), (6, None, "x"), (7, "", "x"),
    (8, "saude " * 50_000 + "atendimentos basicos", "x"), (9, "SAÚDE", "x"),
]


def taxonomy(spark):
    return spark.createDataFrame(TAX, "n1_pos int, n1 string, n2_pos int, n2 string")


def test_labels(spark):
    df = spark.createDataFrame(TEXTS, "row_id long, proposal_text string, n1 string")
    rows = {r["row_id"]: (r["n1"], r["n2"]) for r in sp.classify_by_spelling(df, taxonomy(spark)).collect()}
    assert rows == {
        1: ("Saúde", None), 2: ("Saúde", "Vigilância sanitária"), 3: ("Educação", "Ensino superior"),
        4: ("Cultura", NO_CHILDREN), 5: (None, None), 6: (None, None), 7: (None, None),
        8: ("Saúde", "Atendimento básico"), 9: ("Saúde", None),
    }


def test_equal_words_only(spark):
    """At a similarity of 1 a word must have the same letters but for case and accents."""
    df = spark.createDataFrame(TEXTS, "row_id long, proposal_text string, extra string")
    rows = {r["row_id"]: r["n1"] for r in sp.classify_by_spelling(df, taxonomy(spark), alike=1.0).collect()}
    assert rows[1] == "Saúde" and rows[3] == "Educação" and rows[4] is None


def test_empty_tables_and_kept_columns(spark):
    df = spark.createDataFrame(TEXTS, "row_id long, proposal_text string, extra string")
    none = sp.classify_by_spelling(df.limit(0), taxonomy(spark), keep=["extra"])
    assert none.columns == ["row_id", "extra", "n1", "n2", "share_1", "share_2"] and none.count() == 0
    bare = sp.classify_by_spelling(df, taxonomy(spark).limit(0))
    assert bare.count() == len(TEXTS) and bare.filter(F.col("n1").isNotNull()).count() == 0


def test_letters_and_texts_are_read_once(spark):
    words = ["", "a", "Ção", "aaaa", "saúde", "𝒳y", None]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    grams = df.select("word", sp.trigrams(F.col("word")).alias("grams"))
    got = {r.word: r.grams for r in grams.collect()}
    assert got == {"": [], "a": ["^a$"], "Ção": ["^ca", "cao", "ao$"], "aaaa": ["^aa", "aaa", "aa$"],
                   "saúde": ["^sa", "sau", "aud", "ude", "de$"], "𝒳y": ["^𝒳y", "𝒳y$"], None: []}
    assert grams._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_cleaned_texts_are_made_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sp, "found_words", lambda texts, *rest: seen.append(texts) or texts.select("row_id", F.lit(None).cast("map<string,double>").alias("found")))
    docs = spark.createDataFrame([(1, "Item: saude"), (2, None), (3, "")], "row_id long, proposal_text string")
    tax = spark.createDataFrame([("Saúde", 0, None, 0)], "n1 string, n1_pos int, n2 string, n2_pos int")
    sp.classify_by_spelling(docs, tax)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Parágrafo") == 1
    assert {r.row_id: r.words for r in seen[0].collect()} == {1: ["saude"], 3: ["emptydoc"]}
