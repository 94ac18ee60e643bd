import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from civictopics.llm import langid

WORDS = {"en": "the and that with thing which people would there".split(),
         "fr": "les des une dans pour être même où leçon garçon".split(),
         "de": "der und nicht auch über können müssen straße".split()}


def rows(n=240):
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        words = WORDS[lang]
        out.append((i, " ".join(words[(i * 7 + k * k) % len(words)] for k in range(3 + i % 20)), lang, "x", 0.5))
    return out


SCHEMA = "doc_id long, text string, lang string, Lang_Pred string, SCORE double"


@pytest.fixture(scope="module")
def fitted(spark):
    return langid.fit(spark.createDataFrame(rows(), SCHEMA))


def test_held_out_accuracy_and_calibration(spark, fitted):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = langid.identify(df, fitted).withColumn("out", langid.held_out(F.col("doc_id"))).collect()
    unseen = [r for r in got if r.out]
    assert {r.doc_id for r in unseen} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in unseen]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_and_other_columns_have_no_say(spark, fitted):
    changed = [(i, "zzz" if zlib.crc32(str(i).encode()) % 5 == 0 else t, lang, a, b) for i, t, lang, a, b in rows()]
    again = langid.fit(spark.createDataFrame(changed, SCHEMA).repartition(5))
    assert again.languages == fitted.languages and np.array_equal(again.table, fitted.table)


def test_texts_do_not_depend_on_their_batch(fitted, monkeypatch):
    texts = [r[1] for r in rows(30)] + [None, "", "123 !", "é", "x" * 5000]
    together, lettered = fitted.scores(texts)
    for i, text in enumerate(texts):
        alone, one = fitted.scores([text])
        assert np.allclose(alone[0], together[i]) and one[0] == lettered[i]
    assert lettered.tolist()[-5:] == [False, False, False, True, True]
    # A text of several slices counts whole: its second half decides.
    monkeypatch.setattr(langid, "SLICE", 400)
    long = "the and " * 50 + "der und über " * 400
    assert fitted.languages[fitted.scores([long])[0].argmax()] == "de"


def test_odd_rows(spark, fitted):
    odd = [(1, None, "en", "x", 1.0), (2, "", None, "x", 1.0), (2, "", None, "x", 1.0), (None, "42 ...", "en", "x", 1.0), (3, "the and", None, "x", 1.0)]
    df = spark.createDataFrame(odd, SCHEMA)
    got = langid.identify(df, fitted).collect()
    assert [r.lang_pred for r in got] == ["und"] * 4 + ["en"]
    assert [r.score == 0 and r.rejected for r in got] == [True] * 4 + [False]
    assert langid.fit(df.limit(0)) is None and langid.identify(df.limit(0), None).count() == 0
    plain = langid.identify(df, None).collect()
    assert [r.rejected for r in plain] == [True] * 4 + [False] and {r.lang_pred for r in plain} == {"und"}


def test_temperature_and_threshold():
    logits = np.array([[4.0, 0], [3, 0], [0, 2], [0.2, 0]])
    _, threshold = langid.calibrate(logits, np.array([0, 0, 1, 1]), 0.99)
    assert langid.softmax(np.array([0.2, 0])).max() < 1 and threshold > 0
    assert langid.calibrate(logits[:3], np.array([0, 0, 1]), 0.99)[1] == 0.0


def test_wrong_labels_do_not_reject_clean_texts(spark):
    random = np.random.default_rng(5)
    for share in (0.01, 0.02, 0.05):
        accepted = []
        for _ in range(40):
            truth = random.integers(0, 4, 480)
            logits = random.uniform(0.5, 6, (480, 1)) * np.eye(4)[truth]
            said = np.where(random.random(480) < share, (truth + 1) % 4, truth)
            temperature, threshold = langid.calibrate(logits, said, 0.99)
            accepted.append((langid.softmax(logits / temperature).max(axis=1) >= threshold).mean())
        assert np.mean(accepted) > 0.98
    wrong = [(i, t, "de" if i % 20 == 0 else lang, a, b) for i, t, lang, a, b in rows(900)]
    df = spark.createDataFrame(wrong, SCHEMA)
    assert langid.identify(df, langid.fit(df)).filter("not rejected").count() > 0.97 * 900


def test_low_scores_that_are_mostly_wrong_are_rejected():
    truth = np.arange(300) % 2
    strength = np.where(np.arange(300) < 40, 0.3, 3.0)[:, None]
    logits = strength * np.eye(2)[np.where((np.arange(300) < 40) & (np.arange(300) % 5 > 0), 1 - truth, truth)]
    temperature, threshold = langid.calibrate(logits, truth, 0.99)
    best = langid.softmax(logits / temperature).max(axis=1)
    assert (best[:40] < threshold).all() and (best[40:] >= threshold).all()
