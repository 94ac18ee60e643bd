import random

import pytest

from civictopics.operators import phrases as ph
from civictopics.operators import vocabulary as vo
from civictopics.plans.model import Settings, fit_topics


def brute(tokens, phrases):
    out = []
    for end in range(1, len(tokens) + 1):
        for size in range(end, 1, -1):
            if tuple(tokens[end - size : end]) in phrases:
                out.append(" ".join(tokens[end - size : end]))
    return out


def test_automaton_finds_every_occurrence():
    draw = random.Random(1)
    for _ in range(200):
        phrases = {tuple(draw.choice("abc") for _ in range(draw.randint(2, 4))) for _ in range(draw.randint(1, 6))}
        tokens = [draw.choice("abcd") for _ in range(draw.randint(0, 30))]
        assert ph.TokenAutomaton(sorted(phrases)).found(tokens) == brute(tokens, phrases)


@pytest.mark.parametrize("most_words", [1000, 0])
def test_automaton_and_join_agree(spark, most_words):
    draw = random.Random(2)
    rows = [(i, [draw.choice(["saúde", "pública", "de", "rede", "x"]) for _ in range(i % 40)]) for i in range(120)]
    rows += [(500, None), (501, [])]
    seeds = [("Saúde pública",), ("rede de saúde",), ("rede de saúde pública",), ("única",), (None,), ("saúde  PÚBLICA",)]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>")
    phrases = ph.seed_phrases(spark.createDataFrame(seeds, "seed string"))
    assert sorted(r.word for r in phrases.collect()) == ["rede de saúde", "rede de saúde pública", "saúde pública"]
    known = {tuple(r.words) for r in phrases.collect()}
    got = {r.row_id: r.phrases for r in ph.find_phrases(df.repartition(3), phrases, most_words=most_words).collect()}
    assert {i: None if f is None else sorted(f) for i, f in got.items()} == {i: None if t is None else sorted(brute(t, known)) for i, t in rows}
    assert ph.find_phrases(df.limit(0), phrases, most_words=most_words).collect() == []


def test_phrases_that_occur_are_matched(spark):
    seeds = spark.createDataFrame([("educação básica",), ("merenda escolar",), ("escola",)], "seed string")
    df = spark.createDataFrame([(1, ["educação", "básica", "escola"])], "row_id long, tokens array<string>")
    vocab = vo.vocabulary(ph.with_phrases(df, ph.seed_phrases(seeds)))
    left = sorted(r.word for r in vo.unmatched_seeds(vocab, ph.seed_terms(seeds)).collect())
    assert left == ["escolar", "merenda", "merenda escolar"]


def test_a_fit_counts_seed_phrases(spark):
    texts = [(i, " ".join(["transporte coletivo urbano", f"linha{i}", "ônibus"] if i % 2 else ["posto saúde básica", f"vaga{i}", "médico"])) for i in range(60)]
    seeds = spark.createDataFrame([(0, 0, "transporte coletivo"), (0, 1, "saúde básica")], "seed_topic int, pos int, seed string")
    docs = spark.createDataFrame(texts, "row_id long, clean_text string")
    settings = Settings(min_topic_size=5, reducer="projection", dim=64)
    words = {r.word for r in fit_topics(docs, settings, seed_words=seeds).words.collect()}
    assert {"transporte coletivo", "saúde básica"} & words
    plain = Settings(min_topic_size=5, reducer="projection", dim=64, seed_phrases=False)
    assert not {w for w in (r.word for r in fit_topics(docs, plain, seed_words=seeds).words.collect()) if " " in w}
