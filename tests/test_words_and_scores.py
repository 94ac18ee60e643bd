import math
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civictopics.operators import agreement as ag
from civictopics.operators import coherence as co
from civictopics.operators import vocabulary as vo

DOCS = [
    (1, 0, ["a", "b", "a", "c"]),
    (2, 0, ["a", "b"] * 12),
    (3, 1, ["d", "e", "d"] + ["x"] * 15 + ["e"]),
    (4, -1, ["a", "d", "z"]),
    (5, 1, []),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "row_id long, topic long, tokens array<string>")


def test_vocabulary(docs):
    got = {r.word: (r.cf, r.df) for r in vo.vocabulary(docs).collect()}
    cf = Counter(w for _, _, t in DOCS for w in t)
    df = Counter(w for _, _, t in DOCS for w in set(t))
    assert got == {w: (cf[w], df[w]) for w in cf}


def test_class_tfidf(docs, spark):
    counts = vo.topic_term_counts(docs)
    got = {(r.topic, r.word): r.weight for r in vo.class_tfidf(counts).collect()}
    per_topic = {t: Counter(w for _, k, tok in DOCS if k == t for w in tok) for t in (-1, 0, 1)}
    mean = math.floor(sum(sum(c.values()) for c in per_topic.values()) / 3)
    total = sum(per_topic.values(), Counter())
    for topic, words in per_topic.items():
        for word, n in words.items():
            expected = n / sum(words.values()) * math.log(1 + mean / total[word])
            assert got[topic, word] == pytest.approx(expected)
    seeds = vo.seed_tokens(spark.createDataFrame([("Ee ee",), ("de nada",)], "seed string"))
    assert sorted(r.word for r in seeds.collect()) == ["de", "ee", "nada"]
    one = spark.createDataFrame([("d",)], "word string")
    boosted = {(r.topic, r.word): r.weight for r in vo.class_tfidf(counts, seed_words=one).collect()}
    assert boosted[1, "d"] == pytest.approx(2 * got[1, "d"])
    assert boosted[1, "e"] == pytest.approx(got[1, "e"])


def test_top_words_break_ties_by_word(spark):
    weights = spark.createDataFrame(
        [(0, "b", 1.0), (0, "a", 1.0), (0, "c", 2.0), (1, "z", 0.5)], "topic long, word string, weight double"
    )
    got = [(r.topic, r["rank"], r.word) for r in vo.top_words(weights, 2).orderBy("topic", "rank").collect()]
    assert got == [(0, 1, "c"), (0, 2, "a"), (1, 1, "z")]
    plan = vo.top_words(weights, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def brute_npmi(docs, topic_words, window=10):
    words = {w for group in topic_words.values() for w in group}
    sets = []
    for tokens in docs:
        if words & set(tokens):
            for s in range(max(len(tokens) - window + 1, 1)):
                sets.append(set(tokens[s:s + window]))
    n, eps, out = len(sets), 1e-12, {}
    count = lambda *ws: sum(all(w in s for w in ws) for s in sets)
    for topic, group in topic_words.items():
        known = [w for w in group if count(w)]
        values = [
            math.log((count(a, b) / n + eps) / (count(a) / n * count(b) / n))
            / -math.log(count(a, b) / n + eps)
            for a, b in combinations(known, 2)
        ]
        out[topic] = sum(values) / len(values) if values else None
    return out


TOPIC_WORDS = {0: ["a", "b", "c"], 1: ["d", "e", "missing"], 2: ["z"]}


def words_table(spark):
    rows = [(t, i + 1, w, 1.0) for t, ws in TOPIC_WORDS.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "topic long, rank long, word string, weight double")


def test_npmi_against_brute_force(spark, docs):
    got = {r.topic: r.npmi for r in co.topic_coherence(docs, words_table(spark)).collect()}
    expected = brute_npmi([t for _, _, t in DOCS], TOPIC_WORDS)
    assert got.keys() == expected.keys()
    for topic, value in expected.items():
        assert got[topic] == (None if value is None else pytest.approx(value))


def test_internal_scores_by_run(spark, docs):
    words = words_table(spark)
    runs = words.withColumn("run", F.lit(1)).unionByName(
        words.filter("topic = 0").withColumn("run", F.lit(2))
    )
    both = {r.run: r for r in co.internal_scores(docs, runs, ["run"]).collect()}
    alone = co.internal_scores(docs, words.filter("topic = 0")).first()
    # Another run's words make more texts relevant, so only the number of windows may differ.
    assert both[2].nd == alone.nd == 1.0
    assert both[1].ws == pytest.approx(0.8 * both[1].nc + 0.2 * both[1].nd)
    single = co.internal_scores(docs, words.filter("topic = 2"), min_words=1).first()
    assert single.nc is None and single.nd == 1.0


def test_diversity_without_topics_is_zero(spark):
    empty = words_table(spark).filter("topic > 9")
    assert co.topic_diversity(empty).first().nd == 0.0


def scores(spark, pairs):
    df = spark.createDataFrame(pairs, "gold string, topic long")
    return ag.agreement(ag.contingency(df, "gold")).first()


def pair_ari(pairs):
    a = b = c = d = 0
    for (g1, t1), (g2, t2) in combinations(pairs, 2):
        same_g, same_t = g1 == g2, t1 == t2
        a += same_g and same_t
        b += same_g and not same_t
        c += same_t and not same_g
        d += not same_g and not same_t
    if b == c == 0:
        return 1.0
    return 2 * (a * d - b * c) / ((a + b) * (b + d) + (a + c) * (c + d))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 3)), min_size=2, max_size=30))
def test_agreement_properties(spark, pairs):
    got = scores(spark, pairs)
    assert got.nmi == pytest.approx(got.v_measure, abs=1e-9)
    assert got.ari == pytest.approx(pair_ari(pairs), abs=1e-9)
    renamed = scores(spark, [(g + "!", 7 - t) for g, t in pairs])
    assert renamed.ari == pytest.approx(got.ari, abs=1e-9)
    assert renamed.nmi == pytest.approx(got.nmi, abs=1e-9)


def test_agreement_edges(spark):
    same = scores(spark, [("x", 1), ("x", 1), ("y", 2)])
    assert (same.ari, same.nmi, same.v_measure) == (1.0, pytest.approx(1.0), pytest.approx(1.0))
    one = scores(spark, [("x", 1), ("x", 1)])
    assert (one.ari, one.nmi, one.homogeneity, one.completeness) == (1.0, 1.0, 1.0, 1.0)
    nothing = scores(spark, [("x", -1)])
    assert nothing.n_scored == 0 and nothing.ari is None and nothing.v_measure is None
    cut_up = scores(spark, [("x", 1), ("x", 2), ("y", 3), ("y", 4)])
    assert cut_up.homogeneity == pytest.approx(1.0) and cut_up.completeness < 1


def test_only_labelled_rows_of_topics_count(spark):
    df = spark.createDataFrame(
        [("x", 1), (None, 1), ("x", -1), ("y", 2)], "gold string, topic long"
    )
    assert ag.contingency(df, "gold").count() == 2
    assert ag.coverage(df, "gold").first().coverage == 0.5


@pytest.mark.parametrize("most", [0, 1000])
def test_top_words_of_many_groupings(spark, monkeypatch, most):
    rows = [(g, f"w{w}", 1 + (7 * g + 3 * w) % 5) for g in range(6) for w in range(40) if (g + w) % 3]
    rows += [(0, None, 50), (None, "w1", 9), (9, "nowhere", 99)]
    counts = spark.createDataFrame(rows, "group long, word string, cnt long").repartition(3)
    places = [(run, g, g % (run + 2) - 1) for run in range(3) for g in range(6)]
    # A group with two places, one that has no words, and a grouping without topics.
    places += [(0, 1, 5), (1, 77, 0), (2, None, 1), (4, 0, None)]
    placed = spark.createDataFrame(places, "run long, group long, topic long")
    joined = counts.join(placed, "group").filter("word is not null and topic is not null").groupBy("run", "topic", "word").agg(F.sum("cnt").alias("cnt"))
    expected = vo.top_words(vo.class_tfidf(joined, ["run"]), 5, ["run"])
    monkeypatch.setattr(vo, "MOST_PLACED", most)
    got = vo.top_words_of_groupings(counts, placed, 5, ["run"])
    assert got.columns == expected.columns and expected.count() >= 50
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    none = vo.top_words_of_groupings(counts.limit(0), placed, 5, ["run"])
    assert none.count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_windows_against_brute_force_over_several_pieces(spark, monkeypatch, most):
    monkeypatch.setattr(co, "MOST_WORDS", most)
    monkeypatch.setattr(co, "ROWS_AT_A_TIME", 3)
    texts = [[f"w{(i * i + 3 * j * j + i * j) % 23}" for j in range(i)] for i in range(40)]
    texts += [None, [], ["w1", None, "w1", "ä", "w2"], ["none"] * 30]
    rows = [(i if i != 7 else 6, t) for i, t in enumerate(texts)] + [(None, ["w1"] * 12)]
    docs = spark.createDataFrame(rows, "row_id long, tokens array<string>").repartition(2)
    wanted = {"w1", "w2", "w5", "w9", "ä", "missing"}
    words = spark.createDataFrame([(w,) for w in wanted], "word string")
    expected = {}
    for i, tokens in rows:
        if i is None or not wanted & set(tokens or []):
            continue
        for s in range(max(len(tokens) - 9, 1)):
            held = sorted(wanted & set(tokens[s:s + 10]))
            for pair in [(None, None), *((a, b) for a in held for b in held if a <= b)]:
                expected[pair] = expected.get(pair, 0) + 1
    counts = co.word_windows(docs, words)
    assert {(r.word_a, r.word_b): r.cnt for r in counts.collect()} == expected
    # Windows are counted inside tasks, not as a row for each.
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString() or most == 0
    assert co.word_windows(docs.limit(0), words).count() == 0
