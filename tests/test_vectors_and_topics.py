import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from civictopics.operators import agreement as ag
from civictopics.operators import density as de
from civictopics.operators import embed as em
from civictopics.operators import topics as to
from civictopics.plans import evaluation as ev
from civictopics.plans import grid as gr
from civictopics.plans import model as mo
from civictopics.sources import taxonomy as ta


def vectors(spark, rows, name="embedding"):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"row_id long, {name} array<double>"
    )


def brute_hash(docs, dim, buckets):
    def numbers(word):
        h = hashlib.md5(word.encode()).hexdigest()
        return int(h[:8], 16) % buckets, int(h[8:16], 16) % dim, 1 if h[16] < "8" else -1

    df = Counter(b for tokens in docs for b in {numbers(w)[0] for w in tokens})
    out = np.zeros((len(docs), dim))
    for i, tokens in enumerate(docs):
        for word in tokens:
            bucket, slot, sign = numbers(word)
            out[i, slot] += sign * math.log((1 + len(docs)) / (1 + df[bucket]))
        if np.linalg.norm(out[i]) > 0:
            out[i] /= np.linalg.norm(out[i])
    return out


def test_hash_embedding(spark):
    docs = [["água", "luz", "luz"], ["água", "rua"], [], ["rua", "praça"]]
    df = spark.createDataFrame(list(enumerate(docs)), "row_id long, tokens array<string>")
    got = em.embed_docs(df.repartition(3), dim=16).orderBy("row_id").collect()
    expected = brute_hash(docs, 16, em.FREQUENCY_BUCKETS)
    assert np.allclose([r.embedding for r in got], expected)
    plan = em.embed_docs(df, dim=16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_own_encoder_and_stored_vectors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "row_id long, clean_text string")
    own = em.embed_docs(df, method=lambda c: F.array(F.length(c), F.lit(1)))
    assert {r.row_id: r.embedding for r in own.collect()} == {1: [2.0, 1.0], 2: [3.0, 1.0]}
    stored = em.embed_docs(df, "precomputed", vectors=own.filter("row_id = 2"))
    assert [r.row_id for r in stored.collect()] == [2]


def test_principal_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) * np.array([5, 3, 1, 0.1, 0.1, 0.1])
    got = np.array([r.reduced for r in em.reduce_dims(vectors(spark, x), 2).orderBy("row_id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ vt[:2].T), atol=1e-6)


def test_projection(spark):
    x = np.random.default_rng(2).normal(size=(5, 8))
    got = em.reduce_dims(vectors(spark, x), 3, "projection", salt="7").orderBy("row_id").collect()
    assert np.allclose([r.reduced for r in got], x @ em.sign_matrix(8, 3, "7"))


def brute_density(x, k, width, sim, min_pts, min_size):
    """Cells compared pairwise, then every cell climbs to its peak step by step."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    steps = np.floor(np.round(unit, 9) / width).astype(int)
    cells = {}
    for i, step in enumerate(map(tuple, steps)):
        cells.setdefault(step, []).append(i)
    mean = {c: unit[m].sum(axis=0) for c, m in cells.items()}
    near = {
        a: {
            b: s for b in cells
            if a != b and max(abs(np.subtract(a, b))) <= 1
            and (s := round(mean[a] @ mean[b] / np.linalg.norm(mean[a]) / np.linalg.norm(mean[b]), 9)) >= sim
        }
        for a in cells
    }
    key = {c: sum((s + 1 + -(-1 // width)) * (2 * -(-1 // width) + 3) ** i for i, s in enumerate(c)) for c in cells}
    density = {c: len(cells[c]) + sum(len(cells[b]) for b in near[c]) for c in cells}
    topics = {}
    for start in cells:
        c = start
        while higher := [(s, -key[b], b) for b, s in near[c].items() if (density[b], -key[b]) > (density[c], -key[c])]:
            c = max(higher)[2]
        if density[c] >= min_pts:
            topics.setdefault(c, []).extend(cells[start])
    kept = sorted((m for m in topics.values() if len(m) >= min_size), key=lambda m: (-len(m), min(m)))
    out = np.full(len(x), -1)
    for number, members in enumerate(kept):
        out[members] = number
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_density_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, 3))
    x = np.concatenate([c + rng.normal(scale=0.12, size=(n, 3)) for c, n in zip(centers, (90, 40, 25, 6))])
    x = np.concatenate([x, rng.normal(size=(30, 3))])
    df = vectors(spark, x, "reduced").repartition(5)
    found = de.density_topics(df, 3, 0.2, 0.97, 5, 10).orderBy("row_id").collect()
    assert [r.topic for r in found] == brute_density(x, 3, 0.2, 0.97, 5, 10).tolist()


def test_copies_cost_one_cell(spark):
    """A third of all rows are one vector: it is one cell, and no row is paired with another."""
    x = np.random.default_rng(5).normal(size=(600, 3))
    df = vectors(spark, np.concatenate([x, np.repeat(x[:1], 300, axis=0)]), "reduced")
    placed = de.with_cells(df, 3, 0.25)
    cells = de.cell_table(placed, 3)
    assert cells.agg(F.max("cnt")).first()[0] >= 301
    assert cells.count() <= 8 ** 3
    assert cells.agg(F.sum("cnt")).first()[0] == 900
    topics = de.density_topics(df, 3, 0.25)
    assert topics.count() == 900


def test_zero_vectors_are_outliers(spark):
    df = vectors(spark, [[0, 0], [1, 0], [1, 0.01], [1, 0.02]], "reduced")
    found = de.density_topics(df, 2, 0.25, 0.9, 2, 2).orderBy("row_id").collect()
    assert [r.topic for r in found] == [-1, 0, 0, 0]


def test_keys_must_fit():
    assert de.Grid(7, 0.25).base ** 7 > 1 << 21
    with pytest.raises(ValueError):
        de.Grid(20, 0.1)


def test_copies_of_all_texts_change_no_group(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(scale=0.2, size=(60, 3)) for c in rng.normal(size=(5, 3))])
    once = {r.row_id: r.topic for r in de.density_topics(vectors(spark, x, "reduced"), 3, 0.25, min_topic_size=1, min_pts=1).collect()}
    ten = de.density_topics(vectors(spark, np.tile(x, (10, 1)), "reduced"), 3, 0.25, min_topic_size=10, min_pts=10).collect()
    assert {(once[r.row_id % len(x)], r.topic) for r in ten} == {(t, t) for t in set(once.values())}
    assert len(set(once.values())) >= 4


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    pairs = [(a, b) for a, b in zip(order, order[1:])] + [(100, 101)]
    links = spark.createDataFrame(
        pairs + [(b, a) for a, b in pairs], "node long, other long"
    )
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 100, 101, 200]], "node long")
    got = {r.node: r.label for r in de.connected_components(nodes, links).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 200: 200}


def test_nearest_of_few_and_of_many(spark):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(40, 4)), rng.normal(size=(9, 4))
    c[7] = c[2]
    targets = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(c)], "topic long, embedding array<double>"
    )
    sims = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 9)
    for most in (4096, 4):
        got = to.assign_nearest(vectors(spark, x), targets, most_targets=most).orderBy("row_id").collect()
        assert [r.topic for r in got] == sims.argmax(axis=1).tolist()
        assert np.allclose([r.probability for r in got], np.clip(sims.max(axis=1), 0, 1))


def test_seed_guide(spark):
    x = np.array([[1, 0.0], [0.9, 0.1], [0, 1], [-1, 0.2]])
    seeds = spark.createDataFrame([(5, [2.0, 0.0])], "topic long, embedding array<double>")
    got = to.seed_guide(vectors(spark, x), seeds).orderBy("row_id").collect()
    assert [r.seed_topic for r in got] == [5, 5, -1, -1]
    assert got[1].embedding == pytest.approx([(3 * 0.9 + 2) / 4, 0.075])
    assert got[2].embedding == [0, 1]


def test_merging_keeps_the_largest(spark):
    rows = [(i, 0) for i in range(5)] + [(i, 1) for i in range(5, 9)] + [(9, 2), (10, 2), (11, 3), (12, -1)]
    assigned = spark.createDataFrame(rows, "row_id long, topic long")
    weights = spark.createDataFrame(
        [(0, "a", 1.0), (1, "b", 1.0), (2, "b", 1.0), (2, "c", 0.5), (3, "q", 1.0), (-1, "b", 1.0)],
        "topic long, word string, weight double",
    )
    merged = dict(to.reduce_topics(assigned, weights, 3).collect())
    # 1 and 2 share a word; 3 shares none and joins the larger topic.  Both then have 6 texts, and
    # the one with the smaller row id is numbered first.
    assert [merged[i] for i in (0, 5, 9, 11, 12)] == [0, 1, 1, 0, -1]
    sizes = Counter(merged.values())
    assert sizes[0] >= sizes[1] and set(merged.values()) == {-1, 0, 1}
    assert to.reduce_topics(assigned, weights, None) is assigned


GROUPS = {
    "saude": "hospital médico posto vacina enfermeiro leito remédio consulta",
    "escola": "professor aluno escola creche merenda ensino aula livro",
    "rua": "asfalto buraco calçada semáforo trânsito ônibus ciclovia avenida",
}


def made_up(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for g, (name, words) in enumerate(GROUPS.items()):
        for i in range(n + 10 * g):
            rows.append((len(rows), " ".join(rng.choices(words.split(), k=12)) + f" x{i}", name))
    return spark.createDataFrame(rows, "row_id long, clean_text string, lang string")


@pytest.fixture(scope="module")
def model(spark):
    return mo.fit_topics(made_up(spark), mo.Settings(dim=64, k=3, min_sim=0.2))


def test_known_groups_are_found(spark, model):
    test = made_up(spark, seed=2)
    predicted = mo.transform(model, test).withColumn("original_text", F.col("clean_text")).drop("lang")
    source = test.select("row_id", F.col("lang").alias("VCGE_N1"), F.lit("x").alias("VCGE_N2"))
    aligned = ev.align_predictions(source, predicted)
    scores = ev.external_scores(aligned).first()
    assert scores.ari > 0.9 and scores.coverage > 0.9
    fitted = model.assigned.join(made_up(spark).select("row_id", "lang"), "row_id")
    assert ag.agreement(ag.contingency(fitted, "lang")).first().ari > 0.9


def test_model_tables(spark, model):
    info = {r.topic: r for r in model.info.collect()}
    assert {0, 1, 2} <= set(info)
    assert info[0].cnt >= info[1].cnt >= info[2].cnt
    assert all(len(info[t].representative_docs) == 3 for t in (0, 1, 2))
    words = {r.word for r in model.words.filter("topic = 0").collect()}
    assert set(GROUPS["rua"].split()) <= words


def test_unrelated_text_is_an_outlier(spark, model):
    odd = spark.createDataFrame([(1, "nenhuma palavra conhecida")], "row_id long, clean_text string")
    assert mo.transform(model, odd).first().topic == -1


def test_transform_accepts_a_stream(spark, model, tmp_path):
    made_up(spark).select("row_id", "clean_text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, clean_text string").parquet(str(tmp_path / "in"))
    query = (
        mo.transform(model, stream).writeStream.format("memory").queryName("assigned")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert spark.table("assigned").filter("topic >= 0").count() > 100


def test_guided_model(spark):
    tax = ta.taxonomy(spark, {"Saúde": [GROUPS["saude"]], "Ensino": [GROUPS["escola"]]})
    settings = mo.Settings(dim=64, k=3, nr_topics=2)
    guided = mo.fit_topics(made_up(spark), settings, ta.seed_table(tax, 2), ta.seed_table(tax))
    near = {r.lang: r.seed for r in guided.assigned.join(made_up(spark).select("row_id", "lang"), "row_id")
            .groupBy("lang").agg(F.mode("seed_topic").alias("seed")).collect()}
    assert (near["saude"], near["escola"]) == (0, 1)
    assert guided.assigned.filter("topic <> -1").select("topic").distinct().count() <= 2


def test_grid(spark):
    docs = made_up(spark).select("row_id", F.split("clean_text", " ").alias("tokens"))
    grid = gr.parameter_grid(spark, ["m"], [2, None], [10, 500], iterations=2)
    runs = gr.run_grid(docs, grid, {"m": 64}, k=3).collect()
    assert len(runs) == 8
    by_size = {(r.nr_topics, r.min_topic_size): r for r in runs if r.iteration == 0}
    assert by_size[None, 10].num_topics_found >= 3 and by_size[2, 10].num_topics_found <= 2
    # No group has 500 texts: the run stays, with no topics and no scores.
    assert by_size[None, 500].num_topics_found == 0 and by_size[None, 500].ws is None
    alone = mo.fit_topics(made_up(spark), mo.Settings(dim=64, k=3))
    assert to.topics_found(alone.assigned).first()[0] == by_size[None, 10].num_topics_found


def test_summary_ignores_nan_and_null(spark):
    nan = float("nan")
    rows = [(1, 0, 3.0, 0.1, 0.5), (1, 1, nan, nan, nan), (1, 2, 5.0, 0.3, 0.7), (2, 0, nan, nan, None), (3, 0, 1.0, 0.9, 0.9)]
    runs = spark.createDataFrame(rows, "config_id long, iteration long, num_topics_found double, nc double, ws double")
    summary = gr.summarise(runs, ["config_id"], ("num_topics_found", "nc", "ws"))
    board = [tuple(r) for r in gr.leaderboard(summary, ["config_id"]).collect()]
    assert board == [
        (3, 1.0, 0.9, 0.9, 1), (1, 4.0, pytest.approx(0.2), pytest.approx(0.6), 2), (2, None, None, None, 0)
    ]
    assert gr.leaderboard(summary, ["config_id"], 1).count() == 1


def test_highest_probability(spark):
    df = spark.createDataFrame([(1, [0.1, 0.7]), (2, None)], "row_id long, probabilities array<double>")
    assert [r.probability for r in ev.highest_probability(df).orderBy("row_id").collect()] == [0.7, None]


def test_bucket_weights_come_near_exact_ones(spark):
    """With far more buckets than words nearly all weights are exact; with few they are averages."""
    rows = [(i, [f"w{j}" for j in range(400) if (i * 31 + j * 17) % (j + 2) == 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>")
    exact = {w: np.log(61 / (1 + n)) for w, n in Counter(w for _, t in rows for w in set(t)).items()}
    place = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in exact}
    off = {b: np.mean([abs(em.inverse_frequencies(df, b)[place[w] % b] - e) for w, e in exact.items()]) for b in (1 << 18, 64)}
    assert off[1 << 18] < 0.01 < off[64]


def test_components_from_moments_are_those_of_spark(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 4
    df = vectors(spark, x).repartition(3)
    want = np.array([r.reduced for r in em.reduce_dims(df, 3).orderBy("row_id").collect()])
    assert np.allclose(x @ em.component_matrix(df, 3, 6), want, atol=1e-9)


def test_a_grid_writes_each_text_once_for_some_runs(spark, monkeypatch):
    from civictopics.operators import vocabulary as vo

    docs = made_up(spark).select("row_id", F.split("clean_text", " ").alias("tokens"))
    grid = gr.parameter_grid(spark, ["a", "b"], [2, None], [10], iterations=2)
    written, texts = [], []
    monkeypatch.setattr(gr, "write", lambda df, path, plain=gr.write: texts.append(df.count()) or plain(df, path))
    monkeypatch.setattr(gr, "cut", lambda df, name, plain=gr.cut: written.append((name, df.count() if name in ("counts", "groups") else 0)) or plain(df, name))
    words, found = gr.grid_topics(docs, grid, {"a": 32, "b": 64}, k=3)
    rows = {(r.config_id, r.iteration, r.topic, r["rank"]): (r.word, r.weight) for r in words.collect()}
    counts = sorted(map(tuple, found.collect()))
    assert len(counts) == 8 and len(rows) > 100
    n = docs.count()
    vocabulary = docs.select(F.explode("tokens")).distinct().count()
    assert texts == [n] and not {"embedded", "placed", "cell-words"} & {name for name, _ in written}
    assert max(k for name, k in written if name == "counts") <= dict(written)["groups"] * vocabulary
    # Few runs at a time, and tables of cells and of groups that are joined, give the same.
    for module, name in ((gr, "MOST_CELLS"), (vo, "MOST_PLACED")):
        monkeypatch.setattr(module, name, 0)
    monkeypatch.setattr(gr, "RUNS_AT_A_TIME", 3)
    again, found = gr.grid_topics(docs, grid, {"a": 32, "b": 64}, k=3)
    assert sorted(map(tuple, found.collect())) == counts
    other = {(r.config_id, r.iteration, r.topic, r["rank"]): (r.word, r.weight) for r in again.collect()}
    assert other.keys() == rows.keys() and all(abs(other[x][1] - rows[x][1]) < 1e-8 for x in rows)
    assert sum(other[x][0] == rows[x][0] for x in rows) > 0.9 * len(rows)
