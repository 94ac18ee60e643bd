"""Merge trees of topics against average linkage by plain Python."""

import random

import pytest

from civictopics.operators import merge_tree as mt


def average_linkage(sizes, sims):
    """``[(kept, gone, sim, step)]``, one pair a step, by all pairs."""
    groups = {t: [t] for t in sizes}
    counts = dict(sizes)
    steps = []
    while True:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    total = sum(sims.get((min(x, y), max(x, y)), 0.0) * sizes[x] * sizes[y] for x in groups[a] for y in groups[b])
                    value = round(total / (counts[a] * counts[b]), 9)
                    if best is None or (-value, a, b) < best:
                        best = (-value, a, b)
        if best is None:
            return steps
        value, a, b = best
        groups[a] += groups.pop(b)
        counts[a] += counts.pop(b)
        steps.append((a, b, -value))


def made_up(n, seed, some=1.0):
    r = random.Random(seed)
    sizes = {t: r.randint(1, 9) for t in range(n)}
    sims = {(a, b): round(r.random(), 3) for a in range(n) for b in range(a + 1, n) if r.random() < some}
    return sizes, sims


def tables(spark, sizes, sims, run="r"):
    size_rows = [(run, t, c) for t, c in sizes.items()]
    sim_rows = [(run, a, b, s) for (a, b), s in sims.items()]
    return size_rows, sim_rows


def frames(spark, size_rows, sim_rows):
    return (spark.createDataFrame(size_rows, "run string, topic long, cnt long"),
            spark.createDataFrame(sim_rows, "run string, topic long, other long, sim double"))


@pytest.mark.parametrize("n, seed, some", [(9, 1, 1.0), (14, 2, 0.5), (12, 3, 0.15)])
def test_merges_by_brute_force(spark, n, seed, some):
    sizes, sims = made_up(n, seed, some)
    tree = mt.merge_tree(*frames(spark, *tables(spark, sizes, sims)), by=["run"])
    found = sorted((r["kept"], r["gone"], r["sim"]) for r in tree.collect())
    assert found == sorted(average_linkage(sizes, sims))


def test_all_runs_at_once_and_any_target(spark):
    runs = {"a": made_up(8, 4), "b": made_up(11, 5, 0.4), "c": ({7: 3}, {})}
    size_rows, sim_rows = [], []
    for run, (sizes, sims) in runs.items():
        more = tables(spark, sizes, sims, run)
        size_rows += more[0]
        sim_rows += more[1]
    sizes_df, sims_df = frames(spark, size_rows, sim_rows)
    tree = mt.merge_tree(sizes_df, sims_df, by=["run"])
    for target in (1, 3, 6, 50):
        placed = mt.cut_tree(sizes_df.select("run", "topic"), tree, target, by=["run"]).collect()
        for run, (sizes, sims) in runs.items():
            into = {t: t for t in sizes}
            for kept, gone, _ in average_linkage(sizes, sims)[: max(len(sizes) - target, 0)]:
                into = {t: kept if g == gone else g for t, g in into.items()}
            assert {r["topic"]: r["into"] for r in placed if r["run"] == run} == into


def test_ties(spark):
    sizes = dict.fromkeys(range(8), 2)
    sims = {(a, b): 0.5 for a in range(8) for b in range(a + 1, 8)}
    tree = mt.merge_tree(*frames(spark, *tables(spark, sizes, sims)), by=["run"])
    assert sorted((r["kept"], r["gone"]) for r in tree.collect()) == sorted((a, b) for a, b, _ in average_linkage(sizes, sims))


def test_odd_tables(spark):
    sizes, sims = frames(spark, *tables(spark, {1: 2, 2: 2, 3: 1}, {(1, 2): 0.4, (1, 3): 0.3}))
    assert mt.merge_tree(sizes.limit(0), sims.limit(0), by=["run"]).count() == 0
    # A pair given twice, in both directions or with itself counts once; null similarities are 0.
    extra = sims.unionByName(sims).unionByName(sims.selectExpr("run", "other topic", "topic other", "sim"))
    extra = extra.unionByName(spark.createDataFrame([("r", 1, 1, 0.9), ("r", 2, 3, None)], sims.schema))
    plain = [tuple(r) for r in mt.merge_tree(sizes, sims, by=["run"]).orderBy("step").collect()]
    assert [tuple(r) for r in mt.merge_tree(sizes, extra, by=["run"]).orderBy("step").collect()] == plain
    assert [r["kept"] for r in mt.merge_tree(sizes.drop("run"), sims.drop("run")).orderBy("step").collect()] == [1, 1]
