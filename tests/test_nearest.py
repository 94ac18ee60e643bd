import numpy as np
import pytest

from civictopics.operators.nearest import nearest_of_many

VECTORS = "id long, embedding array<double>"


def brute(x, targets):
    ids, y = [i for i, _ in targets], np.array([v for _, v in targets], dtype=float)

    def unit(m):
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    sims = np.round(unit(x) @ unit(y).T, 9)
    return {i: (min(t for t, s in zip(ids, row) if s == row.max()), float(row.max())) for i, row in enumerate(sims)}


def tables(spark, x, targets):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<double>").repartition(3)
    return rows, spark.createDataFrame([(t, list(map(float, v))) for t, v in targets], "topic long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("seed, pivots", [(1, 1024), (2, 3), (3, 1)])
def test_equal_to_brute_force(spark, seed, pivots):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 5))
    y = np.concatenate([c + rng.normal(scale=0.1, size=(50, 5)) for c in centres])
    y[30:40] = y[0]
    x = np.concatenate([centres, y[:20], -y[:20], rng.normal(size=(60, 5)), np.zeros((2, 5))])
    targets = [(int(t), v) for t, v in zip(rng.permutation(len(y)) - 100, y)]
    got = {r.id: (r.topic, r.sim) for r in nearest_of_many(*tables(spark, x, targets), most_pivots=pivots).collect()}
    want = brute(x, targets)
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 2e-9 for i in want)


def test_zero_targets_win_over_opposite_ones(spark):
    x = np.array([[1.0, 0], [-1, 0], [0, 0]])
    targets = [(5, [-1, 0.1]), (7, [0, 0]), (6, [0, 0])]
    assert {r.id: r.topic for r in nearest_of_many(*tables(spark, x, targets)).collect()} == {0: 6, 1: 5, 2: 5}
    only_zero = [(7, [0, 0]), (6, [0, 0])]
    assert {r.id: (r.topic, r.sim) for r in nearest_of_many(*tables(spark, x, only_zero)).collect()} == {i: (6, 0.0) for i in range(3)}


def test_rows_meet_few_groups(spark):
    """With tight groups far apart, a row's pack is sent to its own group only."""
    from civictopics.operators import nearest as ne

    rng = np.random.default_rng(4)
    pivots = np.eye(6)
    y = np.concatenate([p + rng.normal(scale=0.01, size=(20, 6)) for p in pivots])
    rows, _ = tables(spark, y, [(0, y[0])])
    shared = spark.sparkContext.broadcast(pivots)
    packs = ne._packed(rows, "row_id", shared, spark.sparkContext.broadcast(np.full(6, 0.1)), 1000).collect()
    assert sum(len(p.ids) for p in packs) == len(y)


def test_scattered_rows_go_in_large_packs(spark):
    """Without groups every row meets all targets: packs and blocks are few then, and copies of a row too."""
    from civictopics.operators import nearest as ne

    rng = np.random.default_rng(5)
    y = rng.normal(size=(5000, 16))
    rows, _ = tables(spark, y, [(0, y[0])])
    pivots = spark.sparkContext.broadcast(y[:70] / np.sqrt((y[:70] ** 2).sum(axis=1, keepdims=True)))
    blocks = ne._packed(rows, "row_id", pivots, None, ne.BLOCK_TARGETS).collect()
    assert len(blocks) <= 3 * 70 and sorted(i for b in blocks for i in b.ids) == list(range(5000))
    # Three groups of some 2,000 targets, rather than 70 small ones.
    copies = []
    whole = ne._packed
    ne._packed = lambda df, id_col, pivots, radii, rows: copies.append(len(pivots.value)) or whole(df, id_col, pivots, radii, rows)
    try:
        got = {r.id: r.topic for r in nearest_of_many(rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(-y)], "topic long, embedding array<double>")).collect()}
    finally:
        ne._packed = whole
    assert copies == [3, 3]
    want = brute(y[:200], list(enumerate(-y)))
    assert all(got[i] == want[i][0] for i in range(200)) and len(got) == 5000


def test_the_query_takes_every_vector(spark, tmp_path):
    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 260)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r.row_id for r in QUERIES["nearest_of_many"](spark, str(tmp_path)).collect()) == list(range(1, 260))
    assert "%" not in ORACLES["nearest_of_many"]


def test_vectors_are_written_once_and_not_for_each_group(spark, monkeypatch):
    from civictopics.operators import nearest as ne

    monkeypatch.setattr(ne, "GROUP_TARGETS", 50)
    monkeypatch.setattr(ne, "HELD", 200)
    monkeypatch.setattr(ne, "HELD_PACKS", 2)
    monkeypatch.setattr(ne, "PACK_ROWS", 64)
    written = {}

    def noted(df, name, plain=ne.cut):
        written[name] = plain(df, name)
        return written[name]

    monkeypatch.setattr(ne, "cut", noted)
    rng = np.random.default_rng(7)
    # Scattered rows meet all groups.  A third of the targets are one vector, some differ by less than single precision tells.
    y = np.concatenate([rng.normal(size=(300, 16)), np.tile(rng.normal(size=(1, 16)), (150, 1))])
    y = np.concatenate([y, y[:100] + rng.normal(scale=1e-8, size=(100, 16))])
    x = np.concatenate([rng.normal(size=(300, 16)), y[:50], y[310:315]])
    targets = [(int(t), v) for t, v in zip(rng.permutation(len(y)), y)]
    got = {r.id: (r.topic, r.sim) for r in nearest_of_many(*tables(spark, x, targets)).collect()}
    want = brute(x, targets)
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 2e-9 for i in want)
    packs, blocks = (written[name].collect() for name in ("row-packs", "target-blocks"))
    assert sum(len(p.ids) for p in packs) == len(x) and sum(len(b.ids) for b in blocks) == len(y)
    # Small blocks that many tasks leave are put together by group.
    assert len(blocks) == len({b.pivot for b in blocks}) and any(len(p.meets) > 3 for p in packs)
