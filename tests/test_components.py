"""Components of wide sparse vectors against exact ones by NumPy."""

import numpy as np
import pytest

from civictopics.operators import components as cp

SCHEMA = "row_id long, entries array<struct<slot:bigint,value:double>>, extra string"


def made_up(rows=240, width=400, seed=3):
    """Sparse rows whose first components stand apart from the rest."""
    random = np.random.default_rng(seed)
    parts = random.normal(size=(rows, 6)) * np.array([30, 20, 12, 7, 3, 1])
    shape = random.normal(size=(6, width)) * (random.random((6, width)) < 0.2)
    noise = random.normal(size=(rows, width)) * (random.random((rows, width)) < 0.02) * 0.05
    return parts @ shape + noise + 2.0 * (np.arange(width) % 50 == 0)


def frame(spark, dense):
    rows = [(i, [(int(s), float(row[s])) for s in np.flatnonzero(row)], "x") for i, row in enumerate(dense)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def angle(a, b):
    """Sine of the largest angle between two subspaces."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


def test_components_equal_the_exact_ones(spark):
    dense = made_up()
    found = cp.fit_components(frame(spark, dense), k=4, width=400)
    _, lengths, exact = np.linalg.svd(dense - dense.mean(axis=0), full_matrices=False)
    assert angle(found.loadings, exact[:4].T) < 1e-6
    assert np.allclose(found.deviations, lengths[:4] / np.sqrt(len(dense) - 1), rtol=1e-9)
    assert np.allclose(found.loadings.T @ found.loadings, np.eye(4), atol=1e-10)
    assert np.allclose(found.mean, dense.mean(axis=0))
    assert (found.loadings.max(axis=0) >= -found.loadings.min(axis=0)).all()


def test_rows_are_projected_as_by_a_dense_product(spark):
    dense = made_up(rows=60)
    df = frame(spark, dense)
    found = cp.fit_components(df, k=3, width=400)
    rows = cp.project_sparse(df, found).select("row_id", "reduced", "extra").collect()
    assert len(rows) == 60
    for row in rows:
        assert np.allclose(row["reduced"], dense[row["row_id"]] @ found.loadings)


def test_the_partitions_do_not_matter(spark):
    df = frame(spark, made_up(rows=100))
    one = cp.fit_components(df.repartition(1), k=3, width=400)
    many = cp.fit_components(df.repartition(70), k=3, width=400)
    assert np.allclose(one.loadings, many.loadings, atol=1e-8)
    assert np.allclose(one.deviations, many.deviations)


def test_tree_of_factors(spark):
    dense = made_up(rows=90, width=30)
    # More tasks than are stacked in one step, so that the tree has two levels.
    n, mean, factor = cp.tall_factor(frame(spark, dense).repartition(cp.STACKED + 8), np.eye(30))
    centred = dense - dense.mean(axis=0)
    assert n == 90 and np.allclose(mean, dense.mean(axis=0))
    assert np.allclose(factor.T @ factor, centred.T @ centred)


def test_stacking_in_any_order():
    dense = made_up(rows=50, width=20)
    whole = cp.stacked([(1, row, np.zeros((1, 20))) for row in dense])
    centred = dense - dense.mean(axis=0)
    assert whole[0] == 50 and np.allclose(whole[2].T @ whole[2], centred.T @ centred)


def test_odd_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    found = cp.fit_components(none, k=2, width=50)
    assert found.loadings.shape == (50, 2) and not found.deviations.any()
    assert cp.project_sparse(none, found).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, [], "x"), (2, [], "x")], SCHEMA)
    found = cp.fit_components(blank, k=2, width=50)
    assert not found.deviations.any()
    assert all(r["reduced"] == [0.0, 0.0] for r in cp.project_sparse(blank, found).collect())
    # All rows alike: no deviation along any direction.
    same = spark.createDataFrame([(i, [(3, 1.0), (4, 2.0)], "x") for i in range(9)], SCHEMA)
    assert np.allclose(cp.fit_components(same, k=2, width=50).deviations, 0)
    with pytest.raises(ValueError):
        cp.fit_components(none, k=80, width=1 << 18)


def test_full_width(spark):
    words = [[f"w{(i * j) % 97}" for j in range(1, 20)] for i in range(1, 120)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "row_id long, tokens array<string>")
    sparse = cp.sparse_vectors(df).cache()
    dense = np.zeros((len(words), 1 << 18))
    for row in sparse.collect():
        for entry in row["entries"]:
            dense[row["row_id"], entry["slot"]] = entry["value"]
    lengths = np.sqrt((dense * dense).sum(axis=1))
    assert np.allclose(lengths[lengths > 0], 1)
    found = cp.fit_components(sparse, k=3, passes=12)
    exact = np.linalg.svd(dense - dense.mean(axis=0), full_matrices=False)[1]
    assert np.allclose(found.deviations, exact[:3] / np.sqrt(len(words) - 1), rtol=1e-3)
