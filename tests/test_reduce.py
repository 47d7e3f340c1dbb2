"""Principal axes of wide vectors, and the neighbour-graph layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import manifold, reduce
from spindrift.operators.neighbors import Index


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("parts", [3, 70])
def test_axes_by_passes_equal_those_of_the_covariance(spark, parts):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)) * 0.8 ** np.arange(64) + 5
    df = frame(spark, x).repartition(parts)
    want = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :3]
    for exact in (512, 10):
        mean, axes = reduce.principal_axes(df, 3, "embedding", exact)
        assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs(axes.T @ want), np.eye(3), atol=1e-8)


def test_axes_of_wide_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4)) * [9, 5, 3, 1] @ rng.normal(size=(4, 3072)) + 0.001 * rng.normal(size=(40, 3072))
    got = np.array([r[0] for r in reduce.pca(frame(spark, x), 2).orderBy("vec_id").select("coordinates").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), rtol=1e-5, atol=1e-4)


def test_bandwidths_and_curve():
    d = np.sort(np.random.default_rng(3).random((20, 15)) + 0.2, axis=1)
    w = manifold.weights(d)
    assert np.allclose(w.max(axis=1), 1) and np.allclose(w.sum(axis=1), np.log2(15), atol=1e-6) and (np.diff(w, axis=1) <= 0).all()
    few = manifold.weights(np.array([[0.0, 0.0, np.inf], [0.5, np.inf, np.inf]]))
    assert few[:, 0].tolist() == [1, 1] and few[0, 2] == few[1, 1] == 0
    a, b = manifold.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)


def test_layout_keeps_neighbours_that_principal_axes_lose(spark):
    rng = np.random.default_rng(4)
    # A rolled-up sheet, and squares that lie in planes of their own.
    t, h = 1.5 * np.pi * (1 + 2 * rng.random(300)), rng.random(300)
    roll = np.c_[t * np.cos(t) / 14, h, t * np.sin(t) / 14, np.zeros((300, 9))]
    groups = np.concatenate([rng.random((80, 2)) @ np.eye(12)[[3 + 2 * g, 4 + 2 * g]] + np.eye(12)[11] * 2 for g in range(4)])
    x = np.concatenate([roll, groups])
    df = frame(spark, x).withColumn("y", F.lit("clash")).repartition(3)
    near = Index(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), False).knn(10)
    flat = manifold.layout(df, cosine=False, rounds=4, epochs=30, block=64)
    ours, theirs = (manifold.preserved(d, near, 10, "vec_id", "coordinates") for d in (flat, reduce.pca(df, 2)))
    assert ours > 1.7 * theirs
    again = manifold.layout(df.repartition(2), cosine=False, rounds=4, epochs=30, block=64)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, flat.collect()))


def test_layout_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (None, [0.0, 1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[0]: r[1] for r in manifold.layout(df, rounds=1, epochs=2).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[2] and len(got[1]) == 2 and got[3] is got[4] is None
    assert manifold.layout(df.where("false"), rounds=1, epochs=1).collect() == []
