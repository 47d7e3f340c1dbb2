"""Hard negatives against all scores, and the index's bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import negatives


def plain(rows, every, positives=5, n_negatives=10):
    kept = [(i, b, np.floor(256 * np.array(v, float)).astype(int)) for i, b, v in rows if i is not None and b is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, b, v in kept:
        if i % every:
            continue
        scored = sorted((-int(sum(int(p) * int(q) for p, q in zip(v, w))), j, c) for j, c, w in kept if j != i)
        for s, p, _ in [x for x in scored if x[2] == b][:positives]:
            inside = [(-t, j) for t, j, c in scored if c != b and 30 * -s <= 100 * -t <= 90 * -s][:n_negatives]
            out += [(i, p, k + 1, j, -s, t) for k, (t, j) in enumerate(inside)]
    return sorted(out)


def made(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, width)) * np.geomspace(1, 0.01, width)
    rows = []
    for i in range(n):
        v = (centres[i % 3] + spread * rng.normal(size=width) * np.geomspace(1, 0.01, width)) * rng.choice([0.3, 1, 4])
        rows.append((i, int(rng.integers(0, 3)), v.tolist()))
    hot = rows[1][2]
    rows += [(1000 + i, 1 + i % 2, hot) for i in range(60)]
    return rows + [(2000, None, hot), (2010, 1, None), (2020, 1, [1.0, None]), (2030, 1, [float("nan")]), (2040, 0, []), (None, 1, hot), (2050, 2, [0.5]), (2060, 9, [1.0] * width)]


@pytest.mark.parametrize(("seed", "width", "spread", "form"), [(1, 12, 0.3, {"group": 50, "block": 7}), (2, 20, 2.0, {"group": 33}), (3, 3, 0.1, {})])
def test_negatives_equal_all_scores(spark, seed, width, spread, form):
    rows = made(seed, 200, width, spread)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, rank int, slot int").repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), **form)
    assert sorted(map(tuple, got.collect())) == plain(rows, 10)
    assert negatives.hard_negatives(df.where("false"), F.col("vec_id") % 10 == 0, F.col("label")).collect() == []


@pytest.mark.parametrize("share", [-1.0, 0.2, 0.5, 0.9])
def test_index_loses_no_pair_and_omits_dimensions(share):
    rng = np.random.default_rng(4)
    scale = np.geomspace(1, 0.001, 40)
    rows, anchors = (np.floor(256 * rng.normal(size=(n, 40)) * scale).astype(np.int64) for n in (500, 20))
    norms = np.linalg.norm(anchors, axis=1), np.linalg.norm(rows, axis=1)
    least = np.ceil(share * norms[0] * norms[1].max()).astype(np.int64) if share > 0 else np.full(20, negatives.LOWEST)
    index = negatives.Index(rows, float(negatives._reach(norms[0], least).min()))
    found = set(zip(*(x.tolist() for x in index.candidates(anchors, least))))
    assert {(i, j) for i, j in zip(*np.nonzero(anchors @ rows.T >= least[:, None]))} <= found
    assert len(found) == 20 * 500 if share < 0 else len(found) < 20 * 500
    held = sum(x.size for x in index.lists)
    assert held == 500 * 40 if share < 0 else held < 500 * 40 / 2


def test_windows_of_large_and_small_scores_are_exact(spark):
    rows = [(0, 1, [1.0]), (1, 1, [0.11]), (2, 1, [3e8])] + [(10 + i, 2, [i / 256]) for i in range(1, 40)] + [(60, 2, [2.7e8]), (61, 2, [0.9e8]), (62, 2, [2.7000001e8])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.hard_negatives(df, F.col("vec_id") == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == [r for r in plain(rows, 100) if r[0] == 0]
