"""Hierarchical clusters against a hierarchy that is cut from the top down, on all pairs."""

import numpy as np
import pytest

from spindrift.operators import cluster, hierarchy
from spindrift.operators.graph import components


def connected(points, w, below):
    """Parts of the points that distances under a limit connect."""
    left, out = set(points), []
    while left:
        front = [left.pop()]
        part = set(front)
        while front:
            i = front.pop()
            near = {j for j in left if w[i, j] < below}
            left -= near
            part |= near
            front += near
        out.append(sorted(part))
    return out


def plain(x, min_size, min_samples, cosine=False, single=False):
    """Labels by splitting the whole table at its longest necessary distance, again and again."""
    x = np.array(x, float)
    n = len(x)
    if cosine:
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = np.round(1 - u @ u.T, 12)
    else:
        d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 12)
    labels = np.full(n, -1)
    if n <= min_samples:
        return labels.tolist()
    core = np.sort(d + np.where(np.eye(n) > 0, -1, 0), axis=1)[:, min_samples]
    w = np.maximum(d, np.maximum(core[:, None], core))
    levels = np.unique(w)

    def grow(points, born):
        """(stability, best, chosen sets) of the cluster that holds these points below the distance `born`."""
        lam = lambda v: 1 / max(v, hierarchy.LEAST)
        birth, total, size = 0.0 if born == np.inf else lam(born), 0.0, len(points)
        while True:
            at = next(v for v in levels if len(connected(points, w, np.nextafter(v, np.inf))) == 1)
            parts = connected(points, w, at)
            large = [p for p in parts if len(p) >= min_size]
            if len(large) != 1:
                total += len(points) * (lam(at) - birth)
                below = [grow(p, at) for p in large]
                break
            total += (len(points) - len(large[0])) * (lam(at) - birth)
            points = large[0]
        kids = sum(b for b, _ in below)
        if total > 1e-9 * size and total >= kids and (single or born != np.inf):
            return total, [whole[born, size, points[0]]]
        return (max(total, kids) if born == np.inf else kids), [s for _, sets in below for s in sets]

    whole: dict = {}

    def chosen(points, born):
        # Remember each cluster's points as it is born, by what is left of it when it ends.
        class Memo(dict):
            def __missing__(self, key):
                return next(p for p in born_sets if len(p) == key[1] and key[2] in p)

        nonlocal whole
        whole = Memo()
        return grow(points, born)[1]

    born_sets = [list(range(n))]
    for v in levels:
        born_sets += [p for p in connected(range(n), w, v) if len(p) >= min_size]
    if n < min_size:
        return labels.tolist()
    found = sorted(chosen(list(range(n)), np.inf), key=lambda p: (-len(p), p[0]))
    for k, p in enumerate(found):
        labels[p] = k
    return labels.tolist()


def blobs(seed, sizes, spreads, width=3, apart=3.0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=width) * apart + s * rng.normal(size=(n, width)) for n, s in zip(sizes, spreads, strict=True)])


TABLES = {
    "nested": np.concatenate([blobs(2, [20, 20], [0.05, 0.05], apart=0.3), blobs(3, [30], [0.5], apart=8.0), blobs(4, [12], [3.0])]),
    "copies": np.concatenate([np.repeat(blobs(5, [9], [1.0]), [14, 1, 3, 1, 1, 7, 1, 12, 2], axis=0), blobs(6, [25], [0.4])]),
    "grid": np.array([[i % 6, i // 6 + 20 * (i > 35), 0] for i in range(60)], float),
    "noise": blobs(7, [50], [1.0]),
}


CASES = [("nested", {"block": 7, "bucket": 20}), ("copies", {"min_size": 4, "min_samples": 6, "bucket": 5, "single": True}), ("grid", {}), ("noise", {"cosine": True, "min_size": 4, "block": 16})]


@pytest.mark.parametrize(("name", "form"), CASES)
def test_labels_equal_a_hierarchy_from_the_top(spark, name, form):
    x = TABLES[name]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, cluster_id string").repartition(3)
    got = dict(map(tuple, hierarchy.hierarchical_clusters(df, **form).collect()))
    want = plain(x, form.get("min_size", 10), form.get("min_samples", 5), form.get("cosine", False), form.get("single", False))
    assert [got[i] for i in range(len(x))] == want
    if name == "nested":
        flat = {r["cluster_id"] for r in cluster.density_clusters(df).collect()}
        assert len(set(want) - {-1}) == 3 and len(set(want)) > len(flat)  # one cut for all doesn't tell them apart


def test_rows_of_a_component_do_not_meet_each_other(monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    own, core = np.where(np.arange(400) % 50 == 7, np.arange(400), 0), np.abs(rng.normal(size=400)) / 9
    cells, within = [], hierarchy.Metric.within
    monkeypatch.setattr(hierarchy.Metric, "within", lambda self, a, b, *more: cells.append(len(a) * len(b)) or within(self, a, b, *more))
    blocks = [{"block": i, "ids": np.arange(i, i + 100).tobytes(), "vectors": x[i : i + 100].tobytes(), "bound": np.full(100, np.inf).tobytes(), "component": own[i : i + 100].tolist(), "core": core[i : i + 100].tolist()} for i in range(0, 400, 100)]
    step, end = hierarchy.least_edges(hierarchy.Metric(False, 4, 10.0), blocks)
    for b in blocks:
        step(b, [0, 1, 2, 3])
    w = np.maximum(np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 12), np.maximum(core[:, None], core))
    w[own[:, None] == own] = np.inf
    got = end()
    assert got["component"].tolist() == np.unique(own).tolist() and np.allclose(got["weight"], [w[own == c].min() for c in np.unique(own)])
    assert sum(cells) < 400 * 400 / 10


def test_nulls_repeats_and_one_vector(spark):
    x = [[1.0, 2.0]] * 12
    df = spark.createDataFrame([*enumerate(x), (3, [1.0, 2.0]), (50, None), (51, [float("nan"), 0.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = dict(map(tuple, hierarchy.hierarchical_clusters(df).collect()))
    assert set(got) == {*range(12), 50, 51} and set(got.values()) == {-1}
    got = dict(map(tuple, hierarchy.hierarchical_clusters(df, single=True).collect()))
    assert {got[i] for i in range(12)} == {0} and got[50] == got[51] == -1
    assert hierarchy.hierarchical_clusters(df.where("false")).collect() == []


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, size=(120, 2))] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    up = {v: v for e in edges for v in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up
