"""Neighbour-graph layout of vectors in few dimensions (UMAP's objective, as Spark rounds).

1. The k nearest neighbours of each different vector (neighbors.Index) get weights by a bandwidth of their own row: the
   nearest counts 1, and the sum is log2(k). Both directions of an edge are united to one weight.
2. The start is spectral: principal coordinates are smoothed by block power iteration on the normalised edge table, so that
   they follow the graph.
3. Rounds improve it. In a round, each block of neighbouring rows is one task with its rows, its edges with the other ends'
   places, and seeded draws of places from all over the table, and takes some epochs of stochastic steps: edges pull by
   their weights, draws push. Other blocks' places stay as they were until the next round.

Places are rounded between rounds and all draws are seeded by ids, so reruns agree. A task holds one block's rows and edges
and its draws, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import norm
from ..shared import discard, stored
from .hierarchy import vertices
from .neighbors import Index, _batch
from .reduce import pca
from .table import with_row_index

ROUNDS = 10
EPOCHS = 20
"""Epochs of a round."""
SMOOTH = 4
"""Times that three power steps are taken before the rounds."""
DRAWS = 2048
"""Places that a block draws in a round."""
PUSHES = 5
"""Draws that push a row each time that an edge pulls it."""
PLACES = 5
"""Decimal places that are kept between rounds."""
BLOCKS = 2
"""As many rows as 2**BLOCKS blocks of the index are a task."""


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b for which 1 / (1 + a x^(2b)) is nearest to 1 up to min_dist and exp(-(x - min_dist) / spread) from there."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    at, damp = np.zeros(2), 1e-3  # logarithms of a and b

    def error(t: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(t[0]) * x ** (2 * np.exp(t[1]))) - y

    for _ in range(200):
        e = error(at)
        slope = np.stack([(error(at + h) - e) / 1e-6 for h in np.eye(2) * 1e-6], axis=1)
        step = np.linalg.solve(slope.T @ slope + damp * np.eye(2), -slope.T @ e)
        if (error(at + step) ** 2).sum() < (e**2).sum():
            at, damp = at + step, damp / 3
        else:
            damp *= 3
    return float(np.exp(at[0])), float(np.exp(at[1]))


def weights(distances: np.ndarray) -> np.ndarray:
    """Weights of rows of ascending neighbour distances (inf: none): exp(-(d - nearest) / bandwidth), summing to log2 of their number."""
    known = np.isfinite(distances)
    d = np.where(known, distances, 0.0)
    positive = np.where(known & (d > 0), d, np.inf).min(axis=1, initial=np.inf)
    d = np.maximum(d - np.where(np.isfinite(positive), positive, 0.0)[:, None], 0)
    target = np.log2(np.maximum(known.sum(axis=1), 1))
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    width = np.ones(len(d))
    least = 1e-3 * np.maximum((d * known).sum(axis=1) / np.maximum(known.sum(axis=1), 1), 1e-12)
    for _ in range(64):
        over = (np.exp(-d / width[:, None]) * known).sum(axis=1) > target
        high, low = np.where(over, width, high), np.where(over, low, width)
        width = np.where(np.isfinite(high), (low + high) / 2, width * 2)
    return np.exp(-d / np.maximum(width, least)[:, None]) * known


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(i, j, w), stored, both directions: united weights of the edges (id, neighbor_id, distance)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("near").to_pylist()
            d = np.full((len(lists), k), np.inf)
            for row, x in enumerate(lists):
                d[row, : len(x)] = [e["distance"] for e in x]
            w = weights(d)
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            place = np.concatenate([np.arange(len(x)) for x in lists]) if lists else row
            yield _batch(i=batch.column("id").to_numpy()[row], j=np.array([e["neighbor_id"] for x in lists for e in x], np.int64), w=w[row, place])

    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    one = lists.mapInArrow(weigh, "i long, j long, w double")
    pair = one.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w").groupBy("i", "j").agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count("*").alias("n"))
    w = pair.select("i", "j", F.when(F.col("n") == 2, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w")).where("w > 0")
    return stored(w.unionByName(w.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "graph")


def spectral_start(graph: DataFrame, coordinates: DataFrame, dims: int) -> DataFrame:
    """(id, y), stored: coordinates (id, c) smoothed along the edges, orthogonal to each other and to the constant one."""
    m = dims + 1
    degree = stored(graph.groupBy("i").agg(F.sum("w").alias("degree")), "degrees")
    to = degree.select(F.col("i").alias("j"), F.col("degree").alias("other"))
    edges = stored(graph.join(degree, "i").join(to, "j").select("i", "j", (F.col("w") / F.sqrt(F.col("degree") * F.col("other"))).alias("s")), "edges")
    start = coordinates.join(degree.withColumnRenamed("i", "id"), "id", "left").select("id", F.concat(F.array(F.sqrt(F.coalesce("degree", F.lit(0.0)))), "c").alias("y"))
    now = _orthogonal(stored(start, "power"), m)
    for _ in range(SMOOTH):
        new = now
        for _ in range(3):
            sums = edges.join(new.withColumnRenamed("id", "j"), "j").groupBy("i").agg(*[F.sum(F.col("s") * F.col("y")[k]).alias(f"s{k}") for k in range(m)])
            moved = new.join(sums, F.col("id") == F.col("i"), "left")
            new = moved.select("id", F.array(*[(F.col("y")[k] + F.coalesce(f"s{k}", F.lit(0.0))) / 2 for k in range(m)]).alias("y"))
        old, now = now, _orthogonal(stored(new, "power"), m)
        discard(old)
    discard(edges)
    discard(degree)
    return now


def _orthogonal(rows: DataFrame, m: int) -> DataFrame:
    """rows with columns of y made orthonormal by the sums of their products, m * m numbers; stored in place of rows."""
    sums = rows.agg(*[F.coalesce(F.sum(F.col("y")[a] * F.col("y")[b]), F.lit(0.0)) for a in range(m) for b in range(a + 1)]).first()
    gram = np.zeros((m, m))
    gram[np.tril_indices(m)] = sums
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    c = np.linalg.cholesky((gram + np.tril(gram, -1).T) / np.outer(scale, scale) + 1e-9 * np.eye(m))
    turn = np.linalg.inv(c).T / scale[:, None]
    out = stored(rows.select("id", F.array(*[sum((F.col("y")[a] * float(turn[a, b]) for a in range(b + 1)), F.lit(0.0)) for b in range(m)]).alias("y")), "power")
    discard(rows)
    return out


def steps(at: np.ndarray, own: np.ndarray, other: np.ndarray, w: np.ndarray, far: np.ndarray, ab: tuple[float, float], rates: np.ndarray, seed: list[int]) -> np.ndarray:
    """Places of a block's rows after one epoch for each rate.

    at: places of the rows, then of the other ends, which stay. own, other: ends of the edges; far: draws that push.
    """
    a, b = ab
    n, rng, at = int(own.max()) + 1 if len(own) else 0, np.random.default_rng(seed), at.copy()
    share = w / w.max() if len(w) else w
    for rate in rates:
        taken = np.flatnonzero(rng.random(len(own)) < share)
        for part in np.array_split(rng.permutation(taken), 8):
            i, j = own[part], other[part]
            pull = at[i] - at[j]
            d = (pull**2).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull *= np.where(d > 0, -2 * a * b * d ** (b - 1) / (1 + a * d**b), 0.0)[:, None]
            move = np.zeros((n, at.shape[1]))
            np.add.at(move, i, np.clip(pull, -4, 4))
            i = np.repeat(i, PUSHES)
            push = at[i] - far[rng.integers(0, len(far), len(i))]
            d = (push**2).sum(axis=1)
            push *= (2 * b / ((0.001 + d) * (1 + a * d**b)))[:, None]
            np.add.at(move, i, np.where(d[:, None] > 0, np.clip(push, -4, 4), 0.0))
            at[:n] += rate * move
    return at


def _round(number: int, ab: tuple[float, float], rates: np.ndarray, dims: int):
    def apply(key: tuple[pa.Scalar, ...], edges: pa.Table, draws: pa.Table) -> pa.Table:
        if not edges.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "y": pa.array([], pa.list_(pa.float64()))})
        edges, draws = edges.sort_by([("i", "ascending"), ("j", "ascending")]), draws.sort_by("draw")

        def places(t: pa.Table, c: str) -> np.ndarray:
            return t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, dims)

        i, j = edges.column("i").to_numpy(), edges.column("j").to_numpy()
        ids, first, own = np.unique(i, return_index=True, return_inverse=True)
        outside, then = np.unique(j[~np.isin(j, ids)], return_index=True)
        at = np.concatenate([places(edges, "yi")[first], places(edges, "yj")[~np.isin(j, ids)][then]])
        other = np.where(np.isin(j, ids), np.searchsorted(ids, j), len(ids) + np.searchsorted(outside, j))
        new = steps(at, own, other, edges.column("w").to_numpy(), places(draws, "y"), ab, rates, [number, int(ids[0]) & (2**63 - 1)])[: len(ids)]
        return pa.table({"id": pa.array(ids), "y": pa.array(list(np.round(new, PLACES)), pa.list_(pa.float64()))})

    return apply


def layout(df: DataFrame, dims: int = 2, k: int = 15, min_dist: float = 0.1, id: str = "vec_id", vector: str = "embedding", out: str = "coordinates", cosine: bool = True, rounds: int = ROUNDS, epochs: int = EPOCHS, block: int = 1024) -> DataFrame:
    """(id, out) of all different ids, stored: places in `dims` dimensions that keep near rows near.

    Equal vectors have one place, null vectors and those that aren't finite have none (null); rows that share an id are one
    row, and null ids are left out. Fewer than two different vectors are at 0.
    """
    ids = df.select(F.col(id).cast("long").alias("id")).where("id is not null").distinct()
    found, rows = vertices(df, id, vector)
    index = Index(found.select(F.col("rep").alias("id"), "v"), cosine, block)
    near = stored(index.knn(k), "near")
    graph = fuzzy_graph(near, k)
    scaled = found.select(F.col("rep").alias("id"), (F.transform("v", lambda x: F.coalesce(F.try_divide(x, norm(F.col("v"))), F.lit(0.0))) if cosine else F.col("v")).alias("v"))
    wide = pca(scaled, min(dims, index.metric.width), "v", "c").select("id", F.concat("c", F.array_repeat(F.lit(0.0), max(0, dims - index.metric.width))).alias("c"))
    start = spectral_start(graph, wide, dims)
    # The first column is the constant one; the others are stretched to 10, and rows in one place are moved apart a little.
    most = start.agg(*[F.max(F.abs(F.col("y")[d + 1])) for d in range(dims)]).first()
    noise = lambda d: (F.pmod(F.xxhash64(F.lit(d), "id"), F.lit(20001)) - 10000) / 1e7
    now = start.select("id", F.array(*[F.round(F.col("y")[d + 1] * (10 / (most[d] or 1.0)) + noise(d), PLACES) for d in range(dims)]).alias("y"))
    numbered = with_row_index(now.select("id"), ["id"], "n")
    # Tasks are cut by the rows' order in the index, which doesn't depend on how Spark has cut it.
    order = with_row_index(index.members, ["block", "place"], "rank")
    block_of = stored(order.select(F.col("id").alias("i"), F.floor(F.col("rank") / (block << BLOCKS)).alias("task")), "tasks")
    edges = stored(graph.join(block_of, "i"), "block-edges")
    tasks = stored(block_of.select("task").distinct(), "task-list")
    now, n = stored(now, "places"), index.n
    ab = curve(min_dist)
    rates = np.linspace(1.0, 0.0, rounds * epochs, endpoint=False)
    for r in range(rounds if n > 1 else 0):
        seat = numbered.join(now, "id").select("n", "y")
        wanted = tasks.select(F.col("task").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(min(DRAWS, 4 * n) - 1))).alias("draw"))
        wanted = wanted.withColumn("n", F.pmod(F.xxhash64(F.lit(r), "of", "draw"), F.lit(n)))
        draws = wanted.join(seat, "n").select("of", "draw", "y")
        held = edges.join(now.select(F.col("id").alias("i"), F.col("y").alias("yi")), "i").join(now.select(F.col("id").alias("j"), F.col("y").alias("yj")), "j").select("task", "i", "j", "w", "yi", "yj")
        moved = held.groupBy("task").cogroup(draws.groupBy("of")).applyInArrow(_round(r, ab, rates[r * epochs : (r + 1) * epochs], dims), "id long, y array<double>")
        # Rows without an edge stay.
        new = stored(now.join(moved.select(F.col("id").alias("of"), F.col("y").alias("to")), F.col("id") == F.col("of"), "left").select("id", F.coalesce("to", "y").alias("y")), "places")
        discard(now)
        now = new
    places = rows.join(now.select(F.col("id").alias("rep"), "y"), "rep").select("id", "y")
    result = stored(ids.join(places, "id", "left").select(F.col("id").alias(id), F.col("y").alias(out)), "layout")
    for x in (found, rows, index.blocks, near, graph, start, block_of, edges, tasks, now):
        discard(x)
    return result


def preserved(df: DataFrame, near: DataFrame, k: int, id: str, place: str) -> float:
    """The share of neighbours (id, neighbor_id) that are among the k nearest by place, too."""
    found = Index(df.select(F.col(id).alias("id"), F.col(place).alias("v")), False).knn(k).select("id", "neighbor_id")
    return near.select("id", "neighbor_id").join(found, ["id", "neighbor_id"]).count() / max(1, near.count())
