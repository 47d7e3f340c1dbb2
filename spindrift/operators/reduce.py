"""Reduction of vectors to few dimensions, and scaling of coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import doubles
from ..shared import discard, stored

EXACT = 512
"""Dimensions up to which the whole covariance is gathered."""
MORE = 8
"""Directions beside those asked for."""
PASSES = 60
TOGETHER = 64
"""Sums that are added up by one task."""
ROWS = 1024
"""Rows that are multiplied at once."""


def _gathered(vectors: DataFrame, width: int, gather: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of gather(rows) over all rows of vectors (v): one binary row of `size` numbers a task, summed by Spark in steps."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                v = batch.column("v").slice(s, ROWS)
                total += gather(v.flatten().to_numpy().reshape(len(v), width))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "x"])

    def step(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("x").to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "x"])

    tasks, sums = vectors.rdd.getNumPartitions(), vectors.mapInArrow(own, "part long, x binary")
    while tasks > TOGETHER:
        sums = sums.groupBy(F.floor(F.col("part") / TOGETHER).alias("of")).applyInArrow(step, "part long, x binary")
        tasks = -(-tasks // TOGETHER)
    rows = sorted((r["part"], bytes(r["x"])) for r in sums.collect())  # TOGETHER at most
    return sum((np.frombuffer(x) for _, x in rows), np.zeros(size))


def _vectors(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    vectors = df.select(doubles(F.col(vector)).alias("v")).where("v is not null")
    return vectors, vectors.agg(F.max(F.size("v"))).first()[0] or 0


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of all vectors; each task sends d * d numbers as one row."""
    vectors, d = _vectors(df, vector)
    x = _gathered(vectors, d, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)]), 1 + d + d * d)
    n, mean, products = int(x[0]), x[1 : d + 1] / max(x[0], 1), x[d + 1 :].reshape(d, d)
    return n, mean, products / max(n, 1) - np.outer(mean, mean)


def principal_axes(df: DataFrame, k: int, vector: str, exact: int = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first k principal axes (d, k) of all vectors, strongest first.

    Up to `exact` dimensions by their covariance. Wider vectors by a randomized range finder: a seeded block of k and a few
    more directions is multiplied by the covariance, one pass over the rows each time and d * (k + few) numbers a task, and
    made orthogonal, until the axes in it move no more (or PASSES are done, where axes are of nearly one strength).
    """
    vectors, d = _vectors(df, vector)
    k = min(k, d)
    if d <= exact:
        _, mean, cov = moments(df, vector)
        return mean, (np.linalg.eigh(cov)[1][:, ::-1][:, :k] if d else np.zeros((0, k)))
    vectors = stored(vectors, "vectors")
    x = _gathered(vectors, d, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), 1 + d)
    n, mean, m = max(x[0], 1), x[1:] / max(x[0], 1), min(d, k + MORE)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(d, m)))[0]
    for _ in range(PASSES):
        z = _gathered(vectors, d, lambda x, q=block: ((x - mean).T @ ((x - mean) @ q)).reshape(-1), d * m).reshape(d, m) / n
        strength, turn = np.linalg.eigh((block.T @ z + z.T @ block) / 2)
        strength, turn = strength[::-1], turn[:, ::-1]
        axes = (block @ turn)[:, :k]
        moved = np.linalg.norm((z @ turn)[:, :k] - axes * strength[:k], axis=0)
        block = np.linalg.qr(z)[0]
        if (moved <= 1e-10 * max(strength[0], 1e-300)).all():
            break
    discard(vectors)
    return mean, axes


def pca(df: DataFrame, k: int = 2, vector: str = "embedding", out: str = "coordinates", exact: int = EXACT) -> DataFrame:
    """df with the first k principal coordinates; each axis points where its largest component is positive."""
    mean, axes = principal_axes(df, k, vector, exact)
    if len(mean):
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    def apply(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), np.float64).reshape(len(v), len(mean))
        return pd.Series(list((x - mean) @ axes))

    return df.withColumn(out, F.pandas_udf(apply, "array<double>")(doubles(F.col(vector))))


def scaled(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Columns stretched to low..high over all rows; a column of one value becomes low."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    joined = df.join(F.broadcast(ends))  # one row
    span = lambda c: F.when(F.col(f"__max_{c}") == F.col(f"__min_{c}"), F.lit(1.0)).otherwise(F.col(f"__max_{c}") - F.col(f"__min_{c}"))
    return joined.withColumns({c: low + (F.col(c) - F.col(f"__min_{c}")) / span(c) * (high - low) for c in columns}).select(*df.columns)
