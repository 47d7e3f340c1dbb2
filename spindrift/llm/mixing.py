"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. Each source takes every document once if its target is that large, and fits the
rest of its target by a choice of documents, one more copy each: a proportional share of every length, then a bounded
knapsack over the lengths for what remains. Which documents of a length are chosen is decided by a seeded hash.

Defined results: null and empty texts have size 0 and nothing is taken of them; a source without words has target 0;
null is a source of its own, after all others; repeated rows are chosen one by one. Columns of the input other than id,
text and source are not used.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
KNAPSACK = 1 << 16
"""Largest budget that the knapsack fits, where no document is longer than a quarter of it; whole lengths are taken until as
little is left."""
BUCKET = 500
"""Documents of one length are ranked within hash buckets of about this many."""


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (key, source, source_size) with each source's target.

    Sources by code point, null last, have the weights in turn. Targets split share * total by weight and stop at
    most * source_size; the excess goes to the others by weight. With the sources in the order in which they are
    filled, the level that those from each one on would share rises until the first that isn't full, then falls. The
    windows over all sources hold one row a source, a few numbers and a name each, whatever the number of documents.
    """
    every, code_point = W.partitionBy(), W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(code_point) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    x = x.withColumn("budget", F.least(F.lit(float(share)) * F.sum("source_size").over(every), F.sum("cap").over(every)))
    before = W.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(0, W.unboundedFollowing)
    x = x.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    return x.withColumn("target", F.least("cap", F.max("level").over(every) * F.col("w"))).select("key", "source", "source_size", "target")


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, counts at most, so that their sum is the largest up to budget.

    Each length costs one pass over the sums, whatever its count.
    """
    taken = np.zeros(len(lengths), np.int64)
    unit = int(np.gcd.reduce(lengths)) if len(lengths) else 0
    if not unit:
        return taken
    sizes, budget = (lengths // unit).tolist(), budget // unit
    reached, last = np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int32)
    reached[0] = True
    for i, (size, count) in enumerate(zip(sizes, counts.tolist(), strict=True)):
        if not 0 < size <= budget or not count:
            continue
        if count == 1:
            new = np.zeros(budget + 1, bool)
            new[size:] = reached[:-size]
        else:
            # Sums by remainder and multiple of the size: how many sizes back is the nearest sum that was reached?
            rows = budget // size + 1
            grid = np.zeros(rows * size, bool)
            grid[: budget + 1] = reached
            grid, row = grid.reshape(rows, size), np.arange(rows, dtype=np.int32)[:, None]
            before = np.maximum.accumulate(np.where(grid, row, np.int32(-rows)), axis=0)
            new = ((before >= 0) & (row - before <= count)).reshape(-1)[: budget + 1]
        new &= ~reached
        reached |= new
        last[new] = i
        if reached[budget]:
            break
    total = int(np.flatnonzero(reached)[-1])
    while total:
        taken[last[total]] += 1
        total -= sizes[last[total]]
    return taken


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int, held: int) -> np.ndarray:
    """fit() with the shares of `held` words less than the budget."""
    total = int((lengths * counts).sum())
    share = np.array([c * (budget - held) // total for c in counts.tolist()], np.int64)  # exact, whatever the size
    left = budget - int((lengths * share).sum())
    for _ in range(2):
        if left <= most:
            break
        # One more of as many lengths as fit, those that lost most to rounding first, then the longest first.
        lost = counts * (budget / total) - share
        order = np.lexsort((lengths, -lost)) if _ == 0 else np.argsort(-lengths, kind="stable")
        for i in order.tolist():
            room = (left - most // 2) // int(lengths[i])
            more = min(int(counts[i] - share[i]), max(0, room), 1 if _ == 0 else room)
            if more > 0:
                share[i] += more
                left -= more * int(lengths[i])
    open_ = (counts > share) & (lengths <= left)
    if open_.any():  # left is at most `most` now, as a length that is still open fits no more above half of it
        order = np.flatnonzero(open_)[np.argsort(-lengths[open_], kind="stable")]
        share[order] += knapsack(lengths[order], (counts - share)[order], left)
    return share


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = KNAPSACK) -> np.ndarray:
    """How many documents of each positive length to take so that their words sum to about budget.

    The knapsack gets `most` words at most, or four times the longest document that fits the budget if that is more. If
    it can't fill what the shares leave, as when documents are longer than that, the shares give back as much as it takes.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    fitting = lengths[lengths <= budget]
    most = max(most, 4 * int(fitting.max())) if len(fitting) else most
    share = _fit(lengths, counts, budget, most, 0)
    if (lengths * share).sum() < budget:
        other = _fit(lengths, counts, budget, most, min(budget, most))
        share = max(share, other, key=lambda x: int((lengths * x).sum()))
    return share


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    lengths, counts = group["size"].to_numpy(), group["n"].to_numpy()
    target, size = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
    whole = int(target // size) if size else 0
    budget = max(0, round(target - whole * size))
    positive = lengths > 0
    chosen = np.zeros(len(group), np.int64)
    chosen[positive] = fit(lengths[positive], counts[positive], budget)
    return group.assign(whole=whole, chosen=chosen)[["key", "size", "n", "source_size", "target", "whole", "chosen"]]


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """(id, size, source_size, target, taken) of every row; taken is a multiple of size."""
    rows = df.select(F.col(id).alias("id"), word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"))
    rows = rows.withColumn("key", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")))
    rows = materialize(rows.withColumn("n_row", F.monotonically_increasing_id()), "sizes")
    counts = rows.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    sources = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sources, weights, share, most).select("key", "source_size", "target")
    plan = counts.select("key", "size", "n").join(goal, "key").groupBy("key")
    plan = materialize(plan.applyInPandas(_plan, "key string, size long, n long, source_size long, target double, whole long, chosen long"), "plan")

    ranked = rows.select("id", "key", "size", F.when(F.col("id").isNull(), F.xxhash64(F.lit(seed), "n_row")).otherwise(F.xxhash64(F.lit(seed), "id")).alias("h")).join(plan, ["key", "size"])
    split = F.col("size").isNotNull() & (F.col("chosen") > 0) & (F.col("chosen") < F.col("n"))
    simple = ranked.where(~split).withColumn("copies", F.col("whole") + (F.col("chosen") > 0).cast("long"))
    some = ranked.where(split).withColumn("bucket", F.pmod("h", F.ceil(F.col("n") / BUCKET)))
    sizes = some.groupBy("key", "size", "bucket").agg(F.count("*").alias("in_bucket"))
    running = W.partitionBy("key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("key", "size", "bucket", F.coalesce(F.sum("in_bucket").over(running), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("h", "id"))
    some = some.join(sizes, ["key", "size", "bucket"]).withColumn("copies", F.col("whole") + (F.col("before") + place <= F.col("chosen")).cast("long"))
    out = [F.col("id").alias(id), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")]
    return simple.select(*out).union(some.select(*out))
