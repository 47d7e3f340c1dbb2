"""Hard negatives by threshold joins whose thresholds fall until the windows are full.

An anchor's positives are its best rows of its own label. For each positive, negatives are the best rows of other labels
whose score lies in a window below the positive's. Both are found by the same join: every open ask (anchor, lowest and
highest score, how many) has a threshold at the lowest score that it takes; asks that the join fills are done, the others
go on with a lower threshold, at last with their window's own floor.

The join is of the L2AP kind. Rows are dealt to groups by descending length, and anchors to blocks; a group whose longest row
can't reach any threshold of a block isn't met. A task builds an inverted index of its group: dimensions come in order of
the energy that all rows have in them, and a row is in the lists of its leading dimensions only, up to where the norm of the
rest times any anchor's norm stays under its threshold. Lists are walked in steps of some dimensions; partial scores
accumulate, and after steps rows are left out that stay below all thresholds by partial score plus the product of the
remaining norms. What is left is scored exactly. A task returns no more rows an ask than it wants.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors are
padded with zeros; an anchor is no candidate of its own, nor are rows that share its id; equal scores rank by smaller id;
anchors that share an id are served each for itself, and their rows repeat; fewer positives or negatives than asked for come
as they are. A positive with a score below 0 has an empty window. Scores past the range of a long are cut to it. Other
columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .topk import LOWEST, _matrix, _packed, _unpacked, pair_products, products, scaled, whole

GROUP = 16384
"""Rows of a group, about."""
ANCHORS = 2048
"""Anchors of a block, about."""
SLICE = 128
"""Anchors that are scored at once."""
STEP = 8
"""Dimensions of a step."""
FIRST = (0.6, 0.3, 0.15)
"""Thresholds of positives, as shares of the anchor's length times the longest row's; then there is none."""
BELOW = (0.95, 0.8)
"""Thresholds of negatives, as shares of the window's highest score; then the window's lowest."""
_HIGHEST = 2**63 - 1


class Index:
    """Inverted lists of the leading dimensions of some rows (integers, dimensions in order).

    reach: the least threshold divided by its anchor's norm. A row's dimensions from its cut on have a norm below it.
    """

    def __init__(self, vectors: np.ndarray, reach: float, step: int = STEP) -> None:
        self.steps = -(-vectors.shape[1] // step)
        self.norms = suffix_norms(vectors, step)
        under = self.norms * (1 + 1e-9) < reach
        cut = np.where(under.any(axis=1), under.argmax(axis=1), self.steps)
        self.order = np.argsort(-cut, kind="stable")
        self.cut, self.norms = cut[self.order], self.norms[self.order]
        self.ends = [int(np.searchsorted(-self.cut, -j)) for j in range(self.steps)]  # rows whose cut is above j
        self.step = step
        self.lists = [np.ascontiguousarray(vectors[self.order[:n], j * step : (j + 1) * step].T.astype(np.float64)) for j, n in enumerate(self.ends)]

    def candidates(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor's place, row's place) of all pairs that may score `least` or more, and perhaps of some others."""
        norms = suffix_norms(anchors, self.step)
        slack = 1e-9 * norms[:, 0] * self.norms[:, 0].max(initial=0) + 1e-6
        wanted = np.where(least == LOWEST, -np.inf, least.astype(np.float64)) - slack
        rows = np.arange(self.ends[0] if self.ends else 0)
        scores = np.zeros((len(anchors), len(rows)))
        for j in range(self.steps):
            n = int(np.searchsorted(rows, self.ends[j]))
            if not n:
                break
            own = self.lists[j] if n == self.ends[j] else self.lists[j][:, rows[:n]]
            scores[:, :n] += anchors[:, j * self.step : (j + 1) * self.step].astype(np.float64) @ own
            # What may still come: the remaining norms, those from the cut on included.
            open_ = (scores + norms[:, [j + 1]] * self.norms[rows, j + 1] >= wanted[:, None]).any(axis=0)
            open_[n:] = True  # their lists have ended, they are judged below
            if open_.mean() < 0.7:
                rows, scores = rows[open_], scores[:, open_]
        rest = norms[:, self.cut[rows]] * self.norms[rows, self.cut[rows]]
        i, k = np.nonzero(scores + rest >= wanted[:, None])
        return i, self.order[rows[k]]


def suffix_norms(vectors: np.ndarray, step: int) -> np.ndarray:
    """Norms of each vector's dimensions from every step on; the last is 0."""
    squares = np.add.reduceat(vectors.astype(np.float64) ** 2, np.arange(0, vectors.shape[1], step), axis=1)
    return np.sqrt(np.c_[np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros(len(vectors))])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by descending score, then by id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


def _energy(width: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += (_matrix(batch.column("v"), width).astype(np.float64) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["i", "x"])

    return apply


def _pack(rows: int, width: int, order: np.ndarray):
    """Rows of a partition in blocks, their dimensions in order."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(x: pa.Table) -> pa.RecordBatch:
            nonlocal number
            x = x.combine_chunks()
            data, size = _packed(_matrix(x.column("v").chunk(0), width)[:, order])
            cells = [(part, pa.int64()), ((part << 20) + number, pa.int64()), (x.num_rows, pa.int64()), (x.column("length")[0].as_py(), pa.float64())]
            cells += [(x.column(c).to_numpy().astype(np.int64).tobytes(), pa.binary()) for c in ("id", "label")] + [(data, pa.binary()), (size, pa.int32())]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in cells], ["part", "block", "n", "longest", "ids", "labels", "vectors", "size"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in held) >= rows:
                joined = pa.concat_tables(held)
                yield block(joined.slice(0, rows))
                held = [joined.slice(rows)]
        if sum(t.num_rows for t in held):
            yield block(pa.concat_tables(held))

    return apply


_BLOCKS = "part long, block long, n long, longest double, ids binary, labels binary, vectors binary, size int"


def _blocks(rows: DataFrame, group: int, width: int, order: np.ndarray) -> DataFrame:
    """(g, block, longest, ids, labels, vectors, size), stored: groups of about `group` rows by descending length."""
    parts = max(1, -(-rows.count() // group))
    ranged = rows.repartitionByRange(parts, F.col("length").desc(), "id").sortWithinPartitions(F.col("length").desc(), "id")
    packed = materialize(ranged.mapInArrow(_pack(min(group, 4096), width, order), _BLOCKS), "negative-blocks")
    # One row a block; many small partitions make one group.
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    of = packed.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.floor(before / group).cast("long").alias("g"))
    return packed.drop("n").join(of, "part").drop("part")


def _joined(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of some blocks."""
    ids, labels = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("ids", "labels"))
    return ids, labels, np.concatenate([_unpacked(r["vectors"], r["size"], width) for r in rows])


def _reach(norm: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The norm that a row needs to score `least`."""
    return np.where(least > 0, least / np.maximum(norm, 1e-300), -np.inf)


def _needs(width: int):
    """The least norm that any row needs for an ask of the block."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                norm = np.linalg.norm(_unpacked(r["vectors"], r["size"], width).astype(np.float64), axis=1)
                at, low = (np.array([a[c] for a in r["asks"]], np.int64) for c in ("place", "low"))
                cells = [pa.array([r["block"]], pa.int64()), pa.array([float(_reach(norm[at], low).min())])]
                yield pa.RecordBatch.from_arrays(cells, ["block", "need"])

    return apply


def _probe(width: int, k: int, same: bool):
    def apply(c: pa.Table, q: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if c.num_rows and q.num_rows:
            ids, labels, vectors = _joined(c.to_pylist(), width)
            blocks = q.to_pylist()
            own_ids, own_labels, anchors = _joined(blocks, width)
            starts = np.cumsum([0] + [len(r["ids"]) // 8 for r in blocks])
            asks = [(start + a["place"], (r["block"] << 20) + a["place"], a["slot"], a["low"], a["high"]) for r, start in zip(blocks, starts, strict=False) for a in r["asks"]]
            place, query, slot, low, high = (np.array(x, np.int64) for x in zip(*asks, strict=True))
            least = np.full(len(anchors), _HIGHEST)
            np.minimum.at(least, place, low)
            asked = np.unique(place)
            norm = np.linalg.norm(anchors.astype(np.float64), axis=1)
            index = Index(vectors, float(_reach(norm[asked], least[asked]).min()))
            by_place = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[by_place], np.arange(len(anchors) + 1))
            for s in range(0, len(asked), SLICE):
                at = asked[s : s + SLICE]
                i, row = index.candidates(anchors[at], least[at])
                if len(i) > 0.1 * len(at) * len(vectors):
                    scores = products(anchors[at], vectors)[i, row]
                else:
                    scores = np.concatenate([pair_products(anchors[at[i[b : b + 65536]]], vectors[row[b : b + 65536]]) for b in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
                good = ((labels[row] == own_labels[at[i]]) == same) & (ids[row] != own_ids[at[i]]) & (scores >= least[at[i]])
                i, row, scores = i[good], row[good], scores[good]
                ends = np.searchsorted(i, np.arange(len(at) + 1))
                for n, a in enumerate(at.tolist()):
                    own, of = row[ends[n] : ends[n + 1]], scores[ends[n] : ends[n + 1]]
                    for x in by_place[edges[a] : edges[a + 1]].tolist():
                        inside = np.flatnonzero((of >= low[x]) & (of <= high[x]))
                        inside = inside[best(of[inside], ids[own[inside]], k)]
                        m = len(inside)
                        out.append((np.full(m, query[x]), np.full(m, own_ids[a]), np.full(m, slot[x]), ids[own[inside]], of[inside]))
        cells = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query", "query_id", "slot", "vec_id", "score"), cells, strict=True)})

    return apply


_FOUND = "query long, query_id long, slot long, vec_id long, score long"


def fill(asks: DataFrame, ladder: list[Column], anchors: DataFrame, groups: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """(query, query_id, slot, vec_id, score, rank), stored: the k first rows of each ask (query, slot, floor, high, ...).

    ladder: the thresholds of an ask, the highest first; the floor comes after them.
    """
    longest = materialize(groups.groupBy("g").agg(F.max("longest").alias("longest")), "groups")
    rank = F.row_number().over(W.partitionBy("query", "slot").orderBy(F.col("score").desc(), "vec_id"))
    done: DataFrame | None = None
    for last, threshold in [(False, t) for t in ladder] + [(True, F.col("floor"))]:
        now = asks.withColumn("low", F.greatest("floor", threshold))
        of_block = now.groupBy(F.shiftright("query", 20).alias("of")).agg(F.collect_list(F.struct(F.col("query").bitwiseAND(2**20 - 1).alias("place"), "slot", "low", "high")).alias("asks"))
        asked = materialize(anchors.join(of_block, F.col("block") == F.col("of")).select("block", "ids", "labels", "vectors", "size", "asks"), "asked")
        need = asked.select("block", "vectors", "size", "asks").mapInArrow(_needs(width), "block long, need double")
        pairs = materialize(longest.join(need, F.col("longest") * (1 + 1e-9) >= F.col("need")).select("g", F.col("block").alias("s")), "pairs")
        left = pairs.join(groups, "g").groupBy("g", "s")
        right = pairs.toDF("of_g", "of_s").join(asked, F.col("of_s") == F.col("block")).groupBy("of_g", "of_s")
        found = left.cogroup(right).applyInArrow(_probe(width, k, same), _FOUND)
        found = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k), "found")
        if last:
            return found if done is None else done.unionByName(found)
        full = found.groupBy("query", "slot").agg(F.count("*").alias("n"))
        state = now.join(full, ["query", "slot"], "left").withColumn("closed", (F.coalesce("n", F.lit(0)) >= k) | (F.col("low") == F.col("floor")))
        state = materialize(state.drop("n", "low"), "asks")
        closed = found.join(state.where("closed").select("query", "slot"), ["query", "slot"])
        done = closed if done is None else done.unionByName(closed)
        asks = state.where("not closed").drop("closed")
        if asks.isEmpty():
            break
    return done


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, factor: float = 256.0, id: str = "vec_id", vector: str = "embedding", group: int = GROUP, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors and positives.

    A negative's score is at least low and at most high hundredths of the positive's.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), is_anchor.alias("anchor"), label.cast("long").alias("label"), F.when(whole(F.col(vector)), F.col(vector)).alias("x"))
    rows = rows.where("x is not null and id is not null and label is not null").select("id", "anchor", "label", scaled(F.col("x"), factor).alias("v"))
    rows = materialize(rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), "vectors")
    about = rows.agg(F.max(F.size("v")), F.max("length"), F.count_if("anchor")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not about[2]:
        return df.sparkSession.createDataFrame([], schema)
    width = max(1, about[0])
    energy = np.zeros(width)
    for i, x in rows.select("v").mapInArrow(_energy(width), "i long, x double").groupBy("i").agg(F.sum("x")).collect():  # a number a dimension
        energy[i] = x
    order = np.argsort(-energy, kind="stable")
    groups = _blocks(rows.drop("anchor"), group, width, order)
    packed = _blocks(rows.where("anchor").drop("anchor"), block, width, order).drop("g", "longest")
    lengths = packed.mapInArrow(_lengths(width), "query long, norm double")
    asks = materialize(lengths.select("query", F.lit(0).cast("long").alias("slot"), F.lit(LOWEST).alias("floor"), F.lit(_HIGHEST).alias("high"), "norm"), "asks")
    first = [F.ceil(F.col("norm") * (share * about[1])).cast("long") for share in FIRST]
    liked = fill(asks, first, packed, groups, width, positives, True)
    liked = materialize(liked.select("query", F.col("rank").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Windows in integers: whole hundreds and the rest of the positive's score, rounded inwards.
    hundreds, rest = F.floor(F.col("positive_score") / F.lit(100).cast("decimal(3,0)")).cast("long"), F.pmod("positive_score", F.lit(100).cast("long"))
    windows = liked.where("positive_score >= 0").select("query", "slot", (hundreds * low + F.ceil(rest * low / 100)).cast("long").alias("floor"), (hundreds * high + F.floor(rest * high / 100)).cast("long").alias("high"))
    below = [F.ceil(F.col("high") * share).cast("long") for share in BELOW]
    found = fill(materialize(windows, "windows"), below, packed, groups, width, negatives, False)
    out = found.join(liked, ["query", "slot"])
    return out.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _lengths(width: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                norm = np.linalg.norm(_unpacked(r["vectors"], r["size"], width).astype(np.float64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(norm)) + (r["block"] << 20)), pa.array(norm)], ["query", "norm"])

    return apply
