"""Hierarchical density clusters (HDBSCAN) as tables.

1. Equal vectors are one vertex with its number of copies. A vertex's core distance is that to its min_samples-th other
   row; two vertices are as far apart as the largest of their distance and core distances.
2. A minimum spanning tree is built by Boruvka's rounds: each component takes its least edge to another. An upper bound comes
   from edges to near neighbours and to the pivots of the index; only rows whose known neighbours don't decide it search,
   and only in rings within that bound (neighbors.Index).
3. The tree's edges are merged by ascending weight, a bucket of edges at a time; within a bucket, each connected part is one
   task's. Components of at least min_size rows are clusters; where two of them meet they end and a new one begins. A
   cluster's stability is the sum over its rows of 1 / (distance at which the row leaves) - 1 / (distance at which the
   cluster ends), and a cluster is chosen if its stability is above 0 and not below the best choice within it.
4. A row belongs to the largest chosen cluster around the cluster that it left last; rows that have none are noise.

Merges at equal distances count as one, so the labels don't depend on the order of ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import doubles, norm
from ..shared import discard, stored
from .cluster import MIN_SAMPLES, MIN_SIZE
from .graph import components
from .neighbors import DIGITS, Asking, Index, Metric, _array, _batch
from .table import with_row_index

BUCKET = 1 << 18
"""Edges of a bucket, about; more only where so many edges are of one weight."""
LISTED = 15
"""Near neighbours that are known of each vertex, at least; they decide most of its least edges."""
LEAST = 10.0**-DIGITS
"""Distances below it count as it where one is divided by them."""
_EDGE = "component long, weight double, low long, high long"


def vertices(df: DataFrame, id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rep, v, copies) of the different finite vectors, and (id, rep) of their rows; both stored."""
    length = norm(F.col("v"))
    rows = df.select(F.col(id).cast("long").alias("id"), doubles(F.col(vector)).alias("v")).where("id is not null and v is not null")
    rows = stored(rows.where(~F.isnan(length) & (length < float("inf"))).dropDuplicates(["id"]), "vectors")
    found = stored(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vertices")
    return found, stored(rows.join(found.select(F.col("v").alias("w"), "rep"), F.col("v") == F.col("w")).select("id", "rep"), "rows")


def core_distances(found: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """(rep, core): near is each vertex's nearest others, min_samples or more. Infinite where there are too few rows."""
    lists = near.join(found.select(F.col("rep").alias("neighbor_id"), "copies"), "neighbor_id").groupBy(F.col("id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("distance", "copies"))).alias("near"))
    start = F.struct((F.col("copies") - 1).alias("n"), F.when(F.col("copies") > min_samples, 0.0).otherwise(float("inf")).alias("core"))
    step = lambda s, x: F.struct((s["n"] + x["copies"]).alias("n"), F.when(s["n"] >= min_samples, s["core"]).when(s["n"] + x["copies"] >= min_samples, x["distance"]).otherwise(float("inf")).alias("core"))
    return found.join(lists, F.col("rep") == F.col("of"), "left").select("rep", F.when(F.col("near").isNull(), start["core"]).otherwise(F.aggregate("near", start, step)["core"]).alias("core"))


def _least(edges: DataFrame) -> DataFrame:
    """The least edge of each component, ties by the smaller ends."""
    best = edges.groupBy("component").agg(F.min(F.struct("weight", "low", "high")).alias("e"))
    return best.select("component", "e.weight", "e.low", "e.high")


def _columns(component, weight, low, high) -> dict[str, np.ndarray]:
    """Of edges (a row's component, weight, ends) the least of each component."""
    order = np.lexsort((high, low, weight, component))
    first = order[np.r_[True, component[order][1:] != component[order][:-1]]] if len(order) else order
    return {"component": component[first], "weight": weight[first], "low": low[first], "high": high[first]}


def _packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """(of, names ...): arrays of a block's rows (block, place, names ...) by place."""
    x = F.array_sort(F.collect_list(F.struct("place", *names)))
    return rows.groupBy(F.col("block").alias("of")).agg(x.alias("x")).select("of", *[F.col(f"x.{n}").alias(n) for n in names])


def least_edges(metric: Metric, blocks: list[dict]):
    """For Index.meet: the least edge of each component of the blocks' rows to rows of others, by the blocks that they meet.

    A component's bound falls to the least edge found so far.
    """
    asking = Asking(metric, blocks, component=np.int64, core=np.float64)
    own, cores = asking.more["component"], asking.more["core"]
    names, code = np.unique(own, return_inverse=True)
    best = np.full(len(names), np.inf)
    kept = [_columns(own[:0], cores[:0], own[:0], own[:0])]

    def step(b: dict, of: list[int]) -> None:
        rows = asking.rows(of)
        if not len(rows):
            return
        ids, others, other_cores, y = _array(b["ids"], np.int64), np.array(b["component"], np.int64), np.array(b["core"], np.float64), _array(b["vectors"]).reshape(-1, metric.width)
        # Rows of the component that most of the block is of meet only the others there.
        found, n = np.unique(others, return_counts=True)
        most = found[n.argmax()]
        inside = own[rows] == most
        for part, columns in ((rows[inside], np.flatnonzero(others != most)), (rows[~inside], np.arange(len(ids)))):
            for row, column, d in asking.within(part, y[columns]):
                column = columns[column]
                w = np.maximum(d, np.maximum(cores[row], other_cores[column]))
                ok = np.flatnonzero((own[row] != others[column]) & (w <= asking.bound[row]))
                row, column, w = row[ok], column[ok], w[ok]
                kept.append(_columns(own[row], w, np.minimum(asking.ids[row], ids[column]), np.maximum(asking.ids[row], ids[column])))
                np.minimum.at(best, code[row], w)
        np.minimum(asking.bound, best[code], out=asking.bound)
        if sum(len(x["weight"]) for x in kept) > 1 << 18 and len(kept) > 64:
            kept[:] = [end()]

    def end() -> dict[str, np.ndarray]:
        return _columns(*(np.concatenate([x[c] for x in kept]) for c in ("component", "weight", "low", "high")))

    return step, end


def spanning_tree(index: Index, near: DataFrame, core: DataFrame) -> DataFrame:
    """(weight, low, high), stored: a minimum spanning tree of the vertices (rep, core); near: (id, neighbor_id, distance, rank)."""
    metric, pivots, pivot_ids = index.metric, index.pivots, index.pivot_ids
    chosen_ids = core.sparkSession.createDataFrame([(p,) for p in pivot_ids.tolist()], "id long")
    last = near.groupBy(F.col("id").alias("of")).agg(F.max("distance").alias("last"))
    static = stored(index.members.join(core, F.col("id") == F.col("rep")).join(last, F.col("id") == F.col("of"), "left").select("block", "place", "id", "core", F.coalesce("last", F.lit(float("inf"))).alias("last")), "static")
    cores = static.select("id", "core")
    known = near.join(cores, "id").join(cores.toDF("neighbor_id", "other"), "neighbor_id")
    known = stored(known.select(F.greatest("core", "other", "distance").alias("weight"), F.least("id", "neighbor_id").alias("low"), F.greatest("id", "neighbor_id").alias("high")).distinct(), "near-edges")
    label = stored(cores.select("id", F.col("id").alias("component")), "components")
    tree: list[DataFrame] = []

    while True:
        a, b = label.toDF("low", "component"), label.toDF("high", "other")
        crossing = known.join(a, "low").join(b, "high").where("component <> other")
        both = crossing.select("component", "weight", "low", "high").unionByName(crossing.select(F.col("other").alias("component"), "weight", "low", "high"))
        # Edges to the pivots bound what a component needs; a number and a label for each pivot.
        of_pivot = {r["id"]: (r["component"], r["core"]) for r in label.join(cores, "id").join(chosen_ids, "id", "left_semi").collect()}
        marks, pivot_cores = (np.array([of_pivot[p][i] for p in pivot_ids.tolist()], t) for i, t in ((0, np.int64), (1, np.float64)))

        def to_pivots(batches: Iterator[pa.RecordBatch], marks=marks, pivot_cores=pivot_cores) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids, own, c = _array(r["ids"], np.int64), np.array(r["component"], np.int64), np.array(r["core"], np.float64)
                    w = np.maximum(metric.distances(_array(r["vectors"]).reshape(-1, metric.width), pivots), np.maximum(c[:, None], pivot_cores))
                    w[own[:, None] == marks] = np.inf
                    k = w.argmin(axis=1)
                    other, weight = pivot_ids[k], w[np.arange(len(ids)), k]
                    for side in (own, marks[k]):
                        ok = np.isfinite(weight)
                        yield _batch(**_columns(side[ok], weight[ok], np.minimum(ids, other)[ok], np.maximum(ids, other)[ok]))

        now = static.join(label, "id")
        held = stored(_packed(now, ["component", "core"]), "packed")
        blocks = index.blocks.join(held, F.col("block") == F.col("of")).select("block", "ids", "vectors", "component", "core")
        upper = stored(_least(both.unionByName(blocks.mapInArrow(to_pivots, _EDGE))), "upper")
        if upper.isEmpty():
            break

        # Rows search whose known neighbours don't reach as far as their component's bound.
        bound = now.join(upper.select("component", "weight"), "component", "left").withColumn("weight", F.coalesce("weight", F.lit(float("inf"))))
        # Without a bound yet, a row looks everywhere; cores above the bound can't give a lesser edge.
        bound = bound.withColumn("bound", F.when((F.col("last") <= F.col("weight")) & (F.col("core") <= F.col("weight")), F.col("weight")).otherwise(-1.0))
        searching = _packed(bound, ["bound"])

        def with_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [pa.array([np.array(x, np.float64).tobytes() for x in batch.column("bound").to_pylist()], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("of"), *cells], ["of", "bound"])

        asked = index.blocks.join(held, F.col("block") == F.col("of")).drop("of").join(searching.mapInArrow(with_bound, "of long, bound binary"), F.col("block") == F.col("of"))
        asked = stored(asked.select("block", "ids", "vectors", "component", "core", "bound"), "asked")

        pairs = index.pairs(asked, True)
        found = index.meet(pairs, asked, blocks, lambda a: least_edges(metric, a), _EDGE)
        chosen = stored(_least(upper.unionByName(found)), "chosen")
        tree.append(stored(chosen.select("weight", "low", "high").distinct(), "tree"))
        ends = tree[-1].join(a, "low").join(b, "high").select(F.col("component").alias("a"), F.col("other").alias("b"))
        merged = components(ends)
        new = stored(label.join(merged.toDF("component", "to"), "component").select("id", F.col("to").alias("component")), "components")
        for x in (held, upper, asked, pairs, chosen, merged, label):
            discard(x)
        label = new
    out = stored(tree[0] if len(tree) == 1 else _union(tree), "spanning-tree") if tree else stored(known.where("false"), "spanning-tree")
    for x in tree:
        discard(x)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out.distinct()


_MERGED = "kind string, vertex long, to long, cluster string, parent string, distance double, stability double, best double, chosen boolean, size long, ready double, lam double, kids double"
_NAMES = [c.split()[0] for c in _MERGED.split(", ")]


class _Part:
    """A component while edges are merged: rows, when it may be a cluster, its cluster and that one's sums."""

    __slots__ = ("size", "ready", "cluster", "lam", "kids", "vertices")

    def __init__(self, vertex: int, size: int, ready: float, cluster: str | None, lam: float, kids: float) -> None:
        self.size, self.ready, self.cluster, self.lam, self.kids, self.vertices = size, ready, cluster, lam, kids, [vertex]


def _density(distance: float) -> float:
    return 1 / max(distance, LEAST)


def merged(edges: list[tuple[float, int, int]], states: dict[int, tuple], min_size: int, name: str) -> list[dict]:
    """What the edges (distance, vertex, vertex), ascending, make of the vertices they connect.

    Rows of kind `fall`: a vertex leaves its cluster at a distance; `cluster`: a cluster ends; `vertex`: where a vertex is
    now; `state`: what the vertices have become.
    """
    up = {v: v for v in states}
    parts = {v: _Part(v, *s) for v, s in states.items()}
    out: list[dict] = []
    number = 0

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    at = 0
    while at < len(edges):
        end, d = at, edges[at][0]
        while end < len(edges) and edges[end][0] == d:
            end += 1
        groups: dict[int, list[int]] = {}
        for _, u, v in edges[at:end]:
            a, b = root(u), root(v)
            if a != b:
                one, other = groups.pop(a, [a]), groups.pop(b, [b])
                a, b = min(a, b), max(a, b)
                up[b] = a
                groups[a] = one + other
        for new, old in groups.items():
            own = [parts.pop(r) for r in old]
            for p in own:
                if p.cluster is None and p.size >= min_size and p.ready < d:  # copies, enough of them to be a cluster
                    number += 1
                    p.cluster, p.lam = f"{name}-{number}", p.size * _density(p.ready)
                    out += [{"kind": "fall", "vertex": v, "cluster": p.cluster, "distance": p.ready} for v in p.vertices]
                    p.vertices = []
            large, small = [p for p in own if p.cluster is not None], [p for p in own if p.cluster is None]
            whole = _Part(new, sum(p.size for p in own), 0.0, None, 0.0, 0.0)
            if len(large) == 1:
                whole.cluster, whole.lam, whole.kids = large[0].cluster, large[0].lam + sum(p.size for p in small) * _density(d), large[0].kids
            elif large or whole.size >= min_size:
                number += 1
                whole.cluster, whole.lam = f"{name}-{number}", whole.size * _density(d)
                for p in large:
                    stability = p.lam - p.size * _density(d)
                    chosen = stability > 1e-9 * p.lam and stability >= p.kids
                    best = stability if chosen else p.kids
                    whole.kids += best
                    out.append({"kind": "cluster", "cluster": p.cluster, "parent": whole.cluster, "distance": d, "stability": stability, "best": best, "chosen": chosen, "size": p.size})
            fallen = [v for p in small for v in p.vertices]
            if whole.cluster is None:
                whole.vertices = fallen
            else:
                whole.vertices = []
                out += [{"kind": "fall", "vertex": v, "cluster": whole.cluster, "distance": d} for v in fallen]
            parts[new] = whole
        at = end
    for v in states:
        out.append({"kind": "vertex", "vertex": v, "to": root(v)})
    out += [{"kind": "state", "vertex": v, "size": p.size, "ready": p.ready, "cluster": p.cluster, "lam": p.lam, "kids": p.kids} for v, p in parts.items()]
    return out


def _merge(min_size: int, bucket: int):
    def apply(edges: pa.Table, states: pa.Table) -> pa.Table:
        rows = states.to_pylist()
        known = {r["vertex"]: (r["size"], r["ready"], r["cluster"], r["lam"], r["kids"]) for r in rows}
        ordered = sorted(zip(*(edges.column(c).to_pylist() for c in ("weight", "u", "v")), strict=True))
        out = merged(ordered, known, min_size, f"{bucket}-{rows[0]['part']}") if rows else []
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        return pa.table({n: pa.array([r.get(n) for r in out], kinds[c.split()[1]]) for n, c in zip(_NAMES, _MERGED.split(", "), strict=True)})

    return apply


def condensed(tree: DataFrame, found: DataFrame, min_size: int, single: bool, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(rep, cluster, distance) at which vertices leave their last cluster, and (cluster, parent, ..., chosen); both stored.

    found: (rep, copies, core). single: the cluster of all rows may be chosen too.
    """
    n = tree.count()
    cuts = tree.approxQuantile("weight", [i / -(-n // bucket) for i in range(1, -(-n // bucket))], 0.001 if n > bucket else 0.0) if n > bucket else []
    edges = tree.withColumn("bucket", F.lit(0))
    for c in sorted(set(cuts)):
        edges = edges.withColumn("bucket", F.col("bucket") + (F.col("weight") > c).cast("int"))
    edges = stored(edges, "bucketed")
    states = stored(found.select(F.col("rep").alias("vertex"), F.col("copies").alias("size"), F.col("core").alias("ready"), F.lit(None).cast("string").alias("cluster"), F.lit(0.0).alias("lam"), F.lit(0.0).alias("kids")), "states")
    at = stored(found.select("rep", F.col("rep").alias("vertex")), "vertices-now")
    fallen: list[DataFrame] = []
    ended: list[DataFrame] = []
    for b in range(len(set(cuts)) + 1):
        now = edges.where(F.col("bucket") == b).join(at.toDF("low", "u"), "low").join(at.toDF("high", "v"), "high").where("u <> v").select("weight", "u", "v")
        now = stored(now, "bucket")
        if now.isEmpty():
            continue
        parts = components(now.select(F.col("u").alias("a"), F.col("v").alias("b")))
        left = now.join(parts.toDF("u", "part"), "u").groupBy("part")
        right = states.join(parts.toDF("vertex", "part"), "vertex").withColumn("of", F.col("part")).groupBy("of")
        made = stored(left.cogroup(right).applyInArrow(_merge(min_size, b), _MERGED), "merged")
        fall = made.where("kind = 'fall'").select("vertex", "cluster", "distance")
        fallen.append(stored(at.join(fall, "vertex").select("rep", "cluster", "distance"), "fallen"))
        ended.append(made.where("kind = 'cluster'").select("cluster", "parent", "distance", "stability", "best", "chosen", "size"))
        moved = made.where("kind = 'vertex'").select(F.col("vertex").alias("old"), "to")
        old, at = at, stored(at.join(moved, F.col("vertex") == F.col("old"), "left").select("rep", F.coalesce("to", "vertex").alias("vertex")), "vertices-now")
        kept = states.join(moved, F.col("vertex") == F.col("old"), "left_anti")
        before, states = states, stored(kept.unionByName(made.where("kind = 'state'").select("vertex", "size", "ready", "cluster", "lam", "kids")), "states")
        for x in (old, before, now, parts):
            discard(x)
    # Copies of one vector and nothing else.
    alone = states.where((F.col("size") >= min_size) & F.col("cluster").isNull() & (F.col("ready") < float("inf")))
    alone = alone.select("vertex", "size", "ready", F.lit("copies").alias("cluster"), (F.col("size") / F.greatest("ready", F.lit(LEAST))).alias("lam"), "kids")
    fallen.append(at.join(alone, "vertex").select("rep", "cluster", F.col("ready").alias("distance")))
    states = states.where("cluster is not null").unionByName(alone)
    # What is left has no parent: it lasts to any distance.
    whole = states.select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(float("inf")).alias("distance"), F.col("lam").alias("stability"), F.greatest("lam", "kids").alias("best"), (F.lit(single) & (F.col("lam") > 0) & (F.col("lam") >= F.col("kids"))).alias("chosen"), "size")
    clusters, falls = whole, fallen[0]
    for x in ended:
        clusters = clusters.unionByName(x)
    for x in fallen[1:]:
        falls = falls.unionByName(x)
    return stored(falls, "falls"), stored(clusters, "condensed")


def highest_chosen(clusters: DataFrame) -> DataFrame:
    """(cluster, top), stored: the chosen cluster nearest to the root among each one and those around it, null if none is.

    Each round doubles how far up a cluster has looked.
    """
    now = stored(clusters.select("cluster", F.when(F.col("chosen"), F.col("cluster")).alias("top"), F.col("parent").alias("next")), "tops")
    while not now.where("next is not null").isEmpty():
        above = now.select(F.col("cluster").alias("at"), F.col("top").alias("above"), F.col("next").alias("then"))
        new = stored(now.join(above, F.col("next") == F.col("at"), "left").select("cluster", F.coalesce("above", "top").alias("top"), F.col("then").alias("next")), "tops")
        discard(now)
        now = new
    return now.select("cluster", "top")


def hierarchical_clusters(df: DataFrame, id: str = "vec_id", vector: str = "embedding", min_size: int = MIN_SIZE, min_samples: int = MIN_SAMPLES, cosine: bool = False, single: bool = False, block: int = 1024, bucket: int = BUCKET) -> DataFrame:
    """(id, cluster_id) of all different ids: 0 is the largest cluster, ties by the smaller id in it; -1 is noise.

    Null vectors and vectors that aren't finite are noise; rows that share an id are one row, and null ids are left out.
    Distances are straight, or cosine distances. single: one cluster of all rows is a result too.
    """
    ids = df.select(F.col(id).cast("long").alias("id")).where("id is not null").distinct()
    found, rows = vertices(df, id, vector)
    index = Index(found.select(F.col("rep").alias("id"), "v"), cosine, block)
    near = stored(index.knn(max(LISTED, 3 * min_samples)), "near")
    core = stored(core_distances(found, near, min_samples), "cores")
    tree = spanning_tree(index, near, core)
    falls, clusters = condensed(tree, found.select("rep", "copies").join(core, "rep"), min_size, single, bucket)
    tops = highest_chosen(clusters)
    ends = clusters.select("cluster", F.col("distance").alias("ends"), "parent")
    # A row that leaves where its cluster ends was never within it.
    last = falls.join(ends, "cluster").select("rep", F.when(F.col("distance") < F.col("ends"), F.col("cluster")).otherwise(F.col("parent")).alias("cluster"))
    named = rows.join(last.join(tops, "cluster").select("rep", "top"), "rep").where("top is not null").select("id", "top")
    sizes = named.groupBy("top").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = with_row_index(sizes, [F.col("n").desc(), F.col("first")], "cluster_id").select("top", "cluster_id")
    out = ids.join(named, "id", "left").join(order, "top", "left").select(F.col("id").alias(id), F.coalesce(F.col("cluster_id").cast("long"), F.lit(-1).cast("long")).alias("cluster_id"))
    out = stored(out, "clusters")
    for x in (found, rows, index.blocks, near, core, tree, falls, clusters):
        discard(x)
    return out
