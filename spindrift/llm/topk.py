"""Exact top-k inner products of integer vectors.

Vectors are dealt to groups by descending length, and packed into blocks by descending length within a group. Queries meet
the groups in passes, each of twice as many groups as the one before; after each pass their k-th scores rise, and groups
whose longest vector can't reach them are left out. One task holds a group and a block of queries: it walks the group's
blocks by descending length, raises the k-th scores as it goes and stops where length times length falls below all of
them. Within a block, partial sums over the leading directions of an SVD rotation, with a Cauchy-Schwarz bound on the rest,
leave out pairs that can't reach the k-th score; the others are scored exactly. A task returns k rows a query at most, and
none below the k-th score.

Defined results: vectors that are null, or hold null or non-finite components, take no part; shorter vectors are padded
with zeros, so empty ones score 0; equal scores rank by smaller id; with fewer candidates than k a query has that many
rows. A row isn't a candidate of queries that have its own id; query rows that share an id are ranked each for itself.
Scaled components and scores past the range of a long are cut to it, and rank as such; all others are exact.
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

GROUP = 16384
"""Candidates of a group, about."""
BLOCK = 4096
"""Candidates of a block."""
QUERIES = 8192
"""Queries of a block, about."""
SLICE = 256
"""Queries that are scored at once."""
LEADING = 0.25
"""Share of the rotated directions that the first partial sums take."""
LOWEST = -(2**63)
"""Stands for no score; scores are cut just above it."""


def scaled(vector: Column, factor: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long"))


def whole(vector: Column) -> Column:
    """Whether all components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    """The bytes of a matrix in the smallest integers that hold it, and the bytes of one of them."""
    size = next(n for n in (1, 2, 4, 8) if _largest(x) < 2 ** (8 * n - 1) or n == 8)
    return x.astype(f"i{size}").tobytes(), size


def _unpacked(data: bytes, size: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"i{size}").astype(np.int64).reshape(-1, width)


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first, from sums of products gathered by Spark (width**2 numbers)."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(np.float64)
            total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], ["i", "j", "x"])

    gram = np.zeros((width, width))
    for i, j, x in vectors.select("v").mapInArrow(products, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        gram[i, j] = x
    scale = np.abs(gram).max()
    return np.linalg.svd(gram / scale if scale > 0 else gram)[0]


def blocks(vectors: DataFrame, width: int, rows: int, group: int) -> DataFrame:
    """(g, block, longest, ids, vectors, size): vectors (id, v, length) dealt to groups and blocks by descending length.

    Blocks are stored. Groups are made of whole range partitions, by how many vectors come before one, so that there are
    about as many groups as their size asks for, whatever the number of partitions.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(x: pa.Table) -> pa.RecordBatch:
            nonlocal number
            x = x.combine_chunks()
            number += 1
            data, size = _packed(_matrix(x.column("v").chunk(0), width))
            cells = [part, (part << 20) + number, x.num_rows, x.column("length")[0].as_py(), x.column("id").to_numpy().astype(np.int64).tobytes(), data, size]
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int32()
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], ["part", "block", "n", "longest", "ids", "vectors", "size"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in held) >= rows:
                joined = pa.concat_tables(held)
                yield block(joined.slice(0, rows))
                held = [joined.slice(rows)]
        if sum(t.num_rows for t in held):
            yield block(pa.concat_tables(held))

    parts = max(1, -(-vectors.count() // group))
    ranged = vectors.repartitionByRange(parts, F.col("length").desc(), "id").sortWithinPartitions(F.col("length").desc(), "id")
    packed = materialize(ranged.mapInArrow(pack, "part long, block long, n long, longest double, ids binary, vectors binary, size int"), "blocks")
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = packed.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.floor(before / group).cast("long").alias("g"))
    return packed.drop("n").join(F.broadcast(parts), "part").drop("part")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of q with all of c, cut to the range of a long."""
    bound = q.shape[1] * _largest(q) * _largest(c)
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, LOWEST + 1, 2**63 - 1).astype(np.int64)


def pair_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of q with those of c, row by row, cut to the range of a long."""
    bound = q.shape[1] * _largest(q) * _largest(c)
    if bound < 2**63:
        return np.einsum("ij,ij->i", q, c)
    return np.clip((q.astype(object) * c.astype(object)).sum(axis=1), LOWEST + 1, 2**63 - 1).astype(np.int64)


def score(q: np.ndarray, c: np.ndarray, kth: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and c; LOWEST where they surely stay below kth."""
    if (kth == LOWEST).all():
        return products(q, c)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    n = max(1, round(LEADING * q.shape[1]))
    qr, cr = qf @ turn, cf @ turn
    rest = np.outer(np.linalg.norm(qr[:, n:], axis=1), np.linalg.norm(cr[:, n:], axis=1))
    slack = 1e-9 * np.outer(np.linalg.norm(qf, axis=1), np.linalg.norm(cf, axis=1)) + 1e-6
    hopeful = qr[:, :n] @ cr[:, :n].T + rest + slack >= kth[:, None]
    if hopeful.mean() > 0.1:
        return np.where(hopeful, products(q, c), LOWEST)
    out = np.full(hopeful.shape, LOWEST)
    i, j = np.nonzero(hopeful)
    for s in range(0, len(i), 1 << 16):
        at = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        out[at] = pair_products(q[at[0]], c[at[1]])
    return out


def walk(q: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, candidates: list[tuple[float, np.ndarray, np.ndarray]], k: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of each query's k best of the candidates, those below its k-th score left out.

    candidates holds the blocks by descending length, each with its greatest length, ids and vectors.
    """
    kth, length = kth.copy(), np.linalg.norm(q.astype(np.float64), axis=1)
    top = [np.zeros(0, np.int64) for _ in range(3)]
    for longest, ids, c in candidates:
        open_ = np.flatnonzero((kth <= 0) | (length * longest * (1 + 1e-9) >= kth))
        if not len(open_):
            break
        found = [top]
        for s in range(0, len(open_), SLICE):
            at = open_[s : s + SLICE]
            scores = score(q[at], c, kth[at], turn)
            scores[q_ids[at, None] == ids[None, :]] = LOWEST
            least = np.maximum(kth[at], np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else LOWEST)
            i, j = np.nonzero((scores >= least[:, None]) & (scores > LOWEST))
            found.append([at[i], ids[j], scores[i, j]])
        of, ids_, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids_, ~scores, of))
        of, ids_, scores = of[order], ids_[order], scores[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        last = place == k - 1
        kth[of[last]] = np.maximum(kth[of[last]], scores[last])
        top = [x[place < k] for x in (of, ids_, scores)]
    enough = top[2] >= kth[top[0]]
    return top[0][enough], top[1][enough], top[2][enough]


def _search(width: int, k: int, block: int, turn: np.ndarray):
    def joined(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """The ids and vectors of some blocks."""
        return np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows]), np.concatenate([_unpacked(r["vectors"], r["size"], width) for r in rows])

    def apply(c: pa.Table, q: pa.Table) -> pa.Table:
        names, cells = ["query", "query_id", "vec_id", "score"], [np.zeros(0, np.int64)] * 4
        if c.num_rows and q.num_rows:
            # Neighbouring blocks that range partitions have left small are walked as one.
            runs, room = [], 0
            for r in sorted(c.to_pylist(), key=lambda r: (-r["longest"], r["block"])):
                n = len(r["ids"]) // 8
                if n > room:
                    runs.append([])
                    room = block
                runs[-1].append(r)
                room -= n
            candidates = [(run[0]["longest"], *joined(run)) for run in runs]
            rows = q.to_pylist()
            ids, vectors = joined(rows)
            number = np.concatenate([np.arange(len(r["ids"]) // 8) + (r["q_block"] << 20) for r in rows])
            at, vec, scores = walk(vectors, ids, np.concatenate([np.frombuffer(r["kth"], np.int64) for r in rows]), candidates, k, turn)
            cells = [number[at], ids[at], vec, scores]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, cells, strict=True)})

    return apply


def inner_top_k(df: DataFrame, is_query: Column, k: int = 20, factor: float = 64.0, id: str = "vec_id", vector: str = "embedding", group: int = GROUP, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all other rows."""
    rows = df.select(F.col(id).cast("long").alias("id"), is_query.alias("q"), F.when(whole(F.col(vector)), F.col(vector)).alias("x")).where("x is not null and id is not null")
    rows = rows.select("id", "q", scaled(F.col("x"), factor).alias("v"))
    rows = materialize(rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    turn = rotation(rows, width)
    c = blocks(rows.select("id", "v", "length"), width, block, group)
    # Numbers of a query: its block's, then its place in the block.
    q = blocks(rows.where("q").select("id", "v", "length"), width, queries, queries).select(F.col("g").alias("s"), F.col("block").alias("q_block"), "ids", "vectors", "size")
    groups = materialize(c.groupBy("g").agg(F.max("longest").alias("longest")), "groups")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                vectors = _unpacked(r["vectors"], r["size"], width)
                kth = np.full(len(vectors), LOWEST)
                for x in r["reached"] or ():
                    kth[x["place"]] = x["kth"]
                length = np.linalg.norm(vectors.astype(np.float64), axis=1)
                least = np.where(kth > 0, kth / np.maximum(length, 1e-300), -np.inf).min()
                cells = [pa.array([r["s"]], pa.int64()), pa.array([r["q_block"]], pa.int64()), pa.array([float(least)]), pa.array([kth.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["s", "q_block", "least", "kth"])

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    schema = "query long, query_id long, vec_id long, score long"
    top, start, end = df.sparkSession.createDataFrame([], schema), 0, groups.agg(F.max("g")).first()[0] + 1
    while start < end:
        reached = top.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        of_block = reached.groupBy(F.shiftright("query", 20).alias("q_block")).agg(F.collect_list(F.struct(F.col("query").bitwiseAND(2**20 - 1).alias("place"), "kth")).alias("reached"))
        bound = materialize(q.join(of_block, "q_block", "left").select("s", "q_block", "vectors", "size", "reached").mapInArrow(bounds, "s long, q_block long, least double, kth binary"), "bounds")
        own = groups.where((F.col("g") >= start) & (F.col("g") < 2 * start + 1))
        least = bound.groupBy("s").agg(F.min("least").alias("least"))
        pairs = materialize(own.join(least, F.col("longest") * (1 + 1e-9) >= F.col("least")).select("g", "s"), "pairs")
        asked = pairs.toDF("of_g", "of_s").join(q.join(bound.select("q_block", "kth"), "q_block"), F.col("of_s") == F.col("s"))
        sides = pairs.join(c, "g").groupBy("g", "s"), asked.groupBy("of_g", "of_s")
        found = sides[0].cogroup(sides[1]).applyInArrow(_search(width, k, block, turn), schema)
        top = materialize(top.union(found).withColumn("rank", rank).where(F.col("rank") <= k).select("query", "query_id", "vec_id", "score"), "top")
        start = 2 * start + 1
    return top.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
