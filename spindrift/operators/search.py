"""Literal and vector search, neighbours, ranking."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_literally
from ..functions.vector import cosine_similarity, doubles, norm
from ..shared import stored
from .neighbors import Index

BLOCK = 2048
BUCKETS = 64
"""Buckets of trigrams."""
CHARS = 4 << 20
"""Characters of texts, about, of which a task collects the trigrams at once."""


def literal_search(df: DataFrame, columns: Sequence[str], query: str, predicate: str | None = None, limit: int = 100, tie: str = "row_index") -> DataFrame:
    found = df.where(contains_literally([F.col(c) for c in columns], query))
    return (found.where(F.expr(predicate)) if predicate else found).orderBy(tie).limit(limit)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigram, bucket, ids): a trigram's rows among about CHARS characters of texts."""

    def packed(codes: list[np.ndarray], ids: list[pa.Array]) -> pa.RecordBatch:
        code, row = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        points = np.stack([code[first] >> 42, code[first] >> 21 & 0x1FFFFF, code[first] & 0x1FFFFF], axis=1).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        found = [text[i : i + 3] for i in range(0, len(text), 3)]
        every = pa.concat_arrays(ids).take(pa.array(row))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), every)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([zlib.crc32(x.encode()) % BUCKETS for x in found], pa.int32()), lists], ["trigram", "bucket", "ids"])

    codes, ids, n = [], [], 0
    for batch in batches:
        column = batch.column("id")
        for i, texts in enumerate(batch.column("texts").to_pylist()):
            points = [np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64) for t in texts]
            code = [p[:-2] << 42 | p[1:-1] << 21 | p[2:] for p in points if len(p) > 2]
            if code:
                codes.append(np.unique(np.concatenate(code)))
                ids.append(column.slice(i, 1))
                n += sum(map(len, code))
            if n >= CHARS:
                yield packed(codes, ids)
                codes, ids, n = [], [], 0
    if codes:
        yield packed(codes, ids)


class TrigramIndex:
    """Rows by the runs of three characters in their lower-cased texts, so that a literal search reads few of them.

    Tasks collect the rows of each trigram before these are dealt out. Postings are stored by buckets of trigrams; a search
    reads the buckets of its own. Ids are unique.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], id: str = "row_index") -> None:
        self.df, self.columns, self.id = df, list(columns), id
        texts = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
        found = df.select(F.col(id).alias("id"), texts.alias("texts")).mapInArrow(_trigrams, f"trigram string, bucket int, ids array<{dict(df.dtypes)[id]}>")
        # Rows are few and hold many ids, so Spark cuts large buckets and joins small ones by their bytes.
        self.postings = stored(found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "trigram"), "trigrams", "bucket")

    def candidates(self, query: str) -> DataFrame | None:
        """(id) of the rows that have all trigrams of the query; None if it has none."""
        q = query.lower()
        wanted = sorted({q[i : i + 3] for i in range(len(q) - 2)})
        if not wanted:
            return None
        buckets = sorted({zlib.crc32(x.encode()) % BUCKETS for x in wanted})
        met = self.postings.where(F.col("bucket").isin(buckets) & F.col("trigram").isin(wanted)).select(F.explode("ids").alias("id"))
        return met.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= len(wanted)).select(F.col("id").alias(self.id))

    def search(self, query: str, predicate: str | None = None, limit: int = 100) -> DataFrame:
        """The rows of literal_search; queries of less than three characters read all rows."""
        some = self.candidates(query)
        return literal_search(self.df if some is None else self.df.join(some, self.id, "left_semi"), self.columns, query, predicate, limit, self.id)


def vector_search(df: DataFrame, query: Sequence[float], id: str = "vec_id", vector: str = "embedding", least: float = 0.5, limit: int = 100, predicate: str | None = None) -> DataFrame:
    """(id, similarity) of the rows most similar to a query vector, above a least similarity."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = (df.where(F.expr(predicate)) if predicate else df).select(id, cosine_similarity(doubles(F.col(vector)), q).alias("similarity"))
    return scored.where(F.col("similarity") > least).orderBy(F.col("similarity").desc(), id).limit(limit)


def nearest_neighbors(df: DataFrame, target, id: str = "vec_id", vector: str = "embedding", k: int = 20, least: float = 0.0) -> DataFrame:
    """(id, similarity) of the rows nearest to the row with id target."""
    one = df.where(F.col(id) == target).limit(1).select(doubles(F.col(vector)).alias("__q"))
    scored = df.where(F.col(id) != target).join(F.broadcast(one)).select(id, cosine_similarity(doubles(F.col(vector)), F.col("__q")).alias("similarity"))
    return scored.where(F.col("similarity") > least).orderBy(F.col("similarity").desc(), id).limit(k)


def ranked(df: DataFrame, query: Sequence[float], id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All rows by similarity to a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(id, cosine_similarity(doubles(F.col(vector)), q).alias("similarity")).where("similarity is not null").orderBy(F.col("similarity").desc(), id)


def knn(df: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, neighbor_id, distance, rank): the k nearest other rows by cosine distance, ties by smaller id.

    Equal vectors are one entry of a pivot index (neighbors.Index), with their k + 1 smallest ids, so copies cost no
    more than one row until the result. Rows without length are at distance 1 from all and are answered by the smallest
    ids; vectors that are null or not finite are nobody's neighbours and have none.
    """
    length = norm(F.col("v"))
    rows = df.select(F.col(id).cast("long").alias("id"), doubles(F.col(vector)).alias("v")).where("v is not null and id is not null")
    rows = stored(rows.where(~F.isnan(length) & (length < float("inf"))).withColumn("flat", length == 0), "vectors")
    first = F.row_number().over(W.partitionBy("v").orderBy("id"))
    classes = rows.select("id", "v").withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = stored(classes.select(F.col("ids")[0].alias("rep"), "v", "ids"), "classes")
    own = stored(rows.join(classes.select(F.col("v").alias("w"), "rep"), F.col("v") == F.col("w")).select("id", "rep", "flat"), "rows")
    near = Index(classes.select(F.col("rep").alias("id"), "v"), True, block).knn(k).select(F.col("id").alias("of"), F.col("neighbor_id").alias("rep"), "distance")
    ids = classes.select("rep", "ids")
    others = near.join(ids, "rep").select("of", F.explode("ids").alias("neighbor_id"), "distance")
    # A row's nearest are its copies and the nearest of other classes; those of a class are ranked once.
    best = F.row_number().over(W.partitionBy("of").orderBy("distance", "neighbor_id"))
    ranked = others.withColumn("n", best).where(F.col("n") <= k).groupBy("of").agg(F.collect_list(F.struct("distance", "neighbor_id")).alias("near"))
    lists = stored(ids.join(ranked, F.col("rep") == F.col("of"), "left").select(F.col("rep").alias("class"), "ids", F.coalesce("near", F.array().cast("array<struct<distance:double,neighbor_id:bigint>>")).alias("near")), "lists")
    of_rows = own.where("not flat").join(lists, F.col("rep") == F.col("class"))
    copies = F.transform(F.filter("ids", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(0.0).alias("distance"), x.alias("neighbor_id")))
    # Rows without length are as far from all: their nearest are the smallest ids.
    smallest = rows.select("id").orderBy("id").limit(k + 1).agg(F.collect_list("id").alias("ids"))
    flat = own.where("flat").select("id").join(F.broadcast(smallest))  # one row
    even = F.transform(F.filter("ids", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(1.0).alias("distance"), x.alias("neighbor_id")))
    every = of_rows.select("id", F.concat(copies, "near").alias("x")).unionByName(flat.select("id", even.alias("x")))
    taken = every.select("id", F.posexplode(F.slice(F.array_sort("x"), 1, k)).alias("n", "x"))
    return taken.select(F.col("id").alias(id), F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"), (F.col("n") + 1).alias("rank"))


def links_within(df: DataFrame, reach: float, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, neighbor_id, distance): links that connect the same rows as all pairs at most reach apart do.

    Ids differ; vectors that are null or not finite have no links.
    """
    length = norm(F.col("v"))
    rows = df.select(F.col(id).cast("long").alias("id"), doubles(F.col(vector)).alias("v")).where("v is not null")
    rows = stored(rows.where(~F.isnan(length) & (length < float("inf"))), "vectors")
    return Index(rows, True, block).links(reach).withColumnRenamed("id", id)


def points_view(points: DataFrame) -> DataFrame:
    return points.withColumn("x", F.try_element_at("coordinates_2d", F.lit(1))).withColumn("y", F.try_element_at("coordinates_2d", F.lit(2)))


def cluster_label(cluster: Column) -> Column:
    return F.when(cluster == -1, F.lit("Noise")).otherwise(F.concat(F.lit("Cluster "), cluster.cast("string")))


def vector_length(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("length", norm(doubles(F.col(vector))))
