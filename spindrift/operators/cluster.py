"""Density clusters of vectors on their nearest-neighbour graph, and cluster statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import doubles, norm
from ..shared import stored
from .graph import components
from .neighbors import Index
from .search import cluster_label, links_within

MIN_SIZE = 10
MIN_SAMPLES = 5
# Colours of clusters, in order.
PALETTE = [
    "#3b82f6",
    "#ef4444",
    "#22c55e",
    "#f59e0b",
    "#8b5cf6",
    "#06b6d4",
    "#ec4899",
    "#84cc16",
    "#f97316",
    "#6366f1",
    "#14b8a6",
    "#a855f7",
    "#eab308",
    "#0ea5e9",
    "#d946ef",
    "#10b981",
]
NOISE_COLOUR = "#9ca3af"


def density_clusters(df: DataFrame, id: str = "vec_id", vector: str = "embedding", min_size: int = MIN_SIZE, min_samples: int = MIN_SAMPLES, quantile: float = 0.9) -> DataFrame:
    """(id, cluster_id): components of neighbours within reach of each other, largest first; -1 is noise.

    A row's core distance is that to its min_samples-th neighbour; two rows are linked if the larger of their distance
    and core distances is at most the given quantile of all core distances. Components of less than min_size rows are
    noise. Equal vectors are one class with a count. Neighbours and links come from pivot indexes (neighbors.Index).
    """
    every = df.select(F.col(id).cast("long").alias("id"), doubles(F.col(vector)).alias("v")).where("id is not null")
    ids = every.select("id").distinct()
    classes = every.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))
    classes = stored(classes, "classes")
    rows = stored(every.join(classes, "v").select("id", "rep").distinct(), "rows")
    # Vectors that aren't finite are near nothing.
    length = norm(F.col("v"))
    finite = classes.where(~F.isnan(length) & (length < float("inf")))
    near = Index(finite.select(F.col("rep").alias("id"), "v")).knn(min_samples).withColumnRenamed("id", "rep")
    near = near.join(classes.select(F.col("rep").alias("neighbor_id"), "copies"), "neighbor_id").select("rep", "distance", "copies")
    # Copies are at distance 0 of each other, or 1 if they have no length.
    own = finite.where(F.col("copies") > 1).select("rep", F.when(length > 0, 0.0).otherwise(1.0).alias("distance"), (F.col("copies") - 1).alias("copies"))
    within = F.sum("copies").over(W.partitionBy("rep").orderBy("distance"))
    core = near.union(own).withColumn("within", within).where(F.col("within") >= min_samples).groupBy("rep").agg(F.min("distance").alias("core"))
    core = stored(core, "core")
    reach = rows.join(core, "rep").agg(F.percentile_approx("core", quantile, 10000)).first()[0]
    dense = core.where(F.col("core") <= F.lit(reach)).select(F.col("rep").alias("id"))
    met = classes.join(dense, F.col("rep") == F.col("id"), "left_semi")
    links = links_within(met, -1.0 if reach is None else reach, "rep", "v")
    parts = components(links.select(F.col("rep").alias("a"), F.col("neighbor_id").alias("b")))
    label = dense.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    label = rows.join(label.withColumnRenamed("id", "rep"), "rep").select("id", "label")
    sizes = label.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    named = sizes.withColumn("cluster_id", F.row_number().over(W.orderBy(F.col("n").desc(), "label")) - 1)
    return ids.join(label, "id", "left").join(named, "label", "left").select(F.col("id").alias(id), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n")).withColumn("name", cluster_label(F.col(cluster)))


def cluster_stats(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Clusters, noise rows and their percentage; 0 % of no rows."""
    noise, rows = F.count_if(F.col(cluster) == -1), F.count("*")
    return df.agg(F.countDistinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("clusters"), noise.alias("noise"), F.coalesce(F.try_divide(noise * 100.0, rows), F.lit(0.0)).alias("noise_percent"))


def largest(df: DataFrame, cluster: str = "cluster_id", k: int = 5) -> DataFrame:
    """The k largest clusters, noise aside."""
    return cluster_sizes(df.where(F.col(cluster) != -1), cluster).orderBy(F.col("n").desc(), cluster).limit(k)


def colour(cluster: int) -> str:
    return NOISE_COLOUR if cluster < 0 else PALETTE[cluster % len(PALETTE)]
