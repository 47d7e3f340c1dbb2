"""Embedding layers: compose, embed, reduce, cluster, find neighbours, and join with the file's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embeddable
from ..operators.augment import embedded
from ..operators.hierarchy import hierarchical_clusters
from ..operators.manifold import layout
from ..operators.reduce import pca
from ..operators.search import cluster_label, knn, points_view
from ..operators.table import RESERVED, display, with_row_index
from ..shared import stored


def build_layer(points: DataFrame, provider, k: int = 10, min_size: int = 10, min_samples: int = 5, reduction: str = "neighbours") -> DataFrame:
    """Points (point_no, label, composed_text, source_row_indices) with embedding, coordinates_2d, cluster_id and neighbors.

    reduction: by the neighbour graph, to 15 dimensions in tight groups for clusters and to a plane; or by principal
    axes ("axes").
    """
    vectors = embedded(points.withColumn("composed_text", embeddable(F.col("composed_text"))), "composed_text", provider)
    if reduction == "axes":
        flat = pca(pca(vectors, 15, "embedding", "coordinates"), 2, "embedding", "coordinates_2d")
    else:
        vectors = stored(vectors, "embedded")
        flat = vectors.join(layout(vectors, 15, 30, 0.001, "point_no"), "point_no").join(layout(vectors, 2, 15, 0.1, "point_no", out="coordinates_2d"), "point_no")
    clusters = hierarchical_clusters(flat, "point_no", "coordinates", min_size, min_samples)
    near = knn(flat, k, "point_no", "embedding").groupBy("point_no").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("neighbor_id").alias("id"), "distance"))).alias("neighbors"))
    return flat.drop("coordinates").join(clusters, "point_no").join(near, "point_no", "left")


def recluster(points: DataFrame, saved: DataFrame | None = None, id: str = "point_id", min_size: int = 10, min_samples: int = 5) -> DataFrame:
    """(id, cluster_id) of a layer's points, anew: on saved coordinates (id, coordinates) if all points have them, else on
    those in the plane. One cluster of all points is a result too."""
    keyed = points.select(id, "coordinates_2d")
    if saved is not None and keyed.join(saved, id, "left_anti").isEmpty():
        keyed = keyed.join(saved.select(id, F.col("coordinates").alias("__v")), id)
    else:
        keyed = keyed.withColumn("__v", F.col("coordinates_2d"))
    numbered = stored(with_row_index(keyed.select(id, "__v"), [id], "__n"), "reclustered")
    found = hierarchical_clusters(numbered, "__n", "__v", min_size, min_samples, single=True)
    return numbered.select(id, "__n").join(found, "__n").select(id, "cluster_id")


def layer_table(points: DataFrame, rows: DataFrame, names: dict[str, str] | None = None, reserved: Sequence[str] = RESERVED) -> DataFrame:
    """Points with x, y, cluster name and the attributes of their first source row, under display names."""
    shown = display(rows.withColumnRenamed("row_index", "__row"), names or {}, reserved)
    p = points_view(points).withColumn("cluster_name", cluster_label(F.col("cluster_id")))
    return p.join(shown, F.element_at("source_row_indices", 1) == F.col("__row")).drop("__row")


def filter_from_points(points: DataFrame, predicate: str) -> DataFrame:
    """(row_index) of all source rows of the points that meet a predicate."""
    return points.where(F.expr(predicate)).select(F.explode("source_row_indices").alias("row_index")).distinct()
