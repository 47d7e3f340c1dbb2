"""A catalog of files, columns, cells, layers and filters as append-only logs of Parquet rows; the last row of a key counts.

A write appends rows with a version; a deletion appends a tombstone. Readers see the last version of each key, so a write
is visible when its append commits, and nothing that is read is overwritten. Versions are the writer's clock, and its
random name where two are equal, so writers need not read the log and any two of them are ordered.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cluster_stats
from .table import drop_column, latest_wins, with_row_index

# The catalog's tables, their columns and keys.
SCHEMAS = {
    "files": ("id string, name string, format string, last_modified timestamp, size long, version int", ["id"]),
    "column_metadata": (
        "file_id string, column_id string, column_name string, column_type string, model string, provider string, prompt string, created_at long, "
        "output_schema string, web_search_enabled boolean, web_search_config string, temperature double, max_tokens int, width int",
        ["file_id", "column_id"],
    ),
    "cell_metadata": ("file_id string, column_id string, row_index long, status string, error string, error_type string, edited boolean, original_value string, last_edit_time long, sources string", ["file_id", "column_id", "row_index"]),
    "embedding_layers": ("id string, file_id string, name string, provider string, model string, dimension int, composition_mode string, composition_config string, created_at timestamp, last_accessed_at timestamp, is_active boolean, cluster_config string, cluster_stats string", ["id"]),
    "embedding_points": ("layer_id string, point_id string, embedding array<double>, coordinates_2d array<double>, composed_text string, label string, source_row_indices array<long>, neighbors string, cluster_id int", ["layer_id", "point_id"]),
    "saved_filters": ("id string, file_id string, name string, layer_id string, row_indices array<long>, created_at timestamp", ["id"]),
}


class Catalog:
    """Tables of one folder; every method that reads returns a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.last = spark, folder, 0

    def _log(self, name: str) -> DataFrame:
        schema = f"{SCHEMAS[name][0]}, __version long, __writer string, __deleted boolean"
        path = f"{self.folder}/{name}"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, name: str, rows: DataFrame, deleted: bool = False) -> None:
        self.last = max(time.time_ns(), self.last + 1)
        marks = F.lit(self.last).alias("__version"), F.lit(uuid.uuid4().hex).alias("__writer"), F.lit(deleted).alias("__deleted")
        rows.select("*", *marks).write.mode("append").parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        keys = SCHEMAS[name][1]
        last = [F.col("__version").desc(), F.col("__writer").desc()]
        return latest_wins(self._log(name), keys, last).where("not __deleted").drop("__version", "__writer", "__deleted")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows by the table's keys; columns that rows lacks are null."""
        kinds = dict(self._log(name).dtypes)
        self._append(name, rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds if not c.startswith("__")]))

    def delete(self, name: str, condition) -> None:
        self._append(name, self.read(name).where(condition), deleted=True)

    def update(self, table: str, condition: Column, **values) -> None:
        """Rows that meet a condition with other values, constants or expressions."""
        new = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
        self.upsert(table, self.read(table).where(condition).withColumns(new))

    def files(self) -> DataFrame:
        """Files, the last modified first."""
        return self.read("files").orderBy(F.col("last_modified").desc(), "id")

    def rename_file(self, file_id: str, name: str) -> None:
        """A new name is a new version."""
        self.update("files", F.col("id") == file_id, name=name, version=F.col("version") + 1, last_modified=F.current_timestamp())

    def save_file(self, file_id: str, name: str, format: str, rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        """Register a file of rows, and its columns {column id: name} in place of those that it had before; a file with an
        id that exists becomes its next version. Returns the rows with row_index.

        The file's own row is appended last: until then, readers see the version before.
        """
        if rows.isEmpty():
            raise ValueError("a file has rows")
        indexed = with_row_index(rows)
        before = self.read("files").where(F.col("id") == file_id).select("version").first()
        self.delete("column_metadata", (F.col("file_id") == file_id) & ~F.col("column_id").isin(list(columns)))
        kinds = dict(rows.dtypes)
        cells = [(file_id, c, n, kinds.get(c, "string")) for c, n in columns.items()]
        self.upsert("column_metadata", self.spark.createDataFrame(cells, "file_id string, column_id string, column_name string, column_type string"))
        row = self.spark.createDataFrame([(file_id, name, format, 1 if before is None else before[0] + 1)], "id string, name string, format string, version int")
        self.upsert("files", row.withColumn("last_modified", F.current_timestamp()).withColumn("size", F.lit(indexed.count())))
        return indexed

    def clear(self) -> None:
        """All files with all that belongs to them."""
        for name in reversed(SCHEMAS):
            self.delete(name, F.lit(True))

    def columns(self, file_id: str) -> DataFrame:
        return self.read("column_metadata").where(F.col("file_id") == file_id).orderBy("created_at", "column_id")

    def cells(self, file_id: str) -> DataFrame:
        return self.read("cell_metadata").where(F.col("file_id") == file_id).orderBy("column_id", "row_index")

    def points(self, layer_id: str) -> DataFrame:
        """Points in the order of their ids as texts."""
        return self.read("embedding_points").where(F.col("layer_id") == layer_id).orderBy("point_id")

    def save_layer(self, layer: DataFrame, points: DataFrame) -> None:
        """A layer (one row) with its points; it becomes its file's active layer when its own row is appended, after its points."""
        self.upsert("embedding_points", points)
        file_id = layer.select("file_id")
        others = self.read("embedding_layers").join(file_id, "file_id", "left_semi").join(layer.select("id"), "id", "left_anti")
        columns = [c for c in self.read("embedding_layers").columns]
        own = layer.withColumn("is_active", F.lit(True))
        self.upsert("embedding_layers", own.select(*[F.col(c) if c in own.columns else F.lit(None).alias(c) for c in columns]).unionByName(others.withColumn("is_active", F.lit(False)).select(*columns)))

    def assign_clusters(self, layer_id: str, clusters: DataFrame, config: str | None = None) -> None:
        """Write a clustering (point_id, cluster_id) back to a layer's points, and its configuration and counts to the layer."""
        points = self.points(layer_id).drop("cluster_id")
        self.upsert("embedding_points", points.join(clusters.select("point_id", "cluster_id"), "point_id", "left"))
        stats = cluster_stats(self.points(layer_id)).select(F.to_json(F.struct("*"))).first()[0]
        self.update("embedding_layers", F.col("id") == layer_id, cluster_config=F.coalesce(F.lit(config), F.col("cluster_config")), cluster_stats=stats)

    def rename_filter(self, filter_id: str, name: str) -> None:
        self.update("saved_filters", F.col("id") == filter_id, name=name)

    def delete_file(self, file_id: str) -> None:
        """A file with its columns, cells, layers, points and filters."""
        layers = self.read("embedding_layers").where(F.col("file_id") == file_id).select(F.col("id").alias("layer_id"))
        points = self.read("embedding_points").join(layers, "layer_id", "left_semi").select(*[c for c in self.read("embedding_points").columns])
        self._append("embedding_points", points, deleted=True)
        for name in ("embedding_layers", "column_metadata", "cell_metadata", "saved_filters"):
            self.delete(name, F.col("file_id") == file_id)
        self.delete("files", F.col("id") == file_id)

    def delete_column(self, file_id: str, column_id: str, rows: DataFrame | None = None) -> DataFrame | None:
        """A column's metadata and cells, and those of its sources column; returns the file's rows without both."""
        both = F.col("column_id").isin(column_id, f"{column_id}_sources") & (F.col("file_id") == file_id)
        self.delete("cell_metadata", both)
        self.delete("column_metadata", both)
        return None if rows is None else drop_column(rows, column_id)

    def activate(self, layer_id: str) -> None:
        """One layer of its file active, the others not."""
        layers = self.read("embedding_layers")
        file_id = layers.where(F.col("id") == layer_id).select("file_id")
        self.upsert("embedding_layers", layers.join(file_id, "file_id", "left_semi").withColumn("is_active", F.col("id") == layer_id))

    def layers(self, file_id: str | None = None) -> DataFrame:
        """Layers with their number of points, newest first."""
        layers = self.read("embedding_layers")
        layers = layers if file_id is None else layers.where(F.col("file_id") == file_id)
        counts = self.read("embedding_points").groupBy("layer_id").agg(F.count("point_id").alias("point_count"))
        joined = layers.join(counts, layers["id"] == counts["layer_id"], "left").drop("layer_id")
        return joined.withColumn("point_count", F.coalesce("point_count", F.lit(0))).orderBy(F.col("created_at").desc(), "id")

    def filter_rows(self, filter_id: str) -> DataFrame:
        """(row_index) of a saved filter."""
        return self.read("saved_filters").where(F.col("id") == filter_id).select(F.explode("row_indices").alias("row_index"))

    def filters(self, file_id: str) -> DataFrame:
        return self.read("saved_filters").where(F.col("file_id") == file_id).withColumn("row_count", F.size("row_indices")).orderBy(F.col("created_at").desc(), "id")

    def name_is_free(self, file_id: str, name: str) -> bool:
        return self.read("column_metadata").where((F.col("file_id") == file_id) & (F.lower("column_name") == name.lower())).isEmpty()


def column_ids(names: Sequence[str], stamp: int) -> dict[str, str]:
    """Stable ids of columns, by place."""
    return {n: f"col_{stamp}_{i}" for i, n in enumerate(names)}
