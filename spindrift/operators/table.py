"""Tables with a row index: predicates, pages, projections, counts, updates and export."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_dir, stored

RESERVED = ("id", "x", "y", "text", "label", "neighbors")
ORDERING = ("=", "!=", ">", "<", ">=", "<=", "IS NULL", "IS NOT NULL")
TEXTUAL = ("=", "!=", "LIKE", "NOT LIKE", "IS NULL", "IS NOT NULL")
SMALL_SET = 100


def _parts(df: DataFrame, order: Sequence[str | Column] | None) -> DataFrame:
    """df, range-partitioned by order if there is one, stored with the number of each row's partition and its place there."""
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order or ()]
    ranged = df if order is None else df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = stored(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    return kept.withColumn("__part", F.shiftright("__id", 33)).withColumn("__pos", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def _with_offsets(rows: DataFrame, size: Column) -> DataFrame:
    """rows of _parts with __before, the sum of size over all partitions before theirs: one row a partition is broadcast."""
    sizes = rows.groupBy("__part").agg(F.sum(size).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")


def with_row_index(df: DataFrame, order: Sequence[str | Column] | None = None, name: str = "row_index") -> DataFrame:
    """Row numbers from 0 without gaps, in the order of the given columns or of the input. Names sort nulls last, as the SQL does.

    The rows are stored once in the shared folder with their place in their partition, so that all that is made of them
    sees one partitioning; only the partitions' sizes are summed up.
    """
    return _with_offsets(_parts(df, order), F.lit(1)).withColumn(name, F.col("__before") + F.col("__pos")).drop("__part", "__pos", "__before")


def with_running_sum(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before each one in the given order, partition by partition."""
    within = F.coalesce(F.sum(value).over(W.partitionBy("__part").orderBy("__pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _with_offsets(_parts(df, order), F.col(value)).withColumn(name, F.col("__before") + within).drop("__part", "__pos", "__before")


def operators_for(kind: T.DataType) -> tuple[str, ...]:
    """The filter operators that a column of this type allows."""
    return ORDERING if isinstance(kind, T.NumericType) else TEXTUAL


def rule(column: Column, operator: str, value=None) -> Column:
    """A filter rule as a predicate; null operands match only IS NULL."""
    made = {
        "=": lambda: column == F.lit(value),
        "!=": lambda: column != F.lit(value),
        ">": lambda: column > F.lit(value),
        "<": lambda: column < F.lit(value),
        ">=": lambda: column >= F.lit(value),
        "<=": lambda: column <= F.lit(value),
        "LIKE": lambda: column.like(value),
        "NOT LIKE": lambda: ~column.like(value),
        "IS NULL": column.isNull,
        "IS NOT NULL": column.isNotNull,
    }
    return made[operator]()


def filtered(df: DataFrame, rules: Iterable[tuple]) -> DataFrame:
    """Rows that meet all rules (column, operator[, value])."""
    return df.where(reduce(lambda a, b: a & b, [rule(F.col(c), *rest) for c, *rest in rules], F.lit(True)))


def in_row_set(df: DataFrame, rows: Sequence[int] | DataFrame, key: str = "row_index") -> DataFrame:
    """Rows whose key is in a set: a list, or a DataFrame with a column named like the key. An empty set has no rows."""
    if isinstance(rows, DataFrame):
        return df.join(rows.select(key).distinct(), key, "left_semi")
    if len(rows) <= SMALL_SET:
        return df.where(F.col(key).isin(list(rows)) if rows else F.lit(False))
    # A caller's list is driver data already; as a table it can be broadcast or shuffled, as Spark sees fit.
    return df.join(df.sparkSession.createDataFrame([(r,) for r in rows], T.StructType([T.StructField(key, T.LongType())])).distinct(), key, "left_semi")


def ordered(df: DataFrame, sort: str | None, direction: str | None, tie: str = "row_index") -> DataFrame:
    """One sort key with nulls last either way, ties and the unsorted state by the row index."""
    if sort is None or direction is None:
        return df.orderBy(tie)
    key = F.col(sort)
    return df.orderBy(key.desc_nulls_last() if direction == "desc" else key.asc_nulls_last(), tie)


def page(df: DataFrame, number: int = 1, size: int = 100, sort: str | None = None, direction: str | None = None, tie: str = "row_index", columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A page of the filtered, sorted table; only as many rows as up to the page's end leave the tasks."""
    out = ordered(df if where is None else df.where(where), sort, direction, tie).offset((number - 1) * size).limit(size)
    return out.select(*columns) if columns else out


def display(df: DataFrame, names: Mapping[str, str], reserved: Sequence[str] = RESERVED) -> DataFrame:
    """Columns under their display names; names that are taken get the prefix original_."""
    taken = {r.lower() for r in reserved}
    return df.select(*[F.col(f"`{c}`").alias(f"original_{n}" if n.lower() in taken else n) for c, n in ((c, names.get(c, c)) for c in df.columns)])


def searchable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not f.name.startswith("_ev_")]


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.count("*") - F.countDistinct(key)).alias("duplicates"))


def bulk_update(df: DataFrame, updates: DataFrame, column: str, key: str = "row_index", value: str = "value") -> DataFrame:
    """df with column set from updates (key, value) where they match; a null value overwrites too."""
    u = updates.select(F.col(key).alias("__key"), F.col(value).alias("__value"), F.lit(True).alias("__hit"))
    joined = df.join(u, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(column, F.when(F.col("__hit"), F.col("__value")).otherwise(F.col(column))).select(*df.columns)


def edit_cells(df: DataFrame, edits: DataFrame, column: str, key: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """Cells of a column written by hand, from edits (key, value, at): df with the values, and the cells' metadata (key,
    column_id, status, edited, original_value, last_edit_time) for the rows that there are."""
    e = edits.select(key, F.col("at").alias("last_edit_time"))
    cells = df.select(key, F.col(column).cast("string").alias("original_value")).join(e, key)
    marks = F.lit(column).alias("column_id"), F.lit("success").alias("status"), F.lit(True).alias("edited")
    return bulk_update(df, edits, column, key), cells.select(key, *marks, "original_value", "last_edit_time")


def add_column(df: DataFrame, name: str, kind: str = "string", default=None) -> DataFrame:
    """df with a new column that holds the default in every row."""
    if name.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.lit(default).cast(kind))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """df without a column and without the column of its sources."""
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.drop(name, f"{name}_sources")


def first_rows(df: DataFrame, most: int = 10_000, tie: str = "row_index") -> DataFrame:
    """The first rows in order, as many as a browser takes."""
    return df.orderBy(tie).limit(most)


def grouping_estimate(df: DataFrame, key: str) -> DataFrame:
    """(rows, groups, all_unique) of a column to group by: null and empty are one group, all_unique says that nothing is grouped."""
    groups = F.countDistinct(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return df.agg(F.count("*").alias("rows"), groups.alias("groups"), ((F.count("*") > 0) & (groups == F.count("*"))).alias("all_unique"))


def rows_of_points(points: DataFrame, id: str = "point_id") -> DataFrame:
    """(row_index) of points named point_<row>; other ids name no row."""
    number = F.regexp_extract(F.col(id), r"point_(\d+)", 1)
    return points.select(F.nullif(number, F.lit("")).try_cast("long").alias("row_index")).where("row_index is not null").distinct()


def latest_wins(log: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of an append-only log the last row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_cell_metadata(rows: DataFrame, cells: DataFrame, columns: Sequence[str], key: str = "row_index") -> DataFrame:
    """rows with a struct <column>__meta for each augmented column, from cells (row_index, column_id, status, error, ...)."""
    fields = [c for c in cells.columns if c not in (key, "column_id")]
    wide = cells.groupBy(key).pivot("column_id", list(columns)).agg(F.first(F.struct(*fields)))
    return rows.join(wide.withColumnsRenamed({c: f"{c}__meta" for c in columns}), key, "left")


def cell_status(cells: DataFrame) -> DataFrame:
    """Per augmented column the cells that failed, were edited, are pending, succeeded, and all."""
    return cells.groupBy("column_id").agg(
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.coalesce(F.col("edited"), F.lit(False))).alias("edited"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count("*").alias("total"),
    )


def export_csv(df: DataFrame, path: str, names: Mapping[str, str] | None = None, columns: Sequence[str] | None = None) -> None:
    """The whole table as CSV parts with a header, under display names; nulls are empty fields."""
    shown = df.select(*(columns or df.columns))
    texts = shown.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias((names or {}).get(c, c)) for c in shown.columns])
    texts.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


class PageIndex:
    """Rows stored in the order of their pages, so that any page reads the one or two ranges that hold it.

    Ranges are Parquet partitions of the shared folder; what is known of them is a count each.
    """

    def __init__(self, df: DataFrame, by: str, direction: str = "asc", tie: str = "row_index", ranges: int | None = None) -> None:
        self.order = [F.col(by).desc_nulls_last() if direction == "desc" else F.col(by).asc_nulls_last(), F.col(tie).asc_nulls_last()]
        n = (ranges,) if ranges else ()
        ranged = df.repartitionByRange(*n, *self.order).withColumn("__range", F.spark_partition_id()).sortWithinPartitions(*self.order)
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
        ranged.write.partitionBy("__range").parquet(self.path)
        self.spark, self.schema = spark, df.schema
        counts = spark.read.schema(ranged.schema).parquet(self.path).groupBy("__range").count().orderBy("__range").collect()  # one a range
        ends = list(accumulate(r["count"] for r in counts))
        self.ranges = [(r["__range"], end - r["count"], end) for r, end in zip(counts, ends, strict=True)]

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number`, from 1, of the rows in order; past the last one it is empty."""
        start = (number - 1) * size
        held = [(r, begin) for r, begin, end in self.ranges if begin < start + size and end > start]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        some = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/__range={r}" for r, _ in held])
        return some.orderBy(*self.order).offset(start - held[0][1]).limit(size)
