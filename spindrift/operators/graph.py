"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component), stored: the smallest id that each end of the edges (a, b) reaches.

    Each end hangs on the least end that it knows; a step hangs all ends on what their least end hangs on, until nothing
    moves. Every two steps are a written table, and the one before it is deleted.
    """
    flat = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
    links = stored(flat.select("e.u", "e.v").distinct(), "links")
    label = stored(links.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), "labels")

    def hang(label: DataFrame) -> DataFrame:
        near = links.join(label.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        # What the neighbours hang on, and also what that label's own end hangs on.
        hung = label.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        jumped = hung.join(label.select(F.col("u").alias("m"), F.col("l").alias("far")), "m", "left").select("u", "l", F.least("m", F.coalesce("far", "m")).alias("m"))
        # The old label's end learns of the new one, so that whole trees move at once.
        told = jumped.select("u", "m").unionByName(jumped.select(F.col("l").alias("u"), "m")).groupBy("u").agg(F.min("m").alias("m"))
        return label.join(told, "u").select("u", F.least("l", "m").alias("l"))

    while True:
        twice = hang(hang(label))
        new = stored(twice.join(label.select("u", F.col("l").alias("old")), "u"), "labels")
        discard(label)
        label = new
        if new.where("old <> l").isEmpty():
            break
    discard(links)
    return label.select(F.col("u").alias("id"), F.col("l").alias("component"))
