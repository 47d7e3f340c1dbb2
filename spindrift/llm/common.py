"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import discard
from ..shared import stored as materialize

#: Words of the contracts: runs of anything but a space and the ASCII controls 9 to 13.
#: ``bytes.split()`` splits UTF-8 text at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique_ids(docs: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame | None]:
    """docs with a key of its own in place of each null or repeated value of the long column id, and (key, id) of such rows.

    Those rows are written to the shared folder, so that they keep their keys. Keys are consecutive numbers that no row
    has as its id: after the largest id, or else where there is room, those of nulls last. None: all ids are unique.
    """
    again = docs.where(F.col(id).isNotNull()).groupBy(id).agg(F.count("*").alias("__n")).where("__n > 1").select(id)
    nulls, again = docs.where(F.col(id).isNull()), materialize(again, "repeated-ids")
    odd, known = nulls, docs.where(F.col(id).isNotNull())
    if not again.isEmpty():
        odd, known = docs.join(again, id, "left_semi").select(docs.columns).unionByName(nulls), known.join(again, id, "left_anti").select(docs.columns)
    elif nulls.isEmpty():
        return docs, None
    stored = materialize(odd.withColumn("__n", F.monotonically_increasing_id()), "own-ids")
    part = F.shiftright("__n", 33)
    rows = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.select("__part", before.alias("__before"))
    n, base = stored.count(), docs.agg(F.coalesce(F.max(id), F.lit(-1))).first()[0] + 1
    random = Random(n)
    while base + n >= 2**63 or not docs.where((F.col(id) >= base) & (F.col(id) < base + n)).isEmpty():
        base = random.randrange(-(2**63), 2**63 - n)
    key = F.lit(base).cast("long") + F.col("__before") + F.col("__n").bitwiseAND((1 << 33) - 1)
    keyed = stored.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("__key", key)
    return known.unionByName(keyed.withColumn(id, F.col("__key")).select(docs.columns)), keyed.select("__key", F.col(id).alias("__id"))


def own_ids(out: DataFrame, keys: DataFrame | None, id: str = "id") -> DataFrame:
    """out with the ids of before in place of the keys that unique_ids gave."""
    if keys is None:
        return out
    joined = out.join(keys, F.col(id) == F.col("__key"), "left")
    return joined.withColumn(id, F.when(F.col("__key").isNull(), F.col(id)).otherwise(F.col("__id"))).drop("__key", "__id")


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def word_count(text: Column) -> Column:
    """Number of words, as a long; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))).cast("long")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the output."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_VALUES = np.where(_SOLID, mix(np.arange(256, dtype=np.uint64), 21), np.uint64(0))
_LOWERED = _VALUES[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))]
_SEGMENT = 1 << 17


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all UTF-8 texts, and each text's number of words; lower: A to Z count as a to z.

    A word's hash is the mixed sum of its bytes' values times factors by place. Works on a segment of bytes at a time, so
    memory beside the hashes is a few bytes a byte of text.
    """
    texts = texts.cast(pa.binary())
    _, ends, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(edges[-1] - edges[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    solid = _SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = edges[:-1][edges[:-1] < edges[1:]]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.searchsorted(starts, edges))
    sums = np.zeros(len(starts), np.uint64)
    values = _LOWERED if lower else _VALUES
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + _SEGMENT)))
        begin, end = int(starts[low]), int(starts[high]) if high < len(starts) else size
        own = starts[low:high] - begin
        # Separators count nothing, so they go with the word before them.
        place = np.arange(end - begin) - np.repeat(own, np.diff(np.r_[own, end - begin]))
        place[~solid[begin:end]] = 0
        factors = mix(np.arange(int(place.max()) + 1, dtype=np.uint64), 22) | np.uint64(1)
        sums[low:high] = np.add.reduceat(values[data[begin:end]] * factors[place], own)
        low = high
    return mix(sums, 23), lengths


def sequence_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of n consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(n, dtype=np.uint64), seed + 1) | np.uint64(1)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += words[j : j + m] * factors[j]
    return mix(total, seed)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id in edges (a, b) reaches.

    Alternating large-star and small-star steps, each cut by a written table, until the edges stay the same.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        seen = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(last)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
