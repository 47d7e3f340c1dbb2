"""Jaccard self-join of word n-gram sets by PartEnum signatures, resolved to connected components.

Sets fall into size bands, and each band has an instance for the pairs whose smaller set lies in it: such sets differ in at
most k features if they are similar enough. The feature domain is dealt into n1 first-level partitions, so that one of them
has at most k2 differences, and each of those into n2 cells; a signature is a hash of what a set has in n2 - k2 of the
cells. Similar sets therefore share a signature, and nothing similar is lost. Equal sets are joined to one class first.

Pairs that share a signature are decided in steps, of which only the last looks at texts. Each class is first checked
against the few others that it shares most signatures with, and the links found make components. Buckets that hold one
component only are done. In the others every pair of different components is compared, within blocks of bounded size, by
a sketch that bounds the differences from below; what it can't rule out is compared set by set. No pair is given up: the
first step only makes the later ones short, and the sketch rules out no similar pair.

Defined results: null and empty texts and texts without words have an empty set, are linked with nothing and are
components of their own; texts shorter than n words have one feature; repeated rows come back repeated. Rows with null ids
are linked like others and come back with null ids; a component's id is the least that isn't null, null if there is none.
Rows that share an id are linked each for itself. Columns of the input other than id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, components, hashed_words, materialize, mix, own_ids, sequence_hashes, unique_ids, utf8

FIRST = 4
"""Others that a class is checked against before components are known; the rest are checked after."""
BATCH = 1 << 20
"""Bytes of text whose sets are made at once."""
BLOCK = 512
"""Classes of one bucket that one step compares with as many others; larger buckets are cut into pairs of blocks."""


@dataclass(frozen=True)
class Scheme:
    """A PartEnum instance: cells and tolerated differences of a first-level partition."""

    n2: int = 3
    k2: int = 1


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den on sets of n-word shingles."""

    n: int = 5
    num: int = 4
    den: int = 5

    def differences(self, total: np.ndarray | int) -> np.ndarray | int:
        """Most elements in just one of two similar sets whose sizes sum to total."""
        return total * (self.den - self.num) // (self.den + self.num)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two sorted sets are similar enough; empty sets never are."""
        if not len(a) or not len(b):
            return False
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * shared >= self.num * (len(a) + len(b) - shared)


class Sets:
    """The shingle sets of UTF-8 texts, A to Z lower-cased: sorted features, one text's after the other's.

    A text of fewer than n words has all its words as one feature.
    """

    def __init__(self, texts: pa.Array, n: int) -> None:
        words, lengths = hashed_words(texts, lower=True)
        starts, row = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
        features, of = [sequence_hashes(words, n)[at]], [row[at]]
        for m in range(1, n):
            short = np.flatnonzero(lengths == m)
            if len(short):
                features.append(sequence_hashes(words, m, 100 + m)[starts[short]])
                of.append(short)
        values, self.row = np.concatenate(features), np.concatenate(of)
        if len(of) > 1:
            order = np.argsort(self.row, kind="stable")
            values, self.row = values[order], self.row[order]
        edges = np.searchsorted(self.row, np.arange(len(lengths) + 1))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            values[low:high].sort()
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (self.row[1:] != self.row[:-1])
        self.values, self.row = values[new], self.row[new]
        self.sizes = np.bincount(self.row, minlength=len(lengths))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.starts[i] : self.starts[i] + self.sizes[i]]


@lru_cache(maxsize=1 << 16)
def band(size: int, num: int, den: int) -> tuple[int, int, int]:
    """(number, largest size of this band, of the band before) of a set's size. A band spans two steps of similarity."""
    low, i, before = 1, 0, 0
    while True:
        high = max(low, low * den * den // (num * num))
        if size <= high:
            return i, high, before
        low, before, i = high + 1, high, i + 1


def instances(sizes: np.ndarray, threshold: Threshold) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, band, tolerated differences) of the instances that sets of these sizes sign.

    The instance of a band serves all pairs whose smaller set lies in it. The larger one lies in it too, or in the next
    band, up to the size that a set of this band can be similar to: a set signs its own band's instance, and that of the
    band before if it is as small.
    """
    num, den = threshold.num, threshold.den
    found = np.array([band(s, num, den) for s in sizes.tolist()], np.int64).reshape(-1, 3)
    rows = np.flatnonzero(sizes > 0)
    own = (rows, found[rows, 0], threshold.differences(found[rows, 1] + found[rows, 1] * den // num))
    low = rows[(found[rows, 0] > 0) & (sizes[rows] <= found[rows, 2] * den // num)]
    return [own, (low, found[low, 0] - 1, threshold.differences(found[low, 2] + found[low, 2] * den // num))]


def signatures(sets: Sets, threshold: Threshold, scheme: Scheme = Scheme()) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit signature, row) of all sets, instance by instance.

    An instance that tolerates no difference has none, as equal sets are one class.
    """
    place, value = mix(sets.values, 3) >> np.uint64(32), mix(sets.values, 4)
    subsets = list(combinations(range(scheme.n2), scheme.n2 - scheme.k2))
    sigs, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for of, number, k in instances(sets.sizes, threshold):
        of, number, k = of[k > 0], number[k > 0], k[k > 0]
        parts = np.zeros(len(sets.sizes), np.int64)  # first-level partitions of each set
        parts[of] = k // (scheme.k2 + 1) + 1
        first = np.cumsum(parts) - parts
        signing = parts[sets.row] > 0
        row = sets.row[signing]
        cell = ((place[signing] * (parts[row] * scheme.n2).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(int(parts.sum()) * scheme.n2, np.uint64)
        np.add.at(sums, first[row] * scheme.n2 + cell, value[signing])
        sums = sums.reshape(-1, scheme.n2)
        owner = np.repeat(of, parts[of])
        part = np.arange(len(owner)) - np.repeat(first[of], parts[of])
        tag = (part + (np.repeat(number, parts[of]) << 40)).astype(np.uint64) * np.uint64(len(subsets))
        for s, subset in enumerate(subsets):
            sigs.append(mix(sums[:, subset].sum(axis=1, dtype=np.uint64) ^ mix(tag + np.uint64(s), 5), 6))
            rows.append(owner)
    return np.concatenate(sigs), np.concatenate(rows)


def sketches(sets: Sets, threshold: Threshold) -> list[bytes]:
    """A parity sketch of each set: bit b is whether it has an odd number of features that hash to b.

    Each element in just one of two sets changes one bit of one of them, so as many bits as differ, elements differ at
    least. A sketch has eight bits for each difference that the band tolerates, so few bits cancel out. Twice as
    long a sketch, folded, is the shorter one.
    """
    own = instances(sets.sizes, threshold)[0]
    words = np.ones(len(sets.sizes), np.int64)
    words[own[0]] = 2 ** np.ceil(np.log2(np.maximum(1, own[2] / 8))).astype(np.int64)
    cell, out = mix(sets.values, 9), [b""] * len(words)
    for n in np.unique(words).tolist():
        of = np.flatnonzero(words == n)
        place = np.full(len(words), -1, np.int64)
        place[of] = np.arange(len(of))
        mine = place[sets.row] >= 0
        at = place[sets.row[mine]] * (64 * n) + (cell[mine] & np.uint64(64 * n - 1)).astype(np.int64)
        odd = np.bincount(at, minlength=len(of) * 64 * n) & 1
        packed = np.packbits(odd.astype(np.uint8).reshape(len(of), -1), axis=1, bitorder="little")
        for i, bits in zip(of.tolist(), packed, strict=True):
            out[i] = bits.tobytes()
    return out


class Bounds:
    """Sizes and sketches of some sets: which pairs of them can be similar enough."""

    def __init__(self, sizes: np.ndarray, sketched: pa.Array) -> None:
        self.sizes, self.words = sizes, np.asarray(pa.compute.binary_length(sketched), np.int64) // 8
        self.place, self.bits = np.zeros(len(sizes), np.int64), {}
        for n in np.unique(self.words).tolist():
            of = np.flatnonzero(self.words == n)
            self.place[of] = np.arange(len(of))
            same = sketched.take(pa.array(of)) if len(of) < len(sizes) else sketched
            self.bits[n] = np.frombuffer(b"".join(same.to_pylist()), np.uint64).reshape(-1, n)

    def possible(self, a: np.ndarray, b: np.ndarray, threshold: Threshold) -> np.ndarray:
        """Whether each pair of rows a and b can be similar enough."""
        most = threshold.differences(self.sizes[a] + self.sizes[b])
        out = np.abs(self.sizes[a] - self.sizes[b]) <= most
        for m, n in {*zip(self.words[a[out]].tolist(), self.words[b[out]].tolist(), strict=True)}:
            these = np.flatnonzero(out & (self.words[a] == m) & (self.words[b] == n))
            for i in range(0, len(these), max(1, (1 << 20) // max(m, n))):
                at = these[i : i + max(1, (1 << 20) // max(m, n))]
                x, y = self.bits[m][self.place[a[at]]], self.bits[n][self.place[b[at]]]
                while x.shape[1] != y.shape[1]:
                    x, y = (x, y) if x.shape[1] > y.shape[1] else (y, x)
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[at]
        return out


def profiles(df: DataFrame, threshold: Threshold) -> DataFrame:
    """(id, n, h1, h2, sketch) of each row: size of its set, a 128-bit hash and a sketch of it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            sets = Sets(batch.column("text"), threshold.n)
            ends = np.r_[sets.starts, len(sets.values)]
            # Sums of mixed features, as differences of running sums.
            h = [np.diff(np.r_[np.uint64(0), np.cumsum(mix(sets.values, k), dtype=np.uint64)][ends]).view(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets.sizes, pa.int64()), pa.array(h[0]), pa.array(h[1]), pa.array(sketches(sets, threshold), pa.binary())], ["id", "n", "h1", "h2", "sketch"])

    return df.mapInArrow(apply, "id long, n long, h1 long, h2 long, sketch binary")


def signed(df: DataFrame, threshold: Threshold) -> DataFrame:
    """(sig, id) for every signature of every row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            sigs, rows = signatures(Sets(batch.column("text"), threshold.n), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), batch.column("id").take(pa.array(rows))], ["sig", "id"])

    return df.mapInArrow(apply, "sig long, id long")


def crowded(sigs: DataFrame) -> DataFrame:
    """Signature rows that another class has too, with the number and the least id of the classes that have it, and the id before."""
    w = W.partitionBy("sig")
    return sigs.select("sig", "id", F.count("*").over(w).alias("n"), F.min("id").over(w).alias("center"), F.lag("id").over(w.orderBy("id")).alias("last")).where("n > 1")


def hopeful(pairs: DataFrame, bounds: DataFrame, threshold: Threshold) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches let them be similar enough."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                x = batch.slice(i, 2048)
                sizes = np.r_[np.asarray(x.column("na"), np.int64), np.asarray(x.column("nb"), np.int64)]
                bounds = Bounds(sizes, pa.concat_arrays([x.column("sa"), x.column("sb")]))
                a = np.arange(x.num_rows)
                yield x.select(["a", "b"]).filter(pa.array(bounds.possible(a, a + x.num_rows, threshold)))

    sides = [bounds.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(apply, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, threshold: Threshold) -> DataFrame:
    """Those of the distinct pairs (a, b) of rows of docs (id, text) that are similar enough."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "ta", BATCH):
            a, b = (Sets(batch.column(c), threshold.n) for c in ("ta", "tb"))
            yield batch.select(["a", "b"]).filter(pa.array([threshold.similar(a[i], b[i]) for i in range(batch.num_rows)], pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(ids, "id", "left_semi")
    ta, tb = (texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    return pairs.join(ta, "a").join(tb, "b").mapInArrow(apply, "a long, b long")


def meetings(rows: DataFrame, keys: list[str], threshold: Threshold) -> DataFrame:
    """The pairs (a, b), a < b, of different components in one bucket that can be similar enough; pairs may come back again.

    rows holds the keys that name a bucket, id, c (component), n, sketch and block; of a bucket whose rows are of two
    blocks, only pairs across them count. A bucket is compared in one task, in the order of the rows: each row with those
    at every distance from it, so a batch's buckets are compared at once.
    """

    def compared(x: pa.RecordBatch) -> pa.RecordBatch:
        ids, c, block = (np.asarray(x.column(k), np.int64) for k in ("id", "c", "block"))
        bounds = Bounds(np.asarray(x.column("n"), np.int64), x.column("sketch"))
        first = changes(x)
        bucket = np.cumsum(first) - 1
        two = np.zeros(bucket[-1] + 1, bool)
        two[bucket[block != block[np.flatnonzero(first)][bucket]]] = True
        found, at, distance = [], np.arange(len(ids)), 1
        while True:
            at = at[at < len(ids) - distance]
            at = at[bucket[at] == bucket[at + distance]]
            if not len(at):
                break
            met = at[(c[at] != c[at + distance]) & (~two[bucket[at]] | (block[at] != block[at + distance]))]
            met = met[bounds.possible(met, met + distance, threshold)]
            found.append(np.sort(np.stack([ids[met], ids[met + distance]], axis=1), axis=1))
            distance += 1
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def changes(x: pa.RecordBatch) -> np.ndarray:
        first = np.ones(x.num_rows, bool)
        columns = [np.asarray(x.column(k), np.int64) for k in keys]
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in columns])
        return first

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.RecordBatch | None = None  # the rows of a bucket that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            x = pa.concat_batches([open_, batch]) if open_ is not None else batch
            cut = int(np.flatnonzero(changes(x))[-1])
            open_ = x.slice(cut)
            if cut:
                yield compared(x.slice(0, cut))
        if open_ is not None:
            yield compared(open_)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(apply, "a long, b long")


def jaccard_components(df: DataFrame, threshold: Threshold = Threshold(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of df."""
    docs = df.select(F.col(id).cast("long").alias("id"), utf8(F.col(text)).alias("text"))
    docs, keys = unique_ids(docs)
    every = materialize(profiles(docs, threshold), "profiles")
    # Written tables on both sides of a join let Spark split a class of very many copies among tasks.
    classes = materialize(every.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep")), "classes")
    member = materialize(every.where("n > 0").select("id", "n", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "n", "rep"), "members")
    rest = member.where("id <> rep").select("id").union(every.where("n = 0").select("id"))
    bounds = every.select("id", "n", "sketch")

    buckets = materialize(crowded(signed(docs.join(rest, "id", "left_anti"), threshold)), "buckets")
    first = buckets.select(F.explode(F.array("center", "last")).alias("a"), F.col("id").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    place = F.row_number().over(W.partitionBy("b").orderBy(F.col("shared").desc(), "a"))
    first = materialize(first.withColumn("place", place).where(F.col("place") <= FIRST).select("a", "b"), "pairs")
    links = materialize(verified(materialize(hopeful(first, bounds, threshold), "pairs"), docs, threshold), "links")

    w = W.partitionBy("sig")
    placed = buckets.select("sig", "id").join(components(links), "id", "left").select("sig", "id", F.coalesce("component", "id").alias("c"))
    placed = placed.select("*", F.min("c").over(w).alias("x"), F.max("c").over(w).alias("y"), F.count("*").over(w).alias("all"), F.row_number().over(w.orderBy("id")).alias("place"))
    block = F.floor((F.col("place") - 1) / BLOCK).cast("long")
    placed = materialize(placed.where("x <> y").select("sig", "id", "c", "all", block.alias("block")), "placed").join(bounds, "id")
    met = meetings(placed.where(F.col("all") <= BLOCK), ["sig"], threshold)
    # A large bucket: each of its blocks with itself and with each other one.
    last = F.floor((F.col("all") - 1) / BLOCK)
    others = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    large = placed.where(F.col("all") > BLOCK).withColumn("pair", F.explode(others)).select("*", "pair.i", "pair.j")
    met = met.union(meetings(large, ["sig", "i", "j"], threshold)).distinct().join(first, ["a", "b"], "left_anti")
    label = components(materialize(links.union(verified(materialize(met, "pairs"), docs, threshold)), "links"))

    sets = member.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sets.union(every.where("n = 0").select("id", "n", "id"))
    if keys is not None:
        # The least id that isn't null; a component without one is named by null. Empty sets are named by their own.
        out = own_ids(out, keys)
        least = out.where("id is not null").groupBy("component_id").agg(F.min("id").alias("least"))
        out = out.join(least, "component_id", "left").select("id", "n", F.col("least").alias("component_id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")
