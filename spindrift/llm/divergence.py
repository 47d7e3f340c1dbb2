"""Divergence of sources within a language: how far term probabilities of a group are from those of others.

1. Documents that hold each term are counted exactly by (language, term); terms of at least `least` documents are kept.
2. The kept terms of a language are dealt to shards by hash, and each shard gets a minimal perfect hash that stores its
   terms by slot.
3. A second pass counts occurrences of kept terms in dense slots of each (language, source) group. Where all hashes are
   small they are broadcast, and each task adds to its groups' slots and sends those that aren't zero; the sums are made
   in steps, so that no task gets the messages of all tasks. Where the hashes exceed `broadcast_bytes`, the terms are
   counted by Spark and meet the hash of their shard in a join instead.
4. Each shard's slots give the divergences between groups, in blocks of groups, and each group's strongest terms.

Results: part `pair` has sum(floor((p - q)^2 / q)) over all kept terms for each other source of the language; part `term`
the kept terms that occur in the group with p above the language's, by floor((p - q)^2 / q), the first `top` only, where
p = 1 + floor(10^9 * (count + 1) / (N + V)). Integers are exact while a language has fewer than 2^47 occurrences.

Defined results: null texts, languages and sources count as empty strings; a group without terms has count 0 for all;
repeated rows are documents of their own; a language with one source has no pairs, one without kept terms has pairs of value
0; no documents give no rows. Other columns of the input are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, materialize, utf8
from .perfect import Shard

LEAST = 3
TOP = 200
SLOTS = 8192
"""Terms of a shard, about."""
SOURCES = 64
"""Groups of a block, about."""
BROADCAST_BYTES = 48 << 20
"""Most bytes of all perfect hashes that are broadcast."""
DENSE_BYTES = 64 << 20
"""Bytes of slots that a task holds before it sends them, or one group's slots."""
_CHUNK = 8 << 20
_ONE = 10**9
# Bytes of terms with A to Z lower-cased, all others as spaces.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, shard long, slots binary, counts binary, total long"


def _tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All texts' terms, and each text's number of them."""
    words, lengths = [], []
    for text in texts:
        own = text.as_buffer().to_pybytes().translate(_TERM).split()
        words += own
        lengths.append(len(own))
    return pa.array(words, pa.binary()).dictionary_encode(), np.array(lengths, np.int64)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.take(pa.array(np.flatnonzero(codes == k)))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", _CHUNK):
        for lang, own in _by_language(batch):
            terms, lengths = _tokens(own.column("text"))
            n = len(terms.dictionary)
            if n:
                of = np.unique(np.repeat(np.arange(len(lengths)), lengths) * n + terms.indices.to_numpy()) % n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), terms.dictionary.cast(pa.string()), pa.array(np.bincount(of, minlength=n))], ["lang", "term", "n"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences by group and term."""
    for batch in by_bytes(batches, "text", _CHUNK):
        for lang, own in _by_language(batch):
            terms, lengths = _tokens(own.column("text"))
            sources = own.column("source").dictionary_encode()
            n = len(terms.dictionary)
            if n:
                key, times = np.unique(np.repeat(sources.indices.to_numpy().astype(np.int64), lengths) * n + terms.indices.to_numpy(), return_counts=True)
                cells = [pa.array([lang] * len(key)), sources.dictionary.take(pa.array(key // n)), terms.dictionary.take(pa.array(key % n)).cast(pa.string()), pa.array(times)]
                yield pa.RecordBatch.from_arrays(cells, ["lang", "source", "term", "n"])


def _hashes(terms: pa.Array) -> np.ndarray:
    """What Spark's xxhash64 gives for the terms."""
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms.to_pylist()), np.uint64, len(terms))


def _build(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    sizes, bits, keys = Shard.build(group.column("term").chunk(0).cast(pa.binary()), group.column("h").to_numpy().view(np.uint64))
    size = len(bits) + keys.nbytes
    return pa.table({"lang": group.column("lang").slice(0, 1), "shard": group.column("shard").slice(0, 1), "of": group.column("of").slice(0, 1), "n": [len(keys)], "bytes": [size], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "keys": pa.array([keys.to_pylist()], pa.list_(pa.binary()))})


def _packed(lang: str, source: str, shard: int, counts: np.ndarray) -> tuple:
    """A row of the slots that aren't zero."""
    at = np.flatnonzero(counts)
    kind = next(f"u{n}" for n in (1, 2, 4, 8) if not len(at) or int(counts[at].max()) < 2 ** (8 * n))
    return lang, source, shard, at.astype(np.int32).tobytes(), kind[1].encode() + counts[at].astype(kind).tobytes(), int(counts[at].sum())


def _unpacked(slots: bytes | None, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not slots:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.frombuffer(slots, np.int32), np.frombuffer(counts[1:], f"u{counts[:1].decode()}").astype(np.int64)


def _messages(rows: list[tuple], salt: int | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()
    names, cells = ["lang", "source", "shard", "slots", "counts", "total"], [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    if salt is not None:
        names, cells = [*names, "salt"], [*cells, pa.array([salt] * len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays(cells, names)


class Vocabulary:
    """The shards of a language; slots of all shards are numbered one after another."""

    def __init__(self, shards: list[tuple[int, Shard]], of: int) -> None:
        self.shards, self.of = dict(shards), of
        self.numbers = sorted(self.shards)
        ends = np.cumsum([0] + [len(self.shards[s].keys) for s in self.numbers])
        self.starts, self.size = dict(zip(self.numbers, ends.tolist(), strict=False)), int(ends[-1])

    def slots(self, terms: pa.Array) -> np.ndarray:
        hashes, out = _hashes(terms), np.full(len(terms), -1, np.int64)
        shard = np.mod(hashes.view(np.int64), self.of)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.of + 1))
        for s in self.numbers:
            at = order[edges[s] : edges[s + 1]]
            if len(at):
                found = self.shards[s].slots(terms.take(pa.array(at)), hashes[at])
                out[at] = np.where(found >= 0, found + self.starts[s], -1)
        return out


def _count_slots(shared, fan: int, most: int):
    """Counts of each group in dense slots; what isn't zero is sent when the slots held take more than `most` bytes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies: dict[str, Vocabulary] = shared.value
        salt, held = TaskContext.get().partitionId() % fan, {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                v = vocabularies[lang]
                parts = [(s, counts[v.starts[s] : v.starts[s] + len(v.shards[s].keys)]) for s in v.numbers]
                yield _messages([_packed(lang, source, s, x) for s, x in parts if x.any()], salt)
            held.clear()

        for batch in by_bytes(batches, "text", _CHUNK):
            for lang, own in _by_language(batch):
                if lang not in vocabularies:
                    continue
                v = vocabularies[lang]
                terms, lengths = _tokens(own.column("text"))
                sources = own.column("source").dictionary_encode()
                slot = v.slots(terms.dictionary)[terms.indices.to_numpy()]
                keep = slot >= 0
                key, times = np.unique(np.repeat(sources.indices.to_numpy().astype(np.int64), lengths)[keep] * v.size + slot[keep], return_counts=True)
                edges = np.searchsorted(key, np.arange(len(sources.dictionary) + 1) * v.size)
                for k, source in enumerate(sources.dictionary.to_pylist()):
                    at = slice(edges[k], edges[k + 1])
                    if at.start == at.stop:
                        continue
                    if (lang, source) not in held:
                        if held and sum(x.nbytes for x in held.values()) + 8 * v.size > most:
                            yield from sent()
                        held[lang, source] = np.zeros(v.size, np.int64)
                    held[lang, source][key[at] - k * v.size] += times[at]
        yield from sent()

    return apply


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the messages of one group and shard, or of one shard (source: none)."""
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for slots, own in zip(batch.column("slots").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            at, own = _unpacked(slots, own)
            if len(at) and at[-1] >= len(counts):
                counts = np.concatenate([counts, np.zeros(max(int(at[-1]) + 1 - len(counts), len(counts)), np.int64)])
            counts[at] += own
    source = key[1].as_py() if len(key) > 2 else ""
    yield _messages([_packed(key[0].as_py(), source, key[2 if len(key) > 2 else 1].as_py(), counts)])


def _join_slots(terms: pa.Table, shard: pa.Table) -> pa.Table:
    """Counts of the groups (source, term, n) of a block in the slots of a shard."""
    rows = []
    if terms.num_rows and shard.num_rows:
        s = _shard(shard.to_pylist()[0])
        terms = terms.combine_chunks()
        term = terms.column("term").chunk(0).cast(pa.binary())
        slot, n = s.slots(term, _hashes(term)), terms.column("n").to_numpy()
        sources = terms.column("source").chunk(0).dictionary_encode()
        for k, source in enumerate(sources.dictionary.to_pylist()):
            own = (sources.indices.to_numpy() == k) & (slot >= 0)
            counts = np.zeros(len(s.keys), np.int64)
            counts[slot[own]] = n[own]
            if own.any():
                rows.append(_packed(terms.column("lang")[0].as_py(), source, terms.column("shard")[0].as_py(), counts))
    return pa.Table.from_batches([_messages(rows)])


def _shard(row: dict) -> Shard:
    return Shard(row["sizes"], row["bits"], pa.array(row["keys"], pa.binary()))


def probability(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(10^9 * (counts + 1) / (total + v)), exactly."""
    d = total + v
    if d >= 2**47:
        raise ValueError("a group has too many occurrences for exact integers")
    q, r = np.divmod((counts + 1) * 31250, d)
    return 1 + q * 32000 + r * 32000 // d


def _compare(top: int):
    """Divergences of the block's groups (side 0) from the other block's (side 1), and their strongest terms."""

    def apply(groups: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if groups.num_rows and shard.num_rows:
            one, rows = shard.to_pylist()[0], groups.to_pylist()
            n = one["n"]

            def dense(slots: bytes | None, counts: bytes | None) -> np.ndarray:
                x = np.zeros(n, np.int64)
                at, own = _unpacked(slots, counts)
                x[at] = own
                return x

            sides = [[(r["source"], dense(r["slots"], r["counts"]), r["total"], r["v"], r["lang_total"]) for r in rows if r["side"] == s] for s in (0, 1)]
            lang, others = rows[0]["lang"], [x[0] for x in sides[1]]
            q = np.array([probability(c, total, v) for _, c, total, v, _ in sides[1]]).reshape(len(others), n)
            whole = dense(one["slots"], one["counts"])
            for source, counts, total, v, lang_total in sides[0]:
                p = probability(counts, total, v)
                d = p - q
                d *= d
                d //= q
                out += [(lang, source, "pair", o, x) for o, x in zip(others, d.sum(axis=1).tolist(), strict=True) if o != source]
                if not rows[0]["b2"]:
                    own = probability(whole, lang_total, v)
                    at = np.flatnonzero((counts > 0) & (p > own))
                    f = (p[at] - own[at]) ** 2 // own[at]
                    if len(at) > top:
                        most = f >= np.partition(f, -top)[-top]
                        at, f = at[most], f[most]
                    ranked = sorted((-x, one["keys"][i]) for x, i in zip(f.tolist(), at.tolist(), strict=True))[:top]
                    out += [(lang, source, "term", k.decode(), -x) for x, k in ranked]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("lang", "source", "part", "item", "value"), columns, [pa.string()] * 4 + [pa.int64()], strict=True)})

    return apply


def _occurring(docs: DataFrame, shards: DataFrame, sizes: DataFrame, broadcast_bytes: int, dense_bytes: int) -> DataFrame:
    """(lang, source, shard, slots, counts, total) of the groups that have terms of a shard."""
    spark = docs.sparkSession
    if shards.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] <= broadcast_bytes:
        by_lang: dict[str, list[dict]] = {}
        for r in shards.select("lang", "shard", "of", "sizes", "bits", "keys").toArrow().to_pylist():
            by_lang.setdefault(r["lang"], []).append(r)
        shared = spark.sparkContext.broadcast({lang: Vocabulary([(r["shard"], _shard(r)) for r in rows], rows[0]["of"]) for lang, rows in by_lang.items()})
        tasks = docs.rdd.getNumPartitions()
        fan = math.isqrt(tasks) if tasks > 64 else 1
        sent = docs.mapInArrow(_count_slots(shared, fan, dense_bytes), f"{_COUNTS}, salt long")
        if fan > 1:
            sent = sent.groupBy("lang", "source", "shard", "salt").applyInArrow(_summed, _COUNTS)
        return sent.groupBy("lang", "source", "shard").applyInArrow(_summed, _COUNTS)
    terms = docs.mapInArrow(_occurrences, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    known = terms.join(sizes.select("lang", "of", "blocks"), "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("of")).alias("shard"), F.pmod(F.xxhash64("source"), F.col("blocks")).alias("b"), "blocks")
    again = shards.join(sizes.select("lang", "blocks"), "lang").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("of", "bytes", "blocks")
    again = again.withColumnsRenamed({k: f"its_{k}" for k in ("lang", "shard", "b")})
    return known.groupBy("lang", "shard", "b").cogroup(again.groupBy("its_lang", "its_shard", "its_b")).applyInArrow(_join_slots, _COUNTS)


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, slots: int = SLOTS, sources: int = SOURCES, broadcast_bytes: int = BROADCAST_BYTES, dense_bytes: int = DENSE_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergences of each group, largest first."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), utf8(F.col(text)).alias("text"))
    held = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = materialize(held.where(F.col("n") >= least).select("lang", "term", F.xxhash64("term").alias("h")), "terms")
    groups = docs.select("lang", "source").distinct()
    groups = materialize(groups, "groups")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("g")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    v = F.coalesce("v", F.lit(0))
    sizes = materialize(sizes.select("lang", v.alias("v"), F.greatest(F.lit(1), F.ceil(v / slots)).alias("of"), F.ceil(F.col("g") / sources).alias("blocks")), "languages")
    sharded = kept.join(sizes, "lang").select("lang", "term", "h", "of", F.pmod("h", F.col("of")).alias("shard"))
    shards = materialize(sharded.groupBy("lang", "shard").applyInArrow(_build, "lang string, shard long, of long, n long, bytes long, sizes array<long>, bits binary, keys array<binary>"), "shards")

    counts = materialize(_occurring(docs, shards, sizes, broadcast_bytes, dense_bytes), "counts")
    whole = materialize(counts.groupBy("lang", "shard").applyInArrow(_summed, _COUNTS), "language-counts").drop("source")
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    lang_totals = whole.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang").join(lang_totals, "lang", "left")
    known = materialize(known.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), "v", "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("b")), "totals")

    # Each block of groups meets each other block of its language, shard by shard.
    rows = known.join(shards.select("lang", "shard"), "lang").join(counts.select("lang", "source", "shard", "slots", "counts"), ["lang", "source", "shard"], "left")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = rows.withColumn("b2", other).withColumnRenamed("b", "b1").withColumn("side", F.lit(0))
    right = rows.withColumn("b1", other).withColumnRenamed("b", "b2").withColumn("side", F.lit(1))
    blocks = shards.join(whole.select("lang", "shard", "slots", "counts"), ["lang", "shard"], "left").join(sizes.select("lang", "blocks"), "lang")
    blocks = blocks.withColumn("b1", other).withColumn("b2", other).select("lang", "shard", "b1", "b2", "n", "keys", "slots", "counts")
    key = ["lang", "shard", "b1", "b2"]
    blocks = blocks.withColumnsRenamed({k: f"its_{k}" for k in key})
    found = left.unionByName(right).groupBy(*key).cogroup(blocks.groupBy(*[f"its_{k}" for k in key])).applyInArrow(_compare(top), "lang string, source string, part string, item string, value long")
    found = materialize(found, "divergences")

    bare = known.where("v = 0").select("lang", "source")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(none)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top))
