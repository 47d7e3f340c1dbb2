"""The divergence audit against plain counts, and the perfect hashes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import divergence
from spindrift.llm.perfect import Shard


def plain(rows, least=3, top=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in terms]
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        own[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {}
        for s, c in own.items():
            d = sum(c.values()) + len(kept)
            p[s] = {t: 1 + 10**9 * (n + 1) // d for t, n in c.items()}
        for s in own:
            if s is None:
                continue
            pairs = [("pair", o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o is not None and o != s]
            terms = [("term", t, (p[s][t] - p[None][t]) ** 2 // p[None][t]) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, n in ((pairs, None), (terms, top)):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, i + 1) for i, r in enumerate(part[:n])]
    return sorted(out)


def made():
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "abcé" for b in "xyü" for c in ("", "q", "日本", "zz")]
    rows = [(None, None, None), ("", "xx", "s"), ("12 3!", "yy", "s"), ("a b c", "yy", "t"), ("Rare words here", None, "s1"), ("a" * 5000 + " b" * 4000, "en", "s1")]
    for _ in range(300):
        text = " ".join(rng.choice(words[: rng.choice([4, 20, len(words)])]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 40)))
        rows.append((text.replace(" ", rng.choice([" ", "-", "_7\n"])), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "é", "", None, "s9"])))
    return rows + [rows[30]] * 5


@pytest.mark.parametrize("form", [{}, {"slots": 5, "sources": 2, "dense_bytes": 1}, {"slots": 7, "sources": 1, "broadcast_bytes": -1}, {"least": 40, "top": 3}])
def test_divergences_equal_plain_counts(spark, form):
    rows = made()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, shard string").repartition(70 if "dense_bytes" in form else 3)
    got = [tuple(r) for r in divergence.divergence(df, **form).collect()]
    assert sorted(got) == plain(rows, form.get("least", 3), form.get("top", 200))
    assert divergence.divergence(df.where("false"), **form).count() == 0


def test_perfect_hashes_are_minimal_and_know_their_keys():
    keys = [f"k{i}".encode() for i in range(5000)]
    hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
    hashes[7] = hashes[11] = hashes[13]  # equal hashes of different keys
    shard = Shard(*Shard.build(pa.array(keys, pa.binary()), hashes))
    assert sorted(shard.slots(pa.array(keys, pa.binary()), hashes).tolist()) == list(range(5000))
    assert [shard.keys[i].as_py() for i in shard.slots(pa.array(keys, pa.binary()), hashes).tolist()] == keys
    assert (shard.slots(pa.array([b"no"] * 5000, pa.binary()), hashes) == -1).all()
    none = Shard(*Shard.build(pa.array([], pa.binary()), np.zeros(0, np.uint64)))
    assert none.slots(pa.array([b"a"], pa.binary()), np.ones(1, np.uint64)).tolist() == [-1]


def test_hashes_are_those_of_spark(spark):
    terms = ["", "a", "é" * 40, "x" * 31, "日本" * 9]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.xxhash64("t")).collect()]
    assert divergence._hashes(pa.array([t.encode() for t in terms], pa.binary())).view(np.int64).tolist() == got


def test_probabilities_are_exact():
    counts = np.array([0, 1, 10**9, 10**13, 12345678901234], np.int64)
    for total, v in ((int(counts.sum()), 7), (10**14, 10**9), (3 * 10**13, 1)):
        assert divergence.probability(counts, total, v).tolist() == [1 + 10**9 * (int(c) + 1) // (total + v) for c in counts]
