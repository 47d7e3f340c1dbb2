import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import partenum


def brute(rows, n, num, den):
    def words(t):
        return (t or "").encode().lower().split()

    def sets(w):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    found = {i: sets(words(t)) for i, t in rows}
    up = {i: i for i in found}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(found)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if found[a] and found[b]:
                both = len(found[a] & found[b])
                if den * both >= num * (len(found[a]) + len(found[b]) - both):
                    lo, hi = sorted((root(a), root(b)))
                    up[hi] = lo
    return {i: (len(found[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], []
    for i in range(260):
        if base and rng.random() < 0.7:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w = w[: rng.randrange(1, len(w) + 1)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 90, 200]))]
        base.append(w)
        rows.append((i * 3, rng.choice([" ", "\t", "\n "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows + [(5001, None), (5002, ""), (5003, " \n"), (5004, "word " * 3000)]


@pytest.mark.parametrize(("n", "num", "den", "seed"), [(3, 9, 10, 1), (5, 4, 5, 2)])
@pytest.mark.parametrize(("first", "block"), [(4, 2048), (0, 3), (1, 7)])
def test_components_equal_brute_force(spark, monkeypatch, n, num, den, seed, first, block):
    monkeypatch.setattr(partenum, "FIRST", first)
    monkeypatch.setattr(partenum, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, sig int, component_id string")
    got = {r[0]: (r[1], r[2]) for r in partenum.jaccard_components(df, partenum.Threshold(n, num, den)).collect()}
    assert got == brute(rows, n, num, den)


def test_null_ids_keep_links(spark):
    words = [f"w{i}" for i in range(200)]
    text, near, far = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:-1], "x"])
    lone = " ".join(f"z{i}" for i in range(100))
    rows = [(None, near), (7, text), (9, far), (None, near), (None, lone), (None, lone + " end"), (None, None), (2**63 - 1, "top"), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, partenum.jaccard_components(df, partenum.Threshold(3, 19, 20)).collect()), key=str)
    want = [(None, 198, 7), (7, 198, 7), (9, 198, 7), (None, 198, 7), (None, 98, None), (None, 99, None), (None, 0, None), (2**63 - 1, 1, 2**63 - 1), (3, 1, 3)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert partenum.jaccard_components(df).collect() == []


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (19, 20), (1, 2)])
def test_similar_sizes_sign_one_instance_that_tolerates_their_differences(num, den):
    threshold = partenum.Threshold(3, num, den)
    sizes = np.arange(900)
    signs = [{} for _ in sizes]
    for rows, number, k in partenum.instances(sizes, threshold):
        for row, i, most in zip(rows.tolist(), number.tolist(), k.tolist(), strict=True):
            signs[row][i] = most
    for a in range(1, 400):
        for b in range(a, a * den // num + 1):
            assert any(signs[a][i] == signs[b][i] >= threshold.differences(a + b) for i in signs[a].keys() & signs[b].keys())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([(9, 10), (4, 5)]))
def test_similar_sets_share_a_signature_and_pass_the_bound(seed, ratio):
    rng = random.Random(seed)
    threshold = partenum.Threshold(1, *ratio)
    base = [f"a{i}" for i in range(rng.choice([5, 20, 90, 300, 2000]))]
    texts = []
    for _ in range(8):
        edits = rng.randrange(1 + len(base) // 4)
        words = [w for w in base if rng.random() > edits / len(base) / 2] + [f"b{rng.random()}" for _ in range(edits // 2)]
        texts.append(" ".join(words).encode())
    sets = partenum.Sets(pa.array(texts, pa.binary()), 1)
    sigs, rows = partenum.signatures(sets, threshold)
    own = [set(sigs[rows == i].tolist()) for i in range(8)]
    bounds = partenum.Bounds(sets.sizes, pa.array(partenum.sketches(sets, threshold), pa.binary()))
    for a in range(8):
        for b in range(a + 1, 8):
            if threshold.similar(sets[a], sets[b]) and (sets.sizes[a] != sets.sizes[b] or (sets[a] != sets[b]).any()):
                assert own[a] & own[b]
                assert bounds.possible(np.array([a]), np.array([b]), threshold).all()


def test_large_group_just_under_the_threshold(spark):
    # 120 copies, each with four words of its own: 4 * 3 of 198 shingles differ on either side, 186 / 210 < 0.9 are shared.
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in range(4):
            words[10 + 50 * k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    words = rows[7][1].split()
    words[199] = "end"
    rows.append((500, " ".join(words)))
    got = partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), partenum.Threshold(3, 9, 10)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 7 if i == 500 else i for i, _ in rows}


def test_rows_that_share_an_id(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = [(1, text), (1, other), (1, other), (2, other + " end"), (2, "x"), (3, text + " end"), (4, "y")]
    got = partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), partenum.Threshold(3, 9, 10)).collect()
    assert sorted(map(tuple, got)) == [(1, 98, 1), (1, 98, 1), (1, 98, 1), (2, 1, 2), (2, 99, 1), (3, 99, 1), (4, 1, 4)]
