"""Operators that join or group: repeated passages, mixing, exact top-k, URL lists, the pipeline."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from spindrift.llm import mixing, phrases, topk, urlfilter


def cut(rows, window):
    words = {i: (t or "").encode().split() for i, t in rows}
    starts = Counter(tuple(w[s : s + window]) for w in words.values() for s in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if starts[tuple(w[s : s + window])] > 1:
                gone |= set(range(s, s + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "seed", "shard"), [(35, 8, 6 << 20), (35, 8, 2000), (6, 2, 900)])
def test_repeated_passages_equal_brute_force(spark, window, seed, shard):
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(window - 2, 2 * window))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "same " * 3 * window), (4, "a b " * window)]
    for i in range(5, 60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 3 * window))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            w[(k := rng.randint(0, len(w))) : k] = p[a:] if rng.random() < 0.5 else p
        rows.append((i, rng.choice([" ", "\n", "\x0b "]).join(w)))
    rows += [(100, rows[10][1]), (101, "é\x85 x\xa0y " * 80)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: tuple(r)[1:4] for r in phrases.remove_repeated(df, window=window, seed=seed, shard_bytes=shard).collect()}
    assert got == cut(rows, window)


def test_repeated_passages_of_rows_that_share_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(6))
    rows = [(1, f"a {passage}"), (1, f"b {passage} c"), (1, "d"), (1, "d"), (2, "e f g h i j k")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = phrases.remove_repeated(df, window=6, seed=2).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == Counter([(1, "a"), (1, "b c"), (1, "d"), (1, "d"), (2, "e f g h i j k")])


def test_memory_of_near_copies_grows_in_proportion():
    def peak(n):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(300)]
        texts = []
        for _ in range(n):
            w = list(base)
            for _ in range(3):
                w[rng.randrange(300)] = f"x{rng.random()}"
            texts.append(" ".join(w).encode())
        texts = pa.array(texts, pa.binary())
        x = phrases.Words(texts, 35)
        at = np.flatnonzero(x.valid)
        hashes, times = np.unique(x.hashes(at), return_counts=True)
        found = x.text(np.unique(x.picks(8)[1][at]), 8)
        tracemalloc.start()
        gone = phrases.covered(x, hashes[times > 1], found, 8)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert gone.mean() > 0.5
        return most

    assert peak(800) < 2.5 * peak(400)


def test_only_what_the_automaton_finds_is_removed(monkeypatch):
    rng = random.Random(4)
    passages = [[f"p{k}_{i}" for i in range(8)] for k in range(3)]
    texts = [" ".join([f"w{rng.random()}" for _ in range(5)] + p + [f"v{rng.random()}"]) for p in passages for _ in range(2)]
    x = phrases.Words(pa.array([t.encode() for t in texts], pa.binary()), 6)
    at = np.flatnonzero(x.valid)
    hashes, times = np.unique(x.hashes(at), return_counts=True)
    repeated, picked = hashes[times > 1], x.picks(2)[1]
    words = [sorted({w for w in x.text(np.unique(picked[a : a + 3]), 2)}) for a in (5, 33, 61)]  # of the windows in each passage
    assert sum(phrases.covered(x, repeated, [w for ws in words for w in ws], 2)) == 48
    for k in range(3):
        gone = phrases.covered(x, repeated, words[k], 2)
        assert np.flatnonzero(gone).tolist() == [28 * k + a + i for a in (5, 19) for i in range(8)]
    assert not phrases.covered(x, repeated, [" p0_0 p1_1 ", " nothing here "], 2).any() and not phrases.covered(x, repeated, [], 2).any()
    assert not phrases.covered(x, np.sort(hashes[times == 1])[:0], words[0], 2).any()
    monkeypatch.setattr(phrases, "_hits", lambda x, found: np.zeros(len(x.words), bool))
    assert not phrases.covered(x, repeated, [w for ws in words for w in ws], 2).any()


def test_repeated_passages_of_no_rows(spark):
    assert phrases.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def reference_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[n] for n in open_)
        full = {n for n in open_ if level * w[n] > most * sizes[n]}
        if not full:
            return out | {n: level * w[n] for n in open_}
        for n in full:
            out[n] = most * sizes[n]
            left -= out[n]
        open_ -= full
    return out


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 7, 20, 111, 400])), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(900)]
    rows += [(20000 + i, "hot " * 50, "a") for i in range(1500)] + [(9999, None, "empty"), (9999, None, "empty")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    want = reference_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9) and abs(taken[s] - want[s]) <= 1.0
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect())) == sorted(map(tuple, got))
    assert mixing.mix(df.where("false")).count() == 0


def test_mixing_takes_no_document_more_than_twice_and_the_budget_that_can_be_fitted(spark):
    rows = [(1, "a " * 5, "s"), (1, "a " * 5, "s"), (1, "b " * 7, "s"), (2, "c " * 3, "s"), (None, "d " * 11, "t"), (None, "d " * 11, "t"), (3, "e " * 90, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    for source in {s for _, _, s in rows}:
        own = [(i, len(t.split())) for i, t, s in rows if s == source]
        total, target = sum(n for _, n in own), next(r["target"] for r in got if (r["doc_id"], r["size"]) == own[0])
        whole = int(target // total)
        sums = {0}
        for _, n in own:
            sums |= {s + n for s in sums}
        taken = sum(r["taken"] for r in got if (r["doc_id"], r["size"]) in own)
        assert taken == whole * total + max(s for s in sums if s <= round(target - whole * total))


def test_fit_reaches_every_budget_that_can_be_reached():
    rng = random.Random(3)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(2, 40), 5)))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        for budget in range(0, int((lengths * counts).sum()) + 2, 7):
            best = max(s for s in sums if s <= budget)
            assert (mixing.knapsack(lengths, counts, budget) * lengths).sum() == best
            chosen = mixing.fit(lengths, counts, budget)
            assert (chosen <= counts).all() and (chosen * lengths).sum() <= budget


def test_fit_takes_documents_longer_than_the_knapsack():
    def sums(lengths, counts, budget):
        return (mixing.fit(lengths := np.array(lengths), np.array(counts), budget) * lengths).sum()

    assert sums([60001, 60002, 60003, 60004, 60005], [1] * 5, 150000) == 120009
    assert sums([70000, 100000], [3, 2], 245000) == 240000
    assert sums([100, 1000000], [1000, 1], 1050000) == 1050000  # the share of the long one is 0, and it fits no more after the others'
    rng = random.Random(4)
    for _ in range(20):
        lengths, counts = sorted(rng.sample(range(33000, 200000), 6)), [rng.randint(1, 3) for _ in range(6)]
        found = {0}
        for n, c in zip(lengths, counts, strict=True):
            found = {s + k * n for s in found for k in range(c + 1)}
        for budget in rng.sample(range(max(found)), 3):
            best, got = max(s for s in found if s <= budget), sums(lengths, counts, budget)
            assert got <= budget and (got == best if budget <= 4 * min(lengths) else budget - got < max(lengths))


@pytest.mark.parametrize(("group", "block", "queries"), [(64, 16, 16), (100, 100, 300), (16384, 4096, 8192)])
def test_top_k_equals_brute_force(spark, group, block, queries):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(700, 6)) * rng.choice([0.1, 1, 5], size=(700, 1))).round(2)
    x[300:420] = x[0]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (920, [1.0, None], "x"), (940, [float("nan")] * 6, "x"), (960, [1.0], "x"), (980, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = topk.inner_top_k(df, topk.F.col("vec_id") % 20 == 0, group=group, block=block, queries=queries).collect()
    whole = {i: np.pad(np.floor(64 * np.array(v)), (0, 6 - len(v))).astype(int) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        scores = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:20]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.inner_top_k(df.where("false"), topk.F.lit(True)).count() == 0
    few = topk.inner_top_k(df.where("vec_id < 3"), topk.F.lit(True)).collect()
    assert len(few) == 6


@pytest.mark.parametrize("scale", [2**20, 2**29, 2**31, 2**55, 2**70])
def test_top_k_of_large_components_equals_exact_integers(spark, scale):
    rng = random.Random(scale)
    rows = [(i, [rng.uniform(-1, 1) * scale / 64 for _ in range(3)]) for i in range(120)] + [(200, [0.0]), (201, [1.7e308, -1.7e308])]
    got = topk.inner_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), topk.F.col("vec_id") % 10 == 0, k=7, group=40, block=20, queries=8).collect()

    def cut(x):
        return max(-(2**63) + 1, min(2**63 - 1, x))

    def long(x):
        return max(-(2**63), min(2**63 - 1, math.floor(x))) if math.isfinite(x) else (2**63 - 1 if x > 0 else -(2**63))

    whole = {i: [long(64.0 * x) for x in v] + [0] * (3 - len(v)) for i, v in rows}
    want = []
    for q in (i for i in whole if i % 10 == 0):
        scores = sorted((-cut(sum(a * b for a, b in zip(whole[q], whole[c], strict=True))), c) for c in whole if c != q)[:7]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_empty_vectors_and_shared_ids(spark):
    rows = [(0, []), (1, []), (2, [])]
    got = topk.inner_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), topk.F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    rows = [(0, [1.0]), (0, [-1.0]), (1, [1.0]), (1, [2.0])]
    got = topk.inner_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), topk.F.col("vec_id") == 0, k=1).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, -4096), (0, 1, 1, 8192)]


def test_url_lists(spark):
    log = [("example.com", "spam", "add", 10), ("example.com", "spam", "add", 12), ("example.com", "spam", "remove", 20), ("example.com", "spam", "add", 30), ("a.b.org/x/y", "adult", "add", 0), ("b.org", "bad", "add", 5), ("b.org", "bad", "remove", 5), (None, "bad", "add", 0), ("idle.org", "bad", "remove", 0)]
    urls = [(1, "HTTP://u:p@Www.Example.COM.:80/q?x", t) for t in (9, 10, 19, 20, 29, 30, 99)] + [(2, "https://a.b.org/x/y/z#f", 3), (3, "https://a.b.org/x/yz", 3), (4, None, 3), (5, "no url", 3), (6, "http://notexample.com/", 15), (7, "http://example.com", None), (2, "https://a.b.org/x/y/z#f", 3)]
    df = spark.createDataFrame([(*u, "x") for u in urls], "page_id long, url string, fetched_at int, blocked string")
    got = urlfilter.evaluate(df, spark.createDataFrame(log, "key string, category string, action string, at int")).collect()
    assert len(got) == len(urls)
    assert {r["fetched_at"]: r["blocked"] for r in got if r["page_id"] == 1} == {9: False, 10: True, 19: True, 20: False, 29: False, 30: True, 99: True}
    assert {r["page_id"]: r["categories"] for r in got if r["page_id"] != 1} == {2: ["adult"], 3: [], 4: [], 5: [], 6: [], 7: []}


def test_url_lists_of_deep_paths(spark):
    deep = "a.org/" + "/".join("abcdefghi")
    log = spark.createDataFrame([(deep, "bad", "add", 0), ("b.org", "bad", "add", 0)], "key string, category string, action string, at int")
    urls = [(1, f"http://{deep}", 3), (2, f"http://{deep}/j?q", 3), (3, f"http://{deep}j", 3), (4, "http://a.org/a/b", 3), (5, "http://x.b.org/1/2", 3)]
    df = spark.createDataFrame(urls, "page_id long, url string, fetched_at int")
    assert {r["page_id"]: r["matched"] for r in urlfilter.evaluate(df, log).collect()} == {1: [deep], 2: [deep], 3: [], 4: [], 5: ["b.org"]}
    assert urlfilter.evaluate(df, log.where("key = 'b.org'")).where("blocked").count() == 1
    assert urlfilter.evaluate(df, log.where("false")).where("blocked").count() == 0


def test_repeated_passages_with_null_ids(spark):
    passage = " ".join(f"p{i}" for i in range(8))
    rows = [(None, f"a {passage}"), (None, f"b b {passage} c"), (1, f"d {passage}"), (None, None), (None, f"a {passage}"), (2**63 - 1, "one two"), (-(2**63), "x")]
    for shard in (6 << 20, 30):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = phrases.remove_repeated(df, window=6, seed=2, shard_bytes=shard).collect()
        want = [(None, ""), (None, ""), (None, "b b c"), (1, "d"), (None, ""), (2**63 - 1, "one two"), (-(2**63), "x")]
        assert Counter((r["doc_id"], r["kept"]) for r in got) == Counter(want)


def test_near_duplicates_with_null_ids(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, text + " end"), (4, text), (None, other), (None, other), (None, None), (6, "short")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == Counter([(4, text), (None, other), (None, None), (6, "short")])


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    parts = {"en": ["the", "of", "and", "to", "in", "tion", "ing"], "de": ["der", "und", "ein", "sch", "ver", "keit"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(80)), lang, f"s{i % 3}", 0))
    rows += [(100, rows[4][1], "de", "s0", 0), (101, rows[4][1] + " keit", "de", "s1", 0), (102, None, "en", None, 0), (103, "123 456", "en", "s0", 0), (104, "mail me at someone@example.org please the of and to in", "en", "s0", 0)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in stages["language_id"](spark, docs, folder).collect()}
    assert set(range(60)) <= kept and not kept & {102, 103}
    single = stages["near_duplicates"](spark, docs, folder)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == set(range(60)) | {102, 103, 104}
    clean = {r["doc_id"]: r for r in stages["personal_data"](spark, docs, folder).collect()}
    assert len(clean) == len(rows) and clean[104]["text"].startswith("mail me at <EMAIL> please") and clean[104]["n_chars"] == len(clean[104]["text"])
    mixed = stages["source_mix"](spark, docs, folder)
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    odd = spark.createDataFrame([(None, "one two three", "en", "s0", 0), (None, None, None, None, 0), (1, "same words here", "en", "s0", 0), (1, "same words here", "en", "s0", 0), (2, "other", None, "s1", 0)], docs.schema)
    often = Counter(tuple(r) for r in stages["source_mix"](spark, odd, folder).collect())
    assert set(often) <= {tuple(r) for r in odd.collect()} and max(often.values()) <= 4 and (None, "one two three", "en", "s0", 0) in often
    out = corpus_pipeline.run(spark, folder)
    assert out.where("not round_trip").count() == 0 and out.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_odd_rows_and_clashing_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    columns = "doc_id long, text string, lang string, source string, n_chars long, size long, sig long, content string, __column string, component_id string, score double"
    rest = (1, 2, "c", "d", "e", 0.5)
    long = "word " * 30000
    text = "the quick brown fox jumps over the lazy dog and runs away into the dark forest"
    rows = [(1, text, "en", "s", 0, *rest), (1, text, "en", "s", 0, *rest), (None, text, None, None, None, *rest), (None, None, "en", "s", 0, *rest), (2, "", "de", "t", 0, *rest), (3, long, "en", "s", 0, *rest), (4, " \x0b", "de", None, 0, *rest)]
    df = spark.createDataFrame(rows, columns)
    assert stage(spark, df.where("false"), "").count() == 0
    out = stage(spark, df, "").collect()
    assert name == "token_ids" or all(list(r.asDict()) == df.columns for r in out)
    texts = Counter((r["doc_id"], r["text"]) for r in out) if name != "token_ids" else None
    if name == "near_duplicates":
        assert texts == Counter([(1, text), (None, None), (2, ""), (3, long), (4, " \x0b")])
    if name == "personal_data":
        assert texts == Counter((r[0], r[1] or "") for r in rows) or texts == Counter((r[0], r[1]) for r in rows)
    if name == "source_mix":
        assert set(texts) <= {(r[0], r[1]) for r in rows} and (3, long) in texts
    if name == "token_ids":
        assert len(out) == len(rows) and all(r["round_trip"] in (True, None) for r in out)


def test_hosts_of_addresses_and_users(spark):
    urls = {
        "http://[2001:db8::1]/a": "[2001:db8::1]", "http://[2001:DB8::2]:80/b": "[2001:db8::2]", "http://x@[::1]:1?q": "[::1]", "http://user:p@ss@h.org/x": "h.org", "http://h.org?a@b": "h.org",
        "http://h.org/a@b.com": "h.org", "HTTP://Ex.COM.:8080": "ex.com", "http://1.2.3.4:9/": "1.2.3.4", "http:///a": None, "http://@": None, "http://a:b@c.d": "c.d", "nothing": None, None: None,
    }
    df = spark.createDataFrame([(u, 5) for u in urls], "url string, fetched_at int")
    assert {r[0]: r[1] for r in df.select("url", urlfilter.host(df["url"])).collect()} == urls
    log = spark.createDataFrame([(k, "c", "add", 0) for k in ("EX.com", "3.4", "4", "[2001:db8::1]", "H.org/x", "h.org/A")], "key string, category string, action string, at int")
    found = {r["url"]: r["matched"] for r in urlfilter.evaluate(df, log).collect()}
    assert {u: m for u, m in found.items() if m} == {"http://[2001:db8::1]/a": ["[2001:db8::1]"], "HTTP://Ex.COM.:8080": ["ex.com"], "http://user:p@ss@h.org/x": ["h.org/x"]}


def test_rows_without_an_id_are_mixed_from_many_buckets(spark):
    df = spark.createDataFrame([(None, "a b", "s")] * 3000 + [(None, "c " * 40, "t")] * 100, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sum(r["taken"] for r in got if r["size"] == 2) == pytest.approx(next(r["target"] for r in got if r["size"] == 2), abs=2)
