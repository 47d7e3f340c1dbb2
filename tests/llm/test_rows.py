"""The row-by-row operators: media, language, toxicity, SentencePiece."""

import hashlib
import os
import random
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from spindrift.llm import langid, media, queries, toxicity, viterbi

ODD = [(0, None), (1, ""), (2, "  "), (3, "a"), (4, "ä😀 " * 5), (5, "x" * 30000), (5, "x" * 30000), (6, "1 2 3")]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, "en" if i % 2 else "de", "s", 0, "clash", 1) for i, t in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, media string, score int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, i % 2) for i, _ in ODD], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_media_query(spark, folder):
    got = queries.op1_media(spark, folder).collect()
    assert len(got) == len(ODD)
    for r in got:
        data = (dict(ODD)[r["doc_id"]] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or 0 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        whole = media.write_samples(payload)
        assert plain_samples(whole) == payload and r["media_bytes"] == len(whole) and r["media_sha256"] == hashlib.sha256(whole).hexdigest()


def test_media_tables():
    payload = os.urandom(576 * 41)
    whole = media.write_samples(payload)
    assert media.read_samples(whole) == payload
    track = media.describe(whole)["tracks"][0]
    assert (track["codec"], track["duration"], track["n_samples"], track["n_keyframes"]) == ("raw ", 576 * 41, 41, 3)
    for k, r in enumerate(track["keyframes"]):
        assert whole[r["offset"] : r["offset"] + r["size"]] == payload[k * 16 * 576 : (k * 16 + 1) * 576]


def test_damaged_media():
    whole = media.write_samples(os.urandom(576 * 9))
    assert media.describe(whole[:-5])["error"] and media.describe(b"")["error"] and media.describe(b"\0\0\0\4moov")["error"]
    rng = random.Random(1)
    for _ in range(300):
        bad = bytearray(whole)
        for _ in range(3):
            bad[rng.randrange(650)] = rng.randrange(256)
        assert isinstance(media.describe(bytes(bad))["tracks"], list)
    payload = whole[-576 * 9 :]
    assert media.read_samples(whole) == payload


def plain_samples(data):
    """The samples of a container with one track of fixed sample sizes, found without the operator's reader."""

    def inside(kind, start, end):
        while start < end:
            size, name = struct.unpack_from(">I4s", data, start)
            if name == kind:
                return start + 8, start + size
            start += size
        raise AssertionError(kind)

    at = 0, len(data)
    for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        at = inside(kind, *at)
    table = {k: inside(k, *at)[0] + 4 for k in (b"stsz", b"stsc", b"stco")}
    size, n = struct.unpack_from(">2I", data, table[b"stsz"])
    chunks = struct.unpack_from(f">{struct.unpack_from('>I', data, table[b'stco'])[0]}I", data, table[b"stco"] + 4)
    runs = list(struct.iter_unpack(">3I", data[table[b"stsc"] + 4 :][: 12 * struct.unpack_from(">I", data, table[b"stsc"])[0]]))
    out = []
    for i, offset in enumerate(chunks):
        each = [count for first, count, _ in runs if first <= i + 1][-1]
        out.append(data[offset : offset + each * size])
    assert sum(map(len, out)) == n * size
    return b"".join(out)


@pytest.mark.parametrize("frames", [1, 7, 8, 9, 41])
def test_stored_media_by_an_independent_reader(frames):
    payload = os.urandom(576 * frames)
    assert plain_samples(media.write_samples(payload)) == payload


def test_hostile_media(spark):
    nested = b""
    for _ in range(1500):
        nested = struct.pack(">I4s", 8 + len(nested), b"moov") + nested
    assert "deeper" in media.describe(nested)["error"] and media.read_samples(nested) is None
    whole = bytearray(media.write_samples(os.urandom(576 * 9)))
    huge, outside = bytearray(whole), bytearray(whole)
    at = whole.index(b"stsz") + 8
    huge[at : at + 8] = struct.pack(">2I", 576, 2**32 - 1)
    assert "stsz" in media.describe(bytes(huge))["error"] and media.read_samples(bytes(huge)) is None
    at = whole.index(b"stco") + 12
    outside[at : at + 4] = struct.pack(">I", len(whole) - 10)
    assert "outside" in media.describe(bytes(outside))["error"] and media.read_samples(bytes(outside)) is None
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([nested, huge, outside, whole])] + [(4, None)], "id long, content binary")
    got = {r["id"]: r for r in media.media_columns(df, samples="payload").collect()}
    assert [got[i]["payload"] is None for i in range(5)] == [True, True, True, False, True] and got[4]["media"] is None


def test_media_columns(spark):
    df = spark.createDataFrame([(1, None, "kept"), (2, bytearray(b"junk"), "kept"), (3, bytearray(media.write_samples(b"a" * 576)), "kept")], "id long, content binary, media string")
    got = {r["id"]: r["media"] for r in media.media_columns(df).collect()}
    assert got[1] is None and got[2]["error"] and got[3]["tracks"][0]["n_samples"] == 1


def test_language_equals_compressing_with_each_dictionary(spark):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 4 <> 2"))
    texts = [t for _, t, _ in rows[:20]] + ["ka", "ka " * 5000, "QX zz!!", "kato sch", None, "", "12 34"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        reduced = re.sub(r"[^a-z]+", " ", (texts[r["doc_id"]] or "").lower())
        if not reduced.strip():
            assert (r["lang_pred"], r["accepted"]) == ("und", False)
            continue
        data, sizes = reduced.encode(), {}
        for name, content in model.dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(data[i : i + model.block])) for i in range(0, len(data), model.block))
        least = min(sizes.values())
        assert r["lang_pred"] == next(k for k in model.dictionaries if sizes[k] == least)  # ties: the language of most rows
        lead = sorted(sizes.values())[1] - least
        assert r["accepted"] == (lead > 0 and lead / max(1, least) >= langid.MIN_MARGIN)


def test_one_language_only(spark):
    rows = [(i, f"some words of one language {i}", "xx") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["accepted"]) for r in langid.predict(df, langid.train(df)).collect()} == {("xx", True)}


def language_rows():
    rng = random.Random(4)
    syllables = {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "und", "ein", "vor"]}
    return [(i, " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(60)), k) for i, k in enumerate(["xx", "yy"] * 60)]


def test_language(spark):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 80"))
    got = langid.predict(df.withColumn("score", F.lit("old")), model).where("doc_id >= 80").collect()
    assert all(r["lang_pred"] == r["lang"] and r["accepted"] and 0 <= r["score"] <= 1 for r in got)
    odd = langid.predict(spark.createDataFrame(ODD, "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in odd} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert langid.train(df.where("false")).dictionaries == {} and langid.predict(df.where("false"), model).count() == 0
    none = langid.predict(df.limit(2), langid.LanguageModel()).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_language_sizes_are_those_of_zstandard():
    c = langid.Classifier(langid.LanguageModel({"a": b"hello world " * 20, "b": b"guten tag " * 20}, level=6, block=50))
    data = b"hello world and guten tag " * 9
    for (_, _), own, d in zip(c.compressors, c.sizes(data), (b"hello world " * 20, b"guten tag " * 20), strict=True):
        z = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        assert abs(sum(len(z.compress(data[i : i + 50])) for i in range(0, len(data), 50)) - own) <= 12


def test_toxicity(spark):
    rng = random.Random(6)
    clean = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(700):
        w = [rng.choice(clean) for _ in range(40)]
        if toxic := int(i % 7 == 0):
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["scum", "vilestem" + rng.choice("abcdefgh")])
        rows.append((i, " ".join(w), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 500"))
    got = toxicity.predict(df.withColumn("predicted", F.lit("old")), model).where("doc_id >= 500").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)
    odd = toxicity.predict(spark.createDataFrame(ODD, "doc_id long, text string"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.train(df.where("toxic = 0")).weights == {} and toxicity.predict(df.where("false"), model).count() == 0


def test_label_model_recovers_planted_voters():
    rng = np.random.default_rng(3)
    truth = (rng.random(4000) < 0.4).astype(float)
    planted = [(0.3, 0.02), (0.25, 0.05), (0.4, 0.03), (0.02, 0.3), (0.05, 0.5), (0.35, 0.01), (0.01, 0.2), (0.3, 0.1)]  # rates under label 1 and 0
    v = np.column_stack([rng.random(4000) < np.where(truth == 1, one, none) for one, none in planted]).astype(float)
    given = np.where(rng.random(4000) < 0.9, truth, 1 - truth)
    v = np.column_stack([v, v[:, 2], given])  # the ninth voter repeats the third
    found = toxicity.label_model(v, given)
    assert np.abs(found.rates[:, :8] - np.array(planted).T[::-1]).max() < 0.05
    right = [max(a * 0.4, b * 0.6) / (a * 0.4 + b * 0.6) for a, b in planted]
    assert np.abs(found.accuracies[:8] - right).max() < 0.07 and abs(found.accuracies[9] - 0.9 * 0.4 / (0.9 * 0.4 + 0.1 * 0.6)) < 0.05
    assert found.repeats[2, 8] > 0.99 and np.abs(found.repeats[:8, :8]).max() < 0.2
    # The voters overrule wrong labels: the posterior is right more often than the labels that it starts from.
    assert ((found.posterior > 0.5) == truth).mean() > (given == truth).mean() + 0.02


def test_toxicity_with_wrong_labels(spark):
    rng = random.Random(8)
    rows, right = [], {}
    for i in range(1500):
        right[i] = int(i % 3 == 0)
        w = [f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(12))}" for _ in range(30)]
        for k in range(5 * right[i]):
            w[k] = "vile" + rng.choice("abcdefghijkl")
        rows.append((i, " ".join(w), 1 - right[i] if rng.random() < 0.08 else right[i]))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 1000"))
    got = toxicity.predict(df.where("doc_id >= 1000"), model).collect()
    assert sum(r["predicted"] == right[r["doc_id"]] for r in got) >= 0.98 * len(got)


def test_repeated_and_contradicting_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 1), (3, 7)], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels).collect()
    assert sorted((r["doc_id"], r["toxic"]) for r in got) == [(1, 1), (2, 0), (2, 1)]


def test_toxicity_and_language_queries_on_odd_rows(spark, folder):
    assert queries.op2_language(spark, folder).count() == len(ODD)
    assert queries.op5_toxicity(spark, folder).count() == len(ODD)
    assert queries.op8_sentencepiece(spark, folder).where("round_trip").count() == len(ODD)


def best_score(v, text, lost):
    best = [0.0] + [-1e300] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            if text[s:e] in v.pieces:
                best[e] = max(best[e], best[s] + v.pieces[text[s:e]][1])
        if text[e - 1] not in v.pieces:
            best[e] = max(best[e], best[e - 1] + lost)
    return best[-1]


def test_streaming_search_is_optimal_for_any_window():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {c: (i, -rng.randint(3, 9) * 1.0) for i, c in enumerate("abc" + viterbi.SPACE)}
        for _ in range(12):
            pieces.setdefault("".join(rng.choice("abc" + viterbi.SPACE) for _ in range(rng.randint(2, 5))), (len(pieces), -rng.randint(2, 12) * 1.0))
        v = viterbi.Vocabulary(pieces, tuple(range(1000, 1256)), 999)
        e, back = viterbi.Encoder(v), {i: (p, s) for p, (i, s) in pieces.items()}
        text = "".join(rng.choice("aabc d") for _ in range(80))
        marked = viterbi.SPACE + text.replace(" ", viterbi.SPACE)
        want = list(chain.from_iterable(e.stream(marked, len(marked))))
        for window in (0, 1, 7, None):
            assert list(chain.from_iterable(e.stream(marked, window))) == list(chain.from_iterable(e.stream(iter(marked), window))) == want
        assert e.encode(text).tolist() == want and viterbi.Decoder(v).decode(want) == text
        assert sum(back[i][1] if i in back else e.lost for i in want) == best_score(v, marked, e.lost)


def test_merges_equal_those_of_the_library_for_any_window():
    v, library = viterbi.load(), sentencepiece.SentencePieceProcessor(model_file=viterbi.MODEL)
    assert v.merges
    rng, e = random.Random(9), viterbi.Encoder(v)
    alphabets = ["ab", "aeinrst", "etaoinshrdlu   ", "=-_/\\*0189", "äöüß éàç", "漢字かなの", "  \n\t.,", "😀\u0301x"]
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(1, 200))) for a in alphabets for _ in range(25)]
    for text in texts:
        want = library.encode(text)
        assert e.encode(text).tolist() == want, text
        if text:
            marked = viterbi.SPACE + text.replace(" ", viterbi.SPACE)
            for window in (0, 5, None):
                assert list(chain.from_iterable(e.stream(marked, window))) == list(chain.from_iterable(e.stream(iter(marked), window))) == want


def test_every_text_goes_through_the_search_and_long_ones_are_committed_on_the_way(monkeypatch):
    v = viterbi.load()
    e, searched = viterbi.Encoder(v), []
    stream = e.stream
    monkeypatch.setattr(e, "stream", lambda text: searched.append(text) or stream(text))
    text = "some words, and a_word_that_never_ends" + "abcdefghij" * 300
    ids = e.encode(text)
    assert "".join(searched) == viterbi.SPACE + text.replace(" ", viterbi.SPACE) and ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=viterbi.MODEL).encode(text)
    read, longest = [], max(searched, key=len)
    found = stream(read.append(c) or c for c in longest)
    for _ in range(5):
        assert next(found)
    assert len(read) < 400 < len(longest)


def test_round_trip_with_the_public_model(spark):
    v = viterbi.load()
    df = spark.createDataFrame(ODD + [(7, "tabs\tand\nlines  ▁ é 漢字 \U0001f600")], "doc_id long, text string").withColumn("ids", F.lit("old"))
    ids = viterbi.encode(df, v)
    back = viterbi.decode(ids.drop("text"), v).collect()
    assert [r["text"] for r in back] == [None if t is None else t.replace("▁", " ") for _, t in ODD] + ["tabs\tand\nlines    é 漢字 \U0001f600"]
    assert viterbi.encode_checked(df.where("false"), v).count() == 0
