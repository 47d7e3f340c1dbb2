"""Quality rules and line frequency against a plain count."""

import random
from collections import Counter, defaultdict

import pytest

from spindrift.llm import lines

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left"]


def plain(rows, most, per):
    """(all columns, text left) of each row."""
    norm = lambda line: b" ".join(line.split()).lower()
    by_line, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        t = (t or "").encode()
        for line in t.split(b"\n"):
            if line.split():
                by_line[s, norm(line)].add(t)
                texts[s].add(t)
    out = []
    for i, t, s in rows:
        t = (t or "").encode()
        words = t.split()
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        own = [x for x in t.split(b"\n") if x.split()]
        gone = {x for x in own if (n := len(by_line[s, norm(x)])) > most and n * per > len(texts[s])}
        left = sum(len(x.split()) for x in own if x not in gone)
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        kept = not failed and left >= 10 and 100 * left >= 20 * len(words)
        cells = (i, len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t.decode()), len(own) - len(set(own)), len(again), failed, kept, left)
        out.append((cells, b"\n".join(x for x in t.split(b"\n") if x not in gone).decode()))
    return out


def made():
    rng = random.Random(3)
    common = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 30))) for _ in range(12)]
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\x0b\n", None), (3, "one two", "b"), (None, "é ü# " * 40, None), (None, None, None), (4, "same line here\n" * 30, "a")]
    for i in range(5, 400):
        own = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 4))]
        own += [rng.choice(common) if rng.random() < 0.5 else rng.choice(common).upper() + " " for _ in range(rng.randint(0, 6))]
        rng.shuffle(own)
        rows.append((i % 390, "\n".join(own), rng.choice(["a", "a", "a", "b", "c", None, ""])))
    return rows + [rows[50]] * 40


@pytest.mark.parametrize(("most", "per"), [(10, 1000), (3, 4), (0, 1000)])
def test_rules_equal_plain_count(spark, most, per):
    rows = made()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, host string, content int")
    want = plain(rows, most, per)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, lines.line_rules(df, most=most, per=per).select(*COLUMNS).collect()), key=key) == sorted((r for r, _ in want), key=key)
    left = lines.without_frequent_lines(df, most=most, per=per).collect()
    assert Counter((r["doc_id"], r["text"], r["text_left"] or "") for r in left) == Counter((i, t, x) for (i, t, _), (_, x) in zip(rows, want, strict=True))
    assert {r["text_left"] for r in left if r["text"] is None} == {None}
    assert any(r[7] for r, _ in want) == (most > 0) and any(not r[7] and not r[6] for r, _ in want)


def test_copies_of_a_document_make_no_line_frequent(spark):
    text = "\n".join(" ".join(f"w{k}_{i}" for i in range(10)) for k in range(5))
    df = spark.createDataFrame([(i, text, "a") for i in range(50)], "doc_id long, text string, source string")
    assert {(r["kept"], r["n_left"]) for r in lines.line_rules(df).collect()} == {(True, 50)}
    assert lines.line_rules(df.where("false")).collect() == []
