import hashlib
import re

from spindrift.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None,
    "",
    "write to a.b@c.de, x@y.z_d@e.f or q@r@s.tt; not a@b or @c.d",
    "😀 ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.02.3.255, 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 5  4111111111111111 9",
    "call +1 (386) 555-5132 or +12 345 or +49.30.1234567- and +1+1+1",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2",
    "a" * 60000 + " " + "1." * 30000 + " " + "9" * 50000,
    "x@" + "a." * 20000 + "b",
    "+1 " + "(" * 20000,
]


def test_base_spans_equal_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string")
    got = pii.find(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert [(x["s"], x["k"], x["e"]) for x in r["base"]] == brute(TEXTS[r["id"]]), r["id"]
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_bootstrapping_finds_numbers_in_known_contexts(spark):
    seeds = [f"some words reach me at +1 (555) 555-{1000 + i} any time" for i in range(12)]
    rows = list(enumerate([*seeds, "other words reach me at 555-987-6543 any time", "the year is 2024 and room 555-987-6543 is red"]))
    got = {r["id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = [tuple(x) for x in got[12]["spans"]]
    assert [rows[12][1][s:e] for s, _, e in new] == ["555-987-6543"] and new[0][1] == 3
    assert got[13]["spans"] == []
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows + [(99, None)], "doc_id long, text string")).collect()}
    assert red[12] == "other words reach me at <PHONE> any time" and red[0] == "some words reach me at <PHONE> any time" and red[99] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df).collect() == [] and pii.redact(df).collect() == []


def test_digest(spark):
    df = spark.createDataFrame([(1, TEXTS[2])], "doc_id long, text string")
    r = pii.find(df).select(pii.written(pii.F.col("base")).alias("w")).first()
    assert r["w"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute(TEXTS[2]))
    assert hashlib.sha256(r["w"].encode()).hexdigest()
