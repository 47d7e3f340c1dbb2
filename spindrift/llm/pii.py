"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Patterns with checks find the base spans: e-mail addresses, IPv4 addresses, payment cards and telephone numbers. They
seed a bootstrapping loop over all texts: words with a digit or an at sign are instances, the words around them are
lexical patterns, and the graph of both is scored in rounds. A pattern is as sure as the share of its instances that are
known; an instance is as sure as its patterns together. Instances that end up sure, and have the shape of their kind, are
new spans wherever a sure pattern surrounds them.

Defined results: null and empty texts have no spans; offsets count code points, ends are exclusive; of matches that fail
their check nothing is retried; base spans stay whatever is found beside them, and new spans overlap none of them;
repeated rows have equal results. Columns of the input other than id and text are passed on only by `redact`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")

# The contracts' patterns, written so that a search is linear: a match begins where a run of its first characters does,
# or where the last match ended, and what can't be given back is possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
INSTANCE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

ROUNDS = 3
PATTERN_LEAST = 0.6
"""Least score of a pattern that lends its score to instances."""
INSTANCE_LEAST = 0.8
"""Least score of an instance that is taken as known."""


def places(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t, before, after>>: the matches in text, with the text between them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.from_json(F.lit("[]"), "array<struct<s:int,e:int,t:string,before:string,after:string>>")
    zipped = F.transform(found, lambda t, i: F.struct(t.alias("t"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after")))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["before"])
        e = s + F.length(x["t"])
        row = F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t"), F.right(x["before"], F.lit(80)).alias("before"), F.left(x["after"], F.lit(40)).alias("after"))
        return F.struct(e.alias("at"), F.array_append(acc["out"], row).alias("out"))

    all_of = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), all_of).otherwise(empty)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(kind: str, t: Column) -> Column:
    """Whether a match of the kind's pattern passes the kind's check."""
    if kind == "ip":
        small = lambda p: F.length(p) <= 3
        parts = F.transform(F.split(t, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: small(p) & (F.coalesce(F.when(small(p), p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(t))
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(t))).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(_digits(t))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def shaped(token: Column) -> Column:
    """The kind whose shape an unmatched token has, or null."""
    n = F.length(_digits(token))
    return (
        F.when(token.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+$"), F.lit("email"))
        .when(token.rlike(r"^[0-9]{1,3}([.:-][0-9]{1,3}){3}$"), F.lit("ip"))
        .when(token.rlike(r"^[0-9]([0-9-]*[0-9])?$") & (n >= 12) & (n <= 19), F.lit("card"))
        .when(token.rlike(r"^\(?[0-9][0-9().-]*[0-9]$") & (n >= 7) & (n <= 15), F.lit("phone"))
    )


def base_matches(text: Column) -> Column:
    """array<struct<s, k, e, t, before, after>> of all base spans, by start, then kind; k is the kind's place in KINDS."""

    def of(k: int, kind: str) -> Column:
        found = F.filter(places(text, PATTERNS[kind]), lambda x: passes(kind, x["t"]))
        return F.transform(found, lambda x: F.struct(x["s"], F.lit(k).alias("k"), x["e"], x["t"], x["before"], x["after"]))

    return F.array_sort(F.flatten(F.array(*[of(k, kind) for k, kind in enumerate(KINDS)])))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def read(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, h, base, seen) of each row: base spans, and all other instances, with what surrounds them."""
    docs = df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("h"), base_matches(F.col("text")).alias("base"), places(F.col("text"), INSTANCE).alias("seen"))
    apart = F.filter("seen", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    return materialize(docs.withColumn("seen", F.when(F.size("base") > 0, apart).otherwise(F.col("seen"))), "spans")


def occurrences(rows: DataFrame) -> DataFrame:
    """(id, h, s, e, token, kind, patterns) of every instance; kind is that of a base span, or null."""
    names = F.array(*[F.lit(k) for k in KINDS])
    seeds = rows.select("id", "h", F.explode("base").alias("x")).select("id", "h", "x.s", "x.e", "x.t", "x.before", "x.after", F.get(names, F.col("x.k")).alias("kind"))
    # Brackets, quotes and stops around another token are no part of it.
    open_ = rows.select("id", "h", F.explode("seen").alias("x")).select("id", "h", "x.*", F.lit(None).cast("string").alias("kind"))
    lead = F.length(F.regexp_extract("t", r"^([\"'(\[<]*)", 1))
    inner = F.regexp_replace(F.col("t"), r"^[\"'(\[<]+|[\"')\]>.,;:!?]+$", "")
    open_ = open_.withColumn("s", F.col("s") + lead).withColumn("t", inner).withColumn("e", F.col("s") + F.length("t")).where("e > s")
    x = seeds.union(open_.select(*seeds.columns))
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "9")
    two = plain(F.regexp_extract("before", r"(?:^|\s)(\S+\s+\S+)\s*$", 1))
    one, right = plain(F.regexp_extract("before", r"(?:^|\s)(\S+)\s*$", 1)), plain(F.regexp_extract("after", r"^\s*(\S+)", 1))
    patterns = F.filter(F.array(F.when(two != "", F.concat(F.lit("l2 "), two)), F.when((one != "") & (right != ""), F.concat(F.lit("lr "), one, F.lit(" _ "), right))), lambda p: p.isNotNull())
    return x.select("id", "h", "s", "e", F.lower("t").alias("token"), "kind", patterns.alias("patterns"))


def bootstrap(occ: DataFrame, rounds: int = ROUNDS, pattern_least: float = PATTERN_LEAST, instance_least: float = INSTANCE_LEAST) -> tuple[DataFrame, DataFrame]:
    """(kind, pattern, score) and (kind, token, score) after the last round; both hold what is sure only."""
    edges = materialize(occ.select(F.explode("patterns").alias("pattern"), "token", "kind").groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "graph")
    of_pattern = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("kind is not null").groupBy("token").agg(F.max("kind").alias("kind"))
    shapes = materialize(edges.select("token").distinct().join(seeds, "token", "left_anti").withColumn("kind", shaped(F.col("token"))).where("kind is not null"), "shapes")
    known = seeds.select("kind", "token", F.lit(1.0).alias("score"))
    patterns = None
    for _ in range(rounds):
        votes = edges.select("pattern", "token").join(known, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        # One unseen instance more than there are keeps rare patterns unsure.
        patterns = votes.join(of_pattern, "pattern").select("kind", "pattern", (F.col("sum") / (F.col("n") + 1)).alias("score")).where(F.col("score") >= pattern_least)
        patterns = materialize(patterns, "patterns")
        new = edges.select("pattern", "token").join(patterns, "pattern").join(shapes, ["token", "kind"]).groupBy("kind", "token")
        new = new.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("score")).where(F.col("score") >= instance_least)
        known = materialize(seeds.select("kind", "token", F.lit(1.0).alias("score")).union(new), "instances")
    return patterns, known


def discovered(occ: DataFrame, patterns: DataFrame, known: DataFrame) -> DataFrame:
    """(id, h, found) of rows with new spans: sure instances that no base span covers, in a sure pattern."""
    open_ = occ.where("kind is null").select("id", "h", "s", "e", "token", F.explode("patterns").alias("pattern"))
    hits = open_.join(known.select("token", "kind"), "token").join(patterns.select("pattern", "kind"), ["pattern", "kind"], "left_semi")
    number = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(KINDS.index(k))), KINDS[1:], F.when(F.col("kind") == KINDS[0], F.lit(0)))
    return hits.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("s", number.alias("k"), "e"))).alias("found"))


def find(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, base, spans) of every row: base spans and all spans, as arrays of (s, k, e)."""
    rows = read(df, id, text)
    occ = materialize(occurrences(rows), "occurrences")
    found = discovered(occ, *bootstrap(occ)).withColumnsRenamed({"id": "id_", "h": "h_"})
    base = F.transform("base", lambda x: F.struct(x["s"], x["k"], x["e"])).alias("base")
    out = rows.select("id", "h", base).join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    return out.select("id", "h", "base", F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "found"))).alias("spans"))


def redact(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every span of its text replaced by its kind in angle brackets; null texts stay null."""
    spans = find(df, id, text).where(F.size("spans") > 0).groupBy("id", "h").agg(F.first("spans").alias("__spans")).withColumnsRenamed({"id": "__id", "h": "__h"})
    rows = df.join(spans, F.col(id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__h")), "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    t = F.col(text)

    def add(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substr(t, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"]))
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), new.alias("out")))

    cut = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1, F.length(t))))
    clean = F.when(F.col("__spans").isNull(), t).otherwise(cut)
    return rows.withColumn(text, clean).select(*[f"`{c}`" for c in df.columns])
