"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, langid, lines, media, mixing, negatives, partenum, phrases, pii, topk, toxicity, urlfilter, viterbi
from .common import table, utf8


def bucket(n: int):
    """crc32 of the id's text mod n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", utf8(F.col("text")).alias("content"))
    padded = docs.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), media.padded(F.col("content")).alias("payload"))
    read = media.media_columns(media.stored(padded).drop("payload"), samples="payload")
    track = F.col("media.tracks")[0]
    ranges = F.array_join(F.transform(track["keyframes"], lambda k: F.concat_ws(":", k["offset"], k["size"])), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("content").cast("long").alias("media_bytes"),
        F.sha2("content", 256).alias("media_sha256"),
        F.concat_ws(";", track["codec"], track["timescale"], track["duration"], track["n_samples"], track["n_keyframes"], ranges).alias("feature"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket(4) == 2)
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeated(table(spark, sf_dir, "documents"), with_text=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find(table(spark, sf_dir, "documents"))

    def count(k: int):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    counts = [count(k) for k in range(len(pii.KINDS))]
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket(5) == 0).select("doc_id", "held_out", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(bucket(5) != 0)
    model = toxicity.train(toxicity.labelled(docs, labels))
    return toxicity.predict(docs, model).drop("text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.inner_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"), partenum.Threshold(3, 9, 10))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return viterbi.encode_checked(docs, viterbi.load()).drop("text")


# The pages have neither fetch times nor lists. A page is fetched on a day that its id gives; list entries are the pages'
# hosts and first path parts, with dates and categories that their hashes give.
DAYS = 360
CATEGORIES = ("adult", "malware", "spam")


def list_log(pages: DataFrame) -> DataFrame:
    """The dated list: three in eight keys are added, half of these are removed and some added once more."""
    host, first = urlfilter.host(F.col("url")), F.regexp_extract(urlfilter.path(F.col("url")), "^/*([^/]+)", 1)
    keyed = pages.select(F.explode(F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), host, F.concat(host, F.lit("/"), first))).alias("key")).where("key is not null and key <> ''").distinct()
    h = F.md5("key")

    def digits(start: int) -> F.Column:
        return F.conv(F.substring(h, start, 4), 16, 10).cast("int")

    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (digits(1) % 3 + 1).cast("int"))
    steps = [(digits(5) % 8 < 3, "add", digits(9) % 120), (digits(5) % 16 < 6, "remove", 120 + digits(13) % 120), (digits(5) % 32 < 6, "add", 240 + digits(17) % 120)]
    rows = F.array(*[F.when(chosen, F.struct(F.lit(action).alias("action"), day.alias("at"))) for chosen, action, day in steps])
    return keyed.withColumn("category", category).withColumn("x", F.explode(rows)).where("x is not null").select("key", "category", "x.action", "x.at")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") * 7 % DAYS).cast("int").alias("fetched_at"))
    found = urlfilter.evaluate(pages, list_log(pages))
    return found.select("page_id", "url", "fetched_at", "blocked", F.array_join("categories", ",").alias("categories"), F.array_join("matched", ",").alias("matched"))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_rules(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_language": op2_language,
    "op3_repeats": op3_repeats,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_topk": op7_topk,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_jaccard": op9_jaccard,
    "op10_url_filter": op10_url_filter,
    "op11_line_rules": op11_line_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_divergence": op13_divergence,
}
ORACLE_SQL: dict[str, str] = {
    "op3_repeats": """
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
        windows AS (
            SELECT doc_id, i, string_agg(word, ' ') OVER o AS seq, count(*) OVER o AS n
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
        hashed AS (SELECT doc_id, i, md5(seq) AS h FROM windows WHERE n = 35),
        again AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
        starts AS (SELECT doc_id, i FROM hashed WHERE h IN (SELECT h FROM again)),
        marked AS (
            SELECT w.doc_id, w.i, w.word, count(s.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
            FROM words w LEFT JOIN starts s ON s.doc_id = w.doc_id AND s.i = w.i),
        kept AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                   coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
            FROM marked GROUP BY doc_id)
        SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept k USING (doc_id)""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_url_filter": r"""
        WITH p AS (
            SELECT page_id, url, CAST(page_id * 7 % 360 AS INTEGER) AS fetched_at,
                   nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)', 1), '\.+$', ''), '') AS host,
                   [x FOR x IN string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') IF x <> ''] AS parts
            FROM pages),
        listed AS (
            SELECT DISTINCT key FROM (
                SELECT unnest([regexp_extract(host, '([^.]+\.[^.]+)$', 1), host, host || '/' || coalesce(parts[1], '')]) AS key FROM p)
            WHERE key IS NOT NULL AND key <> ''),
        h AS (
            SELECT key, [('0x' || substr(md5(key), i, 4))::INTEGER FOR i IN [1, 5, 9, 13, 17]] AS n FROM listed),
        log AS (
            SELECT key, ['adult', 'malware', 'spam'][n[1] % 3 + 1] AS category, 'add' AS action, n[3] % 120 AS day FROM h WHERE n[2] % 8 < 3
            UNION ALL SELECT key, ['adult', 'malware', 'spam'][n[1] % 3 + 1], 'remove', 120 + n[4] % 120 FROM h WHERE n[2] % 16 < 6
            UNION ALL SELECT key, ['adult', 'malware', 'spam'][n[1] % 3 + 1], 'add', 240 + n[5] % 120 FROM h WHERE n[2] % 32 < 6),
        steps AS (SELECT key, category, day, min(action = 'add') AS active FROM log GROUP BY ALL),
        changes AS (SELECT *, coalesce(lag(active) OVER w, false) AS was FROM steps WINDOW w AS (PARTITION BY key, category ORDER BY day)),
        valid AS (SELECT *, lead(day) OVER (PARTITION BY key, category ORDER BY day) AS until FROM changes WHERE active <> was),
        asked AS (
            SELECT page_id, url, fetched_at, unnest(list_concat(
                CASE WHEN regexp_full_match(host, '\[.*|[0-9]+(\.[0-9]+){3}') THEN [host] ELSE [array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)] END,
                [host || '/' || array_to_string(parts[1:i], '/') FOR i IN range(1, len(parts) + 1)])) AS key
            FROM p WHERE host IS NOT NULL),
        hits AS (
            SELECT DISTINCT page_id, url, v.category, a.key FROM asked a JOIN valid v USING (key)
            WHERE v.active AND v.day <= a.fetched_at AND (v.until IS NULL OR a.fetched_at < v.until))
        SELECT p.page_id, p.url, p.fetched_at, count(hits.key) > 0 AS blocked,
               coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories, coalesce(string_agg(DISTINCT key, ',' ORDER BY key), '') AS matched
        FROM p LEFT JOIN hits ON hits.page_id = p.page_id AND hits.url = p.url GROUP BY p.page_id, p.url, p.fetched_at""",
    "op11_line_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT n, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)),
        s AS (SELECT n, i, string_agg(word, ' ') OVER o AS seq, count(*) OVER o AS k FROM w WINDOW o AS (PARTITION BY n ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
        again AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, seq) AS times FROM s WHERE k = 5) WHERE times > 1),
        marked AS (SELECT w.n, count(again.i) OVER (PARTITION BY w.n ORDER BY w.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0 AS twice FROM w LEFT JOIN again USING (n, i)),
        repeats AS (SELECT n, count(*) FILTER (twice) AS n_repeat_words FROM marked GROUP BY n),
        l AS (SELECT n, source, t, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own FROM (SELECT n, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
        x AS (SELECT n, source, t, line, len(own) AS words, translate(array_to_string(own, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM l WHERE len(own) > 0),
        dups AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM x GROUP BY n),
        hosts AS (SELECT source, count(DISTINCT t) AS texts FROM x GROUP BY source),
        above AS (SELECT x.source, norm FROM x JOIN hosts ON x.source IS NOT DISTINCT FROM hosts.source GROUP BY x.source, norm, texts HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) * 1000 > texts),
        gone AS (SELECT n, sum(words) AS removed FROM x JOIN above ON x.source IS NOT DISTINCT FROM above.source AND x.norm = above.norm GROUP BY n),
        m AS (SELECT doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed
              FROM d LEFT JOIN dups USING (n) LEFT JOIN repeats USING (n) LEFT JOIN gone USING (n)),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - removed AS n_left FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_left >= 10 AND 100 * n_left >= 20 * n_words AS kept, n_left FROM f""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
              FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        w AS (SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
              WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank FROM w)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT n, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        lc AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL),
        n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
        ln AS (SELECT lang, sum(c) AS n FROM lc GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (coalesce(n.n, 0) + v.v) AS HUGEINT) AS p
              FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        lp AS (SELECT k.lang, k.term, CAST(1 + 1000000000::HUGEINT * (coalesce(lc.c, 0) + 1) // (ln.n + v.v) AS HUGEINT) AS p FROM kept k JOIN v USING (lang) JOIN ln USING (lang) JOIN lc ON lc.lang = k.lang AND lc.term = k.term),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
                  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
                    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
        terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - lp.p) * (p.p - lp.p) // lp.p AS BIGINT) AS value FROM p JOIN lp ON lp.lang = p.lang AND lp.term = p.term WHERE p.c > 0 AND p.p > lp.p),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
