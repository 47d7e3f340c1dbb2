"""The registered queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors
from ..functions import text as tx
from ..functions.vector import cosine_similarity, doubles
from ..operators import augment, conversation, hierarchy, manifold, reduce, search, table
from ..operators import cluster as cl
from ..shared import shared_dir
from ..sources import normalize, readers
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- tables


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 200")
def page_orders(spark, d):
    return table.page(read(spark, d, "orders"), 3, 100, "o_totalprice", "desc", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey * 8 + l_linenumber LIMIT 25 OFFSET (SELECT count(*) // 50 * 25 FROM lineitem)")
def page_deep(spark, d):
    rows = read(spark, d, "lineitem").withColumn("row_index", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    index = table.PageIndex(rows, "l_extendedprice", "desc")
    return index.page(rows.count() // 50 + 1, 25).select("l_orderkey", "l_linenumber", "l_extendedprice")


def _filter(name: str, source: str, columns: list[str], rules: list[tuple], where: str) -> None:
    @query(f"SELECT {', '.join(columns)} FROM {source} WHERE {where}", name)
    def run(spark, d):
        return table.filtered(read(spark, d, source), rules).select(*columns)


_filter("filter_eq", "orders", ["o_orderkey", "o_orderstatus"], [("o_orderstatus", "=", "F")], "o_orderstatus = 'F'")
_filter("filter_ne", "customer", ["c_custkey", "c_mktsegment"], [("c_mktsegment", "!=", "BUILDING")], "c_mktsegment <> 'BUILDING'")
_filter("filter_range", "orders", ["o_orderkey", "o_totalprice"], [("o_totalprice", ">", 50000.0), ("o_totalprice", "<=", 150000.0)], "o_totalprice > 50000 AND o_totalprice <= 150000")
_filter("filter_like", "part", ["p_partkey", "p_type"], [("p_type", "LIKE", "%ECONOMY%")], "p_type LIKE '%ECONOMY%'")
_filter("filter_not_like", "part", ["p_partkey", "p_type"], [("p_type", "NOT LIKE", "%ECONOMY%")], "p_type NOT LIKE '%ECONOMY%'")
_filter("filter_stack", "orders", ["o_orderkey"], [("o_orderstatus", "!=", "F"), ("o_orderpriority", "LIKE", "1%"), ("o_totalprice", ">=", 1000.0)], "o_orderstatus <> 'F' AND o_orderpriority LIKE '1%' AND o_totalprice >= 1000")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def filter_nulls(spark, d):
    joined = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return table.filtered(joined, [("quality", "IS NULL")]).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 100, 2001)")
def filter_row_set(spark, d):
    return table.in_row_set(read(spark, d, "orders"), [1, 2, 3, 7, 100, 2001], "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def filter_row_set_large(spark, d):
    rows = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table.in_row_set(read(spark, d, "orders"), rows, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, text AS original_text, lang AS language, source, n_chars FROM documents")
def project_alias_reserved(spark, d):
    return table.display(read(spark, d, "documents"), {"lang": "language"})


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem")
def dup_ids(spark, d):
    return table.duplicate_count(read(spark, d, "lineitem"), "l_orderkey")


@query("SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS row_index, l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem")
def row_index(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return table.with_row_index(rows, ["l_extendedprice", "l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, count(o_orderkey) AS point_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def layer_metadata(spark, d):
    counts = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    joined = read(spark, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("point_count"))


def _cells(spark, d):
    """Labels as cell metadata of two augmented columns."""
    labels = read(spark, d, "labels")
    cells = labels.select(F.col("doc_id").alias("row_index"), F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("column_id", "x"))
    status = F.when(F.col("x") == 1, "success").when(F.col("row_index") % 3 == 0, "failed").otherwise("pending")
    return cells.select("row_index", "column_id", status.alias("status"), (F.col("row_index") % 7 == 0).alias("edited"))


_CELLS_SQL = """cells AS (
    SELECT doc_id AS row_index, column_id, CASE WHEN x = 1 THEN 'success' WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'pending' END AS status, doc_id % 7 = 0 AS edited
    FROM (SELECT doc_id, 'quality' AS column_id, quality AS x FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels))"""


@query(f"""WITH {_CELLS_SQL}
    SELECT d.doc_id AS row_index, q.status AS quality_status, t.status AS toxic_status, q.edited AS quality_edited
    FROM documents d LEFT JOIN cells q ON q.row_index = d.doc_id AND q.column_id = 'quality' LEFT JOIN cells t ON t.row_index = d.doc_id AND t.column_id = 'toxic'""")
def cell_meta_enrich(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("row_index"))
    wide = table.with_cell_metadata(rows, _cells(spark, d), ["quality", "toxic"])
    return wide.select("row_index", F.col("quality__meta.status").alias("quality_status"), F.col("toxic__meta.status").alias("toxic_status"), F.col("quality__meta.edited").alias("quality_edited"))


@query(f"""WITH {_CELLS_SQL}
    SELECT column_id, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (edited) AS edited, count(*) FILTER (status = 'pending') AS pending,
           count(*) FILTER (status = 'success') AS succeeded, count(*) AS total FROM cells GROUP BY column_id""")
def cell_status_counts(spark, d):
    return table.cell_status(_cells(spark, d))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN l.toxic END ELSE d.n_chars END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def bulk_update(spark, d):
    updates = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("toxic")).cast("long").alias("value"))
    return table.bulk_update(read(spark, d, "documents").select("doc_id", "n_chars"), updates, "n_chars", "doc_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins_upsert(spark, d):
    return table.latest_wins(read(spark, d, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, min(event_id) AS first_id, arg_min(value, event_id) AS original_value, arg_max(value, event_id) AS value, count(*) AS edits FROM events GROUP BY user_id")
def edit_tracking(spark, d):
    log = read(spark, d, "events")
    return augment.edited_cells(log.select("user_id", F.col("value").alias("before"), F.col("value").alias("after"), F.col("event_id").alias("at")), ["user_id"]).join(log.groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.count("*").alias("edits")), "user_id").select("user_id", "first_id", "original_value", "value", "edits")


# ---------------------------------------------------------------- conversations

_LINES = "'role: ' || coalesce(role, '') || chr(10) || 'text: ' || coalesce(text, '')"
_BOUNDS = {"turn_only": "BETWEEN CURRENT ROW AND CURRENT ROW", "history_until_turn": "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "turn_plus_n": "BETWEEN 2 PRECEDING AND CURRENT ROW", "full_conversation": "BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"}


def _history(strategy: str, name: str) -> None:
    @query(
        f"""WITH t AS (SELECT conv_id, turn, {_LINES} AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
        f AS (SELECT conv_id, turn, i, list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS {_BOUNDS[strategy]}) AS a FROM t)
        SELECT conv_id, turn, array_to_string([
            '[Turn ' || (k + 1) || ']' || CASE WHEN k = len(a) - 1 AND k = i THEN ' ← CURRENT' ELSE '' END || chr(10) || a[k + 1] FOR k IN range(len(a))], chr(10) || '---' || chr(10)) AS history FROM f""",
        name,
    )
    def run(spark, d):
        return conversation.history(read(spark, d, "conversations"), "conv_id", ["turn"], ["role", "text"], strategy).select("conv_id", "turn", "history")


for _s, _n in (("turn_only", "history_turn_only"), ("history_until_turn", "history_until_turn"), ("turn_plus_n", "history_turn_plus_n"), ("full_conversation", "history_full")):
    _history(_s, _n)

_POINTS = """t AS (SELECT *, conv_id * 1000 + turn AS row_index, 'role: ' || coalesce(role, '') || chr(10) || 'text: ' || coalesce(text, '') AS line FROM conversations),
    p AS (SELECT conv_id, row_index, min(row_index) OVER (PARTITION BY conv_id) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn, row_index) AS k,
          list(line) OVER w AS a, list(row_index) OVER w AS s FROM t WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, row_index ROWS {bounds})),
    q AS (SELECT row_number() OVER (ORDER BY first, k) - 1 AS point_no, CAST(conv_id AS VARCHAR) AS label, array_to_string(a, chr(10) || '---' || chr(10)) AS composed_text, s FROM p {where})"""


def _turns(spark, d):
    return read(spark, d, "conversations").withColumn("row_index", F.col("conv_id") * 1000 + F.col("turn"))


def _compose(strategy: str, name: str) -> None:
    points = _POINTS.format(bounds=_BOUNDS[strategy], where="WHERE k = 1" if strategy == "full_conversation" else "")

    @query(f"WITH {points} SELECT point_no, label, composed_text, array_to_string(s, ',') AS sources FROM q", name)
    def run(spark, d):
        points = conversation.compose(_turns(spark, d), "conv_id", ["turn"], ["role", "text"], strategy)
        return points.select("point_no", "label", "composed_text", F.array_join(F.col("source_row_indices").cast("array<string>"), ",").alias("sources"))


for _s, _n in (("turn_only", "compose_turn_only"), ("history_until_turn", "compose_history_until"), ("turn_plus_n", "compose_turn_plus_n"), ("full_conversation", "compose_full")):
    _compose(_s, _n)


@query(f"WITH {_POINTS.format(bounds=_BOUNDS['turn_plus_n'], where='')} SELECT row_index, arg_max(composed_text, point_no) AS composed_text FROM (SELECT point_no, composed_text, unnest(s) AS row_index FROM q) GROUP BY row_index")
def compose_writeback(spark, d):
    turns = _turns(spark, d)
    points = conversation.compose(turns, "conv_id", ["turn"], ["role", "text"], "turn_plus_n")
    return conversation.write_back(turns, points).select("row_index", "composed_text")


@query("SELECT doc_id, coalesce(source, '') AS composed_text FROM documents")
def compose_single(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.compose_single(F.col("source")).alias("composed_text"))


@query("SELECT doc_id, coalesce(lang, '') || ' | ' || coalesce(source, '') || ' | ' || coalesce(CAST(quality AS VARCHAR), '') AS composed_text FROM documents LEFT JOIN labels USING (doc_id)")
def compose_multi(spark, d):
    df = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", tx.compose_multi([(F.col(c), df.schema[c].dataType) for c in ("lang", "source", "quality")], " | ").alias("composed_text"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role = 'assistant' AS a,
                 CASE WHEN role = 'assistant' THEN 'Assistant: ' ELSE 'User: ' END || text AS entry
          FROM conversations WHERE conv_id IS NOT NULL AND role IN ('user', 'assistant') AND coalesce(text, '') <> ''),
    x AS (SELECT *, count(*) FILTER (a) OVER w AS k, coalesce(max(CASE WHEN a THEN pos END) OVER w, 0) AS lastpos FROM m
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT x.conv_id || '_turn_' || x.k AS id, CAST(x.conv_id AS VARCHAR) AS session_id, x.text AS agent_response,
           coalesce((SELECT y.text FROM m y WHERE y.conv_id = x.conv_id AND NOT y.a AND y.pos < x.pos AND y.pos >= x.lastpos - 19 ORDER BY y.pos DESC LIMIT 1), '') AS user_input,
           coalesce((SELECT string_agg(y.entry, chr(10) ORDER BY y.pos) FROM m y WHERE y.conv_id = x.conv_id AND y.pos < x.pos AND y.pos >= x.lastpos - 19), '') AS conversation_context
    FROM x WHERE x.a""")
def normalize_messages(spark, d):
    return conversation.normalize_messages(read(spark, d, "conversations"), "conv_id", ["turn"], "role", "text")


@query(ORACLE["normalize_messages"])
def stream_turns(spark, d):
    """The same turns from a stream of files, some conversations' turns in each."""
    c = read(spark, d, "conversations").withColumn("part", F.floor(F.col("turn") / 3))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for part in [r["part"] for r in c.select("part").distinct().orderBy("part").collect()]:
        c.where(F.col("part") == part).coalesce(1).write.mode("append").json(f"{base}/in")
    stream = ingest.turns(spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 1).json(f"{base}/in"), "conv_id", "turn", "role", "text")
    ingest.append(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _records(spark, d):
    c = read(spark, d, "conversations")
    return c.select(F.when(F.col("turn") % 5 != 4, F.concat_ws("_", "conv_id", "turn")).alias("id"), F.when(F.col("turn") % 3 == 0, F.lit("2024-01-01T00:00:00.1Z")).otherwise(F.lit("soon")).alias("timestamp"), F.when(F.col("role") != "system", F.col("text")).alias("user_input"), F.col("text").alias("agent_response"))


_RECORDS = "r AS (SELECT CASE WHEN turn % 5 <> 4 THEN conv_id || '_' || turn END AS id, turn % 3 <> 0 AS bad, CASE WHEN role <> 'system' THEN text END AS user_input, text AS agent_response FROM conversations)"


@query(f"""WITH {_RECORDS} SELECT error, count(*) AS n FROM (
    SELECT unnest([CASE WHEN id IS NULL THEN 'id' END, CASE WHEN trim(coalesce(user_input, '')) = '' THEN 'user_input' END, CASE WHEN trim(coalesce(agent_response, '')) = '' THEN 'agent_response' END, CASE WHEN bad THEN 'timestamp' END]) AS error FROM r)
    WHERE error IS NOT NULL GROUP BY error""")
def validate_records(spark, d):
    return normalize.errors(_records(spark, d)).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query(f"""WITH {_RECORDS}, e AS (SELECT *, CAST(id IS NULL AS INT) + CAST(trim(coalesce(user_input, '')) = '' AS INT) + CAST(trim(coalesce(agent_response, '')) = '' AS INT) + CAST(bad AS INT) AS n FROM r)
    SELECT count(*) FILTER (n = 0) AS valid_rows, count(*) FILTER (n > 0) AS invalid_rows, CAST(sum(n) AS BIGINT) AS error_count, count(id) FILTER (n = 0) - count(DISTINCT id) FILTER (n = 0) AS duplicate_ids FROM e""")
def upload_stats(spark, d):
    return normalize.upload_stats(_records(spark, d))


@query()
def profile_fields(spark, d):
    return normalize.profile(read(spark, d, "events").orderBy("event_id"), ["event_id", "ts", "event_type", "value", "props"])


@query("SELECT CAST(conv_id AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS session_id, text AS user_input, role AS agent_response FROM conversations WHERE coalesce(text, '') <> '' AND coalesce(role, '') <> ''")
def normalize_turns(spark, d):
    df = read(spark, d, "conversations").select("conv_id", F.col("conv_id").alias("id"), F.col("text").alias("user_message"), F.col("role").alias("answer"))
    return normalize.turn_level(df).select("id", "session_id", "user_input", "agent_response")


# ---------------------------------------------------------------- vectors

_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)"


def _seven(spark, d):
    return read(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]


@query(f"SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) AS s FROM embeddings) WHERE s > 0.1 ORDER BY s DESC, vec_id LIMIT 100")
def vector_search(spark, d):
    return search.vector_search(read(spark, d, "embeddings"), _seven(spark, d), least=0.1).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) AS s FROM embeddings WHERE vec_id <> 7) WHERE s > 0 ORDER BY s DESC, vec_id LIMIT 20")
def nearest_neighbors(spark, d):
    return search.nearest_neighbors(read(spark, d, "embeddings"), 7).withColumn("similarity", F.round("similarity", 6))


@query("""WITH p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS x FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, neighbor_id) AS rank FROM p) SELECT vec_id, neighbor_id, rank, round(x, 6) AS distance FROM r WHERE rank <= 10""")
def knn_topk(spark, d):
    return search.knn(read(spark, d, "embeddings"), 10).withColumn("distance", F.round("distance", 6))


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}), 6) AS similarity FROM embeddings")
def similarity_rank(spark, d):
    return search.ranked(read(spark, d, "embeddings"), _seven(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query("SELECT a.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return pairs.select("vec_id", F.round(1 - cosine_similarity(F.col("v"), F.col("w")), 6).alias("distance"))


def _clustered(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster_id"))


_CLUSTERED = "c AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_id FROM embeddings)"


@query(f"WITH {_CLUSTERED} SELECT count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS clusters, count(*) FILTER (cluster_id = -1) AS noise, round(count(*) FILTER (cluster_id = -1) * 100.0 / count(*), 6) AS noise_percent FROM c")
def cluster_stats(spark, d):
    return cl.cluster_stats(_clustered(spark, d)).withColumn("noise_percent", F.round("noise_percent", 6))


@query(f"WITH {_CLUSTERED} SELECT cluster_id, count(*) AS n, 'Cluster ' || cluster_id AS name FROM c WHERE cluster_id <> -1 GROUP BY cluster_id ORDER BY n DESC, cluster_id LIMIT 5")
def cluster_top5(spark, d):
    return cl.largest(_clustered(spark, d))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
    SELECT vec_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 100, 6) AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 100, 6) AS y FROM p""")
def minmax_2d(spark, d):
    points = search.points_view(read(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("coordinates_2d"))).select("vec_id", "x", "y")
    return reduce.scaled(points, ["x", "y"]).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""SELECT e.vec_id, CAST(e.embedding[1] AS DOUBLE) AS x, CAST(e.embedding[2] AS DOUBLE) AS y, CASE WHEN e.label = 9 THEN 'Noise' ELSE 'Cluster ' || e.label END AS cluster_name, d.doc_id, d.source
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id * 2""")
def layer_table(spark, d):
    from .layer import layer_table as joined

    points = _clustered(spark, d).select("vec_id", "cluster_id", doubles(F.col("embedding")).alias("coordinates_2d"), F.array(F.col("vec_id") * 2, F.col("vec_id") * 2 + 1).alias("source_row_indices"))
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("row_index"), "doc_id", "source")
    return joined(points, rows).select("vec_id", "x", "y", "cluster_name", "doc_id", "source")


@query("SELECT DISTINCT unnest([vec_id * 2, vec_id * 2 + 1]) AS row_index FROM embeddings WHERE label IN (1, 2)")
def saved_filter_apply(spark, d):
    from .layer import filter_from_points

    return filter_from_points(_clustered(spark, d).withColumn("source_row_indices", F.array(F.col("vec_id") * 2, F.col("vec_id") * 2 + 1)), "cluster_id in (1, 2)")


@query("SELECT vec_id FROM embeddings WHERE label > 3 AND embedding[1] > 0")
def selection_export(spark, d):
    return read(spark, d, "embeddings").where(F.expr("label > 3 and embedding[0] > 0")).select("vec_id")


@query()
def pca_2d(spark, d):
    flat = reduce.pca(read(spark, d, "embeddings"), 2).select("vec_id", F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y"))
    return reduce.scaled(flat, ["x", "y"]).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def density_clusters(spark, d):
    return cl.density_clusters(read(spark, d, "embeddings"))


@query()
def layout_2d(spark, d):
    return manifold.layout(read(spark, d, "embeddings")).select("vec_id", F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y"))


@query()
def hierarchical_clusters(spark, d):
    return hierarchy.hierarchical_clusters(read(spark, d, "embeddings"))


@query("SELECT doc_id, CAST(length(t) AS DOUBLE) AS n_chars, CAST(length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS n_spaces FROM (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN '[empty]' ELSE text END AS t FROM documents)")
def embed_fake(spark, d):
    texts = read(spark, d, "documents").select("doc_id", tx.embeddable(F.coalesce("text", F.lit(""))).alias("t"))
    return augment.embedded(texts, "t", augment.EchoProvider()).select("doc_id", F.col("embedding")[0].alias("n_chars"), F.col("embedding")[1].alias("n_spaces"))


# ---------------------------------------------------------------- texts


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the%') OR contains(lower(text), 'and the') ORDER BY doc_id LIMIT 100")
def fts_literal(spark, d):
    docs = read(spark, d, "documents")
    found = docs.where(tx.contains_literally([F.col("text")], "the%") | tx.contains_literally([F.col("text")], "AND the"))
    return found.orderBy("doc_id").limit(100).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'tion') OR contains(lower(source), 'tion')) AND lang = 'en' ORDER BY doc_id LIMIT 100")
def fts_with_predicate(spark, d):
    return search.literal_search(read(spark, d, "documents"), ["text", "source"], "TION", "lang = 'en'", tie="doc_id").select("doc_id")


@query(ORACLE["fts_with_predicate"])
def fts_indexed(spark, d):
    return search.TrigramIndex(read(spark, d, "documents"), ["text", "source"], "doc_id").search("TION", "lang = 'en'").select("doc_id")


@query("SELECT doc_id, CASE WHEN len(w) <= 40 THEN text ELSE array_to_string(w[1:39], ' ') || '  [truncated...]' END AS text FROM (SELECT doc_id, text, regexp_extract_all(text, '[^ \\n]+') AS w FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents))")
def truncate_tokens(spark, d):
    """Texts cut to 40 words, the suffix counted."""
    text = F.array_join(F.regexp_extract_all(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("([^ \\n]+)"), F.lit(1)), " ")
    docs = read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("whole"), text.alias("t"))
    cut = augment.truncated_at(F.col("t"), _word_starts, 40)
    return docs.select("doc_id", F.when(cut == F.col("t"), F.col("whole")).otherwise(cut).alias("text"))


def _word_starts(x: str) -> list[int]:
    return [m.start() for m in re.finditer(r"[^ ]+", x)]


@query("SELECT conv_id, turn, 'Turn ' || turn || ' of ' || conv_id || ' by ' || coalesce(role, '(empty)') || ': ' || coalesce(text, '(empty)') || ' (empty)' AS prompt FROM conversations")
def prompt_interpolate(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.interpolate("Turn {{turn}} of {{conv_id}} by {{role}}: {{text}} {{nothing}}", c.schema).alias("prompt"))


@query("SELECT doc_id, lang || ',' || source AS refs FROM documents")
def extract_refs(spark, d):
    template = F.concat(F.lit("Say {{ "), F.col("lang"), F.lit(" }} and {{"), F.col("source"), F.lit("}}, {x}"))
    return read(spark, d, "documents").select("doc_id", F.array_join(tx.column_references(template), ",").alias("refs"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_partkey || ' ' || p_type, '[^A-Za-z0-9_.-]', '_', 'g'), '^([0-9])', '_\\1') AS name FROM part")
def sanitize_names(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.sanitized(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_type")).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return read(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS answer_k, CAST(NULL AS VARCHAR) AS answer_missing FROM events")
def json_expand(spark, d):
    answers = read(spark, d, "events").select("event_id", F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```")).alias("answer"))
    return augment.expand_structured(answers, "answer", [{"name": "k", "type": "number"}, {"name": "missing", "type": "string"}], "expanded")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def lenient_json(spark, d):
    n = F.col("event_id") % 4
    answer = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(n == 2, F.concat(F.lit("```\n"), "props", F.lit("```"))).otherwise(F.lit("no answer"))
    return read(spark, d, "events").select("event_id", F.try_variant_get(tx.lenient_json(answer), "$.k", "long").alias("k"))


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 1 ELSE 0 END AS n FROM events")
def structured_violations(spark, d):
    return augment.validated(read(spark, d, "events"), "props", [{"name": "k", "type": "number"}]).select("event_id", F.size("violations").alias("n"))


_MESSAGES = {"click": "429 Too Many Requests", "purchase": "Invalid API key", "view": "fetch failed", "signup": "503 Service Unavailable"}


@query("""SELECT event_type, CASE event_type WHEN 'click' THEN 'rate_limit' WHEN 'purchase' THEN 'auth' WHEN 'view' THEN 'network' WHEN 'signup' THEN 'server_error' ELSE 'invalid_request' END AS kind,
    CASE event_type WHEN 'click' THEN 60 WHEN 'signup' THEN 30 ELSE 0 END AS wait, count(*) AS n FROM events GROUP BY ALL""")
def classify_errors(spark, d):
    message = F.coalesce(F.create_map(*[F.lit(x) for kv in _MESSAGES.items() for x in kv])[F.col("event_type")], F.lit("bad prompt"))
    return read(spark, d, "events").withColumn("kind", errors.error_class(message)).groupBy("event_type", "kind").agg(F.count("*").alias("n")).withColumn("wait", errors.retry_wait(F.col("kind")))


# ---------------------------------------------------------------- augmentation

_PROMPT = "length('Describe ' || coalesce(source, '(empty)') || ': ' || coalesce(text, '(empty)'))"


@query(f"SELECT doc_id, CASE WHEN source = 'src3' THEN NULL ELSE {_PROMPT} || ' characters' END AS value, CASE WHEN source = 'src3' THEN 'failed' ELSE 'success' END AS status, CASE WHEN source = 'src3' THEN 'rate_limit' END AS error_type FROM documents")
def llm_column(spark, d):
    return augment.model_column(read(spark, d, "documents"), "Describe {{source}}: {{text}}", augment.EchoProvider("Describe src3:"), "doc_id").select("doc_id", "value", "status", "error_type")


@query(f"SELECT doc_id, CASE WHEN source = 'src3' THEN length('Again ' || text) ELSE {_PROMPT} END || ' characters' AS value, 'success' AS status FROM documents")
def llm_retry_failed(spark, d):
    docs = read(spark, d, "documents")
    cells = augment.model_column(docs, "Describe {{source}}: {{text}}", augment.EchoProvider("Describe src3:"), "doc_id").withColumn("edited", F.lit(False))
    return augment.retry(docs, cells, "Again {{text}}", augment.EchoProvider(), "failed", "doc_id").select("doc_id", "value", "status")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 10")
def few_shot_sample(spark, d):
    return augment.seeded_sample(read(spark, d, "documents"), 10, "doc_id").select("doc_id")


# ---------------------------------------------------------------- sources: files written from the tables and read back


def _file(lines: DataFrame, one: bool = False) -> str:
    """The folder of text files that hold the lines; one: a single file."""
    path = f"{shared_dir(lines.sparkSession)}/source-{uuid.uuid4().hex}"
    (lines.coalesce(1) if one else lines).write.text(path)
    return path


def _v(path: str, kind: str = "string"):
    return F.try_variant_get("v", path, kind)


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 3")
def source_jsonl(spark, d):
    e = read(spark, d, "events")
    line = F.to_json(F.struct("event_id", "event_type", "props"))
    bad = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), line)).otherwise(line)
    path = _file(e.select(F.explode(F.array(bad, F.lit("  "))).alias("value")))
    rows = readers.read_jsonl(spark, path, some=True)
    return rows.select(_v("$.event_id", "long").alias("event_id"), _v("$.event_type").alias("event_type"), F.try_variant_get(F.try_parse_json(_v("$.props")), "$.k", "long").alias("k"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def source_json_document(spark, d):
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    items = nations.agg(F.collect_list(F.struct("n_nationkey", "n_name", "r_name")).alias("records"))  # 25 nations
    path = _file(items.select(F.to_json(F.struct(F.lit(1).alias("version"), "records")).alias("value")), one=True)
    return readers.load(spark, path, "json").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "r_name")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'a \"b\", ' || o_orderpriority AS note, o_orderstatus FROM orders")
def source_csv(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit('a "b", '), "o_orderpriority").alias("note"), "o_orderstatus")
    path = f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"
    table.export_csv(rows, path)
    return readers.load(spark, path, "csv").select("o_orderkey", "note", "o_orderstatus")


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_returnflag AS flag, l_orderkey || ', ' || l_linenumber AS keys, '[{"n":' || l_linenumber || '}]' AS parts, CASE WHEN l_linenumber > 3 THEN l_linestatus END AS status
    FROM lineitem""")
def source_flatten(spark, d):
    x = read(spark, d, "lineitem")
    nested = F.struct(F.struct("l_quantity", F.struct("l_returnflag").alias("flags")).alias("item"), F.when(F.col("l_linenumber") > 3, F.col("l_linestatus")).alias("status"))
    line = F.struct("l_orderkey", "l_linenumber", nested.alias("a"), F.array("l_orderkey", "l_linenumber").alias("keys"), F.array(F.struct(F.col("l_linenumber").alias("n"))).alias("parts"))
    flat = readers.load(spark, _file(x.select(F.to_json(line).alias("value"))), "jsonl")
    return flat.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("`a.item.l_quantity`").cast("double").alias("quantity"), F.col("`a.item.flags.l_returnflag`").alias("flag"), "keys", "parts", F.col("`a.status`").alias("status"))


_PAIRS = """p AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant' AND u.text <> '' AND a.text <> '')"""


def _pairs(spark, d):
    c = read(spark, d, "conversations").where("text <> ''")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    return asked.join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r")), ["conv_id", "turn"])


def _text_of(n):
    return n.cast("string")


@query(f"""WITH {_PAIRS} SELECT conv_id || '_obs_o' || turn AS id, 'day ' || turn AS timestamp, 's' || conv_id AS session_id, q AS user_input, r AS agent_response, 'why ' || turn AS agent_reasoning,
    'gpt' AS model, CAST(turn AS VARCHAR) AS total, 'trace' AS origin, 'llm call' AS name FROM p""")
def source_langfuse(spark, d):
    metadata = F.struct(F.concat(F.lit("why "), "turn").alias("reasoning"), F.lit("observation").alias("origin"))
    one = F.struct(
        F.concat(F.lit("o"), "turn").alias("id"), F.lit("SPAN").alias("type"), F.lit("llm call").alias("name"), F.concat(F.lit("day "), "turn").alias("start_time"), F.lit("gpt").alias("model"),
        F.struct(F.col("turn").alias("total")).alias("usage"), metadata.alias("metadata"), F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content"))).alias("messages")).alias("input"), F.struct(F.col("r").alias("content")).alias("output"),
    )
    traces = _pairs(spark, d).groupBy("conv_id").agg(F.collect_list(one).alias("observations"))
    line = F.struct(_text_of(F.col("conv_id")).alias("id"), F.concat(F.lit("s"), "conv_id").alias("session_id"), F.struct(F.lit("trace").alias("origin")).alias("metadata"), "observations")
    rows = readers.read_jsonl(spark, _file(traces.select(F.to_json(line).alias("value"))))
    m = F.col("metadata")
    return normalize.langfuse(rows).select("id", "timestamp", "session_id", "user_input", "agent_response", "agent_reasoning", m["model"].alias("model"), F.get_json_object(m["usage"], "$.total").alias("total"), m["origin"].alias("origin"), m["observation_name"].alias("name"))


@query(f"""WITH {_PAIRS} SELECT conv_id || '-' || turn AS id, CAST(NULL AS VARCHAR) AS timestamp, CAST(conv_id AS VARCHAR) AS session_id, q AS user_input, r AS agent_response,
    CAST(turn AS VARCHAR) AS execution_order, 'llm' AS run_type, 'x' AS tag, '{{"input":"' || turn || '"}}' AS short_context FROM p""")
def source_langsmith(spark, d):
    outputs = F.struct(F.array(F.struct(F.col("r").alias("text"))).alias("generations"))
    line = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("llm").alias("run_type"), _text_of(F.col("conv_id")).alias("trace_id"), F.col("turn").alias("execution_order"), F.struct(F.lit("x").alias("tag")).alias("extra"), F.struct(F.col("q").alias("input")).alias("inputs"), outputs.alias("outputs"))
    rows = readers.read_jsonl(spark, _file(_pairs(spark, d).select(F.to_json(line).alias("value"))))
    m = F.col("metadata")
    # The context is the inputs as JSON; with the question taken out it is short enough to compare.
    short = F.when(F.get_json_object("conversation_context", "$.input") == F.col("user_input"), F.concat(F.lit('{"input":"'), m["execution_order"], F.lit('"}')))
    return normalize.langsmith(rows).select("id", "timestamp", "session_id", "user_input", "agent_response", m["execution_order"].alias("execution_order"), m["run_type"].alias("run_type"), m["tag"].alias("tag"), short.alias("short_context"))


@query(f"""WITH {_PAIRS} SELECT conv_id || '_' || turn AS id, CAST(conv_id AS VARCHAR) AS session_id, q AS user_input, r AS agent_response, q AS conversation_context, 'm' AS model, CAST(turn AS VARCHAR) AS tokens FROM p""")
def source_arize(spark, d):
    attributes = F.struct(F.col("q").alias("input.value"), F.array(F.struct(F.lit("assistant").alias("message.role"), F.col("r").alias("message.content"))).alias("llm.output_messages"), F.lit("m").alias("llm.model_name"), F.col("turn").alias("llm.token_count.total"))
    line = F.struct(_text_of(F.col("conv_id")).alias("context.trace_id"), _text_of(F.col("turn")).alias("context.span_id"), attributes.alias("attributes"))
    rows = readers.read_jsonl(spark, _file(_pairs(spark, d).select(F.to_json(line).alias("value"))))
    m = F.col("metadata")
    return normalize.arize(rows).select("id", "session_id", "user_input", "agent_response", "conversation_context", m["model"].alias("model"), F.get_json_object(m["token_usage"], "$.total").alias("tokens"))


@query(f"""WITH {_PAIRS} SELECT CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS session_id, q AS user_input, r AS agent_response, 'because' AS agent_reasoning, CAST(turn * 2 AS VARCHAR) AS score FROM p""")
def source_turn_level(spark, d):
    rows = _pairs(spark, d).select(F.col("turn").alias("turn_id"), F.col("conv_id").alias("conversation_id"), F.col("q").alias("question"), F.col("r").alias("answer"), F.lit("because").alias("rationale"), (F.col("turn") * 2).alias("score"))
    path = f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"
    table.export_csv(rows, path)
    found = normalize.turn_level(readers.load(spark, path, "turn-level"))
    return found.select("id", "session_id", "user_input", "agent_response", "agent_reasoning", F.col("metadata")["score"].alias("score"))


_DETECTED = {"message-centric": 1.0, "langfuse": 0.0, "langsmith": 0.0, "arize": 0.0, "turn-level": 0.0}


def _detect(name: str, expected: dict[str, float], lines: Callable[[DataFrame], DataFrame]) -> None:
    values = ", ".join(f"('{k}', {v:.1f}::DOUBLE)" for k, v in expected.items())

    @query(f"SELECT * FROM (VALUES {values}) AS v(format, confidence)", name)
    def run(spark, d):
        rows = read(spark, d, "conversations").where("text <> '' and role in ('user', 'assistant')").orderBy("conv_id", "turn").limit(20)
        return readers.detect(spark, _file(lines(rows), one=True)).select("format", F.round("confidence", 6).alias("confidence"))


_detect("detect_messages", _DETECTED, lambda rows: rows.select(F.to_json(F.struct("role", F.col("text").alias("content"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))).alias("value")))
_detect(
    "detect_langsmith",
    _DETECTED | {"message-centric": 0.5, "langsmith": 1.0},
    lambda rows: rows.select(F.to_json(F.struct(F.lit("llm").alias("run_type"), F.struct(F.col("text").alias("input")).alias("inputs"), F.struct(F.col("text").alias("output")).alias("outputs"))).alias("value")),
)
_detect(
    "detect_arize",
    _DETECTED | {"message-centric": 0.5, "arize": 1.0},
    lambda rows: rows.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("context.trace_id"), F.struct(F.col("text").alias("input.value")).alias("attributes"))).alias("value")),
)
_detect(
    "detect_langfuse",
    _DETECTED | {"message-centric": 0.5, "langfuse": 1.0},
    lambda rows: rows.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("2024-01-01").alias("timestamp"), F.lit(True).alias("public"), F.array(F.struct(F.lit("t").alias("trace_id"), F.lit("SPAN").alias("type"))).alias("observations"))).alias("value")),
)


@query("SELECT * FROM (VALUES ('File format not clearly detected. Please verify your data format.'), ('Consider checking if your file contains the expected headers or JSON structure.')) AS v(suggestion)")
def detect_suggestions(spark, d):
    return readers.suggestions(readers.detect(spark, _file(read(spark, d, "documents").orderBy("doc_id").limit(5).select(F.concat(F.lit("- "), F.col("doc_id").cast("string")).alias("value")), one=True)))


@query("SELECT CAST(n AS BIGINT) AS n, k, error FROM (VALUES (0, '0', NULL), (1, NULL, 'not JSON'), (2, '2', NULL)) AS v(n, k, error)")
def source_preview(spark, d):
    lines = spark.range(9).select(F.when(F.col("id") == 1, "oops").otherwise(F.concat(F.lit('{"k": '), F.col("id").cast("string"), F.lit("}"))).alias("value"))
    shown = readers.preview(spark, _file(lines.orderBy("id"), one=True), 3)
    return shown.select("n", _v("$.k").alias("k"), "error")


# ---------------------------------------------------------------- columns and estimates


@query("SELECT doc_id, 'none' AS note, CAST(7 AS BIGINT) AS rank FROM documents")
def add_drop_column(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", F.lit(1).alias("lang_sources"))
    added = table.add_column(table.add_column(docs, "note", "string", "none"), "rank", "long", 7)
    return table.drop_column(added, "lang")


@query("SELECT count(*) AS rows, count(DISTINCT coalesce(source, '')) AS groups, count(*) = count(DISTINCT coalesce(source, '')) AS all_unique FROM documents")
def grouping_estimate(spark, d):
    return table.grouping_estimate(read(spark, d, "documents"), "source")


@query("SELECT vec_id AS row_index FROM embeddings WHERE label = 3")
def rows_of_points(spark, d):
    e = read(spark, d, "embeddings").where("label in (3, 4)")
    return table.rows_of_points(e.select(F.when(F.col("label") == 3, F.concat(F.lit("point_"), "vec_id")).otherwise(F.lit("other")).alias("point_id")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000")
def first_rows(spark, d):
    return table.first_rows(read(spark, d, "orders"), tie="o_orderkey").select("o_orderkey", "o_totalprice")


_SEARCH = {"click": "web_search rate limited", "purchase": "Grounding quota used up", "view": "search timeout", "signup": "search error", "error": "other"}


@query("""SELECT event_type, kind, CASE kind WHEN 'search_rate_limit' THEN 60 WHEN 'search_timeout' THEN 5 WHEN 'search_provider_error' THEN 5 ELSE 0 END AS wait, coalesce(kind <> 'search_quota_exceeded', true) AS again,
    CASE kind WHEN 'search_rate_limit' THEN 'Search rate limited: Too many search requests in a short time.' WHEN 'search_quota_exceeded' THEN 'Search quota exceeded: You have reached the search API limit for this period.'
        WHEN 'search_timeout' THEN 'Search timed out: The web search took too long to complete.' WHEN 'search_provider_error' THEN 'Search service error: The search provider encountered an error.' ELSE 'An unknown error occurred.' END AS said
    FROM (SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'search_rate_limit' WHEN 'purchase' THEN 'search_quota_exceeded' WHEN 'view' THEN 'search_timeout' WHEN 'signup' THEN 'search_provider_error' END AS kind FROM events)""")
def search_errors(spark, d):
    message = F.coalesce(F.create_map(*[F.lit(x) for kv in _SEARCH.items() for x in kv])[F.col("event_type")], F.lit("bad prompt"))
    found = read(spark, d, "events").select("event_type", errors.search_error_class(message).alias("kind")).distinct()
    return found.select("event_type", "kind", errors.retry_wait(F.col("kind")).alias("wait"), errors.retryable(F.col("kind")).alias("again"), errors.error_text(F.col("kind")).alias("said"))


from . import lifecycle  # noqa: E402, F401  registers its queries, which need what is above
