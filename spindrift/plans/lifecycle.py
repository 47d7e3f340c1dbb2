"""Registered queries over a catalog that is made from the test tables, and over files in each log format."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates
from ..functions import text as tx
from ..operators import augment, table
from ..operators.catalog import Catalog
from ..shared import shared_dir
from ..sources import readers
from .queries import _file, query, read

# Nations are files, suppliers their layers, customers the points of layers, labels the cells of files, vectors' labels filters.


def _catalog(spark: SparkSession, d: str) -> Catalog:
    c = Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    day = F.timestamp_add("DAY", F.col("n_nationkey").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    c.upsert("files", read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("jsonl").alias("format"), day.alias("last_modified"), F.col("n_regionkey").cast("long").alias("size"), F.lit(1).alias("version")))
    suppliers = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("file_id"), F.col("s_name").alias("name"), F.lit(False).alias("is_active"))
    c.upsert("embedding_layers", suppliers)
    points = read(spark, d, "customer").select((F.col("c_custkey") % 20).cast("string").alias("layer_id"), F.concat(F.lit("point_"), "c_custkey").alias("point_id"), F.array("c_custkey").alias("source_row_indices"), (F.col("c_nationkey") % 5 - 1).cast("int").alias("cluster_id"))
    c.upsert("embedding_points", points)
    labels = read(spark, d, "labels")
    file_of = (F.col("doc_id") % 25).cast("string").alias("file_id")
    cells = [labels.select(file_of, F.lit(k).alias("column_id"), F.col("doc_id").alias("row_index"), F.when(F.col(k) == 1, "success").otherwise("failed").alias("status"), (F.col("doc_id") % 7 == 0).alias("edited")) for k in ("quality", "toxic")]
    c.upsert("cell_metadata", cells[0].unionByName(cells[1]))
    rows = read(spark, d, "embeddings").where("label is not null").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("row_indices"))
    c.upsert("saved_filters", rows.select(F.col("label").cast("string").alias("id"), F.col("label").cast("string").alias("file_id"), F.concat(F.lit("Label "), "label").alias("name"), "row_indices"))
    return c


_LAYERS = """l AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_nationkey AS VARCHAR) AS file_id, s_name AS name FROM supplier),
    p AS (SELECT CAST(c_custkey % 20 AS VARCHAR) AS layer_id, 'point_' || c_custkey AS point_id, c_nationkey % 5 - 1 AS cluster_id FROM customer)"""


@query(f"WITH {_LAYERS} SELECT id, file_id, name, (SELECT count(*) FROM p WHERE layer_id = id) AS point_count FROM l")
def catalog_layers(spark, d):
    return _catalog(spark, d).layers().select("id", "file_id", "name", "point_count")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_regionkey = 2 THEN 2 ELSE 1 END AS version FROM nation WHERE n_regionkey <> 4")
def catalog_files(spark, d):
    """Files with some renamed, each as a new version, and some deleted."""
    c = _catalog(spark, d)
    c.update("files", F.col("size") == 2, name=F.lower("name"), version=F.col("version") + 1)
    c.delete("files", F.col("size") == 4)
    return c.files().select("id", "name", "version")


@query(f"""WITH {_LAYERS} SELECT 'files' AS part, count(*) - 1 AS n FROM nation UNION ALL SELECT 'embedding_layers', count(*) FROM l WHERE file_id <> '3'
    UNION ALL SELECT 'embedding_points', count(*) FROM p WHERE layer_id NOT IN (SELECT id FROM l WHERE file_id = '3')
    UNION ALL SELECT 'cell_metadata', 2 * count(*) FROM labels WHERE doc_id % 25 <> 3 UNION ALL SELECT 'saved_filters', count(DISTINCT label) FILTER (label <> 3) FROM embeddings""")
def catalog_delete_file(spark, d):
    """What is left of each table when a file has gone with all that belongs to it."""
    c = _catalog(spark, d)
    c.delete_file("3")
    parts = [c.read(n).agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n in ("files", "embedding_layers", "embedding_points", "cell_metadata", "saved_filters")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query(f"WITH {_LAYERS} SELECT id, file_id, id = (SELECT max(id) FROM l WHERE file_id = (SELECT file_id FROM l WHERE id = '5')) AS is_active FROM l")
def catalog_active_layer(spark, d):
    """One layer of its file is active: the one that was made so last."""
    c = _catalog(spark, d)
    file_id = c.read("embedding_layers").where("id = '5'").select("file_id")
    last = c.read("embedding_layers").join(file_id, "file_id", "left_semi").agg(F.max("id")).first()[0]
    c.activate("5")
    c.activate(last)
    return c.layers().select("id", "file_id", "is_active")


@query(f"""WITH {_LAYERS}, q AS (SELECT layer_id, point_id, CASE WHEN layer_id = '7' THEN CAST(substr(point_id, 7) AS BIGINT) // 20 % 3 - 1 ELSE cluster_id END AS cluster_id FROM p)
    SELECT layer_id, count(*) AS points, count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS clusters, count(*) FILTER (cluster_id = -1) AS noise FROM q GROUP BY layer_id""")
def catalog_clusters(spark, d):
    """Points by layer after one layer has been clustered anew, with the counts that the layer keeps."""
    c = _catalog(spark, d)
    new = c.points("7").select("point_id", (F.floor(F.substring("point_id", 7, 20).cast("long") / 20) % 3 - 1).cast("int").alias("cluster_id"))
    c.assign_clusters("7", new, '{"min_size": 3}')
    noise = F.count_if(F.col("cluster_id") == -1)
    found = c.read("embedding_points").groupBy("layer_id").agg(F.count("*").alias("points"), F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("clusters"), noise.alias("noise"))
    kept = c.read("embedding_layers").where("cluster_stats is not null").select(F.col("id").alias("layer_id"), F.get_json_object("cluster_stats", "$.clusters").cast("long").alias("c"), F.get_json_object("cluster_stats", "$.noise").cast("long").alias("x"))
    joined = found.join(kept, "layer_id", "left")
    return joined.select("layer_id", "points", F.coalesce("c", "clusters").alias("clusters"), F.coalesce("x", "noise").alias("noise"))


@query("""SELECT CAST(label AS VARCHAR) AS filter_id, CASE WHEN label = 2 THEN 'renamed' ELSE 'Label ' || label END AS name, count(*) OVER (PARTITION BY label) AS row_count, vec_id AS row_index
    FROM embeddings WHERE label IS NOT NULL AND label <> 4""")
def catalog_filters(spark, d):
    """Saved filters with their rows; one has been renamed, one deleted."""
    c = _catalog(spark, d)
    c.rename_filter("2", "renamed")
    c.delete("saved_filters", F.col("id") == "4")
    every = c.read("saved_filters").withColumn("row_count", F.size("row_indices").cast("long"))
    return every.select(F.col("id").alias("filter_id"), "name", "row_count", F.explode("row_indices").alias("row_index"))


@query("""SELECT column_id, status, count(*) AS n FROM (
        SELECT doc_id, 'quality' AS column_id, CASE WHEN quality = 1 THEN 'success' ELSE 'failed' END AS status FROM labels WHERE doc_id % 25 <> 6
        UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 OR doc_id % 3 = 0 THEN 'success' ELSE 'failed' END FROM labels) GROUP BY ALL""")
def catalog_cells(spark, d):
    """Cells by column and status, after a column of one file was dropped and some cells were asked again."""
    c = _catalog(spark, d)
    c.delete_column("6", "quality")
    again = c.read("cell_metadata").where("column_id = 'toxic' and row_index % 3 = 0")
    c.upsert("cell_metadata", again.withColumn("status", F.lit("success")))
    return c.read("cell_metadata").groupBy("column_id", "status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source, CASE WHEN toxic = 1 THEN 'flagged' END AS note, CASE WHEN toxic = 1 THEN doc_id END AS edited_at FROM documents LEFT JOIN labels USING (doc_id)")
def cell_edit(spark, d):
    """Single cells written with their metadata: the value goes to the rows, when it was edited to the cells."""
    c = _catalog(spark, d)
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    edits = read(spark, d, "labels").where("toxic = 1").select("doc_id")
    rows, cells = table.edit_cells(table.add_column(docs, "note", "string"), edits.select("doc_id", F.lit("flagged").alias("value"), F.col("doc_id").alias("at")), "note", "doc_id")
    c.upsert("cell_metadata", cells.select(F.lit("f").alias("file_id"), "column_id", F.col("doc_id").alias("row_index"), "status", "edited", "original_value", "last_edit_time"))
    seen = c.cells("f").select(F.col("row_index").alias("doc_id"), F.col("last_edit_time").alias("edited_at"))
    return rows.join(seen, "doc_id", "left").select("doc_id", "lang", "source", "note", "edited_at")


# ---------------------------------------------------------------- files in each log format


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").orderBy("conv_id", "turn")


_HEAD = "h AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS place FROM conversations ORDER BY conv_id, turn LIMIT 10)"
_SCORES = "SELECT format, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM (SELECT unnest(['message-centric', 'langfuse', 'langsmith', 'arize', 'turn-level']) AS format, unnest([{}, {}, {}, {}, {}]) AS confidence FROM (SELECT {} FROM h))"


def _scored(spark: SparkSession, lines: DataFrame) -> DataFrame:
    return readers.detect(spark, _file(lines, one=True)).select("format", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_HEAD} " + _SCORES.format("0.5 + 0.5 * m / n", "0", "0", "0", "0", "count(*) AS n, count(*) FILTER (role IN ('user', 'assistant') AND coalesce(text, '') <> '') AS m"))
def detect_message_table(spark, d):
    """A file of all turns, the system's too."""
    line = F.struct("role", F.col("text").alias("content"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))
    return _scored(spark, _conversations(spark, d).select(F.to_json(line).alias("value")))


@query(f"WITH {_HEAD} " + _SCORES.format("0.5", "0", "least(1, 0.4 * m)", "0", "0", "count(*) FILTER (place <= 5 AND role <> 'assistant') AS m"))
def detect_langsmith_table(spark, d):
    """Runs of which only some are of a known type."""
    kind = F.when(F.col("role") != "assistant", "llm").otherwise("note")
    line = F.struct(kind.alias("run_type"), F.struct(F.col("text").alias("input")).alias("inputs"), F.struct(F.col("turn").alias("output")).alias("outputs"))
    return _scored(spark, _conversations(spark, d).select(F.to_json(line).alias("value")))


@query(f"WITH {_HEAD} " + _SCORES.format("0.5", "0", "0", "greatest(least(1, 0.5 * m), whole)", "0", "count(*) FILTER (place <= 5 AND role = 'assistant') AS m, max(CASE WHEN place = 1 AND role = 'assistant' THEN 1 ELSE 0 END) AS whole"))
def detect_arize_table(spark, d):
    """Spans of which only some have attributes."""
    line = F.struct(F.col("conv_id").cast("string").alias("context.trace_id"), F.when(F.col("role") == "assistant", F.struct(F.col("turn").alias("input.value"))).alias("attributes"))
    return _scored(spark, _conversations(spark, d).select(F.to_json(line).alias("value")))


@query(f"WITH {_HEAD} " + _SCORES.format("0.5", "greatest(least(1, 0.4 * m), whole)", "0", "0", "0", "count(*) FILTER (place <= 5 AND turn % 2 = 1) AS m, max(CASE WHEN place = 1 AND turn % 2 = 1 THEN 1 ELSE 0 END) AS whole"))
def detect_langfuse_table(spark, d):
    """Traces of which only some have an id."""
    line = F.struct(F.when(F.col("turn") % 2 == 1, F.concat_ws("-", "conv_id", "turn")).alias("id"), F.array(F.struct(F.lit("t").alias("trace_id"), F.lit("SPAN").alias("type"))).alias("observations"))
    return _scored(spark, _conversations(spark, d).select(F.to_json(line).alias("value")))


@query("SELECT n_nationkey - (SELECT min(n_nationkey) FROM nation) AS n, CASE WHEN n_regionkey <> 1 THEN n_name END AS name, CASE WHEN n_regionkey = 1 THEN 'not JSON' END AS error FROM nation ORDER BY n_nationkey LIMIT 10")
def preview_nations(spark, d):
    """The first lines of a file with broken ones among them."""
    line = F.to_json(F.struct("n_name"))
    lines = read(spark, d, "nation").orderBy("n_nationkey").select(F.when(F.col("n_regionkey") == 1, F.concat(F.lit("oops "), line)).otherwise(line).alias("value"))
    return readers.preview(spark, _file(lines, one=True), 10).select("n", F.try_variant_get("v", "$.n_name", "string").alias("name"), "error")


@query("SELECT CAST(conv_id AS VARCHAR) AS trace, CAST(turn AS BIGINT) AS execution_order, text AS input, CAST(turn * 2 AS BIGINT) AS tokens FROM conversations WHERE role = 'user'")
def load_langsmith(spark, d):
    rows = read(spark, d, "conversations").where("role = 'user'")
    line = F.struct(F.lit("llm").alias("run_type"), F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").alias("execution_order"), F.struct(F.col("text").alias("input")).alias("inputs"), F.struct(F.struct((F.col("turn") * 2).alias("tokens")).alias("usage")).alias("outputs"))
    flat = readers.load(spark, _file(rows.select(F.to_json(line).alias("value"))), "langsmith")
    return flat.select(F.col("trace_id").alias("trace"), F.col("execution_order").cast("long").alias("execution_order"), F.col("`inputs.input`").alias("input"), F.col("`outputs.usage.tokens`").cast("long").alias("tokens"))


@query("SELECT 'c' || conv_id AS trace, 'o' || turn AS observation, CASE WHEN role = 'system' THEN 'EVENT' ELSE 'SPAN' END AS kind, text FROM conversations")
def load_langfuse(spark, d):
    """Traces of several observations, flattened to one row an observation."""
    one = F.struct(F.concat(F.lit("o"), "turn").alias("id"), F.when(F.col("role") == "system", "EVENT").otherwise("SPAN").alias("type"), F.struct("text").alias("input"))
    traces = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(one).alias("observations"))
    flat = readers.load(spark, _file(traces.select(F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("id"), "observations")).alias("value"))), "langfuse")
    return flat.select(F.col("trace_id").alias("trace"), F.col("`observation.id`").alias("observation"), F.col("`observation.type`").alias("kind"), F.col("`observation.input.text`").alias("text"))


@query("SELECT 'c' || conv_id AS trace, text AS value, CAST(turn AS BIGINT) AS total FROM conversations")
def load_arize(spark, d):
    line = F.struct(F.concat(F.lit("c"), "conv_id").alias("context.trace_id"), F.struct(F.col("text").alias("input.value"), F.struct(F.col("turn").alias("total")).alias("tokens")).alias("attributes"))
    flat = readers.load(spark, _file(read(spark, d, "conversations").select(F.to_json(line).alias("value"))), "arize")
    return flat.select(F.col("`context.trace_id`").alias("trace"), F.col("`attributes.input.value`").alias("value"), F.col("`attributes.tokens.total`").cast("long").alias("total"))


# ---------------------------------------------------------------- templates and names


@query("SELECT doc_id, 'Rate ' || coalesce(lang, '(empty)') || ' text of ' || coalesce(source, '(empty)') || ' with ' || n_chars || ' characters, (empty)' AS prompt FROM documents")
def prompt_document(spark, d):
    """A template document with variables by name, mapped to columns, filled for each row."""
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("col_1"), F.col("source").alias("col_2"), F.col("n_chars").alias("col_3"))
    names = {"language": "col_1", "origin": "col_2", "length": "col_3"}
    doc = templates.document("Rate {{language}} text of {{origin}} with {{length}} characters, {{nothing}}", [{"id": n, "slug": n, "display_name": n.title()} for n in names])
    made = templates.prompt(doc, {n: {"slug": c, "name": n.title()} for n, c in names.items()})
    return augment.filled_prompts(docs, made).select("doc_id", "prompt")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size || 'B' WHEN p_size % 3 = 1 THEN p_size * 10 || 'M' END AS size FROM part")
def parameter_counts(spark, d):
    """Sizes in names of models: the last one counts."""
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("llama-1K-"), size, F.lit("b-chat"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("tiny-"), (F.col("p_size") * 10).cast("string"), F.lit("M"))).otherwise(F.lit("gpt"))
    return read(spark, d, "part").select("p_partkey", tx.parameter_count(name).alias("size"))
