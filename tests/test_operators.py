import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import errors, templates
from spindrift.functions import text as tx
from spindrift.operators import augment, catalog, cluster, conversation, reduce, search, table
from spindrift.plans import layer


def test_js_strings(spark):
    values = [0.00045, 100.0, 1.5, 1e21, 1.25e-7, -0.5, 0.0, 123456789012.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(tx.js_number(F.col("x"))).collect()]
    assert got == ["0.00045", "100", "1.5", "1e+21", "1.25e-7", "-0.5", "0", "123456789012", None]


def test_interpolation(spark):
    df = spark.createDataFrame([("{{b}}", None, True, 2.0)], "a string, b string, c boolean, d double")
    got = df.select(tx.interpolate("{{a}}|{{b}}|{{c}}|{{d}}|{{e}}|{a}|{{ a }}", df.schema)).first()[0]
    assert got == "{{b}}|(empty)|true|2|(empty)|{a}|{{ a }}"


def test_lenient_json(spark):
    texts = ['{"a": 1}', 'so ```json\n{"a": 1}\n``` ok', 'well {"a": 1} then', '{"a": 1} and {"b": 2}', "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.try_variant_get(tx.lenient_json(F.col("t")), "$.a", "int")).collect()]
    assert got[:3] == [1, 1, 1] and got[4:] == [None, None]


def test_violations(spark):
    df = spark.createDataFrame([('{"n": "x", "e": "c", "l": [1]}',)], "j string")
    schema = [{"name": "n", "type": "number"}, {"name": "e", "type": "enum", "enum": ["a", "b"]}, {"name": "l", "type": "array_number", "min_items": 2}, {"name": "m", "type": "string"}]
    assert len(df.select(tx.violations(F.col("j"), schema)).first()[0]) == 4


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "", None]), st.integers(0, 4), st.text("xy\n", max_size=3)), min_size=1, max_size=12), st.sampled_from(conversation.FRAMES))
def test_history_equals_a_model(spark, rows, strategy):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, c string, s long, t string")
    got = {r["i"]: r["history"] for r in conversation.history(df, "c", ["s", "i"], ["t"], strategy).collect()}
    groups = {}
    for i, (c, s, t) in enumerate(rows):
        groups.setdefault(c or "", []).append((s, i, t))
    for turns in groups.values():
        turns.sort()
        for k, (_, i, _) in enumerate(turns):
            low, high = {"turn_only": (k, k), "history_until_turn": (0, k), "turn_plus_n": (max(0, k - 2), k), "full_conversation": (0, len(turns) - 1)}[strategy]
            shown = turns[low : high + 1]
            parts = [f"[Turn {j + 1}]{' ← CURRENT' if j == len(shown) - 1 and j == k else ''}\nt: {t}" for j, (_, _, t) in enumerate(shown)]
            assert got[i] == "\n---\n".join(parts)


def test_normalizer_equals_the_fold(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice(["user", "user", "assistant", "system"]), f"m{i}") for i in range(160)]
    df = spark.createDataFrame(rows, "line_no long, conversation_id string, role string, content string")
    got = {r["id"]: (r["user_input"], r["conversation_context"]) for r in conversation.normalize_messages(df).collect()}
    state, want = {}, {}
    for _, c, role, content in rows:
        context, n = state.setdefault(c, ([], 0))
        if role == "user":
            context.append(f"User: {content}")
        elif role == "assistant":
            want[f"{c}_turn_{n}"] = (next((x[6:] for x in reversed(context) if x.startswith("User: ")), ""), "\n".join(context))
            state[c] = ([*context, f"Assistant: {content}"][-20:], n + 1)
    assert got == want


def test_row_index_and_sets(spark):
    df = spark.createDataFrame([(x,) for x in "dacb"], "k string")
    assert [tuple(r) for r in table.with_row_index(df, ["k"]).orderBy("row_index").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    numbered = table.with_row_index(df)
    assert sorted(r["row_index"] for r in numbered.collect()) == [0, 1, 2, 3]
    assert table.in_row_set(numbered, []).count() == 0 and table.in_row_set(numbered, list(range(101))).count() == 4
    assert table.in_row_set(numbered, [1, 2]).count() == 2


def test_nulls_sort_last(spark):
    df = spark.createDataFrame([(0, None), (1, 2), (2, 1)], "row_index long, x long")
    for direction, want in (("asc", [2, 1, 0]), ("desc", [1, 2, 0]), (None, [0, 1, 2])):
        assert [r[0] for r in table.page(df, sort="x", direction=direction).collect()] == want


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "i long, t string")
    table.export_csv(df, str(tmp_path / "x"), {"t": "Text"})
    back = spark.read.csv(str(tmp_path / "x"), header=True, escape='"')
    assert sorted(map(tuple, back.collect())) == [("1", 'a "b", c'), ("2", None)]


def test_knn_over_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).tolist() + [[0.0] * 5]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, search.knn(df, 4, block=b).collect())) for b in (2048, 7))
    assert one == many and all(r[0] != r[1] for r in one) and all(r[2] == 1 for r in one if r[0] == 60)
    assert search.knn(df.limit(1), 4).count() == 0


def test_pca_recovers_a_line(spark):
    x = [[1.0 * i, 2.0 * i, 0.0] for i in range(20)]
    got = reduce.pca(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, embedding array<double>"), 2).orderBy("i").collect()
    first = [r["coordinates"][0] for r in got]
    assert np.allclose(np.diff(first), np.sqrt(5)) and np.allclose([r["coordinates"][1] for r in got], 0, atol=1e-6)


def test_planted_blobs_are_clusters(spark):
    rng = np.random.default_rng(2)
    centers = np.eye(3) * 10
    x = [(c * 100 + i, (centers[c] + rng.normal(size=3) * 0.2).tolist()) for c in range(3) for i in range(25)]
    got = cluster.density_clusters(spark.createDataFrame(x, "vec_id long, embedding array<double>"), min_size=5).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"] // 100, []).append(r["cluster_id"])
    main = [max(set(v), key=v.count) for v in by.values()]
    assert len(set(main)) == 3 and -1 not in main


def test_clusters_of_copies_within_reach_are_one(spark):
    def at(angle):
        return [float(np.cos(angle)), float(np.sin(angle))]

    # Two groups of copies within reach of each other, and loose rows, the core distances of which make the reach.
    x = [at(0.0)] * 15 + [at(0.01)] * 15 + [at(2 + 0.02 * i) for i in range(12)] + [[0.0, 0.0], None]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = dict(map(tuple, cluster.density_clusters(df, min_size=5).collect()))
    assert len(got) == len(x) and {got[i] for i in range(30)} == {0} and got[42] == got[43] == -1


def test_links_within_connect_what_all_pairs_do(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def roots(pairs):
        up = list(range(len(x)))
        for _ in up:
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    want = roots([(a, b) for a in range(80) for b in range(a) if 1 - u[a] @ u[b] <= 0.02])
    for block in (2048, 9):
        links = [tuple(r)[:2] for r in search.links_within(df, 0.02, block=block).collect()]
        assert roots(links) == want and len(set(want)) > 1
        assert block == 9 or len(links) < 80


def test_failures_are_data(spark):
    class Broken:
        def complete(self, prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("connection reset")
            return list(prompts)

    df = spark.createDataFrame([(0, "a"), (1, "boom"), (2, "c")], "row_index long, t string").coalesce(1)
    got = {r["row_index"]: r for r in augment.model_column(df, "{{t}}", Broken(), batch=1).collect()}
    assert got[1]["status"] == "failed" and got[1]["error_type"] == "network" and got[1]["value"] is None and got[0]["value"] == "a"
    assert {r["status"] for r in augment.model_column(df, "{{t}}", Broken(), batch=5).collect()} == {"failed"}


def test_truncation(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("a b",), (None,)], "t string")
    got = [r[0] for r in df.select(augment.truncated(F.col("t"), lambda x: len(x.split()), 4)).collect()]
    assert got[0].endswith(" [truncated...]") and len(got[0].split()) <= 4 and got[1:] == ["a b", None]
    assert augment.token_limit("text-embedding-004", "google") == 1740


def test_truncation_by_one_tokenization(spark):
    def starts(x):
        return [i for i, c in enumerate(x) if c != " " and (i == 0 or x[i - 1] == " ")]

    rows = [("a b c d e f g",), ("a b",), (None,), ("",), ("  x  yy zzz  w v  u",), ("one " * 50,)]
    df = spark.createDataFrame(rows, "t string")
    for most in (1, 2, 4, 9):
        got = df.select(augment.truncated_at(F.col("t"), starts, most), augment.truncated(F.col("t"), lambda x: len(x.split()), most)).collect()
        assert [r[0] for r in got] == [r[1] for r in got]


def test_indexed_search_reads_few_rows(spark):
    texts = [f"row {i} {'needle' if i % 50 == 7 else 'nee dle'} %_x" for i in range(500)] + [None, "", "NEEDLE", "é%_X"]
    df = spark.createDataFrame([(i, t, "b" if i % 2 else None) for i, t in enumerate(texts)], "row_index long, t string, u string")
    index = search.TrigramIndex(df, ["t", "u"])
    for q in ("Needle", "%_x", "zz", "b", "row 49", "nee dlex", ""):
        assert index.search(q).collect() == search.literal_search(df, ["t", "u"], q).collect()
    assert index.search("needle", "row_index < 100").count() == 2 and index.candidates("needle").count() == 11 and index.candidates("ab") is None


def test_postings_are_collected_by_tasks(spark, monkeypatch):
    texts = [f"Row {i} of \U0001f600\u00e9 needles" for i in range(300)] + ["", "ab", None]
    df = spark.createDataFrame([(f"r{i:03d}", t) for i, t in enumerate(texts)], "row_index string, t string").repartition(3)
    every = {(t[i : i + 3], n) for n, t in enumerate(x.lower() if x else "" for x in texts) for i in range(len(t) - 2)}
    for chars in (search.CHARS, 50):
        monkeypatch.setattr(search, "CHARS", chars)
        index = search.TrigramIndex(df, ["t"])
        got = [(r["trigram"], i) for r in index.postings.collect() for i in r["ids"]]
        assert sorted(got) == sorted((t, f"r{n:03d}") for t, n in every)
        assert index.postings.count() <= 3 * len({t for t, _ in every}) < len(every)
        assert [r["row_index"] for r in index.search("\U0001f600\u00c9 n", limit=3).collect()] == ["r000", "r001", "r002"]


def test_catalog_keeps_the_last_version(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    c.upsert("files", spark.createDataFrame([("f", "one"), ("g", "two")], "id string, name string"))
    c.upsert("files", spark.createDataFrame([("f", "new")], "id string, name string"))
    assert {r["id"]: r["name"] for r in c.read("files").collect()} == {"f": "new", "g": "two"}
    c.upsert("embedding_layers", spark.createDataFrame([("l1", "f", True), ("l2", "f", False)], "id string, file_id string, is_active boolean"))
    c.upsert("embedding_points", spark.createDataFrame([("l1", "p")], "layer_id string, point_id string"))
    c.activate("l2")
    assert {r["id"]: (r["is_active"], r["point_count"]) for r in c.layers("f").collect()} == {"l1": (False, 1), "l2": (True, 0)}
    c.upsert("column_metadata", spark.createDataFrame([("f", "c", "Name")], "file_id string, column_id string, column_name string"))
    assert not c.name_is_free("f", "NAME") and c.name_is_free("g", "name")
    c.delete_file("f")
    assert c.read("files").count() == 1 and all(c.read(n).count() == 0 for n in ("embedding_layers", "embedding_points", "column_metadata"))


@pytest.mark.parametrize("n", [30])
def test_layer_from_turns(spark, n):
    rows = [(i, f"c{i % 3}", i, f"word {'x' * (i % 7)}") for i in range(n)]
    df = spark.createDataFrame(rows, "row_index long, conv string, turn long, text string")
    points = layer.build_layer(conversation.compose(df, "conv", ["turn"], ["text"], "turn_only"), augment.EchoProvider(), k=3, min_size=2, min_samples=2, reduction="axes")
    joined = layer.layer_table(points, df, {"text": "Text"})
    assert joined.count() == n and "original_Text" in joined.columns
    assert layer.filter_from_points(points, "label = 'c1'").count() == n // 3


def test_row_index_of_many_files_with_all_columns(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(40), i, f"payload {i}") for i in range(6000)]
    spark.createDataFrame(rows, "k int, i long, payload string").repartition(12).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    table.with_row_index(df, ["k"]).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["row_index"] for r in got) == list(range(6000)) and {(r["k"], r["i"], r["payload"]) for r in got} == set(rows)
    assert [r["k"] for r in sorted(got, key=lambda r: r["row_index"])] == sorted(k for k, _, _ in rows)
    plain = table.with_row_index(df).collect()
    assert sorted(r["row_index"] for r in plain) == list(range(6000))
    assert table.with_row_index(df.where("false"), ["k"]).count() == 0


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, n long").repartition(5)
    got = {r["i"]: r["before"] for r in table.with_running_sum(df, ["i"], "n", "before").collect()}
    assert got == {i: sum(n for _, n in rows[:i]) for i, _ in rows}


def test_ranked_keeps_all_rows(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in search.ranked(df, [1.0, 0.0]).collect()] == list(range(50))


def test_columns_files_layers_and_filters_of_a_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int")
    saved = c.save_file("f", "logs", "csv", rows, {"col_0": "x", "col_1": "y"})
    assert sorted(r["row_index"] for r in saved.collect()) == [0, 1]
    c.save_file("f", "logs", "csv", rows, {"col_0": "x"})
    c.rename_file("f", "other")
    assert [(r["name"], r["version"], r["size"]) for r in c.files().collect()] == [("other", 3, 2)]
    assert [r["column_id"] for r in c.columns("f").collect()] == ["col_0"]
    with pytest.raises(ValueError):
        c.save_file("g", "none", "csv", rows.where("false"), {})
    layers = spark.createDataFrame([("l1", "f", "one"), ("l2", "f", "two")], "id string, file_id string, name string")
    points = spark.createDataFrame([("l1", f"p{i}", [float(i), 0.0], 0) for i in range(4)], "layer_id string, point_id string, coordinates_2d array<double>, cluster_id int")
    c.save_layer(layers.where("id = 'l1'"), points)
    c.save_layer(layers.where("id = 'l2'"), points.where("false"))
    assert {r["id"]: r["is_active"] for r in c.layers("f").collect()} == {"l1": False, "l2": True}
    c.assign_clusters("l1", spark.createDataFrame([("p0", 3), ("p1", -1)], "point_id string, cluster_id int"), "{}")
    assert [(r["point_id"], r["cluster_id"]) for r in c.points("l1").collect()] == [("p0", 3), ("p1", -1), ("p2", None), ("p3", None)]
    assert '"noise":1' in c.layers("f").where("id = 'l1'").first()["cluster_stats"]
    c.upsert("saved_filters", spark.createDataFrame([("s", "f", "mine", [0])], "id string, file_id string, name string, row_indices array<long>"))
    c.rename_filter("s", "yours")
    assert c.filters("f").first()["name"] == "yours"
    c.clear()
    assert c.files().isEmpty() and c.points("l1").isEmpty()


def test_adding_and_dropping_columns(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, x string, x_sources string")
    assert table.add_column(df, "new", "int", "7").first()["new"] == 7
    assert table.drop_column(df, "x").columns == ["id"]
    for wrong in (lambda: table.add_column(df, "ID"), lambda: table.drop_column(df, "y")):
        with pytest.raises(ValueError):
            wrong()


def test_reclustering_on_saved_coordinates(spark):
    rng = np.random.default_rng(1)
    saved = [(f"point_{i}", [*(rng.normal(size=3) * 0.01 + (np.eye(3)[i % 2])).tolist()]) for i in range(60)]
    points = spark.createDataFrame([(i, [1.0, 1.0 + 0.001 * k]) for k, (i, _) in enumerate(saved)], "point_id string, coordinates_2d array<double>")
    found = layer.recluster(points, spark.createDataFrame(saved, "point_id string, coordinates array<double>")).collect()
    assert len({r["cluster_id"] for r in found if int(r["point_id"][6:]) % 2} - {-1}) == 1 and len({r["cluster_id"] for r in found} - {-1}) == 2
    part = spark.createDataFrame(saved[:5], "point_id string, coordinates array<double>")
    assert len({r["cluster_id"] for r in layer.recluster(points, part).collect()} - {-1}) == 1


def test_template_documents():
    variables = [{"id": "v1", "slug": "topic", "display_name": "Topic"}, {"id": "v2", "display_name": "Tone", "required": False, "default": "calm"}, {"id": "v3", "display_name": "Size"}]
    doc = templates.document("Write on {{topic}},\n{{v2}} {{v3}} {{other}}", variables)
    assert [v["id"] for v in templates.variables(doc)] == ["v1", "v2", "v3"]
    p = templates.prompt(doc, {"v1": {"slug": "col_1", "name": "Subject"}})
    assert (p.text, p.shown) == ("Write on {{col_1}},\ncalm {{Size}} {{other}}", "Write on {{Subject}},\ncalm {{Size}} {{other}}")
    assert not p.valid and p.unmapped == [{"id": "v3", "name": "Size"}] and (p.mapped_count, p.total_count) == (1, 3)
    assert templates.prompt(templates.document("", []), {}).text == "" and templates.prompt(templates.document("plain", []), {}).valid
    assert templates.filled("{a} and {b} and {c}", {"a": "1", "b": "2"}) == "1 and 2 and {c}"
    assert templates.history_config('{"conversationIdColumn": "c", "sequenceIdColumn": "s", "aggregationStrategy": "turn_only"}')["sequenceIdColumn"] == "s"
    assert templates.history_config("plain") is None and templates.history_config("[1]") is None
    preview = templates.few_shot_preview("Sum {{ c1 }}", [{"input": {"c1": "x\ny", "c2": "z"}, "wrong": "w", "right": "r"}] * 4, {"c1": "Text"})
    assert preview.startswith("Sum {{Text}}") and preview.count("Example") == 3 and "Text: x\n  y\nWrong output: w\nRight output: r" in preview and "z" not in preview


def test_structured_columns_and_corrections(spark):
    class Answers:
        def complete(self, prompts):
            return ['{"n": 3}' if "one" in p else "nothing" if "two" in p else '{"n": "x"}' if "three" in p else RuntimeError("quota exceeded") for p in prompts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "two", "three", "four"])], "row_index long, t string")
    got = {r["row_index"]: r for r in augment.structured_column(df, "{{t}}", [{"name": "n", "type": "number"}], Answers()).collect()}
    assert got[0]["value"] == '{"n":3}' and [got[i]["error_type"] for i in range(4)] == [None, "invalid_request", "invalid_request", "rate_limit"]
    cells = spark.createDataFrame([(0, "c", True, "A", 5), (1, "c", False, "B", 9), (2, "c", True, "C", 7), (3, "d", True, "D", 8)], "row_index long, column_id string, edited boolean, value string, last_edit_time long")
    assert [(r["t"], r["output"]) for r in augment.corrections(df, cells, "c").collect()] == [("three", "C"), ("one", "A")]
    assert augment.dimension("embed-english-light-v3.0") == 384 and augment.embedded_query(" ", augment.EchoProvider())[0] == 7.0
