import json

import pytest
from pyspark.sql import functions as F

from spindrift.sources import normalize, readers
from spindrift.streaming import ingest

MESSAGES = [
    {"role": "user", "content": "hello", "timestamp": "2024-01-01T00:00:00Z", "conversation_id": "c"},
    {"role": "assistant", "content": "hi\nthere", "timestamp": "2024-01-01T00:00:01Z", "metadata": {"session_id": "c", "tokens": 3}},
]
TRACE = {
    "id": "t", "name": "run", "timestamp": "2024-01-01T00:00:00.1Z", "user_id": "u", "session_id": "s", "public": False,
    "observations": [
        {"id": "o1", "trace_id": "t", "type": "SPAN", "name": "plan", "input": "x"},
        {"id": "o2", "trace_id": "t", "type": "GENERATION", "name": "g", "input": {"messages": [{"role": "user", "content": "q"}]}, "output": {"content": "a"}},
    ],
}
RUN = {"id": "r", "run_type": "llm", "inputs": {"input": "q"}, "outputs": {"generations": [{"text": "a"}]}, "trace_id": "t", "dotted_order": "1", "execution_order": 1, "status": "ok", "session_id": "s"}
SPAN = {"context.trace_id": "t", "context.span_id": "p", "attributes": {"input.value": "q", "llm.output_messages": [{"message.role": "assistant", "message.content": "a"}], "session.id": "s"}}


def write(tmp_path, name, rows, indent=None):
    path = tmp_path / name
    path.write_text(json.dumps(rows, indent=indent) if isinstance(rows, dict) else "\n".join(json.dumps(r) for r in rows))
    return str(path)


def best(spark, path):
    return tuple(readers.detect(spark, path).first())


def test_detection(spark, tmp_path):
    assert best(spark, write(tmp_path, "m.jsonl", MESSAGES)) == ("message-centric", 1.0)
    assert best(spark, write(tmp_path, "t.json", TRACE, 2)) == ("langfuse", 1.0)
    assert best(spark, write(tmp_path, "r.jsonl", [RUN, RUN])) == ("langsmith", 1.0)
    assert best(spark, write(tmp_path, "a.json", SPAN, 2)) == ("arize", 1.0)
    csv = tmp_path / "c.csv"
    csv.write_text('turn_id,session_id,user_id,timestamp,user_message,assistant_message\n1,s,u,now,"a, b","it\'s\nso"\n\n2,s,u\n')
    name, score = best(spark, str(csv))
    assert name == "turn-level" and abs(score - 1) < 1e-9
    rows = readers.load(spark, str(csv), "turn-level").collect()
    assert [r["assistant_message"] for r in rows] == ["it's\nso", None] and rows[0]["user_message"] == "a, b"


def test_normalization(spark, tmp_path):
    trace = readers.read_json(spark, write(tmp_path, "t.json", TRACE, 2))
    assert [tuple(r)[:5] for r in normalize.langfuse(trace).collect()] == [("t_obs_o2", "2024-01-01T00:00:00.1Z", "s", "q", "a")]
    run = normalize.langsmith(readers.read_json(spark, write(tmp_path, "r.json", RUN))).first()
    assert tuple(run)[3:5] == ("q", "a") and run["metadata"] == {"run_type": "llm", "execution_order": "1", "status": "ok"} and json.loads(run["conversation_context"]) == RUN["inputs"]
    span = normalize.arize(readers.read_json(spark, write(tmp_path, "a.json", SPAN))).first()
    assert tuple(span)[:5] == ("t_p", None, "s", "q", "a") and span["conversation_context"] == "q"
    one_sided = [RUN, {**RUN, "outputs": {}}]
    assert normalize.langsmith(readers.read_jsonl(spark, write(tmp_path, "o.jsonl", one_sided))).count() == 1
    errors = normalize.errors(normalize.langfuse(trace)).first()["errors"]
    assert errors == []


def test_flattening(spark, tmp_path):
    rows = [{"a": {"b": {"c": 1}}, "n": 1, "l": [1, None, 2], "o": [{"x": 1}], "e": []}, {"n": 1.5, "a": {"b": {"d": "y" * 12000}}, "big": 3000000000, "l": list(range(2000))}]
    t = readers.load(spark, write(tmp_path, "f.jsonl", rows))
    got = {r["n"]: r.asDict() for r in t.collect()}
    assert got[1.0]["a.b.c"] == 1 and got[1.0]["l"] == "1, 2" and got[1.0]["o"] == '[{"x":1}]' and got[1.0]["e"] == "[]" and got[1.0]["big"] is None
    assert len(got[1.5]["a.b.d"]) == 12000 and got[1.5]["big"] == 3000000000 and got[1.5]["l"].count(",") == 999
    shallow = readers.flatten(readers.read_jsonl(spark, write(tmp_path, "f.jsonl", rows)).select("v"), 1)
    assert json.loads(shallow.where("n = 1").first()["a"]) == {"b": {"c": 1}}


def test_bad_lines_and_wrapped_rows(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(path)).count() == 2
    assert readers.load(spark, write(tmp_path, "w.json", {"meta": 1, "items": [{"a": 1}, {"a": 2}]})).count() == 2
    bad = tmp_path / "n.jsonl"
    bad.write_text("x\ny\n{}\n")
    assert readers.validate_lines(spark, str(bad), "message-centric").count() == 1


def test_json_documents_are_whole_or_an_error(spark, tmp_path):
    big = tmp_path / "big.json"
    item = json.dumps({"a": "x" * 1_000_000, "n": [1, "]", {"b": "\\\"}"}]})
    big.write_text('{"items": [' + ", ".join([item] * 140) + "]}")  # beyond the size of a VARIANT
    assert readers.read_json(spark, str(big)).count() == 140
    small = tmp_path / "small.json"
    for text, n in (('\ufeff[1, null,\n{"a": [1]}]', 3), ('{"meta": [1], "rows": {}, "records": [{"a": 1}, 2]}', 2), ('{"a": [1, 2]}', 1), ("[]", 0), ('"text"', 1), (" \n", 0)):
        small.write_text(text)
        assert readers.read_json(spark, str(small)).count() == n
    for text in ('[{"a": 1}, {"a": ', '{"a": 1} {"a": 2}', '{"a" 1}', "[1 2]", "[NaN]", "a,b\n1,2"):
        small.write_text(text)
        with pytest.raises(Exception, match="not a JSON document"):
            readers.load(spark, str(small), "json").collect()
    assert readers.load(spark, str(small)).columns == ["a", "b"]  # no JSON at all is CSV


def test_detection_reads_a_whole_document_only_where_it_must(spark, tmp_path, monkeypatch):
    paths = [write(tmp_path, "m.jsonl", MESSAGES), write(tmp_path, "t.jsonl", [TRACE, TRACE])]
    document = write(tmp_path, "t.json", TRACE, 2)
    items, asked = readers._items, []
    monkeypatch.setattr(readers, "_items", lambda spark, path: asked.append(path) or items(spark, path))
    assert [best(spark, p)[0] for p in paths] == ["message-centric", "langfuse"] and not asked
    assert best(spark, document) == ("langfuse", 1.0) and asked == [document]


def test_stream_takes_what_is_new(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "1.jsonl", MESSAGES)
    for n in (2, 4):
        ingest.append(ingest.messages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        write(tmp_path / "in", "2.jsonl", MESSAGES)


def test_profile(spark):
    df = spark.createDataFrame([("1", "true", '{"a":1}', "x"), ("2.5", "false", "[1]", "2024-01-01")], "n string, b string, j string, s string")
    assert {r["field"]: r["type"] for r in normalize.profile(df, ["n", "b", "j"]).collect()} == {"n": "number", "b": "boolean", "j": "json"}
    assert F.lit(1) is not None


def test_suggestions_previews_and_samples(spark, tmp_path):
    assert best(spark, write(tmp_path, "zero.jsonl", [{**SPAN, "context.trace_id": "0"}] * 3)) == ("arize", 1.0)
    path = tmp_path / "odd.jsonl"
    path.write_text("\n".join(['{"a": 1}', "oops", "", '{"a": 2}']))
    assert [(r["n"], r["error"]) for r in readers.preview(spark, str(path)).collect()] == [(0, None), (1, "not JSON"), (2, None)]
    assert readers.sample(spark, str(path), most_bytes=14).count() == 2 and readers.sample(spark, str(path), most_bytes=1).count() == 1
    bad = tmp_path / "bad.jsonl"
    bad.write_text("x\ny")
    assert readers.read_jsonl(spark, str(bad)).count() == 0
    with pytest.raises(ValueError, match="JSON"):
        readers.read_jsonl(spark, str(bad), some=True)
    detected = spark.createDataFrame([("langfuse", 0.5), ("arize", 0.1)], "format string, confidence double")
    assert [r[0] for r in readers.suggestions(detected).collect()] == [readers.LOW_CONFIDENCE.format("langfuse")]
    assert tuple(readers.stored_bytes(spark, str(tmp_path)).first())[1] >= 3


def test_a_line_is_parsed_once(spark, tmp_path):
    rows = ['{"a": {"b": 1, "c": [1, null]}, "d": "x"}', "no JSON", '{"a": {"b": 2.5, "c": null}}', "null", '{"a": null, "d": "\u00e9"}']
    path = tmp_path / "once.jsonl"
    path.write_text("\n".join(rows))
    flat = readers.load(spark, str(path), "jsonl")
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.count("parse_json(") == 1 and "from_json" not in plan
    assert {tuple(r) for r in flat.collect()} == {(1.0, "1", "x"), (2.5, None, None), (None, None, None), (None, None, "\u00e9")} and flat.count() == 4
