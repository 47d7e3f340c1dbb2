"""JSON documents read by ranges of bytes, against the parser of whole texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spindrift.sources import ranges, readers


def value(rng, deep=0):
    kind = rng.randrange(8 if deep < 3 else 5)
    if kind == 0:
        return rng.choice([None, True, False, 1, -2.5e3])
    if kind < 5:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "日", "a", " ", "\n", "x" * 30]) for _ in range(rng.randrange(12)))
    if kind < 7:
        return {rng.choice(["data", "items", "k", "é}"]) + str(rng.randrange(3)): value(rng, deep + 1) for _ in range(rng.randrange(4))}
    return [value(rng, deep + 1) for _ in range(rng.randrange(4))]


def texts():
    rng = random.Random(1)
    out = []
    for i in range(6):
        rows = [value(rng) for _ in range(150)]
        out += [json.dumps(rows, indent=rng.choice([None, 1]), ensure_ascii=i % 2 == 0)]
        out += [json.dumps({"meta": value(rng), "results": rows, "more": {"data": [1]}, "list": [{"a": [2]}]}), json.dumps({"rows": 1, "documents": rows, "items": [] if i % 2 else {"a": 1}})]
    return [*out, "[]", " [ ] ", '{"data": []}', '{"a": 1}', '"one"', "7", "", "  \n", "﻿[1, {}]", '[{"a": 1}, 2]\n', '{"data": [{"x": "}"}]}']


@pytest.fixture
def small(spark, monkeypatch):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def items(spark, path, large):
    return sorted(r[0] for r in readers.read_json(spark, path, large).select(F.to_json("v")).collect())


def test_rows_of_ranges_equal_those_of_whole_texts(spark, tmp_path, small):
    for i, text in enumerate(texts()):
        (tmp_path / f"f{i}.json").write_text(text, encoding="utf-8")
    want = items(spark, str(tmp_path), 2**60)
    assert ranges._ranges(spark, str(tmp_path / "f0.json")).select("start").distinct().count() > 5
    assert items(spark, str(tmp_path), -1) == want and len(want) > 2000


@pytest.mark.parametrize("text", ['[{"a": 1}, {"b": 2', '[{"a": 1}, {"b": 2}', '[{"a": 1}] x', '[{"a": 1}] []', '[{"a": 1},]', '[{"a": 1},, 2]', '[{"a": 1} {"b": 2}]', '[{"a": 1]]', '{"data": [{"a": 1}}', '{"data": [{"a": 1}], "b": }', '{"data": [{"a": 1}]', '{"a": 1', '[{"a": "x}]', '[{"a": 1}}'])
def test_broken_documents_fail(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    for large in (-1, 2**60):
        with pytest.raises(Exception):  # noqa: B017
            items(spark, str(tmp_path), large)
