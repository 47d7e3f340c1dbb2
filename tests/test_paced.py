"""Paced calls, deep pages and turns from a stream."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindrift.operators import conversation, paced, table
from spindrift.streaming import ingest


class Limited:
    """Writes each call to a file; tells callers to wait if more than `most` came within a second; dies once, if told to."""

    def __init__(self, path, most=1000, dies=None):
        self.path, self.most, self.dies = str(path), most, dies

    def calls(self):
        return [(float(a), b) for a, b in (x.split(" ", 1) for x in open(self.path).read().splitlines())] if os.path.exists(self.path) else []

    def complete(self, prompts):
        now = time.time()
        if sum(now - 1 < t <= now for t, _ in self.calls()) >= self.most:
            with open(f"{self.path}.refused", "a") as f:
                f.write(f"{prompts[0]}\n")
            return [RuntimeError("429 rate limit, try again in 300 ms")]
        with open(self.path, "a") as f:
            f.write(f"{now} {prompts[0]}\n")
        if self.dies in prompts and not os.path.exists(f"{self.path}.dead"):
            open(f"{self.path}.dead", "w").close()
            os._exit(1)
        return [f"<{p}>" for p in prompts] if prompts[0] != "bad" else [RuntimeError("invalid")]


def test_no_burst_and_equal_prompts_once(spark, tmp_path):
    provider = Limited(tmp_path / "calls")
    df = spark.range(60).select(F.col("id").alias("row_index"), F.when(F.col("id") == 59, None).when(F.col("id") == 58, "bad").otherwise(F.concat(F.lit("p"), F.col("id") % 20)).alias("t"), F.lit(1).alias("hash")).repartition(4)
    out = paced.paced_answers(df, F.col("t"), provider, paced.Pace(rate=20, name=str(tmp_path))).collect()
    got = {r["row_index"]: (r["content"], r["error"]) for r in out}
    assert len(out) == 60 and got[59] == (None, None) and got[58] == (None, "invalid") and all(got[i] == (f"<p{i % 20}>", None) for i in range(58))
    times = sorted(t for t, _ in provider.calls())
    assert Counter(p for _, p in provider.calls()) == Counter([f"p{i}" for i in range(20)] + ["bad"])
    assert all(b - a > 0.9 for a, b in zip(times, times[20:], strict=False))  # 20 calls a second, of all tasks together


def test_waits_that_the_provider_states(spark, tmp_path):
    provider = Limited(tmp_path / "calls", most=5)
    df = spark.range(12).select(F.col("id").alias("row_index")).repartition(3)
    out = paced.paced_answers(df, F.concat(F.lit("q"), "row_index"), provider, paced.Pace(rate=40, attempts=20, name=str(tmp_path))).collect()
    assert {r["content"] for r in out} == {f"<q{i}>" for i in range(12)} and len(provider.calls()) == 12 and os.path.exists(f"{provider.path}.refused")
    few = paced.paced_answers(df, F.concat(F.lit("r"), "row_index"), Limited(tmp_path / "few", most=0), paced.Pace(rate=100, attempts=2, name=f"{tmp_path}2")).collect()
    assert {r["error"] for r in few} == {"429 rate limit, try again in 300 ms"} and set(Counter(open(tmp_path / "few.refused").read().split()).values()) == {2}
    assert [paced.stated_wait(RuntimeError(x)) for x in ("Retry after 2 s", "try again in 1.5m", "no")] == [2.0, 90.0, None]
    assert paced.Pace.with_search().width == 3


def test_a_killed_worker_asks_nothing_again(spark, tmp_path):
    provider = Limited(tmp_path / "calls", dies="p30")
    df = spark.range(40).select(F.col("id").alias("row_index"), F.concat(F.lit("p"), F.col("id")).alias("t")).coalesce(1)
    run = lambda: paced.paced_answers(df, F.col("t"), provider, paced.Pace(rate=200, width=1, name=str(tmp_path)), str(tmp_path / "answers")).collect()
    with pytest.raises(Exception):  # noqa: B017  a local master runs a task once
        run()
    assert {r["content"] for r in run()} == {f"<p{i}>" for i in range(40)}
    times = Counter(p for _, p in provider.calls())
    assert times.pop("p30") == 2 and set(times.values()) == {1} and len(times) == 39


def test_deep_pages_read_few_ranges(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("row_index"), (F.col("id") % 7).alias("k"), F.lit("x").alias("__part")).repartition(5)
    index = table.PageIndex(df, "k", "desc", ranges=16)
    want = [r["row_index"] for r in df.orderBy(F.col("k").desc(), "row_index").collect()]
    for number, size in ((1, 10), (50, 10), (100, 10), (7, 150), (8, 150), (2, 999)):
        assert [r["row_index"] for r in index.page(number, size).collect()] == want[(number - 1) * size : number * size]
    assert len(index.ranges) > 4 and len(index.page(50, 10).inputFiles()) <= 2
    assert table.PageIndex(df.where("false"), "k").page(1, 10).collect() == []


def test_turns_of_a_stream(spark, tmp_path):
    rows = [(f"c{i % 3}", i, "assistant" if i % 4 == 3 else "user", f"m{i}" if i % 11 else "") for i in range(150)]
    rows += [(None, 1, "user", "x"), ("c1", 200, "system", "y"), ("c9", 3, "assistant", "first")]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] * 3 // 201 == part], "conversation_id string, line_no long, role string, content string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema("conversation_id string, line_no long, role string, content string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ingest.append(ingest.turns(source, order="line_no"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    df = spark.createDataFrame(rows, "conversation_id string, line_no long, role string, content string")
    want = conversation.normalize_messages(df)
    key = lambda d: sorted(map(tuple, d.select(want.columns).collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want)
    # What comes late is left out.
    spark.createDataFrame([("c0", 5, "assistant", "late"), ("c0", 300, "assistant", "new")], "conversation_id string, line_no long, role string, content string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    ingest.append(ingest.turns(source, order="line_no"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    more = {r["agent_response"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "new" in more and "late" not in more


def test_sessions_of_a_stream_are_forgotten(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame(rows, "conversation_id string, timestamp string, role string, content string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = spark.readStream.schema("conversation_id string, timestamp timestamp, role string, content string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        ingest.append(ingest.turns(source, forget="1 hours"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    put(("a", "2024-01-01T00:00:00Z", "user", "q"), ("a", "2024-01-01T00:01:00Z", "assistant", "r"))
    put(("b", "2024-01-01T05:00:00Z", "user", "q"))
    put(("b", "2024-01-01T05:01:00Z", "assistant", "r"))
    put(("a", "2024-01-01T06:00:00Z", "assistant", "again"))
    got = {r["agent_response"]: r["id"] for r in spark.read.parquet(str(tmp_path / "out")).where("session_id = 'a'").collect()}
    assert got == {"r": "a_turn_0", "again": "a_turn_0"}
