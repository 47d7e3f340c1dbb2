"""Provider calls at a steady pace, with waits that the provider asks for, and answers that outlive a lost task.

Equal prompts are asked once. The tasks of a machine share a token bucket, kept in a locked file, so that together they stay
under the rate; a provider that says how long to wait is asked again after that time, by the same task, and the bucket waits
with it. Each answer is written to a folder by its prompt's hash as it comes, so that a task that is run again, or the
whole query, asks only what has no answer yet.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .augment import CONCURRENCY, Provider

SEARCH_CONCURRENCY = 3
SEARCH_GAP = 0.5
_WAIT = re.compile(r"(?:retry after|try again in|retry in)\s+([0-9]+(?:\.[0-9]+)?)\s*(ms|s|m)?", re.I)


@dataclass(frozen=True)
class Pace:
    """rate: calls a second of all tasks of a machine; burst: calls that may come at once after a pause; width: calls of a task
    that run at a time; gap: seconds between a task's calls; attempts: of a prompt that is told to wait."""

    rate: float = 10.0
    burst: int = 1
    width: int = CONCURRENCY
    gap: float = 0.0
    attempts: int = 4
    name: str = "provider"

    @staticmethod
    def with_search(rate: float = 10.0, **more) -> Pace:
        """Calls that search the web: fewer at a time, with a gap."""
        return Pace(rate, width=SEARCH_CONCURRENCY, gap=SEARCH_GAP, **more)


class Bucket:
    """The time at which the next call may start, shared by the processes of a machine."""

    def __init__(self, pace: Pace) -> None:
        self.pace = pace
        self.path = f"{tempfile.gettempdir()}/spindrift-pace-{hashlib.sha1(pace.name.encode()).hexdigest()[:16]}"

    def _next(self, change) -> float:
        with open(self.path, "a+") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            start, then = change(float(f.read() or 0), time.time())
            f.truncate(0)
            f.write(repr(then))
        return start

    def take(self) -> None:
        """Wait for a turn."""
        step = 1 / self.pace.rate

        def change(free: float, now: float) -> tuple[float, float]:
            free = max(free, now - self.pace.burst * step + step)  # a pause saves up `burst` calls, not more
            return max(free, now), free + step

        time.sleep(max(0.0, self._next(change) - time.time()))

    def hold(self, seconds: float) -> None:
        """No call starts before that time has gone by."""
        self._next(lambda free, now: (now, max(free, now + seconds)))


def stated_wait(error: Exception) -> float | None:
    """Seconds that an error says to wait: its retry_after, or in its text."""
    if isinstance(getattr(error, "retry_after", None), int | float):
        return float(error.retry_after)
    m = _WAIT.search(str(error))
    return None if m is None else float(m[1]) * {"ms": 0.001, "m": 60.0}.get((m[2] or "s").lower(), 1.0)


class Answers:
    """Answers by prompt hash, a small file each, in a folder that all executors share (a path or URI of pyarrow.fs)."""

    def __init__(self, folder: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)

    def _path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def get(self, key: str) -> str | None:
        if self.files.get_file_info(self._path(key)).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(self._path(key)) as f:
            return json.loads(f.read().decode())

    def put(self, key: str, content: str) -> None:
        path = self._path(key)
        self.files.create_dir(path.rpartition("/")[0])
        other = f"{path}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(other) as f:
            f.write(json.dumps(content).encode())
        self.files.move(other, path)  # whole or not at all


def ask(prompt: str, key: str, provider: Provider, bucket: Bucket, answers: Answers | None) -> tuple[str | None, str | None]:
    """(content, error) of one prompt."""
    if answers is not None and (known := answers.get(key)) is not None:
        return known, None
    for left in range(bucket.pace.attempts - 1, -1, -1):
        bucket.take()
        try:
            found = provider.complete([prompt])[0]
        except Exception as e:
            found = e
        if not isinstance(found, Exception):
            if answers is not None:
                answers.put(key, found)
            return found, None
        wait = stated_wait(found)
        if wait is None or not left:
            return None, str(found)
        bucket.hold(wait)
    raise AssertionError("no attempt was made")


def paced_answers(df: DataFrame, prompt: Column, provider: Provider, pace: Pace, folder: str | None = None, key: str = "row_index") -> DataFrame:
    """(key, content, error) of every row. folder: where answers are kept; failed prompts are asked again by the next run.

    A null prompt has neither; rows with equal prompts share an answer. A provider that raises anything but an Exception
    (or whose worker dies) fails the task, which finds its answers when it is run again.
    """

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, answers = Bucket(pace), None if folder is None else Answers(folder)

        def one(pair: tuple[str, str]) -> tuple[str | None, str | None]:
            found = ask(*pair, provider, bucket, answers)
            time.sleep(pace.gap)
            return found

        with ThreadPoolExecutor(pace.width) as pool:
            for part in parts:
                found = list(pool.map(one, zip(part["prompt"], part["hash"], strict=True)))
                yield pd.DataFrame({"hash": part["hash"], "content": [c for c, _ in found], "error": [e for _, e in found]})

    rows = df.select(F.col(key), prompt.alias("prompt")).withColumn("hash", F.sha2("prompt", 256))
    asked = rows.where("prompt is not null").select("hash", "prompt").dropDuplicates(["hash"])
    return rows.drop("prompt").join(asked.mapInPandas(apply, "hash string, content string, error string"), "hash", "left").select(key, "content", "error")
