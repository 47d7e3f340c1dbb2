"""The label model against the plain labels, held out, on the given tables."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import toxicity


def area(y, score):
    """The share of pairs of a toxic and a clean row that the scores put in order."""
    return np.mean([np.mean((score[y == 0] < s) + 0.5 * (score[y == 0] == s)) for s in score[y == 1]])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_posteriors_are_not_below_plain_labels(spark, sf):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", toxicity.letters(F.col("text")).alias("text"))
    rows = sorted(map(tuple, docs.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic is not null").collect()))
    found = {}
    for fold in range(5):
        part = [zlib.crc32(str(i).encode()) % 5 == fold for i, _, _ in rows]
        train, held = ([r for r, p in zip(rows, part, strict=True) if p == side] for side in (False, True))
        y, truth = np.array([r[2] for r in train]), np.array([r[2] for r in held])
        x = toxicity.Terms([r[1] or "" for r in train])
        used = np.unique(np.concatenate(toxicity.lexicons(x, y)))
        for name, target in (("labels", y.astype(float)), ("posterior", toxicity.posterior(x, y))):
            score = np.array(list(map(toxicity.Scorer(toxicity.linear(x, target, used)), [r[1] for r in held])))
            found.setdefault(name, []).append((area(truth, score), np.mean(score[truth == 1] >= 0.5)))
    ours, theirs = (np.mean(found[k], axis=0) for k in ("posterior", "labels"))
    assert ours[0] > theirs[0] - 0.002 and ours[1] >= theirs[1]


def test_given_labels_are_overruled_by_clear_votes_only():
    y = np.array([0, 1] * 400)
    odds = np.where(y == 1, 6.0, -6.0)
    odds[[0, 3]] *= -2.5  # clear votes against the given label
    odds[[10, 13]] *= -0.3
    p, rates = toxicity.with_given(odds, y)
    assert p[0] > 0.9 and p[3] < 0.1 and p[10] < 0.5 < p[13] and (rates < 0.02).all()
    assert toxicity.calibrated(np.array([40.0, -40.0] * 50 + [40.0, -40.0]), np.array([1, 0] * 50 + [0, 1]))[0] == pytest.approx(np.log(50), abs=0.3)
