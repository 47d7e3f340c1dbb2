"""Toxicity scores by weak supervision.

Labelled training rows give terms (words, word beginnings, and beginnings that several words have) that occur with one
label far more often than with the other. The terms are dealt into many voters: lexicon voters of words, pattern voters of
beginnings, for either class, each of which votes for its class or abstains on a text. Each training row is voted on with
terms of the other rows only, in FOLDS parts, so that the votes don't repeat the row's own label.

A generative label model estimates by EM, starting at the given labels, how often each voter votes under either class and
how far voters repeat each other within a class; voters that repeat each other share their weight. The voters' joint
evidence is brought to the scale of the labels, because many voters repeat each other in more than pairs. The given label
is a voter of its own whose error rates by class are estimated against that evidence. The posterior probabilities, in which
the voters can overrule a given label, are the labels that a linear classifier of the voters' terms is trained on.

The training set is bounded: at most about SAMPLE rows of each label, chosen by a seeded hash of their ids, with texts of
SAMPLE_BYTES at most. Everything else covers all rows.

Defined results: null and empty texts get the classifier's score of no terms; without labelled rows of both labels every
score is the share of label 1 (0 if there is none); repeated equal labels of an id count once, contradicting ones count
one for each label; repeated rows have equal results. Columns of the input named score or predicted are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import letters

SAMPLE = 2500
"""Training rows of each label, about."""
SAMPLE_BYTES = 64 << 10
LEAST = 3
"""Training rows that have a term at least, for it to count."""
VOTERS = 10
"""Voters of each family."""
FOLDS = 5
GIVEN_ERROR, GIVEN_ROWS = 0.003, 500
"""How often given labels are wrong, before there is evidence, and how many rows that assumption weighs as."""
TERMS = 800
"""Most terms of a family."""
REPEATING = 0.5
"""Correlation within a class above which voters share their weight."""
L2 = 1e-4
ROUNDS = 300
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of terms, and the bias."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0


def words(text: str | None) -> set[str]:
    """The words of a text that `letters` has reduced to lower-case letters and spaces."""
    return set((text or "").split())


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}~" for n in BEGINNINGS if len(word) >= n]


def terms(found: set[str]) -> list[str]:
    """The words of a text, their beginnings, and, marked again, the beginnings that several of the words have."""
    counts = Counter(b for w in found for b in beginnings(w))
    return [*found, *counts, *(f"{b}~" for b, n in counts.items() if n > 1)]


class Terms:
    """Training texts as arrays of term numbers."""

    def __init__(self, texts: Sequence[str]) -> None:
        numbers: dict[str, int] = {}
        self.rows = [np.array([numbers.setdefault(t, len(numbers)) for t in sorted(terms(words(x)))], np.int64) for x in texts]
        self.names = list(numbers)
        self.row = np.repeat(np.arange(len(self.rows)), [len(x) for x in self.rows])
        self.col = np.concatenate(self.rows) if self.rows else np.zeros(0, np.int64)

    def sums(self, y: np.ndarray) -> np.ndarray:
        """By term, the sum of y over the rows that have it."""
        return np.bincount(self.col, y[self.row], len(self.names))


def lexicons(x: Terms, y: np.ndarray, rows: np.ndarray | None = None) -> list[np.ndarray]:
    """The voters' terms, as they are in some rows: for toxic and for clean, families of words, of beginnings and of repeated
    beginnings. A voter's place in the list is its part, the same whatever the rows; it may have no terms."""
    on = np.ones(len(y)) if rows is None else rows.astype(float)
    n1, n0 = max(1, int((y * on).sum())), max(1, int(((1 - y) * on).sum()))
    in1, in0 = x.sums(y * on), x.sums((1 - y) * on)
    family = np.array([min(2, len(t) - len(t.rstrip("~"))) for t in x.names], np.int64)
    out = []
    for own, other, n, m in ((in1, in0, n1, n0), (in0, in1, n0, n1)):
        for f in range(3):
            found = np.flatnonzero((family == f) & (own >= LEAST) & ((own + 0.5) / n >= 8 * (other + 0.5) / m))
            best = found[np.argsort(-own[found], kind="stable")][:TERMS]
            # Neighbours in rank go to different voters, so that each has strong and weak terms.
            out += [best[i::VOTERS] for i in range(VOTERS)]
    return out


def fair_votes(x: Terms, y: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """Votes on each row by voters whose terms were found in the other folds' rows, so that no row votes for its own label."""
    fold = np.random.default_rng(0).permutation(len(y)) % folds
    out: np.ndarray | None = None
    for f in range(folds):
        cast = votes(x, lexicons(x, y, fold != f))
        out = cast if out is None else np.where((fold == f)[:, None], cast, out)
    return out[:, out.any(axis=0)]


def votes(x: Terms, voters: Sequence[np.ndarray]) -> np.ndarray:
    """Texts by voters: 1 where a voter finds one of its terms."""
    out = np.zeros((len(x.rows), len(voters)))
    for i, v in enumerate(voters):
        has = np.zeros(len(x.names), bool)
        has[v] = True
        out[x.row[has[x.col]], i] = 1
    return out


@dataclass(frozen=True)
class LabelModel:
    """What EM estimates of binary voters: `rates` by class and voter, `repeats` by pair of voters, and the rows' posteriors.

    repeats is the correlation of two voters within a class, averaged over both classes.
    """

    share: float
    rates: np.ndarray
    repeats: np.ndarray
    posterior: np.ndarray

    def evidence(self, v: np.ndarray, repeating: float = REPEATING) -> np.ndarray:
        """The log-odds of label 1 that the votes give."""
        weight = 1 / (1 + np.where(self.repeats > repeating, self.repeats, 0).sum(axis=1))
        yes, no = weight * np.log(self.rates[1] / self.rates[0]), weight * np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return v @ yes + (1 - v) @ no

    @property
    def accuracies(self) -> np.ndarray:
        """By voter, how often its class is right when it votes; its class is the one that it votes under more often."""
        votes = self.rates * np.array([[1 - self.share], [self.share]])
        return votes.max(axis=0) / votes.sum(axis=0)


def label_model(v: np.ndarray, start: np.ndarray, rounds: int = 25, repeating: float = REPEATING) -> LabelModel:
    """EM for two classes over rows of votes: 1 where a voter votes, 0 where it abstains.

    start is the first guess of label 1's probability, and no evidence after that. Given a class, voters count as
    independent, but one that has a correlation above `repeating` with others there shares its weight with them.
    """
    p = 0.25 + 0.5 * start
    for _ in range(rounds):
        share = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
        rates = np.array([(w @ v + 0.01) / (w.sum() + 0.5) for w in (1 - p, p)]).clip(1e-4, 1 - 1e-4)
        repeats = np.zeros((v.shape[1], v.shape[1]))
        for w, r, part in zip((1 - p, p), rates, (1 - share, share), strict=True):
            spread = ((v - r) * w[:, None]).T @ (v - r) / max(1.0, w.sum())
            repeats += part * spread / np.sqrt(np.outer(r * (1 - r), r * (1 - r)))
        np.fill_diagonal(repeats, 0)
        found = LabelModel(share, rates, repeats, p)
        p = _logistic(found.evidence(v, repeating) + np.log(share / (1 - share)))
    return LabelModel(share, rates, repeats, p)


def _logistic(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def calibrated(evidence: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Odds a * evidence + b that fit the labels best. What voters repeat of each other beyond their pairs makes a small."""
    at = np.array([0.1, 0.0])
    x = np.column_stack([evidence, np.ones(len(y))])
    for _ in range(rounds):
        p = _logistic(x @ at)
        at -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y))
        at = np.clip(at, [0, -30], [10, 30])
    return x @ at


def with_given(odds: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of label 1 from the voters' odds and the given label, and that one's error rates by class.

    The given label is a voter too; its rates are estimated, from a prior of GIVEN_ERROR as of GIVEN_ROWS rows.
    """
    rates = np.array([GIVEN_ERROR, GIVEN_ERROR])
    for _ in range(rounds):
        p = _logistic(odds + np.where(y == 1, np.log((1 - rates[1]) / rates[0]), np.log(rates[1] / (1 - rates[0]))))
        rates = np.array([(((1 - p) * y).sum() + GIVEN_ERROR * GIVEN_ROWS) / ((1 - p).sum() + GIVEN_ROWS), ((p * (1 - y)).sum() + GIVEN_ERROR * GIVEN_ROWS) / (p.sum() + GIVEN_ROWS)])
    return p, rates


def linear(x: Terms, posterior: np.ndarray, used: np.ndarray, l2: float = L2, rounds: int = ROUNDS) -> ToxicityModel:
    """Logistic regression on the used terms, by gradient steps that are scaled for each term."""
    n, m = max(1, len(x.rows)), len(used)
    place = np.full(len(x.names), -1)
    place[used] = np.arange(m)
    keep = place[x.col] >= 0
    row, col = x.row[keep], place[x.col[keep]]
    share = float(np.clip(posterior.mean(), 1e-3, 1 - 1e-3))
    weight = (posterior / share + (1 - posterior) / (1 - share)) / (2 * n)  # both labels weigh the same
    w, bias, gw, gb = np.zeros(m), 0.0, np.full(m, 1e-12), 1e-12
    for _ in range(rounds):
        odds = np.bincount(row, w[col], n) + bias
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - posterior) * weight
        dw, db = np.bincount(col, error[row], m) + l2 * w / n, float(error.sum())
        gw, gb = gw + dw * dw, gb + db * db
        w, bias = w - 0.3 * dw / np.sqrt(gw), bias - 0.3 * db / math.sqrt(gb)
    return ToxicityModel({x.names[used[i]]: float(w[i]) for i in np.flatnonzero(w)}, float(bias))


def _chosen(rows: DataFrame, counts: dict[int, int], sample: int, seed: int) -> DataFrame:
    """Of rows (id, y) about `sample` of each label, by a seeded hash of their ids."""
    share = F.when(F.col("y") == 1, F.lit(min(1.0, sample / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, sample / max(1, counts.get(0, 0)))))
    unit = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(unit < share)


def _counts(rows: DataFrame) -> dict[int, int]:
    return {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}


def labelled(docs: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """The sampled labels with their documents. Labels are sampled before they meet a text: of each label about `sample`
    different ids, which bounds what is broadcast, and no text is shuffled. Repeated equal labels of an id count once."""
    rows = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    few = _chosen(rows, _counts(rows), sample, seed).select(F.col("id").alias(id), F.col("y").alias(label))
    return docs.drop(label).join(F.broadcast(few), id)


def train(labelled: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, seed: int = 5) -> ToxicityModel:
    """A model from rows with text and label 0 or 1; rows without either are left out."""
    rows = labelled.select(F.col(id).alias("id"), letters(F.col(text)).alias("text"), F.col(label).cast("int").alias("y")).where("text is not null and y in (0, 1)")
    counts = _counts(rows)
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 0.0
        return ToxicityModel(bias=float(np.log((share + 1e-13) / (1 - share + 1e-13))))
    taken = _chosen(rows, counts, sample, seed).where(F.octet_length("text") <= SAMPLE_BYTES).select("id", "text", "y").collect()
    taken.sort(key=lambda r: (r["id"] is None, r["id"], r["text"]))
    y = np.array([r["y"] for r in taken])
    if len(set(y.tolist())) < 2:
        return ToxicityModel(bias=float(np.log(counts[1] / counts[0])))
    x = Terms([r["text"] for r in taken])
    used = np.unique(np.concatenate(lexicons(x, y)))
    if not len(used):
        return ToxicityModel(bias=float(np.log(counts[1] / counts[0])))
    return linear(x, posterior(x, y), used)


def posterior(x: Terms, y: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each training row, by all voters and the given label."""
    v = fair_votes(x, y)
    odds = calibrated(label_model(v, y).evidence(v), y) if v.shape[1] else np.full(len(y), np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    return with_given(odds, y)[0]


class Scorer:
    """Scores texts; remembers a bounded number of words."""

    MOST = 400_000

    def __init__(self, model: ToxicityModel) -> None:
        self.weights, self.bias, self.known = model.weights, model.bias, _Known(model.weights)

    def __call__(self, text: str | None) -> float:
        if len(self.known) > self.MOST:
            self.known.clear()
        hits = list(filter(None, map(self.known.__getitem__, words(text))))
        counts = Counter(b for _, starts in hits for b in starts)
        found = [own for own, _ in hits] + [self.weights.get(b, 0.0) + (self.weights.get(f"{b}~", 0.0) if n > 1 else 0.0) for b, n in counts.items()]
        odds = self.bias + math.fsum(found)  # the same whatever the order
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, odds))))


class _Known(dict):
    """Of each word its own weight and those of its beginnings that have a weight; None if there are none."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[float, tuple[str, ...]] | None:
        own = self.weights.get(word, 0.0)
        starts = tuple(b for b in beginnings(word) if b in self.weights or f"{b}~" in self.weights)
        value = self[word] = (own, starts) if own or starts else None
        return value


def predict(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (0 or 1); row by row, without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # weights of the sample's terms at most

    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for part in parts:
            yield part.map(scorer, na_action=None).astype("float64")

    apply.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = df.withColumn("score", F.pandas_udf(apply, "double")(letters(F.coalesce(F.col(text), F.lit("")))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
