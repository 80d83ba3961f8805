"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. A line's potentials use its own features and those of the lines before and
after it; transitions tie neighbours. Forward-backward gives each line's marginal, and the marginals,
weighted by the lines' lengths, make the document's quality. Training is by gradient on the documents'
labels: first every line carries its document's label, then twice the lines of bad documents that the
model finds good are given that label, and the field is fitted again.

Fitting reads a bounded sample of the labelled rows (`max_rows`); scoring covers every row and every
line of every whole text.

Defined results: a null or empty text, or one of white space only, has no line and gets 0; repeated
rows get a row each; an empty table gives an empty result; without labelled rows of both kinds every
text with a line gets the share of good labels, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import common

UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&|<>{}[]\\^~=_@")
DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
ENDS = frozenset(b'.!?:;"')

#: Of each measure: the bounds of its steps. A line has one feature for each step and, besides, its yes-or-no features.
STEPS = {
    "bytes": (20, 60, 150, 400, 1000),
    "words": (1, 3, 6, 12, 30),
    "word_bytes": (3.0, 4.5, 6.0, 7.5, 9.0, 12.0),
    "symbols": (0.01, 0.1, 0.3, 0.6, 1.0),
    "upper": (0.02, 0.1, 0.3, 0.6),
    "digits": (0.01, 0.1, 0.4),
    "letters": (0.4, 0.6, 0.75, 0.85),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
    "adjacent": (0.02, 0.1, 0.3, 0.6),
    "bangs": (0.01, 0.3),
    "bars": (0.01, 0.3),
    "commas": (0.01, 0.1),
}
OFFSETS = np.cumsum([0] + [len(v) + 1 for v in STEPS.values()])
FLAGS = ("ends", "lower_start", "seen")
OWN = int(OFFSETS[-1]) + len(FLAGS)
BOUNDS = [np.array(v, dtype=np.float64) for v in STEPS.values()]


@dataclass(frozen=True)
class Field:
    """w: features x (line itself, line before, line after) weights of good; turn: 2 x 2 transition weights, bad first.

    scale and shift: a logistic curve, fitted on the training documents, from the mean marginal to a probability.
    """

    w: np.ndarray
    bias: float
    turn: np.ndarray
    scale: float = 1.0
    shift: float = 0.0


def lines_of(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x and not x.isspace()]


def measure(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    words = line.split()
    n, size = len(words), len(line)
    same = sum(map(bytes.__eq__, words, words[1:])) if len(set(words)) < n else 0
    found = (
        size,
        n,
        size / n,
        len(line.translate(None, SYMBOL)) / n,
        len(line.translate(None, UPPER)) / size,
        len(line.translate(None, DIGIT)) / size,
        len(line.translate(None, LETTER)) / size,
        len(set(words)) / n,
        same / n,
        line.count(b"!!") / n,
        line.count(b"|") / n,
        line.count(b",") / n,
        words[-1][-1] in ENDS,
        97 <= line.lstrip()[0] <= 122,
        line in seen,
    )
    seen.add(line)
    return found


def matrix(measures: np.ndarray) -> np.ndarray:
    """Feature numbers of every line: one for each measure, and OWN where a flag is off."""
    k = len(STEPS)
    out = np.empty((len(measures), k + len(FLAGS)), dtype=np.int64)
    for j, bounds in enumerate(BOUNDS):
        out[:, j] = OFFSETS[j] + np.searchsorted(bounds, measures[:, j], side="right")
    for j in range(len(FLAGS)):
        out[:, k + j] = np.where(measures[:, k + j] > 0, OFFSETS[-1] + j, OWN)
    return out


@dataclass
class Batch:
    """Lines of many documents, one after another. place: of each line, its number in its document."""

    features: np.ndarray
    first: np.ndarray
    count: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(all_texts: list[bytes]) -> Batch:
        measures: list[tuple[float, ...]] = []
        count = np.zeros(len(all_texts), dtype=np.int64)
        for i, text in enumerate(all_texts):
            seen: set[bytes] = set()
            before = len(measures)
            measures += [measure(x, seen) for x in lines_of(text)]
            count[i] = len(measures) - before
        x = np.array(measures, dtype=np.float64).reshape(len(measures), len(STEPS) + len(FLAGS))
        return Batch(matrix(x), np.cumsum(count) - count, count, x[:, 0].copy())

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def emissions(field: Field, b: Batch) -> np.ndarray:
    """Log potential of good over bad of every line."""
    w = np.vstack([field.w, np.zeros((1, 3))])
    part = w[b.features].sum(axis=1)  # lines x 3
    out = part[:, 0] + field.bias
    doc = b.doc()
    same = doc[1:] == doc[:-1]
    out[1:] += np.where(same, part[:-1, 1], 0)
    out[:-1] += np.where(same, part[1:, 2], 0)
    return out


def forward_backward(field: Field, b: Batch, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of good of every line, joint marginals (2 x 2) of every line and the one before, and each document's log partition."""
    n = len(e)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    order = np.argsort(-b.count, kind="stable")
    count, first = b.count[order], b.first[order]
    most = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(most), side="left")  # documents with more than t lines
    t = field.turn
    for k in range(most):
        at = first[: active[k]] + k
        if k:
            a = alpha[at - 1]
            alpha[at, 0] = np.logaddexp(a[:, 0] + t[0, 0], a[:, 1] + t[1, 0])
            alpha[at, 1] = np.logaddexp(a[:, 0] + t[0, 1], a[:, 1] + t[1, 1])
        alpha[at, 1] += e[at]
    for k in range(most - 1, 0, -1):
        at = first[: active[k]] + k
        b0, b1 = beta[at, 0], beta[at, 1] + e[at]
        beta[at - 1, 0] = np.logaddexp(t[0, 0] + b0, t[0, 1] + b1)
        beta[at - 1, 1] = np.logaddexp(t[1, 0] + b0, t[1, 1] + b1)
    doc = b.doc()
    end = (b.first + b.count - 1)[b.count > 0]
    log_z = np.zeros(len(b.count))
    log_z[b.count > 0] = np.logaddexp(alpha[end, 0], alpha[end, 1])
    good = 1 / (1 + np.exp(np.clip(alpha[:, 0] + beta[:, 0] - alpha[:, 1] - beta[:, 1], -500, 500)))
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    joint = alpha[inner - 1][:, :, None] + t[None] + (beta[inner] + np.stack([np.zeros(len(inner)), e[inner]], 1))[:, None, :]
    return good, np.exp(joint - log_z[doc[inner]][:, None, None]), log_z


def train(b: Batch, y: np.ndarray, steps: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Adam on the regularised conditional log-likelihood of the lines' labels y."""
    n = max(len(y), 1)
    w, bias, turn = np.zeros((OWN, 3)), 0.0, np.zeros((2, 2))
    m = v = np.zeros(OWN * 3 + 5)
    doc = b.doc()
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    seen_turn = np.zeros((2, 2))
    np.add.at(seen_turn, (y[inner - 1], y[inner]), 1)

    def by_feature(d: np.ndarray) -> np.ndarray:
        return np.bincount(b.features.ravel(), np.repeat(d, b.features.shape[1]), minlength=OWN + 1)[:OWN]

    for step in range(1, steps + 1):
        field = Field(w, bias, turn)
        good, joint, _ = forward_backward(field, b, emissions(field, b))
        d = y - good
        before, after = np.zeros(len(d)), np.zeros(len(d))
        before[inner - 1] = d[inner]
        after[inner] = d[inner - 1]
        g_w = np.stack([by_feature(d), by_feature(before), by_feature(after)], 1) / n - decay * w
        g_t = (seen_turn - joint.sum(axis=0)) / n - decay * turn
        g = np.concatenate([g_w.ravel(), [d.sum() / n], g_t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = w + move[:-5].reshape(OWN, 3)
        bias += float(move[-5])
        turn = turn + move[-4:].reshape(2, 2)
    return Field(w, bias, turn)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def calibrated(field: Field, mean: np.ndarray, labels: np.ndarray, share: float) -> Field:
    """field with a curve that gives the share of good labels in all labelled rows; Newton steps on the weighted logistic loss."""
    x = np.stack([logit(mean), np.ones(len(mean))], 1)
    weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(2)
        at = at + np.clip(np.linalg.solve(h, x.T @ (weight * (labels - p)) - 1e-2 * (at - [1, 0])), -1, 1)
    return replace(field, scale=max(float(at[0]), 1e-3), shift=float(at[1]))


def fit_field(all_texts: list[bytes], labels: np.ndarray, rounds: int = 3, all_share: float | None = None) -> Field:
    """all_share: the share of good labels in the rows of which these are a sample."""
    labels = np.asarray(labels, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3) if len(labels) else 0.5
    prior = Field(np.zeros((OWN, 3)), float(np.log(share / (1 - share))), np.zeros((2, 2)))
    if len(set(labels.tolist())) < 2:
        return prior
    b = Batch.of(all_texts)
    doc_label = labels[b.doc()]
    y = doc_label.copy()
    field = prior
    for _ in range(rounds):
        field = train(b, y)
        good, _, _ = forward_backward(field, b, emissions(field, b))
        y = np.where(doc_label == 1, 1, (good > 0.5).astype(np.int64))
    has_line = b.count > 0
    mean = score_batch(field, b)[has_line]
    return calibrated(field, mean, labels[has_line], share if all_share is None else all_share)


def score_batch(field: Field, b: Batch) -> np.ndarray:
    """Mean of the lines' marginals, weighted by their lengths, on the field's curve; 0 without lines."""
    n = len(b.count)
    if not len(b.features):
        return np.zeros(n)
    good, _, _ = forward_backward(field, b, emissions(field, b))
    doc = b.doc()
    total = np.bincount(doc, b.weight, minlength=n)
    mean = np.clip(np.bincount(doc, good * b.weight, minlength=n) / np.maximum(total, 1), 0, 1)
    if (field.scale, field.shift) != (1.0, 0.0):
        mean = 1 / (1 + np.exp(-(field.scale * logit(mean) + field.shift)))
    return np.where(b.count > 0, mean, 0.0)


def score_texts(field: Field, all_texts: list[bytes]) -> np.ndarray:
    return score_batch(field, Batch.of(all_texts))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 1500, max_chars: int = 20_000) -> Field:
    """Learn from the training folds: at most max_rows rows of each label, whose texts have at most max_chars characters. The sample's ids are broadcast, their number is bounded."""
    rows = common.labelled(documents.sparkSession, labels, "quality")
    all_share = rows.agg(F.avg("label")).first()[0]
    sample = common.bounded(rows.where("label = 0"), max_rows).unionByName(common.bounded(rows.where("label = 1"), max_rows))
    sampled = documents.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    found = sampled.join(F.broadcast(sample), "doc_id").toArrow().sort_by([("doc_id", "ascending")])
    text = [b"" if x is None else x.encode() for x in found.column("text").to_pylist()]
    return fit_field(text, found.column("label").to_numpy(), all_share=all_share)


def score_column(spark: SparkSession, field: Field):
    shared = spark.sparkContext.broadcast(field)

    @common.vector_udf(pa.float64())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(score_texts(shared.value, common.texts(text)), pa.float64())

    return score


def score_documents(documents: DataFrame, labels: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row of documents."""
    score = score_column(documents.sparkSession, field or fit(documents, labels))
    return documents.select(
        "doc_id", (common.fold(F.col("doc_id")) == 0).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
