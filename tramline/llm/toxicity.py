"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word starts is trained with numpy from confirmed toxic
examples and unlabelled text. The risk is the class-prior-corrected estimator

    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

with the logistic loss l; where the second part is negative, its gradient is reversed.

Positive examples are a bounded sample of the rows labelled toxic (`max_positive`); unlabelled text is one of all
rows of the training folds that have a label (`max_unlabelled`), with the label put aside: only there is the class
prior known, as the share of toxic rows. (Text of all documents was tried: with the same prior it has other
shares of both classes, and more clean documents are taken for toxic.) Texts of more than `max_chars` characters
aren't sampled, so what comes to the driver is bounded in bytes. Scoring covers every row and every whole text.

Defined results: a null or empty text has no words and gets the score of the bias alone; repeated
rows get a row each; an empty table gives an empty result; with no toxic example every score is the
prior. Extra columns are kept by `add_scores` and left out by `score_documents`.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import common

#: All bytes but ASCII letters, digits and those of other letters become spaces; A-Z are lower-cased.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)
PREFIX = 6


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float


def features(text: bytes) -> set[int]:
    """Hashes of the distinct words and of the starts of longer words."""
    words = set(text.translate(WORD_BYTES).split())
    found = {zlib.crc32(w) for w in words}
    found.update(zlib.crc32(w[:PREFIX], 1) for w in words if len(w) > PREFIX)
    return found


def fit_nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    max_features: int = 4096,
    steps: int = 400,
    rate: float = 0.05,
    decay: float = 1e-4,
) -> Model:
    """numpy Adam on the non-negative risk; features are those whose shares in both sets differ the most."""
    prior = min(max(prior, 1e-3), 0.999)
    base = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model({}, base)
    ids, column = np.unique(np.concatenate(positive + unlabelled), return_inverse=True)
    row = np.repeat(np.arange(len(positive) + len(unlabelled)), [len(x) for x in positive + unlabelled])
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(column[row < n_p], minlength=len(ids))
    in_u = np.bincount(column[row >= n_p], minlength=len(ids))
    p, u = in_p / n_p, in_u / n_u
    both = (in_p + in_u) / (n_p + n_u)
    z = (p - u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    z[in_p + in_u < 4] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:max_features]
    chosen = chosen[np.abs(z[chosen]) >= 3.5]
    place = np.full(len(ids), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[column] >= 0
    row, column = row[kept], place[column][kept]
    share = np.where(np.arange(n_p + n_u) < n_p, 1 / n_p, 1 / n_u)
    is_p = np.arange(n_p + n_u) < n_p

    w, bias = np.zeros(len(chosen)), base
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        g = np.bincount(row, w[column], minlength=n_p + n_u) + bias
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        minus = np.logaddexp(0, g)  # l(-g)
        rest = float((minus * share)[~is_p].sum() - prior * (minus * share)[is_p].sum())
        d_plus = np.where(is_p, prior * share * (s - 1), 0)
        d_rest = np.where(is_p, -prior * share * s, share * s)
        d = d_plus + d_rest if rest >= 0 else -d_rest
        grad = np.append(np.bincount(column, d[row], minlength=len(chosen)) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model(dict(zip(ids[chosen].tolist(), w.tolist(), strict=True)), bias)


def margin(model: Model, text: bytes) -> float:
    get = model.weights.get
    return model.bias + sum(get(f, 0.0) for f in features(text))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    max_positive: int = 4000,
    max_unlabelled: int = 8000,
    max_chars: int = 20_000,
) -> Model:
    """Learn from the training folds. The sample's ids are bounded by the parameters, so they're broadcast."""
    spark = documents.sparkSession
    rows = common.labelled(spark, labels, "toxic")
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("t")).first()
    prior = (total["t"] or 0) / total["n"] if total["n"] else 0.0
    sample = (
        common.bounded(rows.where("label = 1"), max_positive)
        .select("doc_id", F.lit(True).alias("is_p"))
        .unionByName(common.bounded(rows, max_unlabelled).select("doc_id", F.lit(False).alias("is_p")))
    )

    @common.vector_udf(pa.list_(pa.int64()))
    def hashed(text: pa.Array) -> pa.Array:
        return pa.array([sorted(features(x)) for x in common.texts(text)], pa.list_(pa.int64()))

    found = (
        documents.select("doc_id", "text")
        .where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
        .join(F.broadcast(sample), "doc_id")
        .select("is_p", "doc_id", hashed("text").alias("f"))
        .toArrow()
        .sort_by([("doc_id", "ascending")])
    )
    flags = found.column("is_p").to_pylist()
    lists = [x.values.to_numpy(zero_copy_only=False) for x in found.column("f")]
    pick = lambda want: [x for x, flag in zip(lists, flags, strict=True) if flag is want]
    return fit_nnpu(pick(True), pick(False), prior)


def score_column(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @common.vector_udf(pa.float64())
    def score(text: pa.Array) -> pa.Array:
        g = np.array([margin(shared.value, x) for x in common.texts(text)], dtype=np.float64)
        return pa.array(1 / (1 + np.exp(-np.clip(g, -30, 30))), pa.float64())

    return score


def score_documents(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents."""
    model = model or fit(documents, labels)
    score = score_column(documents.sparkSession, model)
    return documents.select(
        "doc_id", (common.fold(F.col("doc_id")) == 0).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that score below the threshold, with all their columns."""
    score = score_column(documents.sparkSession, fit(documents, labels))
    return documents.where(score(F.col("text")) < threshold)
