"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Every whole text is reduced to ``FEATURES`` once. Trusted positives are documents labelled 1; the unlabelled set
is documents without a label. Labels 0 are never used. The class prior is estimated from the two samples
alone: a first model ranks them, and over all thresholds the share of unlabelled rows above it, divided by the
share of positives above it, bounds the prior from above; the smallest bound with its sampling error is taken.
The model then minimises

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with the logistic loss, so its output estimates the probability of label 1. It is fitted on the driver on about
``MAX_POSITIVES`` and ``MAX_UNLABELLED`` rows at most, chosen by a hash of their id; these two bounds
are parameters. The score is computed for every row by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import NO_ID, column_bytes, slices, stage

MAX_POSITIVES = 20_000
MAX_UNLABELLED = 40_000
#: Bytes counted one by one, besides the classes below.
_SINGLE = b"|!#&%*$@^~<>{}[]\\/_=+\"'`;:?().,-"
FEATURES = (
    ["upper", "digit", "blank", "newline", "tab", "high"] + [f"byte_{b}" for b in _SINGLE] + ["repeated", "distinct", "word_length", "log_words", "shouted", "symbol_words", "longest"]
)
_SYMBOL_WORD = re.compile(rb"[^\sA-Za-z0-9\x80-\xff]{2,}(?=\s|$)")


def features(text: bytes | None) -> np.ndarray:
    """Shares of character classes and word statistics; zeros for a text without words."""
    text = text or b""
    words = text.split()
    n = len(words)
    out = np.zeros(len(FEATURES))
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    letters = counts[65:91].sum() + counts[97:123].sum() + 1
    out[:6] = counts[65:91].sum() / letters, counts[48:58].sum() / size, counts[32] / size, counts[10] / size, counts[9] / size, counts[128:].sum() / size
    k = 6 + len(_SINGLE)
    out[6:k] = counts[np.frombuffer(_SINGLE, np.uint8)] / n
    lengths = np.fromiter(map(len, words), np.int64, n)
    out[k] = sum(map(eq, words, words[1:])) / n
    out[k + 1] = len(set(words)) / n * np.log1p(n) / 5
    out[k + 2] = min(lengths.mean(), 30.0) / 10
    out[k + 3] = np.log1p(n) / 10
    out[k + 4] = sum(map(bytes.isupper, words)) / n
    out[k + 5] = len(_SYMBOL_WORD.findall(text)) / n
    out[k + 6] = min(np.log1p(lengths.max()), 10.0) / 10
    # shares of rare characters matter in proportion, not in absolute terms
    out[6:k] = np.log1p(50 * out[6:k])
    return out


def table_of_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, held_out, x) per row; held_out rows lend no label."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t).astype(np.float32) for t in column_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x, pa.list_(pa.float32()))], names=["id", "x"])

    found = rows.mapInArrow(run, "id long, x array<float>")
    return stage(found.withColumn("held_out", held_out(F.col("id"))), "features")


def held_out(column):
    """The rows whose labels are never learned: crc32 of the id as text leaves 1 modulo 3, or the id is null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(True))


@dataclass(frozen=True)
class Fitted:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Adam on the non-negative risk; without a prior, plain positives against unlabelled rows."""
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        positive = -(sigmoid(-zp) @ p) / len(p)  # gradient of the loss of positives called positive
        as_negative_u = sigmoid(zu) @ u / len(u)
        if prior is None:
            grad = positive + as_negative_u
        else:
            as_negative_p = sigmoid(zp) @ p / len(p)
            negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            negative = as_negative_u - prior * as_negative_p
            grad = prior * positive + negative if negative_risk >= 0 else -negative
        grad = grad + decay * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Smallest upper bound of the share of positives among unlabelled rows, over all thresholds of a ranking.

    The bounds are compared with their sampling error (at 5 %), the value returned is without it.
    """
    cuts = np.quantile(p, np.linspace(0.02, 0.98, 97))
    share_p = np.array([(p >= c).mean() for c in cuts])
    share_u = np.array([(u >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> Fitted | None:
    """None where either sample is empty."""
    if not len(p) or not len(u):
        return None
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-3

    def ready(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])

    p, u = ready(p), ready(u)
    half = len(p) // 2, len(u) // 2
    first = _descend(p[: half[0]], u[: half[1]], None, 200) if min(half) else np.zeros(p.shape[1])
    prior = estimate_prior(p[half[0] :] @ first, u[half[1] :] @ first)
    return Fitted(mean, scale, _descend(p, u, prior), prior)


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Features of all rows, or of about ``most`` of them: those whose id hash lies below a cut that the count gives.

    Only the rows chosen leave the executors, however many partitions there are.
    """
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * most / n))
    found = rows.orderBy(F.xxhash64("id"), "id").select("x").toArrow()
    return np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
) -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``.

    Null and empty texts are scored like any other. An id with several labels is positive only if all are 1;
    null labels and ids count for nothing. Without positives or without unlabelled rows every score is 0.5, which
    counts as 1. Repeated rows give one row each; other columns are not read.
    """
    x, model = learned(docs, labels, id_col, text_col, label_col, max_positives, max_unlabelled)
    return apply(x, model)


def learned(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
) -> tuple[DataFrame, Fitted | None]:
    """The stored features of all rows, and the model fitted to them."""
    x = table_of_features(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    usable = x.where(~F.col("held_out") & (F.col("id") != NO_ID))
    positives = usable.join(known.where("label = 1"), "id", "left_semi")
    unlabelled = usable.join(known, "id", "left_anti")
    return x, fit(_sample(positives, max_positives), _sample(unlabelled, max_unlabelled))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, with all their columns; no row is shuffled for it.

    Null texts are scored as empty ones, rows with a null id like any other, repeated rows stay or go together. An empty table
    gives an empty result. Documents from which nothing can be learned, for lack of positive labels or of unlabelled
    texts, are an error: nothing passes unjudged.
    """
    _, model = learned(docs, labels, id_col, text_col, **options)
    if model is None:
        if docs.isEmpty():
            return docs
        raise ValueError("the quality classifier needs documents labelled 1 and documents without a label")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(None if t is None else t.encode()) for t in texts], np.float32).reshape(-1, len(FEATURES)).astype(float)))

    return docs.where(score(F.col(text_col).cast("string")) >= 0.5)


def apply(x: DataFrame, model: Fitted | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.asarray(b.column("x").flatten(), dtype=float).reshape(b.num_rows, len(FEATURES))
            score = np.full(b.num_rows, 0.5) if model is None else model.scores(values)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"],
            )

    return x.mapInArrow(run, "id long, held_out boolean, score double, predicted int")
