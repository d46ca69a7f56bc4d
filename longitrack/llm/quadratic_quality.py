"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a few transformed statistics. Spark sums their moments over all labelled rows of a
class; the class covariances are shrunk towards the pooled one and towards a multiple of the identity,
and a text is scored by the difference of the two Mahalanobis log-densities, with Cholesky factors that
are computed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from longitrack.llm.toxicity import in_fold
from longitrack.session import materialise

THRESHOLD = 0.7
# Shrinkage towards the pooled covariance and towards the identity.
POOLED = 0.3
IDENTITY = 0.05
# The log-density difference is divided by this many dimensions' worth of overconfidence, and clipped.
TEMPER = 2.0
LARGEST_LOGIT = 30.0
FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "digits", "upper", "punctuation", "other_bytes", "distinct", "dup_lines", "repeat_pairs", "log_line",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&<>{}[]=+~^_\\"]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?'\"()-"]] = True
_CODES = np.arange(256)
_DIGITS, _UPPER, _OTHER = (_CODES >= 48) & (_CODES <= 57), (_CODES >= 65) & (_CODES <= 90), _CODES >= 128


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text; an empty one has zeros everywhere."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, n_bytes = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [line for line in data.split(b"\n") if line.strip()]
    pairs = set(zip(words, words[1:]))

    def root(x: float) -> float:
        return math.sqrt(max(0.0, x))

    return [
        math.log1p(n),
        math.log((n_bytes - n + 1) / n + 1),
        root(counts[_SYMBOLS].sum() / n),
        root(counts[ord("|")] / n),
        root(counts[_DIGITS].sum() / n_bytes),
        root(counts[_UPPER].sum() / n_bytes),
        root(counts[_PUNCTUATION].sum() / n),
        root(counts[_OTHER].sum() / n_bytes),
        len(set(words)) / n ** 0.75,
        root(1 - len(set(lines)) / len(lines)),
        root(1 - len(pairs) / max(1, n - 1)),
        math.log1p(n / len(lines)),
    ]


@dataclass
class QuadraticModel:
    """Means, inverse Cholesky factors, log-determinants and log priors of the classes bad (0) and good (1)."""

    means: list[np.ndarray]
    inverse_factors: list[np.ndarray]
    log_dets: list[float]
    log_priors: list[float]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of the class good for rows of statistics."""
        densities = []
        for mean, inverse, log_det, prior in zip(self.means, self.inverse_factors, self.log_dets, self.log_priors):
            white = (rows - mean) @ inverse.T
            densities.append(prior - 0.5 * (log_det + (white ** 2).sum(1)))
        logit = np.clip((densities[1] - densities[0]) / TEMPER, -LARGEST_LOGIT, LARGEST_LOGIT)
        return 1 / (1 + np.exp(-logit))


def fit(counts: list[float], sums: list[np.ndarray], products: list[np.ndarray], pooled: float = POOLED, identity: float = IDENTITY) -> QuadraticModel:
    """The model from the number of rows, sums and sums of products of each class.

    A class without rows takes the moments of the other one, and the scores are one half.
    """
    if not sum(counts):
        size = len(FEATURES)
        return QuadraticModel([np.zeros(size)] * 2, [np.eye(size)] * 2, [0.0] * 2, [math.log(0.5)] * 2)
    full = [k if counts[k] else 1 - k for k in (0, 1)]
    means = [sums[k] / counts[k] for k in full]
    own = [products[k] / counts[k] - np.outer(m, m) for k, m in zip(full, means)]
    weights = [(c + 1) / (sum(counts) + 2) for c in counts]
    shared = weights[0] * own[0] + weights[1] * own[1]
    factors, log_dets = [], []
    for cov in own:
        mixed = (1 - pooled) * cov + pooled * shared
        scale = max(np.trace(mixed) / len(mixed), 1e-6)
        # The identity is scaled by each statistic's own pooled variance, so that units do not matter.
        target = np.diag(np.maximum(np.diag(shared), 1e-3 * scale))
        factor = np.linalg.cholesky((1 - identity) * mixed + identity * target)
        factors.append(np.linalg.inv(factor))
        log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
    return QuadraticModel(means, factors, log_dets, [math.log(w) for w in weights])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, f): the statistics of every text; null texts are empty, other columns are ignored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, f array<double>")


def train_on_labels(counted: DataFrame, labels: DataFrame) -> QuadraticModel:
    """Moments of all labelled rows outside the held-out fold; of labels that repeat an id the highest holds."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("quality"))
    d = len(FEATURES)
    moments = [F.count(F.lit(1)).alias("n"), *[F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(d)],
               *[F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]]
    found = {r["quality"]: r for r in counted.join(known, "doc_id").groupBy("quality").agg(*moments).collect()}
    counts, sums, products = [], [], []
    for k in (0, 1):
        r = found.get(k)
        counts.append(r["n"] if r else 0)
        sums.append(np.asarray([r[f"s{i}"] if r else 0.0 for i in range(d)]))
        half = np.asarray([[r[f"p{max(i, j)}_{min(i, j)}"] if r else 0.0 for j in range(d)] for i in range(d)])
        products.append(half)
    return fit(counts, sums, products)


def with_scores(counted: DataFrame, model: QuadraticModel) -> DataFrame:
    """Adds ``score`` to the statistics of documents."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("f").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(rows))], names=[*batch.schema.names, "score"])

    return counted.mapInArrow(score, "doc_id long, f array<double>, score double")


def op7_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = materialise(document_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    model = train_on_labels(counted, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(counted, model).select(
        "doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
