"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams, which share a hashed table, so that a
misspelling never seen in training still gets most of a known word's vector. A passage is the mean of its
words, a text as toxic as its most toxic passage. Embeddings and softmax are trained jointly in numpy.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from longitrack.llm.tokens import gathered

# Words are runs of letters, marks, digits and the signs that stand for letters in disguised words.
WORD = regex.compile(r"[\p{L}\p{M}\p{N}@$!*]+")
THRESHOLD = 0.7
# Labelled rows used for training, by label: the bound of the sample, taken by a hash of the id.
MAX_TRAINED = {0: 2_500, 1: 1_200}
# Size of the n-gram table and of its vectors, and the n-grams of a word.
BUCKETS = 1 << 18
DIMENSIONS = 6
GRAMS = (3, 4, 5)
# Words of a passage; passages overlap by half. In short ones a single insult outweighs its neighbours.
PASSAGE = 4
# Training: steps of gradient descent, passages per step, steps between two choices of passages.
STEPS = 600
BATCH = 192
ROUND = 150
RATE = 0.3
DECAY = 1e-4
# Squared gradient that every n-gram starts with: the larger, the slower rare ones learn.
CALM = 1e-2
# Passages of a text that are trained on after the first round, by label; all of them are ranked for it. A word
# lies in two passages, so a third one of a toxic text need hold nothing toxic.
HARD_PASSAGES = {0: 4, 1: 2}
# Passages of a text trained on in the first round: so many that look most toxic by counts, and so many drawn.
FIRST_PASSAGES = {0: 10, 1: 10}
MEMO_LIMIT = 300_000


def gram_slots(word: str) -> np.ndarray:
    """Slots of the n-grams of a word between its marks of begin and end; the whole word is one of them."""
    marked = f"<{word}>"
    grams = [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    grams.append(marked)
    return np.asarray([zlib.crc32(g.encode()) % BUCKETS for g in grams], np.int32)


def passages(count: int) -> tuple[np.ndarray, int]:
    """Starts of the overlapping word ranges that cover ``count`` words, and their length; the last one ends with the text."""
    if count <= PASSAGE:
        return np.zeros(min(count, 1), np.int64), count
    return np.append(np.arange(0, count - PASSAGE, PASSAGE // 2), count - PASSAGE), PASSAGE


@dataclass
class ToxicityModel:
    """``slot_logits`` is the softmax applied to the n-gram vectors: one logit per slot."""

    slot_logits: np.ndarray
    bias: float

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def word_logit(self, word: str) -> float:
        if len(self.memo) > MEMO_LIMIT:
            self.memo.clear()
        found = self.memo.get(word)
        if found is None:
            found = self.memo[word] = float(self.slot_logits[gram_slots(word)].mean())
        return found

    def score(self, text: str | None) -> float:
        """Probability between 0 and 1 that the most toxic passage is toxic; a text without words gets the bias alone."""
        words = WORD.findall((text or "").lower())
        if not words:
            return 1 / (1 + math.exp(-self.bias))
        upto = np.zeros(len(words) + 1)
        np.cumsum([self.word_logit(w) for w in words], out=upto[1:])
        starts, size = passages(len(words))
        top = float((upto[starts + size] - upto[starts]).max()) / size + self.bias
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, top))))


def train(texts: list[str | None], toxic: list[int], seed: int = 0) -> ToxicityModel:
    """Joint training of n-gram vectors and softmax by adaptive gradients over passages.

    A text counts as toxic by its most toxic passage, so every text is represented by the passages that
    score highest among all it has: in the first round by how many toxic and clean texts hold their n-grams,
    with some drawn ones beside, later by the model so far. Without either label the score is one half everywhere.
    """
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    # The words of all texts one after another, and for every passage its first word, its length and its text.
    told, begins, sizes, n_words = [], [], [], [0]
    for text in texts:
        words = WORD.findall((text or "").lower())
        starts, size = passages(len(words))
        told.append(np.asarray([number.setdefault(w, len(number)) for w in words], np.int32))
        begins.append(starts + n_words[-1])
        sizes.append(np.full(len(starts), size))
        n_words.append(n_words[-1] + len(words))
    owner = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
    label = np.asarray(toxic, np.int64)[owner] if len(owner) else owner
    if len(set(label.tolist())) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0)
    told, begins, sizes = np.concatenate(told), np.concatenate(begins), np.concatenate(sizes)
    grams = [gram_slots(w) for w in number]
    n_grams = np.asarray([len(g) for g in grams])
    grams, first_gram = np.concatenate(grams), np.cumsum(n_grams) - n_grams
    del number
    texts_with = np.zeros((2, BUCKETS), np.int64)
    for y, a, b in zip(toxic, n_words, n_words[1:]):
        words = np.unique(told[a:b])
        texts_with[y, np.unique(grams[gathered(first_gram[words], n_grams[words])])] += 1
    # By how many standard deviations the shares of toxic and of clean texts with an n-gram differ.
    of_label = np.bincount(toxic, minlength=2)
    share = (texts_with.sum(0) + 1) / (len(toxic) + 2)
    contrast = (texts_with[1] / of_label[1] - texts_with[0] / of_label[0]) / np.sqrt(share * (1 - share) * (1 / of_label).sum())
    # An n-gram that no training text holds weighs nothing.
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32) * texts_with.any(0)[:, None]
    softmax, bias = rng.normal(0, 0.5, DIMENSIONS).astype(np.float32), 0.0
    square_v, square_s, square_b = np.full(BUCKETS, CALM, np.float32), np.full(DIMENSIONS, 1e-6, np.float32), 1e-6

    def scored(logits: np.ndarray) -> np.ndarray:
        """Logits of all passages from those of the slots."""
        of_word = np.add.reduceat(logits[grams], first_gram) / n_grams
        upto = np.zeros(len(told) + 1)
        np.cumsum(of_word[told], out=upto[1:])
        return (upto[begins + sizes] - upto[begins]) / sizes + bias

    def highest(scores: np.ndarray, many: dict[int, int]) -> np.ndarray:
        """The passages of every text with the highest scores, as many as its label says."""
        order = np.lexsort((-scores, owner))
        rank = np.arange(len(order)) - np.maximum.accumulate(
            np.where(np.concatenate([[True], owner[order][1:] != owner[order][:-1]]), np.arange(len(order)), 0))
        return order[rank < np.where(label[order] == 1, many[1], many[0])]

    active = np.concatenate([highest(scored(contrast), FIRST_PASSAGES), highest(rng.random(len(sizes)), FIRST_PASSAGES)])
    shuffled, at = rng.permutation(active), 0
    for step in range(STEPS):
        if step and step % ROUND == 0:
            active = highest(scored(vectors @ softmax), HARD_PASSAGES)
            shuffled, at = rng.permutation(active), 0
        if at >= len(shuffled):
            shuffled, at = rng.permutation(active), 0
        own = shuffled[at:at + BATCH]
        at += BATCH
        size = sizes[own]
        words = told[gathered(begins[own], size)]
        line = grams[gathered(first_gram[words], n_grams[words])]
        of_word = np.add.reduceat(vectors[line], np.cumsum(n_grams[words]) - n_grams[words]) / n_grams[words][:, None]
        hidden = np.add.reduceat(of_word, np.cumsum(size) - size) / size[:, None]
        p = 1 / (1 + np.exp(-np.clip(hidden @ softmax + bias, -50, 50)))
        y = label[own]
        share = label[active].mean()  # both labels weigh the same
        error = ((p - y) * np.where(y == 1, 0.5 / share, 0.5 / (1 - share))).astype(np.float32)
        grad_s, grad_b = error @ hidden.astype(np.float32) / len(own), float(error.mean())
        of_words = np.repeat(error / size, size) / n_grams[words]
        pull = np.bincount(line, np.repeat(of_words, n_grams[words]), BUCKETS).astype(np.float32)
        touched = np.flatnonzero(pull)
        grad_v = pull[touched, None] * softmax
        square_v[touched] += (grad_v ** 2).mean(1)
        vectors[touched] -= RATE * grad_v / np.sqrt(square_v[touched])[:, None] + DECAY * vectors[touched]
        square_s += grad_s ** 2
        square_b += grad_b ** 2
        softmax -= RATE * grad_s / np.sqrt(square_s)
        bias -= RATE * grad_b / math.sqrt(square_b)
    return ToxicityModel((vectors @ softmax).astype(np.float32), float(bias))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id as text falls into ``fold``; a null id does not."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, limit: dict[int, int] = MAX_TRAINED) -> ToxicityModel:
    """Train on the labelled rows outside the held-out fold, at most about ``limit`` of each label.

    The sample is drawn by a hash of the id, so it does not depend on the order of rows. Rows without a
    label count for nothing, and of labels that repeat an id the highest one holds.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 3, 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    wanted = F.lit(False)
    for value, size in sizes.items():
        wanted = wanted | ((F.col("toxic") == value) & (share < min(1.0, limit.get(value, 0) / size)))
    # The sample of ids is bounded by ``limit``, whatever the size of the tables.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.where(wanted)), "doc_id")
    rows = sample.select("doc_id", "text", "toxic").collect() if sizes else []
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_column(text: Column, model: ToxicityModel) -> Column:
    """Toxicity of ``text`` between 0 and 1."""
    logits, bias = model.slot_logits, model.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = ToxicityModel(logits, bias)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return score(text)


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return docs.where(score_column(F.col("text"), train_on_labels(docs, labels)) < THRESHOLD)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), score_column(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
