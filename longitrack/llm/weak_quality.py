"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes for good (1), for bad (-1) or abstains (0). Expectation-maximisation over the counts of
vote patterns estimates, without labels, how often each rule gives each vote on good and on bad texts,
and the share of good texts. The posterior probability of good decides instead of an all-must-pass filter.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from longitrack.llm.wordcount import WHITE, hashes, let, windows, words
from longitrack.session import materialise

# Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
# Expectation-maximisation.
ROUNDS = 15
TOLERANCE = 0.01
SMOOTHING = 1.0
FIRST_ACCURACY = 0.8
FIRST_GOOD = 0.8
KEEP_PROBABILITY = 0.5
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(hashed: Column) -> Column:
    """Words inside 3-word windows found twice or more, the first included.

    Windows are sorted by hash with their places; those equal to a neighbour are the repeated ones. Each
    repeated window adds the words that the repeated window before it does not reach.
    """
    def same(own: Column, at: Column, x: Column) -> Column:
        return F.coalesce(F.get(own, at)["k"] == x["k"], F.lit(False))

    def repeated(own: Column) -> Column:
        return F.sort_array(F.transform(F.filter(own, lambda x, i: same(own, i - 1, x) | same(own, i + 1, x)), lambda x: x["i"]))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.aggregate(
            let(placed, repeated), F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum"), i.alias("last")),
            lambda acc: acc["sum"])

    # Most short texts repeat nothing, which a set of hashes tells sooner than a sort.
    return let(windows(hashed, 3), lambda keys: F.when(
        F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys))).cast("long")


def quality(text: Column) -> Column:
    """The statistics of ``text`` as a struct; a null text is empty."""
    def lines_of(text: Column) -> Column:
        return F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, WHITE, "") != "")

    def count(text: Column, own: Column, lines: Column, hashed: Column) -> Column:
        return F.struct(
            F.size(own).cast("long").alias("n_words"),
            F.aggregate(own, F.lit(0).cast("long"), lambda acc, w: acc + F.char_length(w)).alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            repeat_words(hashed).alias("n_repeat_words"),
            F.size(F.array_distinct(hashed)).cast("long").alias("n_distinct"),
            (F.char_length(text) - F.char_length(F.translate(text, "0123456789", ""))).cast("long").alias("n_digits"))

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda own: let(
        lines_of(t), lambda lines: let(hashes(own), lambda hashed: count(t, own, lines, hashed)))))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of its texts in a struct column ``_quality``."""
    return docs.withColumn("_quality", quality(F.col("text")))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def rule_votes(s: Column) -> dict[str, Column]:
    """The rules. Each has a limit for a good vote and one for a bad vote, and abstains between them."""
    n = F.greatest(s["n_words"], F.lit(1))

    def low_is_good(value: Column, good: float, bad: float) -> Column:
        return F.when(s["n_words"] == 0, 0).when(value <= good, 1).when(value > bad, -1).otherwise(0)

    length = s["word_chars"] / n
    return {
        "symbols": low_is_good(s["n_symbols"] / n, 0.02, 0.10),
        "symbol_chars": low_is_good(s["n_symbols"] / F.greatest(s["word_chars"], F.lit(1)), 0.005, 0.02),
        "repeat_words": low_is_good(s["n_repeat_words"] / n, 0.15, 0.40),
        "dup_lines": F.when(s["n_lines"] < 3, 0).otherwise(low_is_good(s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)), 0.10, 0.35)),
        "word_length": F.when(s["n_words"] == 0, 0).when(length.between(3.0, 9.0), 1).when((length < 2.0) | (length > 12.0), -1).otherwise(0),
        "distinct_words": F.when(s["n_words"] < 100, 0).when(s["n_distinct"] / F.sqrt(n) >= 4.0, 1).when(s["n_distinct"] / F.sqrt(n) < 2.0, -1).otherwise(0),
        "digits": low_is_good(s["n_digits"] / F.greatest(s["word_chars"], F.lit(1)), 0.05, 0.20),
        "length": F.when(s["n_words"] >= 80, 1).when(s["n_words"] < 25, -1).otherwise(0),
    }


def votes_column(s: Column) -> Column:
    """All votes as an array of -1, 0 and 1."""
    return F.array(*[v.cast("int") for v in rule_votes(s).values()])


def fit_rules(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[list[float]]]:
    """Estimate the share of good texts and, per rule, the log-likelihood ratio of the votes -1, 0 and 1.

    ``patterns`` (votes, count) has at most 3 to the power of the number of rules rows, and a round is
    one aggregation of it. An empty table leaves the starting values.
    """
    rules = len(rule_votes(F.col("_quality")))
    good_share = FIRST_GOOD
    wrong = 1 - FIRST_ACCURACY
    ratios = [[math.log(wrong / FIRST_ACCURACY), 0.0, math.log(FIRST_ACCURACY / wrong)] for _ in range(rules)]
    cells = [(r, v) for r in range(rules) for v in (-1, 1)]

    def sums(weight: Column) -> list[Column]:
        return [F.sum(F.when(F.col("votes")[r] == v, weight).otherwise(0.0)) for r, v in cells]

    total, *of_cell = patterns.agg(F.sum("count"), *sums(F.col("count"))).first()
    if not total:
        return good_share, ratios
    for _ in range(rounds):
        before = ratios
        p = F.col("good")
        weighted = patterns.select("votes", (posterior(F.col("votes"), good_share, ratios) * F.col("count")).alias("good"))
        good, *good_cell = weighted.agg(F.sum(p), *sums(p)).first()
        good_share = (good + SMOOTHING) / (total + 2 * SMOOTHING)
        # Abstaining says nothing; of the votes given, a rule's accuracy on either side counts.
        counts = {cell: (g + SMOOTHING, n - g + SMOOTHING) for cell, g, n in zip(cells, good_cell, of_cell)}
        ratios = []
        for r in range(rules):
            (good_no, bad_no), (good_yes, bad_yes) = counts[r, -1], counts[r, 1]
            goods, bads = good_no + good_yes, bad_no + bad_yes
            # A rule that has come to mean the opposite is mute rather than turned round.
            ratios.append([min(math.log(good_no / goods * bads / bad_no), 0.0), 0.0, max(math.log(good_yes / goods * bads / bad_yes), 0.0)])
        if max(abs(x - y) for own, old in zip(ratios, before) for x, y in zip(own, old)) < TOLERANCE:
            break
    return good_share, ratios


def posterior(votes: Column, good_share: float, ratios: list[list[float]]) -> Column:
    """Probability that a text with these votes is good."""
    parts = [F.get(F.array(*[F.lit(float(x)) for x in own]), votes[r] + 1) for r, own in enumerate(ratios)]
    odds = reduce(lambda a, b: a + b, parts, F.lit(math.log(good_share / (1 - good_share))))
    return 1 / (1 + F.exp(-odds))


def apply_rules(counted: DataFrame, good_share: float, ratios: list[list[float]]) -> DataFrame:
    """Adds ``_base_failed``, ``_probability`` and ``_kept`` to a table with ``_quality``."""
    s = F.col("_quality")
    return (
        counted.withColumn("_base_failed", base_failed(s))
        .withColumn("_probability", posterior(votes_column(s), good_share, ratios))
        .withColumn("_kept", ~F.col("_base_failed") & (F.col("_probability") >= KEEP_PROBABILITY)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Null and empty texts fail the base rules. The rows are written once with their votes, which are dear
    to count and serve both the estimation and the verdicts.
    """
    mark = "_votes"
    while mark in {c.lower() for c in docs.columns}:
        mark += "_"
    cast = let(quality(F.col("text")), lambda s: F.struct(base_failed(s).alias("failed"), votes_column(s).alias("votes")))
    seen = materialise(docs.withColumn(mark, cast))
    votes = F.col(f"{mark}.votes")
    good_share, ratios = fit_rules(materialise(seen.groupBy(votes.alias("votes")).count()))
    return seen.where(~F.col(f"{mark}.failed") & (posterior(votes, good_share, ratios) >= KEEP_PROBABILITY)).drop(mark)


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics are written once and serve both the estimation and the verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = materialise(with_statistics(docs).drop("text"))
    patterns = materialise(counted.select(votes_column(F.col("_quality")).alias("votes")).groupBy("votes").count())
    found = apply_rules(counted, *fit_rules(patterns))
    return found.select(
        F.col("doc_id").cast("long"), *[F.col(f"_quality.{c}").alias(c) for c in STATISTICS],
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_probability").alias("probability"))
