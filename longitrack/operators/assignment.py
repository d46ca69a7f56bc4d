"""One-to-one assignment between two sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from longitrack.operators.candidates import PAIR
from longitrack.session import materialise

# (column, descending) pairs; the two labels at the end make the order strict.
SCORE_ORDER = (("score", True), ("dice", True), ("distance_um", False), ("label_a", False), ("label_b", False))
GRAPH_ORDER = (
    ("refined_score", True), ("graph_support_count", True), ("graph_residual_median_um", False), ("dice", True),
    ("distance_um", False), ("label_a", False), ("label_b", False),
)


def _best_first(order: Sequence[tuple[str, bool]]) -> Column:
    """A struct whose maximum is the first row of ``order``; missing values come last either way."""
    return F.struct(*[(F.col(c) if desc else -F.col(c)).alias(f"_k{i}") for i, (c, desc) in enumerate(order)],
                    F.col("label_a").alias("label_a"), F.col("label_b").alias("label_b"))


def mutual_best_overlap(overlaps: DataFrame, pair: Sequence[str] = PAIR) -> DataFrame:
    """Overlap pairs that are the best of both labels; ties go to the lower label.

    Both sides are plain aggregations with map-side combining, so a label with very many overlaps
    is one row per map task before the shuffle.
    """
    pair = list(pair)
    columns = [c for c in overlaps.columns if c not in pair]
    row = F.struct(*columns)
    best_a = overlaps.groupBy(*pair, "label_a").agg(F.max_by(row, F.struct("dice", -F.col("label_b"))).alias("e"))
    best_b = overlaps.groupBy(*pair, "label_b").agg(
        F.max_by("label_a", F.struct("dice", -F.col("label_a"))).alias("label_a")
    )
    return best_a.select(*pair, "e.*").join(best_b, [*pair, "label_a", "label_b"], "left_semi")


def _counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``df`` written once, and how many of its rows meet ``condition``, observed while writing."""
    seen = Observation()
    table = materialise(df.observe(seen, F.count_if(condition).alias("n")))
    return table, seen.get["n"]


def _decided(left: DataFrame, pair: list[str]) -> DataFrame:
    """(``pair``, labels) of accepted candidates among ``left`` (``pair``, ``_e``); the best of all is one of them.

    A candidate that is the best of both its labels is accepted. One that is the best of one label and the second
    of the other hangs on a single better rival: it is accepted if the rival is not. Such candidates form
    chains, which pointer doubling follows to their ends in logarithmic steps. Chains that end in a
    candidate with several better rivals stay undecided.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"_e.{c}").alias("label")) for i, c in enumerate(("label_a", "label_b"))]))
    order = W.partitionBy(*pair, "_end").orderBy(F.desc("_e"))
    best_two = (
        left.withColumn("_end", ends)
        .withColumn("_r", F.row_number().over(order))
        .withColumn("_rival", F.first("_e").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .where(F.col("_r") <= 2)
    )
    second = F.col("_r") == 2
    standing = best_two.groupBy(*pair, "_e").agg(
        F.count_if(~second).alias("_firsts"), F.count_if(second).alias("_seconds"), F.max(F.when(second, F.col("_rival"))).alias("_rival"))
    chains = standing.where(F.col("_firsts") + F.col("_seconds") == 2).where("_firsts > 0").select(
        *pair, "_e.label_a", "_e.label_b", F.col("_rival.label_a").alias("_to_a"), F.col("_rival.label_b").alias("_to_b"),
        F.lit(True).alias("_turn"), F.when(F.col("_firsts") == 2, True).alias("_accepted"))
    open_ = F.col("_accepted").isNull()
    chains, n = _counted(chains, open_)
    while n:
        target = chains.select(*pair, F.col("label_a").alias("_to_a"), F.col("label_b").alias("_to_b"), F.col("_to_a").alias("_next_a"),
                               F.col("_to_b").alias("_next_b"), F.col("_turn").alias("_next_turn"), F.col("_accepted").alias("_known"))
        stepped = chains.where(open_).join(target, [*pair, "_to_a", "_to_b"]).select(
            *pair, "label_a", "label_b", F.col("_next_a").alias("_to_a"), F.col("_next_b").alias("_to_b"),
            (F.col("_turn") != F.col("_next_turn")).alias("_turn"), (F.col("_known") != F.col("_turn")).alias("_accepted"))
        chains, n = _counted(chains.where(~open_).unionByName(stepped), open_)
    return chains.where("_accepted").select(*pair, "label_a", "label_b")


def greedy_keys(
    candidates: DataFrame, order: Sequence[tuple[str, bool]] = SCORE_ORDER, pair: Sequence[str] = PAIR,
) -> DataFrame:
    """Keys of the matches a greedy pass in ``order`` accepts.

    With a strict order the greedy result equals this fix-point: accept every candidate that is decided to be
    a match, remove its labels, repeat. A round is an aggregation of the two best of every label, the
    steps along chains of better rivals (see ``_decided``) and joins on unique keys. ``candidates`` should
    be a written table.
    """
    pair = list(pair)
    left = candidates.select(*pair, _best_first(order).alias("_e"))
    accepted, n = None, 1
    while n:
        now = materialise(_decided(left, pair))
        accepted = now if accepted is None else accepted.unionByName(now)
        for c in ("label_a", "label_b"):
            taken = now.select(*pair, F.col(c).alias("_label"))
            left = left.withColumn("_label", F.col(f"_e.{c}")).join(taken, [*pair, "_label"], "left_anti").drop("_label")
        left, n = _counted(left, F.lit(True))
    return accepted


def greedy_one_to_one(
    candidates: DataFrame, rule: str, order: Sequence[tuple[str, bool]] = SCORE_ORDER, pair: Sequence[str] = PAIR,
) -> DataFrame:
    """Greedy one-to-one matches among the candidates that pass ``rule``."""
    allowed = materialise(candidates.where(F.col(rule)))
    chosen = greedy_keys(allowed, order, pair)
    return allowed.join(chosen, [*pair, "label_a", "label_b"], "left_semi").withColumn(
        "assignment_policy", F.lit(rule.removesuffix("_rule"))
    )


def reciprocal_best(candidates: DataFrame, pair: Sequence[str] = PAIR, tolerance: float = 1e-9) -> DataFrame:
    """The weekly matcher's assignment: a candidate must be the best of both its labels.

    The confidence adds the margins over the second-best score of either label. The two best scores
    per label come from an aggregation that keeps the highest score and how often it occurs, and
    from a second one over the rest, so no label's candidates meet in one window.
    """
    pair = list(pair)
    rows = materialise(candidates)

    def top_two(label: str, tag: str) -> DataFrame:
        best = rows.groupBy(*pair, label).agg(F.max("score").alias(f"_best_{tag}"))
        both = rows.select(*pair, label, "score").join(best, [*pair, label])
        return both.groupBy(*pair, label).agg(
            F.max(f"_best_{tag}").alias(f"_best_{tag}"),
            F.when(F.count(F.when(F.col("score") == F.col(f"_best_{tag}"), 1)) > 1, F.max(f"_best_{tag}"))
            .otherwise(F.coalesce(F.max(F.when(F.col("score") < F.col(f"_best_{tag}"), F.col("score"))), F.lit(0.0)))
            .alias(f"_second_{tag}"),
        )

    scored = rows.join(top_two("label_a", "a"), [*pair, "label_a"]).join(top_two("label_b", "b"), [*pair, "label_b"])
    score = F.col("score")
    confidence = 0.70 * score + 0.15 * (score - F.col("_second_a")) + 0.15 * (score - F.col("_second_b"))
    eligible = scored.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).where(
        (score + tolerance >= F.col("_best_a")) & (score + tolerance >= F.col("_best_b"))
    )
    # Only equal scores of one label are still in conflict.
    eligible = materialise(eligible.drop("_best_a", "_best_b", "_second_a", "_second_b"))
    order = (("score", True), ("confidence", True), ("label_a", False), ("label_b", False))
    return eligible.join(greedy_keys(eligible, order, pair), [*pair, "label_a", "label_b"], "left_semi")

