"""Review samples, example tracks and match diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longitrack.operators.ordering import exact_quantiles
from longitrack.operators.ranking import seeded_sample
from longitrack.session import materialise


def take(df: DataFrame, order: Sequence[Column], limit: int, out: str = "category_rank") -> DataFrame:
    """The first ``limit`` rows with their rank; the window sees these rows only."""
    return df.orderBy(*order).limit(limit).withColumn(out, F.row_number().over(W.orderBy(*order)))


def pair_summary_long(summary: DataFrame, pair: Sequence[str], policies: Sequence[str] = ("high", "balanced")) -> DataFrame:
    """One row per pair and policy from the per-pair counts ``n_<policy>``."""
    long = summary.unpivot(list(pair), [f"n_{p}" for p in policies], "match_policy", "n_matches")
    return long.withColumn("match_policy", F.substring("match_policy", 3, 100))


def example_tracks(tracks: DataFrame, per_group: int = 6, keys: Sequence[str] = ("field_id", "signature")) -> DataFrame:
    """Typical tracks: most confident, closest to the median, least confident, and flagged for review."""
    tracks = materialise(tracks)
    eligible = tracks.where(F.col("n_days_present") >= 2)
    if eligible.isEmpty():
        eligible = tracks
    clean = materialise(eligible.where(~F.coalesce(F.col("needs_review"), F.lit(False))))
    flagged = eligible.where("needs_review")
    median = exact_quantiles(clean, "mean_confidence", {"m": 0.5})
    distance = F.round(F.abs(F.col("mean_confidence") - median.select("m").scalar()), 9)
    tie = [F.asc(k) for k in keys]
    high = [F.desc("mean_confidence"), F.desc("min_confidence"), *tie]
    low = [F.asc("min_confidence"), F.asc("mean_confidence"), *tie]
    # Without a clean track the middle examples are simply the first eligible ones.
    middle = clean if not clean.isEmpty() else eligible
    medium = middle.withColumn("_d", distance)
    parts = {
        "high": take(clean, high, per_group),
        "medium": take(medium, [F.asc("_d"), F.desc("mean_confidence"), *tie], per_group).drop("_d"),
        "low": take(eligible, low, per_group),
        "review": take(flagged, low, per_group),
    }
    out = None
    for name, part in parts.items():
        part = part.withColumn("example_group", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def review_sample(
    high: DataFrame, balanced: DataFrame | None, limit: int = 6, seed: int | None = 7, keys: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """Tracks worth a look, up to ``limit`` per category.

    ``seed`` draws the random category with a seeded NumPy generator; ``None`` leaves it out.
    """
    high = materialise(high)
    tie = [F.asc(k) for k in keys]
    truncated = F.col("missing_internal_days") > 0
    if "n_edge_sessions" in high.columns:
        truncated = truncated | (F.col("n_edge_sessions") > 0)
    categories = {
        "lowest_score_high": (None, [F.asc_nulls_last("min_score")]),
        "largest_distance_high": (None, [F.desc_nulls_last("max_distance_um")]),
        "lowest_dice_high": (None, [F.asc_nulls_last("min_dice")]),
        "cycle_conflict": (F.col("has_cycle_conflict"), []),
        "gap_bridge": (F.col("used_gap_bridge"), []),
        "transform_fallback": (F.col("contains_transform_fallback_edge"), []),
        "edge_or_truncated": (truncated, [F.asc("n_days_present")]),
    }
    parts = []
    if seed is not None:
        parts.append(
            seeded_sample(high, tie, limit, seed, out="category_rank").withColumn("review_category", F.lit("random_high"))
        )
    for name, (condition, order) in categories.items():
        rows = high if condition is None else high.where(condition)
        parts.append(take(rows, [*order, *tie], limit).withColumn("review_category", F.lit(name)))
    if balanced is not None:
        shared = [c for c in ("field_id", "component_signature") if c in high.columns]
        only = balanced.join(high.select(*shared), shared, "left_anti")
        parts.append(take(only, tie, limit).withColumn("review_category", F.lit("balanced_only")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def pair_diagnostics(matches: DataFrame, pair: Sequence[str], distances: Sequence[str] = ("distance_um",)) -> DataFrame:
    """Per pair: accepted matches, median and maximum distances, deciles of score and confidence."""
    matches = materialise(matches)
    out = matches.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("accepted_reciprocal_matches"),
        *[F.max(d).alias(f"max_{d}") for d in distances],
    )
    wanted = {d: {f"median_{d}": 0.5} for d in distances}
    wanted |= {v: {f"{v}_p10": 0.1, f"{v}_median": 0.5, f"{v}_p90": 0.9} for v in ("score", "confidence")}
    # All columns in one selection, each as a group of its own.
    long = matches.select(*pair, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in wanted])).alias("_m")).select(*pair, "_m.*")
    every = {p: f"_q{i}" for i, p in enumerate(sorted({p for probs in wanted.values() for p in probs.values()}))}
    found = exact_quantiles(long, "_value", {name: p for p, name in every.items()}, [*pair, "_column"])
    columns = [F.max(F.when(F.col("_column") == c, F.col(every[p]))).alias(name) for c, probs in wanted.items() for name, p in probs.items()]
    return out.join(found.groupBy(*pair).agg(*columns), list(pair), "left")


def match_distances(matches: DataFrame, pair: Sequence[str], xy_um: float = 710.0 / 1024.0, z_um: float = 5.0) -> DataFrame:
    """One row per accepted match with its distances in pixels, planes and micrometres."""
    return matches.select(
        *pair, "label_a", "label_b", F.col("dxy").alias("distance_xy_px"), (F.col("dxy") * xy_um).alias("distance_xy_um"),
        F.col("dz").alias("distance_z_planes"), (F.col("dz") * z_um).alias("distance_z_um"),
        F.col("score").alias("match_score"), "confidence",
    )
