"""Candidate pairs between two sessions: evidence, scores and inclusion rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from longitrack.operators.spatial import AXES, distance, knn_join
from longitrack.params import OverlapParams, Spacing
from longitrack.session import materialise

PAIR = ("day_a", "day_b")


def apply_transform(points: DataFrame, spacing: Spacing = Spacing()) -> DataFrame:
    """Physical coordinates of the moving session after its pair's restricted transform.

    The rows carry the pair's coefficients ``a0, a1`` (z), ``b0, b1, b2`` (y) and ``c0, c1, c2`` (x).
    """
    z, y, x = F.col("centroid_z"), F.col("centroid_y"), F.col("centroid_x")
    return (
        points.withColumn("z_um", (F.col("a0") + F.col("a1") * z) * spacing.z_um)
        .withColumn("y_um", (F.col("b0") + F.col("b1") * y + F.col("b2") * x) * spacing.y_um)
        .withColumn("x_um", (F.col("c0") + F.col("c1") * y + F.col("c2") * x) * spacing.x_um)
    )


def two_nearest(queries: DataFrame, targets: DataFrame, pair: Sequence[str] = PAIR) -> DataFrame:
    """Nearest target, its distance and the second distance (NULL without a second target)."""
    near = knn_join(queries, targets, 2, pair)
    return near.groupBy(*pair, "label").agg(
        F.max(F.when(F.col("rank") == 1, F.col("neighbour"))).alias("neighbour"),
        F.max(F.when(F.col("rank") == 1, F.col("distance_um"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.col("distance_um"))).alias("d2"),
    )


def _ambiguity(first: Column, second: Column, fallback: float) -> Column:
    return F.when(second > 0, first / second).otherwise(F.lit(fallback))


def mutual_centroid_pairs(
    a: DataFrame, b: DataFrame, params: OverlapParams = OverlapParams(), pair: Sequence[str] = PAIR,
) -> DataFrame:
    """Points that are each other's nearest neighbour within the distance limit, with their ambiguity."""
    pair = list(pair)
    # Both directions are one neighbour join: the direction is a further key.
    queries = a.withColumn("_way", F.lit(0)).unionByName(b.withColumn("_way", F.lit(1)))
    targets = b.withColumn("_way", F.lit(0)).unionByName(a.withColumn("_way", F.lit(1)))
    near = materialise(two_nearest(queries, targets, [*pair, "_way"]).where(F.col("d1") <= params.centroid_max_um))
    ab, ba = near.where(F.col("_way") == 0), near.where(F.col("_way") == 1)
    left = ab.select(*pair, F.col("label").alias("label_a"), F.col("neighbour").alias("label_b"),
                     F.col("d1").alias("distance_um"), F.col("d2").alias("_second_a"))
    right = ba.select(*pair, F.col("label").alias("label_b"), F.col("neighbour").alias("label_a"),
                      F.col("d1").alias("_first_b"), F.col("d2").alias("_second_b"))
    joined = left.join(right, [*pair, "label_a", "label_b"])
    ambiguity = F.greatest(
        _ambiguity(F.col("distance_um"), F.col("_second_a"), params.overlap_only_ambiguity),
        _ambiguity(F.col("_first_b"), F.col("_second_b"), params.overlap_only_ambiguity),
    )
    return joined.select(*pair, "label_a", "label_b", "distance_um", ambiguity.alias("ambiguity"))


def candidate_pairs(
    a: DataFrame, b: DataFrame, overlaps: DataFrame, params: OverlapParams = OverlapParams(), pair: Sequence[str] = PAIR,
) -> DataFrame:
    """Mutual centroid pairs joined with sufficiently overlapping pairs, scored and ruled.

    ``a`` and ``b`` have ``label``, the aligned coordinates and ``area_voxels``. A centroid pair
    with any overlap takes that overlap's dice and counts as evidence from both.
    """
    keys = [*pair, "label_a", "label_b"]
    centroid = mutual_centroid_pairs(a, b, params, pair).withColumn("_centroid", F.lit(True))
    overlap = overlaps.select(*keys, "dice", "iou").withColumn("_overlap", F.lit(True))
    merged = centroid.join(overlap, keys, "full_outer").where(
        F.col("_centroid") | (F.col("dice") >= params.overlap_min_dice)
    )
    # Wanted columns travel in one struct per side, so that each side is joined once.
    side_a = a.select(*pair, F.col("label").alias("label_a"), F.struct(*AXES, "area_voxels").alias("pa"))
    side_b = b.select(*pair, F.col("label").alias("label_b"), F.struct(*AXES, "area_voxels").alias("pb"))
    placed = merged.join(side_a, [*pair, "label_a"]).join(side_b, [*pair, "label_b"])
    area_a, area_b = F.col("pa.area_voxels"), F.col("pb.area_voxels")
    source = (
        F.when(F.col("_centroid") & F.col("_overlap"), "both")
        .when(F.col("_centroid"), "mutual_centroid")
        .otherwise("mutual_overlap")
    )
    placed = placed.select(
        *keys,
        source.alias("candidate_source"),
        F.coalesce("distance_um", distance("pa", "pb")).alias("distance_um"),
        F.coalesce("ambiguity", F.lit(params.overlap_only_ambiguity)).alias("ambiguity"),
        F.coalesce("dice", F.lit(0.0)).alias("dice"),
        F.coalesce("iou", F.lit(0.0)).alias("iou"),
        (F.least(area_a, area_b) / F.greatest(area_a, area_b)).alias("area_ratio"),
    )
    return add_rules(add_scores(placed, params))


def add_scores(candidates: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """Spatial and ambiguity terms and the weighted score."""
    scaled = F.col("distance_um") / params.score_scale_um
    return (
        candidates.withColumn("spatial_term", F.exp(-(scaled * scaled)))
        .withColumn("ambiguity_term", F.greatest(F.lit(0.0), 1.0 - F.least(F.col("ambiguity"), F.lit(1.0))))
        .withColumn(
            "score",
            params.weight_spatial * F.col("spatial_term")
            + params.weight_dice * F.col("dice")
            + params.weight_area_ratio * F.col("area_ratio")
            + params.weight_ambiguity * F.col("ambiguity_term"),
        )
    )


def _any_of(limits: Sequence[dict[str, float]]) -> Column:
    """True where one of the given sets of limits holds."""
    result = F.lit(False)
    for limit in limits:
        holds = F.lit(True)
        for name, bound in limit.items():
            column = F.col(name)
            holds = holds & ((column >= bound) if name in ("dice", "area_ratio") else (column <= bound))
        result = result | F.coalesce(holds, F.lit(False))
    return result


# Fixed limits of the two inclusion rules; a row passes when it meets all limits of one line.
HIGH_LIMITS = (
    {"dice": 0.40, "distance_um": 8.0, "area_ratio": 0.30},
    {"distance_um": 3.5, "area_ratio": 0.55, "ambiguity": 0.70},
)
BALANCED_LIMITS = HIGH_LIMITS + (
    {"dice": 0.20, "distance_um": 7.0, "area_ratio": 0.30},
    {"distance_um": 5.0, "area_ratio": 0.40, "ambiguity": 0.85},
)


def add_rules(candidates: DataFrame, high: Sequence[dict] = HIGH_LIMITS, balanced: Sequence[dict] = BALANCED_LIMITS) -> DataFrame:
    """Boolean ``high_rule`` and ``balanced_rule``."""
    return candidates.withColumn("high_rule", _any_of(high)).withColumn("balanced_rule", _any_of(balanced))
