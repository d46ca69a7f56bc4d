"""The weekly matcher: region records from a label volume, gated candidates and their scores.

A record keeps small pixel sets of the region's fullest plane. Pixels are cut to the fixed windows
of the method before they are collected, so a record is bounded however large a region is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from longitrack.operators.spatial import radius_join
from longitrack.params import LegacyParams

PAIR = ("day_a", "day_b")
# Fixed values of the method.
BINS = 8
CANVAS = 20
WEIGHTS = {
    "spatial_term": 0.28, "z_term": 0.12, "patch_cos": 0.14, "iou": 0.24, "area_ratio": 0.08, "radial_term": 0.04,
    "bbox_iou": 0.10,
}


def ring_sizes(radius: int) -> tuple[list[float], list[int]]:
    """Upper edges and pixel counts of the rings of a square patch."""
    axis = np.arange(-radius, radius + 1)
    distance = np.sqrt(axis[:, None] ** 2 + axis[None, :] ** 2)
    edges = np.linspace(0.0, float(distance.max()) + 1e-6, BINS + 1)
    return edges[1:].tolist(), np.histogram(distance, edges)[0].tolist()


def records(voxels: DataFrame, volumes: DataFrame, params: LegacyParams = LegacyParams()) -> DataFrame:
    """One record per region: centroid, bounding box, fullest plane, patch, ring profile and edge distance."""
    key = ["session_id", "label"]
    axes = ("z", "y", "x")
    shape = voxels.groupBy(*key).agg(
        *[F.avg(c).alias(f"centroid_{c}") for c in axes],
        *[F.min(c).alias(f"min_{c}") for c in axes],
        *[F.max(c).alias(f"max_{c}") for c in axes],
        F.count(F.lit(1)).alias("area_total"),
    )
    planes = voxels.groupBy(*key, "z").agg(F.count(F.lit(1)).alias("n"))
    # The lowest of equally full planes.
    fullest = planes.groupBy(*key).agg(
        F.max(F.struct(F.col("n"), -F.col("z"))).alias("p")
    ).select(*key, (-F.col("p.col2")).alias("center_plane"), F.col("p.n").alias("area_center"))
    base = shape.join(fullest, key).join(volumes, "session_id")
    edge = F.least(
        F.col("centroid_y"), F.col("centroid_x"), F.col("ny") - 1 - F.col("centroid_y"), F.col("nx") - 1 - F.col("centroid_x")
    )
    base = base.withColumn("dist_to_edge", edge).withColumn("is_edge", F.col("dist_to_edge") < params.edge_margin)
    radius = params.patch_radius
    edges, sizes = ring_sizes(radius)
    wide = max(radius, CANVAS) + 1
    near = voxels.join(base.select(*key, "center_plane", "centroid_y", "centroid_x"), key).where(
        (F.col("z") == F.col("center_plane"))
        & (F.abs(F.col("y") - F.col("centroid_y")) <= wide)
        & (F.abs(F.col("x") - F.col("centroid_x")) <= wide)
    )
    dy, dx = F.col("y") - F.rint("centroid_y"), F.col("x") - F.rint("centroid_x")
    in_patch = (F.abs(dy) <= radius) & (F.abs(dx) <= radius)
    patch = F.when(in_patch, (dy + radius) * (2 * radius + 1) + dx + radius).cast("int")

    def canvas(axis: str) -> Column:
        offset = (F.col(axis) - F.col(f"centroid_{axis}")).cast("float")
        return F.rint(offset + F.lit(float(CANVAS)).cast("float")).cast("int")

    side = 2 * CANVAS + 1
    cy, cx = canvas("y"), canvas("x")
    on_canvas = (cy >= 0) & (cy < side) & (cx >= 0) & (cx < side)
    distance = F.sqrt(dy * dy + dx * dx)
    rings, low = [], 0.0
    for i, (high, size) in enumerate(zip(edges, sizes)):
        inside = in_patch & (distance >= low) & (distance < high)
        rings.append((F.count(F.when(inside, 1)) / size).alias(f"_ring{i}"))
        low = high
    pixels = near.groupBy(*key).agg(
        F.collect_set(patch).alias("patch"),
        F.collect_set(F.when(on_canvas, cy * side + cx)).alias("canvas"),
        *rings,
    )
    ring = [F.col(f"_ring{i}") for i in range(BINS)]
    total = sum(ring[1:], ring[0])
    profile = F.array(*[F.when(total > 0, r / total).otherwise(F.lit(0.0)) for r in ring])
    pixels = pixels.select(*key, "patch", "canvas", profile.alias("radial_profile"))
    return base.join(pixels, key, "left").drop("nz", "ny", "nx")


def scored_pairs(
    records_table: DataFrame, shifts: DataFrame, params: LegacyParams = LegacyParams(), pair: Sequence[str] = PAIR,
) -> DataFrame:
    """Candidate pairs within the gates, with score components, down to the minimum score.

    ``shifts`` has one row per pair with ``shift_y`` and ``shift_x`` for the second session.
    """
    pair = list(pair)
    shifts = shifts.select(*pair, "shift_y", "shift_x")

    def side(which: str) -> DataFrame:
        own = records_table.withColumnRenamed("session_id", f"day_{which}").withColumnRenamed("label", f"label_{which}")
        rows = shifts.join(own, f"day_{which}")
        moved = which == "b"
        return rows.withColumn("py", F.col("centroid_y") + (F.col("shift_y") if moved else 0.0)).withColumn(
            "px", F.col("centroid_x") + (F.col("shift_x") if moved else 0.0)
        )

    reach = params.max_dist_xy + params.edge_relax
    near = radius_join(side("a"), side("b"), reach, reach, pair, ("py", "px")).withColumnRenamed("distance_um", "dxy")
    edge = F.col("a.is_edge") | F.col("b.is_edge")
    limit = params.max_dist_xy + F.when(edge, F.lit(params.edge_relax)).otherwise(F.lit(0.0))
    near = near.withColumn("_limit", limit).withColumn("dz", F.abs(F.col("a.centroid_z") - F.col("b.centroid_z")))
    near = near.where((F.col("dxy") <= F.col("_limit")) & (F.col("dz") <= params.max_dist_z))

    def shared(name: str) -> tuple[Column, Column]:
        return F.size(F.array_intersect(f"a.{name}", f"b.{name}")), F.size(F.array_union(f"a.{name}", f"b.{name}"))

    both_patch, _ = shared("patch")
    norm = F.sqrt(F.size("a.patch").cast("double") * F.size("b.patch"))
    both_canvas, either_canvas = shared("canvas")
    radial = F.aggregate(
        F.zip_with("a.radial_profile", "b.radial_profile", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda acc, v: acc + v
    )

    def span(axis: str) -> tuple[Column, Column, Column]:
        a0, a1, b0, b1 = (F.col(f"{s}.{m}_{axis}") for s in ("a", "b") for m in ("min", "max"))
        return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1), a1 - a0 + 1, b1 - b0 + 1

    (hy, ay, by_), (hx, ax, bx) = span("y"), span("x")
    box = (hy * hx).cast("double")
    union = ay * ax + by_ * bx - box
    area_a, area_b = F.col("a.area_center"), F.col("b.area_center")
    out = near.select(
        *pair, F.col("a.label_a").alias("label_a"), F.col("b.label_b").alias("label_b"), "dxy", "dz",
        (F.least(area_a, area_b) / F.greatest(area_a, area_b)).alias("area_ratio"),
        F.when(norm > 0, both_patch / norm).otherwise(F.lit(0.0)).alias("patch_cos"),
        radial.alias("radial_l1"),
        F.when(either_canvas > 0, both_canvas / either_canvas).otherwise(F.lit(0.0)).alias("iou"),
        F.when(union > 0, box / union).otherwise(F.lit(0.0)).alias("bbox_iou"),
        F.col("a.shift_y").alias("shift_y"), F.col("a.shift_x").alias("shift_x"),
        edge.cast("double").alias("edge_case"), "_limit",
    )
    return add_legacy_score(out, params).drop("_limit").where(F.col("score") >= params.min_score)


def add_legacy_score(pairs: DataFrame, params: LegacyParams = LegacyParams()) -> DataFrame:
    """Weighted score of the components, between 0 and 1."""
    xy = F.col("dxy") / F.greatest(F.lit(1.0), 0.45 * F.col("_limit"))
    z = F.col("dz") / max(1.0, 0.55 * params.max_dist_z)
    terms = {
        **{name: F.col(name) for name in WEIGHTS},
        "spatial_term": F.exp(-(xy * xy)), "z_term": F.exp(-(z * z)), "radial_term": F.exp(-2.0 * F.col("radial_l1")),
    }
    score = F.col("edge_case") * params.edge_bonus
    for name, weight in WEIGHTS.items():
        score = score + weight * terms[name]
    return pairs.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
