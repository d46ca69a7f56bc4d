"""Voxel-level operators. A volume is a relation ``(session_id, z, y, x, label)`` without background.

All of these are aggregations with map-side combining or equi-joins on unique voxel keys, so a
label or a session that holds a third of all voxels is spread over the tasks like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from longitrack.params import Spacing
from longitrack.session import materialise

# Edge of the image tiles on which crops and voxels meet, in pixels.
TILE = 32


def invalid_masks(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Sessions whose mask has no foreground or no background; empty when all are fine."""
    counts = voxels.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    cells = F.col("nz").cast("long") * F.col("ny") * F.col("nx")
    filled = F.coalesce(F.col("_n"), F.lit(0))
    return volumes.join(counts, "session_id", "left").where((filled == 0) | (filled >= cells)).select("session_id")


def region_features(voxels: DataFrame, volumes: DataFrame, spacing: Spacing = Spacing()) -> DataFrame:
    """Size, centroid, half-open bounding box and edge contact of every region."""
    axes = ("z", "y", "x")
    out = voxels.groupBy("session_id", "label").agg(
        F.count(F.lit(1)).cast("double").alias("area_voxels"),
        *[F.avg(c).alias(f"centroid_{c}") for c in axes],
        *[F.min(c).alias(f"bbox_{c}0") for c in axes],
        *[(F.max(c) + 1).alias(f"bbox_{c}1") for c in axes],
    ).join(volumes, "session_id")
    step = {"z": spacing.z_um, "y": spacing.y_um, "x": spacing.x_um}
    out = out.withColumn("volume_um3", F.col("area_voxels") * (spacing.z_um * spacing.y_um * spacing.x_um))
    for c in axes:
        out = out.withColumn(f"centroid_{c}_um", F.col(f"centroid_{c}") * step[c])

    def touches(c: str) -> Column:
        return (F.col(f"bbox_{c}0") == 0) | (F.col(f"bbox_{c}1") == F.col(f"n{c}"))

    return (
        out.withColumn("bbox_depth_planes", F.col("bbox_z1") - F.col("bbox_z0"))
        .withColumn("bbox_height_px", F.col("bbox_y1") - F.col("bbox_y0"))
        .withColumn("bbox_width_px", F.col("bbox_x1") - F.col("bbox_x0"))
        .withColumn("touches_z_edge", touches("z"))
        .withColumn("touches_xy_edge", touches("y") | touches("x"))
        .drop("nz", "ny", "nx")
    )


def label_means(
    voxels: DataFrame, channels: Sequence[str] = ("red", "green"), exclude_zero: bool = True,
    by: Sequence[str] = ("session_id",),
) -> DataFrame:
    """Mean intensity per label and channel; with ``exclude_zero`` a label with a zero voxel drops out.

    The exclusion is per channel, as every channel is its own image.
    """
    means = voxels.groupBy(*by, "label").agg(
        *[F.avg(c).alias(c) for c in channels], *[F.bool_or(F.col(c) == 0).alias(f"_zero_{c}") for c in channels]
    )
    kept = [F.when(~F.col(f"_zero_{c}"), F.col(c)).alias(c) if exclude_zero else F.col(c) for c in channels]
    long = means.select(*by, "label", *kept).unpivot([*by, "label"], list(channels), "channel", "mean_intensity")
    return long.where(F.col("mean_intensity").isNotNull())


def shifted_overlap(voxels: DataFrame, areas: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overlap of labels of two sessions after an integer-rounded shift of the second one.

    ``pairs`` has ``day_a``, ``day_b``, ``shift_z``, ``shift_y``, ``shift_x``; one row per scheduled
    pair. A voxel has one partner per pair, so the join is an equi-join on unique keys. Dice and
    IoU use the whole areas, also where the shift moves a part out of the volume.
    """
    a = pairs.join(voxels, pairs["day_a"] == voxels["session_id"]).select(
        "day_a", "day_b", "z", "y", "x", F.col("label").alias("label_a")
    )
    moved = [(F.col(c) + F.rint(f"shift_{c}").cast("int")).alias(c) for c in ("z", "y", "x")]
    b = pairs.join(voxels, pairs["day_b"] == voxels["session_id"]).select(
        "day_a", "day_b", *moved, F.col("label").alias("label_b")
    )
    counts = a.join(b, ["day_a", "day_b", "z", "y", "x"]).groupBy("day_a", "day_b", "label_a", "label_b").agg(
        F.count(F.lit(1)).alias("intersection_voxels")
    )
    for side in ("a", "b"):
        counts = counts.join(
            areas.select(F.col("session_id").alias(f"day_{side}"), F.col("label").alias(f"label_{side}"),
                         F.col("area_voxels").alias(f"_area_{side}")),
            [f"day_{side}", f"label_{side}"],
        )
    both = F.col("_area_a") + F.col("_area_b")
    n = F.col("intersection_voxels")
    return counts.select(
        "day_a", "day_b", "label_a", "label_b", "intersection_voxels",
        (2.0 * n / both).alias("dice"), (n / (both - n)).alias("iou"),
    )


def occupancy_projection(voxels: DataFrame) -> DataFrame:
    """Number of foreground voxels over z at every pixel that has one."""
    return voxels.groupBy("session_id", "y", "x").agg(F.count(F.lit(1)).alias("n"))


def z_profiles(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Foreground voxels per plane as one array per session; planes without any are zero."""
    counts = voxels.groupBy("session_id", "z").agg(F.count(F.lit(1)).cast("double").alias("n"))
    maps = counts.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("z", "n"))).alias("_m"))
    planes = F.sequence(F.lit(0), F.col("nz") - 1)
    filled = F.transform(planes, lambda z: F.coalesce(F.try_element_at(F.col("_m"), z), F.lit(0.0)))
    return volumes.join(maps, "session_id").select("session_id", filled.alias("profile"))


def z_shifts(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Plane shift of the second session with the highest correlation of the centred profiles.

    The smallest such lag wins. A constant profile gives shift 0 and a fallback reason. There is one
    row per pair with two arrays of the stack depth.
    """
    joined = pairs.select("day_a", "day_b")
    for side in ("a", "b"):
        joined = joined.join(
            profiles.select(F.col("session_id").alias(f"day_{side}"), F.col("profile").alias(f"_p{side}")), f"day_{side}"
        )

    def centred(name: str) -> Column:
        total = F.aggregate(name, F.lit(0.0), lambda acc, v: acc + v)
        return F.transform(name, lambda v: v - total / F.size(name))

    joined = joined.withColumn("_ca", centred("_pa")).withColumn("_cb", centred("_pb"))
    flat = F.forall("_ca", lambda v: F.abs(v) <= 1e-8) | F.forall("_cb", lambda v: F.abs(v) <= 1e-8)
    lags = F.sequence(1 - F.size("_cb"), F.size("_ca") - 1)

    def correlation(lag: Column) -> Column:
        first = F.greatest(F.lit(0), lag)
        last = F.least(F.size("_ca"), F.size("_cb") + lag) - 1
        positions = F.sequence(first, last)
        return F.aggregate(
            positions, F.lit(0.0), lambda acc, z: acc + F.get(F.col("_ca"), z) * F.get(F.col("_cb"), z - lag)
        )

    scored = F.transform(lags, lambda lag: F.struct(correlation(lag).alias("c"), (-lag).alias("l")))
    best = -F.array_max(scored)["l"]
    return joined.select(
        "day_a", "day_b",
        F.when(flat, F.lit(0)).otherwise(best).cast("double").alias("shift_z"),
        flat.alias("z_fallback"),
        F.when(flat, "constant_profile").alias("z_fallback_reason"),
    )


# --- crops and projections ---------------------------------------------------------------------

def center_crop(voxels: DataFrame, volumes: DataFrame, height: int, width: int) -> DataFrame:
    """Central rectangle of every plane, with the origin moved to its corner."""
    sized = voxels.join(volumes, "session_id")
    y0, x0 = F.floor((F.col("ny") - height) / 2).cast("int"), F.floor((F.col("nx") - width) / 2).cast("int")
    fits = (F.col("ny") >= height) & (F.col("nx") >= width)
    y0 = F.when(fits, y0).otherwise(F.raise_error(F.lit("the crop is larger than the image")).cast("int"))
    return sized.where((F.col("y") >= y0) & (F.col("y") < y0 + height) & (F.col("x") >= x0) & (F.col("x") < x0 + width)).select(
        *[(F.col("y") - y0).alias("y") if c == "y" else (F.col("x") - x0).alias("x") if c == "x" else F.col(c) for c in voxels.columns]
    )


def fixed_crop(center: Column, size: int, limit: Column) -> tuple[Column, Column]:
    """Start and stop of a fixed-size window around ``center``, moved inside ``[0, limit)``."""
    start = F.rint(center - size / 2).cast("int")
    start = F.greatest(F.lit(0), F.least(start, limit - size))
    return start, start + size


def _grown(start: Column, stop: Column, limit: Column, least: int) -> tuple[Column, Column]:
    """Widen an interval to ``least``, evenly where the limits allow it."""
    missing = F.greatest(F.lit(0), F.lit(least) - (stop - start))
    low = F.floor(missing / 2).cast("int")
    wide = F.least(F.lit(least), limit)
    a, b = F.greatest(F.lit(0), start - low), F.least(limit, stop + missing - low)
    short = (missing > 0) & (b - a < least)
    return (
        F.when(short & (a > 0) & (b == limit), limit - wide).otherwise(a),
        F.when(short & (a == 0), wide).otherwise(b),
    )


def roi_crops(features: DataFrame, volumes: DataFrame, pad_xy: int = 20, min_size: int = 48, z_pad: int = 0) -> DataFrame:
    """Padded crop of at least ``min_size`` pixels around every region, inside its volume."""
    sized = features.join(volumes, "session_id")
    out = sized.withColumn("z_start", F.greatest(F.lit(0), F.col("bbox_z0") - z_pad)).withColumn(
        "z_stop", F.least(F.col("nz"), F.col("bbox_z1") + z_pad)
    )
    for c in ("y", "x"):
        limit = F.col(f"n{c}")
        start = F.greatest(F.lit(0), F.col(f"bbox_{c}0") - pad_xy)
        stop = F.least(limit, F.col(f"bbox_{c}1") + pad_xy)
        start, stop = _grown(start, stop, limit, min_size)
        out = out.withColumn(f"{c}_start", start).withColumn(f"{c}_stop", stop)
    return out.select("session_id", "label", "z_start", "z_stop", "y_start", "y_stop", "x_start", "x_stop")


def crop_projection(voxels: DataFrame, crop: DataFrame, value: str) -> DataFrame:
    """Maximum over z of ``value`` in each region's crop, and where the region itself is.

    ``crop`` comes from :func:`roi_crops` for the regions to show. Crops and voxels meet on image tiles,
    so a voxel is only compared with the crops that reach into its tile.
    """
    def tile(c: str | Column) -> Column:
        return F.floor((F.col(c) if isinstance(c, str) else c) / TILE)

    boxes = crop.withColumnRenamed("label", "roi_id")
    for c in ("y", "x"):
        tiles = F.sequence(tile(f"{c}_start"), tile(F.col(f"{c}_stop") - 1))
        boxes = boxes.withColumn(f"tile_{c}", F.explode(tiles))
    placed = voxels.withColumn("tile_y", tile("y")).withColumn("tile_x", tile("x"))
    inside = boxes.join(placed, ["session_id", "tile_y", "tile_x"]).where(
        (F.col("z") >= F.col("z_start")) & (F.col("z") < F.col("z_stop"))
        & (F.col("y") >= F.col("y_start")) & (F.col("y") < F.col("y_stop"))
        & (F.col("x") >= F.col("x_start")) & (F.col("x") < F.col("x_stop"))
    )
    return inside.groupBy(
        "session_id", "roi_id", (F.col("y") - F.col("y_start")).alias("y"), (F.col("x") - F.col("x_start")).alias("x")
    ).agg(F.max(value).alias("value"), F.bool_or(F.col("label") == F.col("roi_id")).alias("is_roi"))


def display_values(df: DataFrame, value: str, dark: float, floor: float = 0.0) -> DataFrame:
    """Dark-subtracted value for display, not below ``floor``."""
    return df.withColumn(value, F.greatest(F.col(value) - dark, F.lit(floor)))


def neighbour_slices(features: DataFrame, volumes: DataFrame) -> DataFrame:
    """The centroid plane of every region and the planes below and above, inside the stack."""
    centre = F.least(F.greatest(F.rint("centroid_z").cast("int"), F.lit(0)), F.col("nz") - 1)
    out = features.join(volumes, "session_id").withColumn("z_center", centre)
    return out.select(
        "session_id", "label", F.greatest(F.lit(0), F.col("z_center") - 1).alias("z_minus1"), "z_center",
        F.least(F.col("nz") - 1, F.col("z_center") + 1).alias("z_plus1"),
    )


def raw_geometry(features: DataFrame) -> DataFrame:
    """Rounded centre and extent of every region and session."""
    return features.select(
        "session_id", "label", *[F.rint(f"centroid_{c}").cast("int").alias(f"{c}_center") for c in ("z", "y", "x")],
        F.col("bbox_width_px").alias("width_px"), F.col("bbox_height_px").alias("height_px"),
    )


def group_geometry(
    features: DataFrame, groups: DataFrame, center_session: str, pad_xy: int = 20, min_size: int = 48,
) -> DataFrame:
    """Shared view of a group of regions: centred on one session, wide enough for all of them.

    ``groups`` has ``group_id`` and ``label``.
    """
    rows = features.join(groups, "label")
    centre = F.col("session_id") == center_session
    spans = rows.groupBy("group_id").agg(
        *[F.rint(F.avg(F.when(centre, F.rint(f"centroid_{c}")))).cast("int").alias(f"{c}_center") for c in ("z", "y", "x")],
        *[F.min(f"bbox_{c}0").alias(f"_{c}0") for c in ("y", "x")],
        *[(F.max(f"bbox_{c}1") - 1).alias(f"_{c}1") for c in ("y", "x")],
    )

    def extent(c: str) -> Column:
        half = F.greatest(F.col(f"{c}_center") - F.col(f"_{c}0"), F.col(f"_{c}1") - F.col(f"{c}_center")) + pad_xy
        return F.greatest(F.lit(min_size), 2 * half + 1)

    return spans.select(
        "group_id", "z_center", "y_center", "x_center", extent("x").alias("width_px"), extent("y").alias("height_px")
    )


def composite_rgb(df: DataFrame, red_max: float, green_max: float) -> DataFrame:
    """Red and green display intensities between 0 and 1."""
    def scaled(name: str, top: float) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(name) / top)) if top > 0 else F.lit(0.0)

    return df.withColumn("r", scaled("red", red_max)).withColumn("g", scaled("green", green_max)).withColumn("b", F.lit(0.0))


def plane_labels(voxels: DataFrame, plane: int | None, matched: int) -> DataFrame:
    """Labels in one plane, or in all if ``plane`` is None, split into the matched region (2) and its neighbours (1)."""
    shown = voxels if plane is None else voxels.where(F.col("z") == plane)
    return shown.withColumn("layer", F.when(F.col("label") == matched, 2).otherwise(1))


def display_planes(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plane to show for a track: the rounded median of its regions' centre planes."""
    return records.groupBy(*keys).agg(F.rint(F.median("center_plane")).cast("int").alias("display_plane"))


def track_crops(regions: DataFrame, keys: Sequence[str], ny: Column, nx: Column, pad_xy: int = 20) -> DataFrame:
    """Common crop of all regions of a track, padded and inside the image."""
    spans = regions.groupBy(*keys).agg(
        *[F.min(f"bbox_{c}0").alias(f"_{c}0") for c in ("y", "x")], *[F.max(f"bbox_{c}1").alias(f"_{c}1") for c in ("y", "x")]
    )
    return spans.select(
        *keys,
        *[F.greatest(F.lit(0), F.col(f"_{c}0") - pad_xy).alias(f"{c}_start") for c in ("y", "x")],
        *[F.least(n, F.col(f"_{c}1") + pad_xy).alias(f"{c}_stop") for c, n in (("y", ny), ("x", nx))],
    )


# --- projected shape ---------------------------------------------------------------------------

def _crofton_weights() -> list[float]:
    """Perimeter contribution of a 2x2 window by its filled corners, for four directions.

    Crossings of a horizontal or vertical line weigh a quarter turn; crossings of a diagonal,
    whose lines are closer together, a quarter turn over the square root of two.
    """
    straight, diagonal = math.pi / 4, math.pi / 4 / math.sqrt(2)
    weights = []
    for code in range(16):
        # Bits: 1 lower right, 2 upper right, 4 lower left, 8 upper left of the window.
        lr, ur, ll, ul = (code >> b & 1 for b in range(4))
        total = straight * (ul < ur) + straight * (ul < ll) + diagonal * (ul < lr) + diagonal * (ur < ll)
        weights.append(total)
    return weights


def projected_shape(voxels: DataFrame, by: Sequence[str] = ("session_id", "label")) -> DataFrame:
    """Area, perimeter, circularity, ellipse axes and spans of every region's projection along z.

    The perimeter sums a weight over all 2x2 pixel windows. Every pixel adds its bit to four windows,
    which is one more aggregation, not a per-region image.
    """
    by = list(by)
    pixels = materialise(voxels.groupBy(*by, "y", "x").agg(
        F.count(F.lit(1)).alias("_n"), F.min("z").alias("_z0"), F.max("z").alias("_z1")
    ))
    moments = pixels.groupBy(*by).agg(
        F.sum("_n").alias("voxel_count"),
        F.count(F.lit(1)).alias("proj_area_px"),
        F.var_pop("y").alias("_yy"), F.var_pop("x").alias("_xx"), F.covar_pop("y", "x").alias("_yx"),
        (F.max("_z1") - F.min("_z0") + 1).alias("z_span_px"),
        (F.max("y") - F.min("y") + 1).alias("y_span_px"),
        (F.max("x") - F.min("x") + 1).alias("x_span_px"),
    )
    corners = F.explode(F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(bit).alias("bit"))
        for dy, dx, bit in ((0, 0, 8), (0, 1, 4), (1, 0, 2), (1, 1, 1))
    ]))
    # A pixel at (y, x) is the lower right corner (bit 1) of the window that ends there, and so on.
    windows = pixels.select(*by, "y", "x", corners.alias("c")).groupBy(
        *by, (F.col("y") - F.col("c.dy")).alias("wy"), (F.col("x") - F.col("c.dx")).alias("wx")
    ).agg(F.sum("c.bit").alias("code"))
    weight = F.element_at(F.array(*[F.lit(w) for w in _crofton_weights()]), F.col("code").cast("int") + 1)
    perimeter = windows.groupBy(*by).agg(F.sum(weight).alias("proj_perimeter_px"))
    half = (F.col("_yy") + F.col("_xx")) / 2
    root = F.sqrt(F.pow((F.col("_yy") - F.col("_xx")) / 2, F.lit(2)) + F.col("_yx") * F.col("_yx"))
    big, small = half + root, F.greatest(half - root, F.lit(0.0))
    out = moments.join(perimeter, by).withColumn("_big", big).withColumn("_small", small)
    return out.withColumn(
        "circularity",
        F.when(F.col("proj_perimeter_px") > 0, 4 * math.pi * F.col("proj_area_px") / F.pow("proj_perimeter_px", F.lit(2))),
    ).withColumn(
        "eccentricity", F.when(F.col("_big") > 0, F.sqrt(1 - F.col("_small") / F.col("_big"))).otherwise(F.lit(0.0))
    ).withColumn(
        "axis_ratio", F.when(F.col("_small") > 1e-12, F.sqrt(F.col("_big") / F.col("_small")))
    ).withColumn("eq_diam_px", F.sqrt(4.0 * F.col("proj_area_px") / math.pi)).drop("_yy", "_xx", "_yx", "_big", "_small")


def size_units(sizes: DataFrame, xy_um: float, z_um: float) -> DataFrame:
    """Physical units beside the pixel measures."""
    return (
        sizes.withColumn("proj_area_um2", F.col("proj_area_px") * (xy_um * xy_um))
        .withColumn("eq_diam_um", F.col("eq_diam_px") * xy_um)
        .withColumn("z_span_um", F.col("z_span_px") * z_um)
    )
