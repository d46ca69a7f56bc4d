"""Catalogue: voxel operators, shapes, crops, registration, the weekly matcher's records and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from longitrack.operators import assignment, hull, legacy, registration, review, voxels as vox
from longitrack.params import LegacyParams, OverlapParams, Spacing
from longitrack.plans import relations as rel
from longitrack.plans.catalogue_ratio import rounded
from longitrack.session import materialise
from longitrack.sources import listing, manifest

UNIT = Spacing(5.0, 0.7, 0.7)


def _pairs(spark: SparkSession, z: float = 0.0, y: float = 0.0, x: float = 0.0) -> DataFrame:
    return spark.createDataFrame(
        [("a", "b", z, y, x)], "day_a string, day_b string, shift_z double, shift_y double, shift_x double"
    )


def roi_features(spark: SparkSession, sf: str) -> DataFrame:
    v = rel.grid_voxels(spark, sf)
    return rounded(vox.region_features(v, rel.volume_sizes(v, 16, 128), UNIT))


def mask_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions without background or foreground (none here) beside the number checked."""
    v = rel.grid_voxels(spark, sf)
    bad = vox.invalid_masks(v, rel.volume_sizes(v, 16, 128))
    return rounded(bad.agg(F.count(F.lit(1)).alias("n_invalid")))


def label_mean_zero_excluded(spark: SparkSession, sf: str) -> DataFrame:
    v = rel.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("label"), (F.sum("l_tax") / 0.7).alias("red"), (F.sum("l_discount") / 0.7).alias("green")
    )
    return rounded(vox.label_means(v, by=()))


def _overlap(spark: SparkSession, sf: str, pairs: DataFrame) -> DataFrame:
    v = rel.grid_voxels(spark, sf)
    areas = v.groupBy("session_id", "label").agg(F.count(F.lit(1)).alias("area_voxels"))
    return rounded(vox.shifted_overlap(v, areas, pairs))


def overlap_dice_iou(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap(spark, sf, _pairs(spark))


def shifted_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap(spark, sf, _pairs(spark, 0.4, 1.6, -0.5))


def occupancy_projection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vox.occupancy_projection(rel.block_voxels(spark, sf)))


def z_shift_xcorr(spark: SparkSession, sf: str) -> DataFrame:
    v = rel.plane_voxels(spark, sf)
    sizes = v.select("session_id").distinct().select("session_id", F.lit(16).alias("nz"))
    return rounded(vox.z_shifts(vox.z_profiles(v, sizes), _pairs(spark)))


def projected_shape(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vox.size_units(vox.projected_shape(rel.block_voxels(spark, sf)), 0.7, 5.0))


def projected_solidity(spark: SparkSession, sf: str) -> DataFrame:
    """Convex hull per region (no SQL twin; checked on small fixtures)."""
    return rounded(hull.solidity(rel.block_voxels(spark, sf)))


# --- crops --------------------------------------------------------------------------------------

def _block(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = rel.block_voxels(spark, sf)
    sizes = rel.volume_sizes(v, 4, 64)
    return v, sizes, vox.region_features(v, sizes, UNIT)


def center_crop(spark: SparkSession, sf: str) -> DataFrame:
    v, sizes, _ = _block(spark, sf)
    return rounded(vox.center_crop(v, sizes, 33, 5).select("session_id", "z", "y", "x", "label"))


def roi_crop_bounds(spark: SparkSession, sf: str) -> DataFrame:
    _, sizes, features = _block(spark, sf)
    return rounded(vox.roi_crops(features, sizes, 3, 20, 1))


def fixed_crop_bounds(spark: SparkSession, sf: str) -> DataFrame:
    _, _, features = _block(spark, sf)
    start, stop = vox.fixed_crop(F.col("centroid_y"), 24, F.lit(64))
    return rounded(features.select("label", start.alias("y_start"), stop.alias("y_stop")))


def crop_projection(spark: SparkSession, sf: str) -> DataFrame:
    v, sizes, features = _block(spark, sf)
    shown = vox.display_values(v, "red", 1000.0)
    return rounded(vox.crop_projection(shown, vox.roi_crops(features, sizes, 2, 12), "red").drop("session_id"))


def neighbour_slices(spark: SparkSession, sf: str) -> DataFrame:
    _, sizes, features = _block(spark, sf)
    return rounded(vox.neighbour_slices(features, sizes).drop("session_id"))


def raw_space_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vox.raw_geometry(_block(spark, sf)[2]).drop("session_id"))


def group_geometry(spark: SparkSession, sf: str) -> DataFrame:
    features = _block(spark, sf)[2]
    groups = features.select("label", (F.floor((F.col("label") - 1) / 8)).alias("group_id"))
    return rounded(vox.group_geometry(features, groups, "f", 2, 8))


# --- registration -------------------------------------------------------------------------------

def restricted_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Transform fit with trimming; a pair of sessions is a return flag and a line status."""
    c = F.col
    seeds = rel.table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("day_a"), c("l_linestatus").alias("day_b"),
        c("l_linenumber").cast("double").alias("zb"), c("l_quantity").alias("yb"), (c("l_suppkey") % 97).cast("double").alias("xb"),
        (1.02 * c("l_linenumber") + 0.3 + c("l_tax")).alias("za"),
        (0.98 * c("l_quantity") + 0.05 * (c("l_suppkey") % 97) + 2 + 20 * c("l_discount")).alias("ya"),
        (1.01 * (c("l_suppkey") % 97) - 0.03 * c("l_quantity") - 1 + 30 * c("l_tax")).alias("xa"),
    )
    shifts = seeds.select("day_a", "day_b").distinct().select(
        "day_a", "day_b", *[F.lit(0.0).alias(f"shift_{x}") for x in ("z", "y", "x")]
    )
    out = registration.restricted_transforms(seeds, shifts, OverlapParams(max_residual_um=2.4), Spacing(1.0, 1.0, 1.0))
    return rounded(out.select(
        "day_a", "day_b", *registration.COEFFICIENTS, "method", "n_seed", "n_inlier", "residual_median_um", "residual_p95_um"
    ), 5)


def xy_phase_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-pixel in-plane shift of every image of 64 x 64 pixels from FFT correlation (no SQL twin; checked on small fixtures).

    The second session is the first one moved by two lines around the border.
    """
    field = F.floor(F.col("x") / 64).cast("string")
    tiles = rel.block_voxels(spark, sf).withColumn("session_id", F.concat(F.lit("a"), field)).withColumn("x", F.col("x") % 64)
    moved = tiles.withColumn("session_id", F.translate("session_id", "a", "b")).withColumn("y", (F.col("y") + 2) % 64)
    v = tiles.unionByName(moved)
    projection = materialise(vox.occupancy_projection(v))
    sizes = projection.select("session_id").distinct().select("session_id", F.lit(64).alias("ny"), F.lit(64).alias("nx"))
    pairs = tiles.select(F.col("session_id").alias("day_a"), F.translate("session_id", "a", "b").alias("day_b")).distinct()
    return rounded(registration.xy_shifts(projection, sizes, materialise(pairs)))


def legacy_shift_support(spark: SparkSession, sf: str) -> DataFrame:
    pts = rel.points(spark, sf)
    name = F.concat(F.lit("f"), F.col("field_id").cast("string"), F.lit("s"), F.col("session_index").cast("string"))
    records = pts.select(
        name.alias("session_id"), "label", (F.col("z_um") / 5).alias("centroid_z"), F.col("y_um").alias("centroid_y"),
        F.col("x_um").alias("centroid_x"),
    )
    steps = pts.select("field_id", "session_index").distinct().where(F.col("session_index") < rel.SESSIONS - 1)
    field = F.concat(F.lit("f"), F.col("field_id").cast("string"), F.lit("s"))
    pairs = steps.select(
        F.concat(field, F.col("session_index").cast("string")).alias("day_a"),
        F.concat(field, (F.col("session_index") + 1).cast("string")).alias("day_b"),
        F.lit(1.5).alias("shift_y"), F.lit(-0.5).alias("shift_x"),
    )
    return rounded(registration.legacy_shift(materialise(records), materialise(pairs)))


# --- weekly matcher -----------------------------------------------------------------------------

def _two_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of :func:`block_voxels` in two sessions; a third of the pending orders counts as finished in the second."""
    k = F.col("o_orderkey")
    y, x = (F.floor(k / 4) % 64).cast("int"), F.floor(k / 256).cast("int")
    session = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("session_id")
    joins = (F.col("session_id") == "b") & (F.col("o_orderstatus") == "P") & (k % 3 == 0)
    return rel.table(spark, sf, "orders").select("*", session).select(
        "session_id", (k % 4).cast("int").alias("z"), y.alias("y"), x.alias("x"),
        rel.block_label(y, x, F.when(joins, 0).otherwise(rel.status_code())).alias("label"),
    )


LEGACY = LegacyParams(patch_radius=4, edge_margin=6, max_dist_xy=5.0, max_dist_z=2.0, min_score=0.30)


def legacy_records(spark: SparkSession, sf: str) -> DataFrame:
    v = _two_weeks(spark, sf)
    out = legacy.records(v, rel.volume_sizes(v, 4, 64), LEGACY)
    return rounded(out.select(
        "session_id", "label", "centroid_z", "centroid_y", "centroid_x", "center_plane", "area_center", "area_total",
        "dist_to_edge", "is_edge", F.size("patch").alias("n_patch"), F.size("canvas").alias("n_canvas"),
        F.get("radial_profile", F.lit(0)).alias("ring0"), F.get("radial_profile", F.lit(5)).alias("ring5"),
    ))


def legacy_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = _two_weeks(spark, sf)
    table = materialise(legacy.records(v, rel.volume_sizes(v, 4, 64), LEGACY))
    return rounded(legacy.scored_pairs(table, _pairs(spark, 0.0, 0.5, 0.25), LEGACY).drop("day_a", "day_b"))


def legacy_match_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted weekly matches with their distances in pixels and micrometres."""
    v = _two_weeks(spark, sf)
    table = materialise(legacy.records(v, rel.volume_sizes(v, 4, 64), LEGACY))
    matches = assignment.reciprocal_best(legacy.scored_pairs(table, _pairs(spark, 0.0, 0.5, 0.25), LEGACY))
    return rounded(review.match_distances(matches, [], 0.7, 5.0))


def track_display(spark: SparkSession, sf: str) -> DataFrame:
    """Display plane and common crop of the regions with the same label in both sessions."""
    v = _two_weeks(spark, sf)
    sizes = rel.volume_sizes(v, 4, 64)
    records = legacy.records(v, sizes, LEGACY)
    crops = vox.track_crops(vox.region_features(v, sizes, UNIT), ["label"], F.lit(64), F.lit(10**6), 3)
    return rounded(vox.display_planes(records, ["label"]).join(crops, "label"))


def plane_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels in every plane, the matched region apart from its neighbours."""
    return rounded(vox.plane_labels(rel.block_voxels(spark, sf), None, 9).select("z", "y", "x", "label", "layer"))


# --- listings and manifests ---------------------------------------------------------------------

def _files(spark: SparkSession, sf: str) -> DataFrame:
    """File names spelled out from the order dates, with every kind of token the parser knows."""
    k = F.col("o_orderkey")
    tokens = F.element_at(
        F.array(*[F.lit(t) for t in ("", "_SyN", "_crop_256_SyN", "_SyN_crop", "_ROI_mask_SyN_inversed", "_cp_masks")]),
        (k % 6 + 1).cast("int"),
    )
    channel = F.when(F.col("o_custkey") % 3 == 0, "G").otherwise("R")
    return rel.table(spark, sf, "orders").select(
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), channel, tokens, F.lit(".tif")).alias("name")
    )


def filename_listing_parse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(listing.parse_names(_files(spark, sf)).groupBy("date_key", "channel", "is_syn").agg(F.count(F.lit(1)).alias("n")))


def infer_start_date(spark: SparkSession, sf: str) -> DataFrame:
    return listing.start_date(listing.parse_names(_files(spark, sf)))


def registered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(listing.registered_lookup(listing.parse_names(_files(spark, sf)), "19960101", "raw"))


def raw_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(listing.raw_lookup(listing.parse_names(_files(spark, sf)), "19960101"))


def inverse_mask_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(listing.inverse_masks(_files(spark, sf).distinct(), "19950101", channel="red"))


def missing_channels(spark: SparkSession, sf: str) -> DataFrame:
    lookup = listing.registered_lookup(listing.parse_names(_files(spark, sf)), "19960101", "syn")
    return rounded(listing.missing_channels(lookup))


def week_buckets(spark: SparkSession, sf: str) -> DataFrame:
    lookup = listing.registered_lookup(listing.parse_names(_files(spark, sf)), "19960101", "syn")
    weeks = listing.calendar_weeks(lookup)
    return rounded(weeks.select(
        F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), F.size("days").alias("n_days"),
        F.array_join("days", ",").alias("days"), F.array_join("date_keys", ",").alias("date_keys"),
    ))


def elapsed_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = rel.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("required"))
    return rounded(manifest.elapsed_since_first(rows, "o_orderdate").select("o_orderkey", "elapsed_days"))


def manifest_order_check(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders numbered by key, where the number breaks off or the date goes back."""
    rows = rel.table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("session_index")).agg(
        F.min(F.to_date("o_orderdate")).alias("first_date")
    ).withColumn("session_index", F.col("session_index") - 1995)
    bad = manifest.ordering_violations(rows, "session_index", "first_date", ["o_custkey"])
    return rounded(bad.select("o_custkey", "session_index"))


QUERIES = {
    f.__name__: f
    for f in (
        roi_features, mask_validation, label_mean_zero_excluded, overlap_dice_iou, shifted_overlap, occupancy_projection,
        z_shift_xcorr, projected_shape, projected_solidity, center_crop, roi_crop_bounds, fixed_crop_bounds, crop_projection,
        neighbour_slices, raw_space_geometry, group_geometry, restricted_transform, xy_phase_shift, legacy_shift_support,
        legacy_records, legacy_candidates, legacy_match_distances, track_display, plane_labels, filename_listing_parse, infer_start_date, registered_lookup, raw_lookup,
        inverse_mask_lookup, missing_channels, week_buckets, elapsed_days, manifest_order_check,
    )
}
