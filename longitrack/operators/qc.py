"""Size, shape and geometry quality control, presence summaries and filter funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longitrack.operators.ordering import exact_quantiles
from longitrack.params import GeometryQC
from longitrack.session import materialise


def size_bounds(sizes: DataFrame, column: str = "proj_area_px", lower: float = 0.05, iqr_factor: float = 1.5) -> DataFrame:
    """One row: lower quantile, quartiles, and the upper limit q3 + factor * (q3 - q1)."""
    if not 0.0 <= lower <= 1.0 or iqr_factor < 0:
        raise ValueError("lower must lie in [0, 1] and iqr_factor must be nonnegative")
    q = exact_quantiles(sizes, column, {"lower_bound": lower, "q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("iqr", iqr).withColumn("upper_bound", F.col("q3") + iqr_factor * F.col("iqr"))


def within_size_bounds(sizes: DataFrame, bounds: DataFrame, column: str = "proj_area_px") -> DataFrame:
    """Rows whose size lies within the bounds, both included."""
    bounds = materialise(bounds)
    return sizes.where(
        (F.col(column) >= bounds.select("lower_bound").scalar()) & (F.col(column) <= bounds.select("upper_bound").scalar())
    )


def shape_flags(
    sizes: DataFrame, min_circularity: float = 0.65, min_solidity: float = 0.80, max_axis_ratio: float = 2.0,
) -> DataFrame:
    """Add ``shape_qc_pass``."""
    if min_circularity < 0 or min_solidity < 0 or max_axis_ratio <= 0:
        raise ValueError("shape limits must be nonnegative and the axis ratio positive")
    passed = (
        (F.col("circularity") >= min_circularity)
        & (F.col("solidity") >= min_solidity)
        & (F.col("axis_ratio") <= max_axis_ratio)
    )
    return sizes.withColumn("shape_qc_pass", F.coalesce(passed, F.lit(False)))


def geometry_flags(geometry: DataFrame, qc: GeometryQC = GeometryQC(), by: Sequence[str] = ()) -> DataFrame:
    """Volume relative to the track's median volume, and one pass flag per rule.

    Without any configured rule all flags are NULL and the status is ``not_configured``. The
    median runs over the sessions of one track.
    """
    track = W.partitionBy(*by, "roi_id")
    ratio = F.col("volume_ratio_to_track_median")
    out = (
        geometry.withColumn("track_median_volume_um3", F.median("volume_um3").over(track))
        .withColumn("volume_ratio_to_track_median", F.try_divide("volume_um3", "track_median_volume_um3"))
        .withColumn("volume_fold_change_to_track_median", F.greatest(ratio, F.try_divide(F.lit(1.0), ratio)))
        .withColumn("segmentation_qc_status", F.lit("configured" if qc.configured else "not_configured"))
    )

    def rule(condition: Column | None) -> Column:
        if not qc.configured:
            return F.lit(None).cast("boolean")
        return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))

    def limit(column: str, bound: float | None, upper: bool) -> Column | None:
        if bound is None:
            return None
        return F.col(column) <= bound if upper else F.col(column) >= bound

    rules = {
        "geometry_min_volume_pass": limit("volume_um3", qc.min_volume_um3, False),
        "geometry_max_volume_pass": limit("volume_um3", qc.max_volume_um3, True),
        "geometry_min_bbox_depth_pass": limit("bbox_depth_planes", qc.min_bbox_depth_planes, False),
        "geometry_max_bbox_depth_pass": limit("bbox_depth_planes", qc.max_bbox_depth_planes, True),
        "geometry_xy_edge_pass": ~F.col("touches_xy_edge") if qc.exclude_xy_edge else None,
        "geometry_z_edge_pass": ~F.col("touches_z_edge") if qc.exclude_z_edge else None,
        "geometry_volume_ratio_pass": limit(
            "volume_fold_change_to_track_median", qc.max_volume_ratio_from_track_median, True
        ),
    }
    every = F.lit(True)
    for name, condition in rules.items():
        out = out.withColumn(name, rule(condition))
        every = every & F.col(name)
    return out.withColumn("geometry_qc_pass", every if qc.configured else F.lit(None).cast("boolean"))


def track_geometry_summary(geometry: DataFrame, qc: GeometryQC = GeometryQC(), by: Sequence[str] = ()) -> DataFrame:
    """Per track: geometry passes on required sessions, edge contacts and volume spread."""
    required = F.col("required")
    touching = F.coalesce(F.col("touches_xy_edge"), F.lit(False)) | F.coalesce(F.col("touches_z_edge"), F.lit(False))
    summary = geometry.groupBy(*by, "roi_id").agg(
        F.first("segmentation_qc_status").alias("segmentation_qc_status"),
        F.size(F.collect_set(F.when(required, F.col("session_id")))).cast("long").alias("n_required_sessions"),
        F.count(F.when(required & F.col("geometry_qc_pass"), 1)).alias("n_geometry_qc_pass"),
        F.count(F.when(touching, 1)).alias("n_edge_sessions"),
        F.count("volume_um3").alias("_n"),
        F.median("volume_um3").alias("track_median_volume_um3"),
        F.min("volume_um3").alias("min_volume_um3"),
        F.max("volume_um3").alias("max_volume_um3"),
    )
    fraction = F.try_divide(F.col("n_geometry_qc_pass"), F.col("n_required_sessions"))
    if qc.mode == "fraction":
        passed = F.coalesce(F.col("segmentation_qc_pass_fraction") >= qc.min_pass_fraction, F.lit(False))
    else:
        passed = (F.col("n_required_sessions") > 0) & (F.col("n_geometry_qc_pass") == F.col("n_required_sessions"))
    spread = F.when(
        (F.col("_n") >= 2) & (F.col("min_volume_um3") > 0), F.col("max_volume_um3") / F.col("min_volume_um3")
    )
    return (
        summary.withColumn("segmentation_qc_pass_fraction", fraction)
        .withColumn(
            "segmentation_qc_pass_all_required_days", F.when(F.col("segmentation_qc_status") == "configured", passed)
        )
        .withColumn("max_volume_fold_change", spread)
        .drop("_n")
    )


def presence_summary(roi_day: DataFrame, required_days: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Per object: required days present, missing, and missing between the first and last present one."""
    days = [int(d) for d in required_days]
    valid = roi_day.where(F.col("red").isNotNull() & F.col("green").isNotNull())
    position = F.array_position(F.array(*[F.lit(d) for d in days]), F.col("day").cast("int")) if days else F.lit(0)
    position = F.when(F.col("required") & (position > 0), position)
    present = F.size(F.collect_set("_p"))
    summary = valid.withColumn("_p", position).groupBy(*by, "roi_id").agg(
        present.cast("long").alias("n_required_sessions_present"),
        (F.lit(len(days)) - present).cast("long").alias("n_required_sessions_missing"),
        F.coalesce(F.max("_p") - F.min("_p") + 1 - present, F.lit(0)).cast("long").alias("missing_required_internal_days"),
    )
    return summary.withColumn("all_required_sessions_present", F.col("n_required_sessions_missing") == 0).withColumn(
        "exactly_one_required_session_missing", F.col("n_required_sessions_missing") == 1
    )


def funnel(df: DataFrame, steps: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Counts of the rows passing each named step, with percentages of the first and the previous step.

    All steps are counted in one pass; the window then sees one row per step.
    """
    by = list(by)
    counts = df.groupBy(*by).agg(*[F.count(F.when(c, 1)).alias(name) for name, c in steps.items()])
    rows = F.array(*[
        F.struct(F.lit(i).alias("step_order"), F.lit(name).alias("step"), F.col(name).alias("count"))
        for i, name in enumerate(steps)
    ])
    long = counts.select(*by, F.explode(rows).alias("s")).select(*by, "s.*")
    order = W.partitionBy(*by).orderBy("step_order")
    start = F.first("count").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    previous = F.coalesce(F.lag("count").over(order), F.col("count"))

    def percent(base: Column) -> Column:
        return F.when(base > 0, 100.0 * F.col("count") / base).otherwise(F.lit(0.0))

    return long.withColumn("pct_of_start", percent(start)).withColumn("pct_of_previous", percent(previous))


def merge_reasons(existing: Column, additions: dict[str, Column]) -> Column:
    """Comma-joined review reasons: the existing ones, then each new one whose condition holds."""
    trimmed = F.transform(F.split(F.coalesce(existing, F.lit("")), ","), lambda r: F.trim(r))
    old = F.filter(trimmed, lambda r: r != "")
    new = F.array(*[F.when(c, F.lit(name)) for name, c in additions.items()])
    fresh = F.filter(new, lambda r: r.isNotNull() & ~F.array_contains(old, r))
    return F.array_join(F.concat(old, fresh), ",")


def legacy_flags(tracks: DataFrame, low_confidence: float = 0.55) -> DataFrame:
    """Review flags of the weekly matcher's tracks."""
    names = ("low_confidence", "gap_bridge_qc", "edge_qc", "fragmented_track_qc")
    out = (
        tracks.withColumn("low_confidence", F.col("min_confidence") < low_confidence)
        .withColumn("gap_bridge_qc", F.coalesce(F.col("used_gap_bridge"), F.lit(False)))
        .withColumn("edge_qc", F.coalesce(F.col("any_edge_roi"), F.lit(False)))
        .withColumn("fragmented_track_qc", F.coalesce(F.col("missing_intermediate_days"), F.lit(0)) > 0)
    )
    review = F.lit(False)
    for name in names:
        review = review | F.col(name)
    return out.withColumn("needs_review", review)
