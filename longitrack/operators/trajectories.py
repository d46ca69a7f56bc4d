"""Sign changes and trajectory classes of one object's time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from longitrack.operators.ratio import roi_window
from longitrack.params import TrajectoryParams


def _session_order(by: Sequence[str]) -> W:
    return W.partitionBy(*by, "roi_id").orderBy("day")


def residual_sign_changes(residuals: DataFrame, column: str = "green_fit_residual", by: Sequence[str] = ()) -> DataFrame:
    """Extremes, range and last value of the residuals, and how often their sign changes.

    A zero takes over the sign before it; leading zeros stay zero.
    """
    order = _session_order(by)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    sign = F.signum(column)
    carried = F.coalesce(F.last(F.when(sign != 0, sign), ignorenulls=True).over(upto), sign)
    marked = residuals.select(*by, "roi_id", "day", F.col(column).alias("_r"), carried.alias("_s"))
    marked = marked.withColumn("_turn", (F.col("_s") != F.lag("_s").over(order)).cast("int"))
    return marked.groupBy(*by, "roi_id").agg(
        F.min("_r").alias(f"min_{column}"),
        F.max("_r").alias(f"max_{column}"),
        (F.max("_r") - F.min("_r")).alias(f"{column}_range"),
        F.max_by("_r", "day").alias(f"last_{column}"),
        F.coalesce(F.sum("_turn"), F.lit(0)).alias(f"{column}_sign_change_count"),
    )


def trajectory_classes(
    metrics: DataFrame, column: str = "delta_log2_green_over_red", params: TrajectoryParams = TrajectoryParams(),
    by: Sequence[str] = (),
) -> DataFrame:
    """Stable, oscillatory, mostly_down or mostly_up, with the figures the class is based on."""
    order = _session_order(by)
    large = F.abs("_d") >= params.oscillation_abs
    sign = F.when(large, F.signum("_d"))
    before = F.last("_sign", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = (
        metrics.select(*by, "roi_id", "day", F.col(column).alias("_d"))
        .withColumn("_sign", sign)
        .withColumn("_turn", (F.col("_sign") != before).cast("int"))
    )
    whole = F.count("_d") == F.count(F.lit(1))
    figures = marked.groupBy(*by, "roi_id").agg(
        F.when(whole, F.max(F.abs("_d"))).alias("max_abs_delta_log2_green_over_red"),
        F.when(whole, F.min("_d")).alias("min_delta_log2_green_over_red"),
        F.when(whole, F.max("_d")).alias("max_delta_log2_green_over_red"),
        F.max_by("_d", "day").alias("final_delta_log2_green_over_red"),
        F.coalesce(F.sum("_turn"), F.lit(0)).alias("significant_sign_change_count"),
    )
    low, high = F.col("min_delta_log2_green_over_red"), F.col("max_delta_log2_green_over_red")
    final = F.col("final_delta_log2_green_over_red")
    swings = (
        (low <= -params.oscillation_abs)
        & (high >= params.oscillation_abs)
        & (F.col("significant_sign_change_count") >= 1)
    )
    down = (low <= -params.directional) & (final <= -params.return_abs) & (F.abs(low) >= high)
    up = (high >= params.directional) & (final >= params.return_abs) & (high >= F.abs(low))
    category = (
        F.when(F.col("max_abs_delta_log2_green_over_red") < params.stable_abs, "stable")
        .when(swings, "oscillatory")
        .when(down, "mostly_down")
        .when(up, "mostly_up")
        .otherwise("stable")
    )
    return figures.withColumn("trajectory_category", category)


def centroid_steps(geometry: DataFrame, by: Sequence[str] = (), order: str = "session_index") -> DataFrame:
    """Distance of each centroid from the one of the previous observed session of the same object."""
    w = W.partitionBy(*by, "roi_id").orderBy(order)
    square = None
    for axis in ("centroid_z_um", "centroid_y_um", "centroid_x_um"):
        step = F.col(axis) - F.lag(axis).over(w)
        square = step * step if square is None else square + step * step
    return geometry.withColumn("centroid_step_um_from_previous_observed_session", F.sqrt(square))


__all__ = ["residual_sign_changes", "trajectory_classes", "centroid_steps", "roi_window"]
