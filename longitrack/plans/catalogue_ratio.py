"""Catalogue: intensity analysis, fits, trajectories, rankings and quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from longitrack.functions import labels
from longitrack.operators import fits as fit_ops, qc, ranking, ratio, sessions, trajectories, voxels as vox
from longitrack.operators.ordering import exact_quantiles
from longitrack.params import GeometryQC
from longitrack.plans import relations as rel
from longitrack.session import materialise


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column: floating sums depend on the order of addition."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else (F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c))
        for c, t in df.dtypes
    ])


# --- intensity analysis ---------------------------------------------------------------------

def dark_correction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratio.dark_correct(rel.roi_long(spark, sf), rel.DARK))


def pivot_channels_first(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rel.roi_day(spark, sf))


def complete_rois(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratio.complete_rois(rel.roi_day(spark, sf)))


def complete_rois_required_subset(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratio.complete_rois(rel.roi_day(spark, sf), [0, 2, 4]))


def log_ratio_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rel.metrics(spark, sf))


def day0_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratio.day0_normalised(rel.roi_day(spark, sf), "green"))


def roi_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratio.roi_summary(rel.metrics(spark, sf)))


def population_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratio.population_quartiles(rel.metrics(spark, sf)))


def event_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse series: user as object, day as session, mean value of views and clicks as red, of all others as green."""
    channel = F.when(F.col("event_type").isin("view", "click"), "red").otherwise("green")
    long = (
        rel.table(spark, sf, "events")
        .select(F.col("user_id").alias("roi_id"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day"),
                channel.alias("channel"), "value")
        .groupBy("roi_id", "day", "channel")
        .agg(F.avg("value").alias("mean_intensity"))
    )
    wide = ratio.pivot_channels(long, "mean_intensity")
    return rounded(ratio.log_ratio_metrics(wide, rel.EPSILON))


# --- fits -------------------------------------------------------------------------------------

FIT_COLUMNS = ["day", "n_rois", "slope", "intercept", "r_value", "r_squared", "slope_stderr", "intercept_stderr"]


def daily_linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fit_ops.daily_fits(rel.metrics(spark, sf)).select(*FIT_COLUMNS))


def fit_limits(spark: SparkSession, sf: str) -> DataFrame:
    """p-values and 95 % confidence limits of the daily fits."""
    return rounded(fit_ops.fit_intervals(fit_ops.daily_fits(rel.metrics(spark, sf))).select(
        "day", "n_rois", "p_value", "t_critical", "slope_ci_low", "slope_ci_high", "intercept_ci_low", "intercept_ci_high"))


def fit_residuals(spark: SparkSession, sf: str) -> DataFrame:
    m = materialise(rel.metrics(spark, sf))
    out = fit_ops.fit_residuals(m, fit_ops.daily_fits(m))
    return rounded(out.select(
        "roi_id", "day", "predicted_green_from_fit", "green_fit_residual", "green_fit_signed_distance",
        "delta_green_fit_residual", "delta_green_fit_signed_distance",
    ))


def residual_sign_changes(spark: SparkSession, sf: str) -> DataFrame:
    m = materialise(rel.metrics(spark, sf))
    return rounded(trajectories.residual_sign_changes(fit_ops.fit_residuals(m, fit_ops.daily_fits(m))))


def artifact_filter_refit(spark: SparkSession, sf: str) -> DataFrame:
    kept = fit_ops.drop_artifacts(rel.metrics(spark, sf), 60.0)
    return rounded(fit_ops.daily_fits(kept).select(*FIT_COLUMNS))


def mean_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fit_ops.mean_line(fit_ops.daily_fits(rel.metrics(spark, sf))))


def ci_band(spark: SparkSession, sf: str) -> DataFrame:
    """Band of half-width one standard error of the mean, on 200 points per day."""
    band = fit_ops.mean_band(fit_ops.daily_fits(rel.metrics(spark, sf)), F.lit(1.0))
    return rounded(band.select("day", "grid_index", "x", "y_hat", "y_low", "y_high"))


# --- trajectories -----------------------------------------------------------------------------

def trajectory_classes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trajectories.trajectory_classes(rel.metrics(spark, sf)))


# --- rankings ---------------------------------------------------------------------------------

RANK_COLUMNS = [
    "roi_id", "selection_rank", "min_delta_log2_green_over_red", "max_delta_log2_green_over_red",
    "delta_log2_range", "day0_brightness", "brightness_threshold", "selection_direction", "selection_metric_column",
]


def _top(spark: SparkSession, sf: str, direction: str) -> DataFrame:
    summary = ratio.roi_summary(rel.metrics(spark, sf))
    return ranking.top_changing(summary, direction, top_n=30, red_cv_max=0.35)


def top_decreasing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_top(spark, sf, "decreasing").select(*RANK_COLUMNS))


def top_increasing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_top(spark, sf, "increasing").select(*RANK_COLUMNS))


def ranked_roi_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.ranked_roi_days(rel.roi_day(spark, sf), _top(spark, sf, "decreasing"), 30, ["selection_rank"])
    return rounded(rows.select("roi_id", "day", "red", "green", "selection_rank"))


def ranked_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    m = materialise(rel.metrics(spark, sf))
    top = ranking.top_changing(ratio.roi_summary(m), "decreasing", top_n=30, red_cv_max=0.35)
    rows = ranking.ranked_roi_days(m, top, 30, ["selection_rank"])
    return rounded(ranking.ranked_heatmap(rows, "delta_log2_green_over_red", range(7)))


def random_sample_rois(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded sample of the red-stable candidates (NumPy generator, hence no SQL twin)."""
    summary = ratio.roi_summary(rel.metrics(spark, sf))
    return rounded(
        ranking.top_changing(summary, top_n=30, red_cv_max=0.35, random_sample=True, seed=0).select("roi_id", "selection_rank")
    )


# --- quality control --------------------------------------------------------------------------

def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Object sizes: part as object, its summed quantity as projected area."""
    return rel.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("roi_id")).agg(
        F.sum("l_quantity").alias("proj_area_px")
    )


def size_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(qc.size_bounds(_sizes(spark, sf)))


def size_filter(spark: SparkSession, sf: str) -> DataFrame:
    sizes = materialise(_sizes(spark, sf))
    return rounded(qc.within_size_bounds(sizes, qc.size_bounds(sizes)))


def display_range(spark: SparkSession, sf: str) -> DataFrame:
    """99.5 % upper display limit of the green value per day."""
    return rounded(exact_quantiles(rel.roi_day(spark, sf), "green", {"vmax": 0.995}, by=("day",)))


def shape_flags(spark: SparkSession, sf: str) -> DataFrame:
    li = rel.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("roi_id")).agg(
        (F.avg("l_discount") / 0.07).alias("circularity"),
        (1 - F.avg("l_tax") / 0.9).alias("solidity"),
        (F.max("l_quantity") / F.min("l_quantity")).alias("axis_ratio"),
    )
    li = li.select("roi_id", *[F.round(c, 6).alias(c) for c in ("circularity", "solidity", "axis_ratio")])
    return rounded(qc.shape_flags(li, min_solidity=0.95, max_axis_ratio=8.0))


def _geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Geometry rows: part and ship year; summed quantity as volume, line count as depth."""
    return (
        rel.table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("roi_id"), (F.year("l_shipdate") - rel.FIRST_YEAR).alias("session_index"))
        .agg(
            F.sum("l_quantity").alias("volume_um3"),
            F.count(F.lit(1)).alias("bbox_depth_planes"),
            (F.min("l_linenumber") == 1).alias("touches_z_edge"),
            (F.max("l_linenumber") == 7).alias("touches_xy_edge"),
            F.avg("l_quantity").alias("centroid_z_um"),
            (F.avg("l_extendedprice") / 1000).alias("centroid_y_um"),
            (F.avg("l_discount") * 100).alias("centroid_x_um"),
        )
        .withColumn("session_id", F.concat(F.lit("day"), F.col("session_index").cast("string")))
        .withColumn("required", F.col("session_index") != 3)
    )


GEOMETRY = GeometryQC(
    min_volume_um3=20.0, max_volume_um3=400.0, min_bbox_depth_planes=2, max_volume_ratio_from_track_median=2.0,
    exclude_xy_edge=True,
)


def geometry_qc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(qc.geometry_flags(_geometry(spark, sf), GEOMETRY).select(
        "roi_id", "session_index", "track_median_volume_um3", "volume_fold_change_to_track_median",
        "geometry_min_volume_pass", "geometry_max_volume_pass", "geometry_min_bbox_depth_pass",
        "geometry_xy_edge_pass", "geometry_volume_ratio_pass", "geometry_qc_pass",
    ))


def track_geometry_summary(spark: SparkSession, sf: str) -> DataFrame:
    flags = qc.geometry_flags(_geometry(spark, sf), GEOMETRY)
    return rounded(qc.track_geometry_summary(flags, GEOMETRY))


def centroid_steps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trajectories.centroid_steps(_geometry(spark, sf)).select(
        "roi_id", "session_index", "centroid_step_um_from_previous_observed_session"
    ))


def presence_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = rel.roi_day(spark, sf).withColumn("required", F.col("day") != 3)
    return rounded(qc.presence_summary(rows, [0, 1, 2, 4, 5, 6]))


def filter_funnel(spark: SparkSession, sf: str) -> DataFrame:
    tracks = qc.presence_summary(rel.roi_day(spark, sf).withColumn("required", F.lit(True)), range(7))
    present = F.col("n_required_sessions_present")
    return rounded(qc.funnel(tracks, {
        "all_tracks": F.lit(True),
        "at_least_two_sessions": present >= 2,
        "complete_required_sessions": F.col("all_required_sessions_present"),
        "one_internal_gap": (present == 6) & (F.col("missing_required_internal_days") == 1),
    }))


def green_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """20-bin histogram of the green mean between 0 and 140."""
    bins = F.width_bucket(F.col("green"), F.lit(0.0), F.lit(140.0), F.lit(20)).alias("bin")
    return rounded(rel.roi_channel_means(spark, sf).groupBy(bins).agg(F.count(F.lit(1)).alias("n")))


def display_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Red and green scaled to display range."""
    return rounded(vox.composite_rgb(rel.roi_channel_means(spark, sf), 40.0, 100.0))


def day_date_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label of every session day of every object."""
    days = rel.roi_channel_means(spark, sf).select("roi_id", "day", F.lit(3).alias("center"))
    return rounded(days.select(
        "roi_id", "day", labels.day_label("day", "20260511").alias("label"), labels.plane_label("day", "center").alias("plane")
    ))


def session_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sessions.session_similarity(rel.roi_day(spark, sf), "green"))


def session_medoid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sessions.medoid(sessions.session_similarity(rel.roi_day(spark, sf), "green")))


def object_components(spark: SparkSession, sf: str) -> DataFrame:
    """Share of variance per principal component of the log-ratio changes (no SQL twin)."""
    _, shares = sessions.object_components(rel.metrics(spark, sf), "delta_log2_green_over_red", range(7), 3)
    return rounded(spark.createDataFrame([(i + 1, v) for i, v in enumerate(shares)], "component int, explained_variance double"))


QUERIES = {
    f.__name__: f
    for f in (
        dark_correction, pivot_channels_first, complete_rois, complete_rois_required_subset, log_ratio_metrics,
        day0_normalized, roi_summary, population_quartiles, event_channels, daily_linear_fit, fit_limits, fit_residuals,
        residual_sign_changes, artifact_filter_refit, mean_line, ci_band, trajectory_classes, top_decreasing,
        top_increasing, ranked_roi_days, ranked_heatmap, random_sample_rois, size_bounds, size_filter, display_range,
        shape_flags, geometry_qc, track_geometry_summary, centroid_steps, presence_summary, filter_funnel,
        green_histogram, display_composite, day_date_labels, session_similarity, session_medoid, object_components,
    )
}
