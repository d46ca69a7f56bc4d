"""Two-channel intensity analysis: dark values, channel pivot, completeness, log ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def finite(column: str | Column) -> Column:
    """NULL for NaN and for both infinities, so that missing values are always NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def dark_correct(
    long: DataFrame, dark: dict[str, float], value: str = "mean_intensity",
    out: str = "mean_intensity_corrected", floor: float | None = None,
) -> DataFrame:
    """Subtract the dark value of the row's channel; an unknown channel is an error."""
    level = F.raise_error(F.concat(F.lit("unsupported channel: "), F.col("channel"))).cast("double")
    for channel, offset in dark.items():
        level = F.when(F.col("channel") == channel, F.lit(float(offset))).otherwise(level)
    level = F.when(F.col("channel").isNotNull(), level)
    corrected = F.col(value).cast("double") - F.col("dark_value")
    if floor is not None:
        corrected = F.greatest(corrected, F.lit(float(floor)))
    return long.withColumn("dark_value", level).withColumn(out, corrected)


def pivot_channels(
    long: DataFrame, value: str = "mean_intensity_corrected", keys: Sequence[str] = ("roi_id", "day"),
    channels: Sequence[str] = ("red", "green"),
) -> DataFrame:
    """One row per key with one column per channel; keys without any value disappear."""
    rows = long.withColumn("_v", F.when(~F.isnan(value), F.col(value))).where(F.col("_v").isNotNull())
    return rows.groupBy(*keys).agg(
        *[F.first(F.when(F.col("channel") == c, F.col("_v")), ignorenulls=True).alias(c) for c in channels]
    )


def complete_rois(
    wide: DataFrame, required_days: Sequence[int] | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Rows with both channels, of objects that have both channels on every required day.

    Valid rows on further days are kept. Without ``required_days`` every day seen in a valid row
    (of the same ``by`` group) is required. A window holds the days of one object only, and it shares
    its partitioning with the windows of the steps that follow.
    """
    by = list(by)
    valid = wide.where(F.col("red").isNotNull() & F.col("green").isNotNull())
    per_roi = W.partitionBy(*by, "roi_id")
    if required_days is not None:
        days = sorted({int(d) for d in required_days})
        seen = F.size(F.collect_set(F.when(F.col("day").isin(days), F.col("day"))).over(per_roi))
        return valid.withColumn("_seen", seen).where(F.col("_seen") == len(days)).drop("_seen")
    counted = valid.withColumn("_seen", F.size(F.collect_set("day").over(per_roi)))
    if by:
        needed = valid.groupBy(*by).agg(F.size(F.collect_set("day")).alias("_need"))
        counted = counted.join(needed, by)
    else:
        needed = valid.agg(F.size(F.collect_set("day")).alias("_need"))
        counted = counted.withColumn("_need", needed.select("_need").scalar())
    return counted.where(F.col("_seen") == F.col("_need")).drop("_seen", "_need")


def roi_window(by: Sequence[str] = ()) -> W:
    """All observations of one object in session order; a group is bounded by the number of sessions."""
    return W.partitionBy(*by, "roi_id").orderBy("day").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def baseline(column: str, by: Sequence[str] = ()) -> Column:
    """The object's first non-missing value in session order."""
    return F.first(column, ignorenulls=True).over(roi_window(by))


def log_ratio_metrics(wide: DataFrame, epsilon: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Brightness, green fraction, log2((green+e)/(red+e)), its first value and the change from it."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    numerator, denominator = F.col("green") + epsilon, F.col("red") + epsilon
    ratio = F.when(denominator != 0, numerator / denominator)
    log2 = F.when(ratio == 0, F.lit(float("-inf"))).when(ratio > 0, F.log2(ratio))
    return (
        wide.withColumn("brightness", F.col("red") + F.col("green"))
        .withColumn("green_fraction", F.when(F.col("brightness") > 0, F.col("green") / F.col("brightness")))
        .withColumn("log2_green_over_red", log2)
        .withColumn("day0_log2_green_over_red", baseline("log2_green_over_red", by))
        .withColumn("delta_log2_green_over_red", F.col("log2_green_over_red") - F.col("day0_log2_green_over_red"))
    )


def day0_normalised(wide: DataFrame, column: str, out: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``column`` divided by the object's first non-missing value; missing where that is not positive."""
    out = out or f"{column}_day0_normalized"
    first = f"day0_{column}"
    return wide.withColumn(first, baseline(column, by)).withColumn(
        out, F.when(F.col(first) > 0, F.col(column) / F.col(first))
    )


def roi_summary(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per object: first-day values, variation, extreme and last change.

    A missing change makes the extremes of its object missing, and the day of the minimum is then
    the first day without a value.
    """
    delta = "delta_log2_green_over_red"

    def first(column: str) -> Column:
        return F.min_by(column, "day")

    def whole(aggregate: Column) -> Column:
        return F.when(F.count(delta) == F.count(F.lit(1)), aggregate)

    def variation(column: str) -> Column:
        mean = F.avg(column)
        return F.when(F.abs(mean) > 1e-8, F.stddev_pop(column) / mean).alias(f"{column}_cv")

    return metrics.groupBy(*by, "roi_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        first("red").alias("day0_red"),
        first("green").alias("day0_green"),
        first("brightness").alias("day0_brightness"),
        first("log2_green_over_red").alias("day0_log2_green_over_red"),
        variation("red"),
        variation("green"),
        variation("brightness"),
        whole(F.min(delta)).alias("min_delta_log2_green_over_red"),
        F.min_by("day", F.struct(F.col(delta), F.col("day"))).alias("day_of_min_delta"),
        whole(F.max(delta)).alias("max_delta_log2_green_over_red"),
        whole(F.max(delta) - F.min(delta)).alias("delta_log2_range"),
        F.max_by(delta, "day").alias("day_last_delta_log2_green_over_red"),
    )


def population_quartiles(metrics: DataFrame) -> DataFrame:
    """Per day: median and quartiles of the log ratio, its change and the green fraction."""
    from longitrack.operators.ordering import exact_quantiles

    columns = {
        "raw_log2": "log2_green_over_red",
        "delta_log2": "delta_log2_green_over_red",
        "green_fraction": "green_fraction",
    }
    long = metrics.select(
        "day", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(v).alias("v")) for k, v in columns.items()])).alias("m")
    ).select("day", "m.metric", "m.v")
    quartiles = exact_quantiles(long, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75}, by=("day", "metric"))
    return quartiles.groupBy("day").agg(
        *[
            F.max(F.when(F.col("metric") == k, F.col(q))).alias(f"{k}_{q}")
            for k in columns
            for q in ("median", "q25", "q75")
        ]
    )
