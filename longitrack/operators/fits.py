"""Per-day straight-line fits of green on red, their residuals and confidence bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from longitrack.functions.student import critical_value, two_sided_p
from longitrack.operators.ratio import baseline, finite
from longitrack.session import materialise


def daily_fits(metrics: DataFrame, x: str = "red", y: str = "green", by: Sequence[str] = ("day",)) -> DataFrame:
    """Least squares per ``by`` group: a single partially aggregated pass over the rows.

    Rows with a missing or infinite value are skipped; a group with fewer than two rows, or
    with a constant ``x``, is an error.
    """
    pairs = metrics.select(*by, finite(x).alias("_x"), finite(y).alias("_y"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    sums = pairs.groupBy(*by).agg(
        F.count(F.when(both, 1)).alias("n_rois"),
        F.regr_avgx("_y", "_x").alias("x_mean"),
        F.regr_avgy("_y", "_x").alias("y_mean"),
        F.regr_sxx("_y", "_x").alias("sxx"),
        F.regr_syy("_y", "_x").alias("syy"),
        F.regr_sxy("_y", "_x").alias("sxy"),
        F.min(F.when(both, F.col("_x"))).alias("x_min"),
        F.max(F.when(both, F.col("_x"))).alias("x_max"),
    )
    sxx = (
        F.when(F.col("n_rois") < 2, F.raise_error(F.lit("a day has fewer than 2 valid rows")).cast("double"))
        .when(F.col("sxx") == 0, F.raise_error(F.lit("cannot fit a line: all x values are identical")).cast("double"))
        .otherwise(F.col("sxx"))
    )
    r = F.when(F.col("syy") == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))))
    )
    df = F.col("n_rois") - 2
    stderr = F.when(df > 0, F.sqrt((1 - F.col("r_value") * F.col("r_value")) * F.col("syy") / F.col("sxx") / df)).otherwise(
        F.lit(0.0)
    )
    return (
        sums.withColumn("sxx", sxx)
        .withColumn("slope", F.col("sxy") / F.col("sxx"))
        .withColumn("intercept", F.col("y_mean") - F.col("slope") * F.col("x_mean"))
        .withColumn("r_value", r)
        .withColumn("r_squared", F.col("r_value") * F.col("r_value"))
        .withColumn("slope_stderr", stderr)
        .withColumn(
            "intercept_stderr",
            F.col("slope_stderr") * F.sqrt(F.col("sxx") / F.col("n_rois") + F.col("x_mean") * F.col("x_mean")),
        )
    )


def fit_intervals(fits: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add ``p_value``, ``t_critical`` and confidence limits, as expressions of every fit's own row.

    With two rows the p-value is 1 for a flat line and else 0, and there are no limits.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie in (0, 1)")
    degrees, r = F.col("n_rois") - 2, F.col("r_value")
    t = F.when(F.abs(r) >= 1, float("inf")).otherwise(r * F.sqrt(degrees / ((1 - r) * (1 + r))))
    p = F.when(degrees > 0, two_sided_p(t, degrees)).when(r == 0, 1.0).otherwise(0.0)
    # Written once: the limits read the critical value four times.
    out = materialise(fits.withColumn("p_value", p).withColumn("t_critical", critical_value(degrees, alpha)))
    for c in ("slope", "intercept"):
        half = F.col("t_critical") * F.col(f"{c}_stderr")
        out = out.withColumn(f"{c}_ci_low", F.col(c) - half).withColumn(f"{c}_ci_high", F.col(c) + half)
    return out


def mean_band(fits: DataFrame, t_critical: Column, points: int = 200) -> DataFrame:
    """Fitted line and confidence band of the mean on ``points`` equally spaced x positions."""
    grid = fits.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn(
        "x", F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("grid_index") / (points - 1)
    ).withColumn("y_hat", F.col("intercept") + F.col("slope") * F.col("x"))
    df = F.col("n_rois") - 2
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / df)
    offset = F.col("x") - F.col("x_mean")
    half = t_critical * spread * F.sqrt(1 / F.col("n_rois") + offset * offset / F.col("sxx"))
    half = F.when(df > 0, half)
    return grid.withColumn("y_low", F.col("y_hat") - half).withColumn("y_high", F.col("y_hat") + half)


def fit_residuals(
    metrics: DataFrame, fits: DataFrame, x: str = "red", y: str = "green",
    on: Sequence[str] = ("day",), by: Sequence[str] = (),
) -> DataFrame:
    """Vertical and perpendicular deviation from the day's line, and their change from the first value.

    The fit table has one row per session. It is written first, so Spark broadcasts it when its
    real size allows and joins by key otherwise. A day without a fit is an error.
    """
    lines = materialise(fits.select(*on, "slope", "intercept"))
    joined = metrics.join(lines, list(on), "left")
    slope = F.when(F.col("slope").isNull(), F.raise_error(F.lit("a day has no fit")).cast("double")).otherwise(F.col("slope"))
    out = (
        joined.withColumn("slope", slope)
        .withColumn("predicted_green_from_fit", F.col("intercept") + F.col("slope") * F.col(x))
        .withColumn("green_fit_residual", F.col(y) - F.col("predicted_green_from_fit"))
        .withColumn(
            "green_fit_signed_distance", F.col("green_fit_residual") / F.sqrt(1 + F.col("slope") * F.col("slope"))
        )
    )
    for column in ("green_fit_residual", "green_fit_signed_distance"):
        out = out.withColumn(f"day0_{column}", baseline(column, by)).withColumn(
            f"delta_{column}", F.col(column) - F.col(f"day0_{column}")
        )
    return out


def drop_artifacts(metrics: DataFrame, threshold: float = 1500.0) -> DataFrame:
    """Keep rows with two finite channels and a green value up to ``threshold``."""
    return metrics.where(
        finite("red").isNotNull() & finite("green").isNotNull() & (F.col("green") <= float(threshold))
    )


def mean_line(fits: DataFrame) -> DataFrame:
    """Average slope and intercept over the days."""
    return fits.agg(F.avg("slope").alias("mean_slope"), F.avg("intercept").alias("mean_intercept"))
