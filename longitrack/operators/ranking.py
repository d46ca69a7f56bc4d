"""Rankings, seeded samples and heatmap matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from longitrack.operators.ordering import exact_quantiles, global_rank
from longitrack.session import materialise


def changing_candidates(
    summary: DataFrame, red_cv_max: float = 0.10, brightness_quantile: float = 0.25,
    min_area: float | None = None, max_area: float | None = None,
) -> DataFrame:
    """Red-stable, bright objects with a positive first green value, with the brightness limit used."""
    summary = materialise(summary)
    limit = exact_quantiles(summary, "day0_brightness", {"q": brightness_quantile})
    rows = summary.withColumn("brightness_threshold", limit.select("q").scalar()).where(
        (F.col("red_cv") <= red_cv_max)
        & (F.col("day0_brightness") >= F.col("brightness_threshold"))
        & (F.col("day0_green") > 0)
    )
    if min_area is not None:
        rows = rows.where(F.col("proj_area_px") >= min_area)
    if max_area is not None:
        rows = rows.where(F.col("proj_area_px") <= max_area)
    return rows


def top_changing(
    summary: DataFrame, direction: str = "decreasing", top_n: int = 15, red_cv_max: float = 0.10,
    brightness_quantile: float = 0.25, min_area: float | None = None, max_area: float | None = None,
    random_sample: bool = False, seed: int = 0,
) -> DataFrame:
    """The ``top_n`` strongest losses or gains, or a seeded random sample of the same candidates."""
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    if direction not in ("decreasing", "increasing"):
        raise ValueError("direction must be decreasing or increasing")
    rows = changing_candidates(summary, red_cv_max, brightness_quantile, min_area, max_area)
    metric = "min_delta_log2_green_over_red" if direction == "decreasing" else "max_delta_log2_green_over_red"
    if random_sample:
        chosen = seeded_sample(rows, [F.col("roi_id")], top_n, seed, out="selection_rank")
        metric = "random_sample"
    else:
        first = F.col(metric).asc_nulls_last() if direction == "decreasing" else F.col(metric).desc_nulls_last()
        order = [first, F.col("delta_log2_range").desc_nulls_last(), F.col("day0_brightness").desc_nulls_last(), F.col("roi_id")]
        # The window sees the top_n rows of the limit only.
        chosen = rows.orderBy(*order).limit(top_n).withColumn("selection_rank", F.row_number().over(W.orderBy(*order)))
    return (
        chosen.withColumn("selection_direction", F.lit(direction))
        .withColumn("selection_metric_column", F.lit(metric))
        .withColumn("selection_random_seed", F.lit(seed if random_sample else None).cast("int"))
    )


def seeded_sample(df: DataFrame, order: Sequence, size: int, seed: int, out: str = "sample_rank") -> DataFrame:
    """``size`` rows drawn without replacement by a seeded NumPy generator over the sorted positions.

    Only the row count and the ``size`` drawn positions pass through the driver.
    """
    ranked = materialise(global_rank(df, order, out="_position"))
    n = ranked.count()
    rng = np.random.default_rng(int(seed))
    drawn = rng.choice(n, size=min(size, n), replace=False) if n else np.empty(0, dtype=int)
    drawn = drawn[rng.permutation(len(drawn))]
    wanted = ranked.sparkSession.createDataFrame(
        [(int(p) + 1, i + 1) for i, p in enumerate(drawn)], f"_position long, {out} int"
    )
    return ranked.join(wanted, "_position").drop("_position")


def ranked_roi_days(roi_day: DataFrame, ranking: DataFrame, top_n: int, columns: Sequence[str]) -> DataFrame:
    """All days of the ``top_n`` ranked objects with the ranking columns attached."""
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    top = ranking.orderBy("selection_rank").limit(top_n).select("roi_id", *columns)
    return roi_day.join(materialise(top), "roi_id")


def ranked_heatmap(ranked: DataFrame, value: str, days: Sequence[int]) -> DataFrame:
    """One row per ranked object, labelled ``rank:object``, and one column per day."""
    label = F.concat(F.lpad(F.col("selection_rank").cast("string"), 2, "0"), F.lit(":"), F.col("roi_id").cast("string"))
    label = F.when(F.col("selection_rank") > 99, F.concat_ws(":", "selection_rank", "roi_id")).otherwise(label)
    return ranked.groupBy(label.alias("row_label")).agg(
        *[F.first(F.when(F.col("day") == d, F.col(value)), ignorenulls=True).alias(f"day_{d}") for d in days]
    )
