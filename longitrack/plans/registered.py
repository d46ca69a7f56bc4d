"""Registered-space pipeline: one mask, all days registered to it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from longitrack.operators import fits as fit_ops, hull, qc, ranking, ratio, trajectories, voxels as vox
from longitrack.params import RatioParams
from longitrack.sources import listing, tiff
from longitrack.sources.sinks import Store, StageTimer, write_json


def size_table(voxels: DataFrame, xy_um: float = 0.693, z_um: float = 5.0) -> DataFrame:
    """Size and shape of every region's projection, in pixels and micrometres."""
    shape = vox.size_units(vox.projected_shape(voxels, ["label"]), xy_um, z_um)
    return shape.join(hull.solidity(voxels, ["label"]).select("label", "solidity"), "label").withColumnRenamed("label", "roi_id")


def run_registered(
    spark: SparkSession, dataset_dir: str | Path, mask_name: str, out_dir: str | Path, start_date: str | None = None,
    params: RatioParams = RatioParams(), xy_um: float = 0.693, z_um: float = 5.0, csv: bool = False,
) -> Store:
    """Measure all regions of one mask on every registered day and write the analysis tables."""
    folder, store, timer = Path(dataset_dir), Store(spark, out_dir, csv), StageTimer()
    parsed = listing.parse_names(listing.list_files(spark, str(folder)))
    start_date = start_date or listing.start_date(parsed).first()[0]
    lookup = store.write("registered_files", listing.registered_lookup(parsed, start_date, "raw"))
    missing = listing.missing_channels(lookup).limit(10).collect()
    if missing:
        raise FileNotFoundError(f"missing registered files: {[(r.day, r.channel) for r in missing]}")
    names: dict[int, dict] = {}
    for r in lookup.collect():
        names.setdefault(r.day, {})[r.channel] = str(folder / r["name"])
    specs = [{"session_id": str(d), "mask": str(folder / mask_name), **files} for d, files in sorted(names.items())]
    means = vox.label_means(tiff.read_voxels(spark, specs))
    raw = store.write("intensity_raw", means.select(
        F.col("label").alias("roi_id"), F.col("session_id").cast("int").alias("day"), "channel", "mean_intensity"
    ))
    corrected = store.write("intensity_dark_corrected", ratio.dark_correct(raw, {"red": params.red_dark, "green": params.green_dark}))
    complete = store.write("roi_day_complete", ratio.complete_rois(ratio.pivot_channels(corrected)))
    metrics = store.write("log_ratio_metrics", ratio.log_ratio_metrics(complete, params.epsilon))
    timer.done("intensities")

    mask = store.write("mask_voxels", tiff.read_voxels(spark, [{"session_id": "mask", "mask": str(folder / mask_name)}]))
    sizes = store.write("sizes", size_table(mask, xy_um, z_um))
    bounds = store.write("size_bounds", qc.size_bounds(sizes))
    area, low, high = F.col("proj_area_px"), bounds.select("lower_bound").scalar(), bounds.select("upper_bound").scalar()
    flagged = store.write("sizes_with_qc", qc.shape_flags(sizes.withColumn("size_qc_pass", (area >= low) & (area <= high))))
    both = metrics.join(flagged, "roi_id")
    store.write("metrics_size_filtered", both.where("size_qc_pass"))
    kept = store.write("metrics_size_shape_filtered", both.where(F.col("size_qc_pass") & F.col("shape_qc_pass")))
    timer.done("shape")

    summary = store.write("roi_summary", ratio.roi_summary(kept).join(flagged, "roi_id", "left"))
    fits = store.write("daily_fits", fit_ops.fit_intervals(fit_ops.daily_fits(kept)))
    residuals = store.write("fit_residuals", fit_ops.fit_residuals(kept, fits))
    store.write("residual_sign_changes", trajectories.residual_sign_changes(residuals))
    store.write("trajectory_classes", trajectories.trajectory_classes(kept))
    store.write("population_quartiles", ratio.population_quartiles(kept))
    state = flagged.select("roi_id", "size_qc_pass", "shape_qc_pass").join(
        complete.select("roi_id", F.lit(True).alias("complete")).distinct(), "roi_id", "left"
    )
    done = F.col("complete")
    store.write("filter_counts", qc.funnel(state, {
        "mask_rois": F.lit(True), "complete_days": done, "size_filtered": done & F.col("size_qc_pass"),
        "size_shape_filtered": done & F.col("size_qc_pass") & F.col("shape_qc_pass"),
    }))
    days = sorted(names)
    for direction in ("decreasing", "increasing"):
        top = store.write(f"top_{direction}", ranking.top_changing(
            summary, direction, params.top_n, params.red_cv_max, params.brightness_quantile
        ))
        ranked = store.write(f"top_{direction}_days", ranking.ranked_roi_days(residuals, top, params.top_n, ["selection_rank"]))
        for value in ("log2_green_over_red", "delta_log2_green_over_red", "delta_green_fit_residual"):
            store.write(f"heatmap_{direction}_{value}", ranking.ranked_heatmap(ranked, value, days))
    timer.done("summaries")
    write_json(store.path("run_log.json"), {"start_date": start_date, "params": params, **timer.record()})
    return store
