"""Weekly pipeline: tracks over weekly masks, measured on every day of their week."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from longitrack.operators import assignment, legacy, qc, registration, tracks, voxels as vox
from longitrack.operators.ordering import global_rank
from longitrack.operators.review import pair_diagnostics
from longitrack.params import LegacyParams, RatioParams
from longitrack.plans.daywise import analyse, pair_schedule
from longitrack.sources import listing, manifest as man, tiff
from longitrack.sources.sinks import Store, StageTimer, write_json

PAIR = ["day_a", "day_b"]
MASK_TEMPLATE = "{week_name}_average_cp_masks.tif"


def match_weeks(
    spark: SparkSession, sessions: list[man.Session], store: Store, params: LegacyParams = LegacyParams(), use_shift: bool = True,
) -> DataFrame:
    """The weekly matcher over label volumes: records, candidates, reciprocal matches, tracks and flags."""
    specs = man.volume_specs(sessions)
    voxels = store.write("voxels", tiff.read_voxels(spark, specs))
    volumes = store.write("volumes", tiff.read_volumes(spark, specs))
    pairs = pair_schedule(spark, sessions, 2)
    records = store.write("roi_records", legacy.records(voxels, volumes, params))
    if use_shift:
        found = registration.xy_shifts(vox.occupancy_projection(voxels), volumes, pairs, legacy_reach=params.max_shift)
        found = store.write("correlation_shifts", found)
        shifts = registration.legacy_shift(records, found, params.max_dist_xy, params.max_dist_z)
    else:
        shifts = pairs.select(*PAIR, F.lit(0.0).alias("shift_y"), F.lit(0.0).alias("shift_x"))
    shifts = store.write("shifts", shifts)
    candidates = store.write("candidates", legacy.scored_pairs(records, shifts, params))
    matches = store.write("matches", assignment.reciprocal_best(candidates).join(pairs, PAIR), ("day_a", "day_b"))
    counts = candidates.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("candidate_pairs"))
    store.write("pair_summary", shifts.join(counts, PAIR, "left").join(pair_diagnostics(matches, PAIR, ("dxy", "dz")), PAIR, "left"))
    nodes, links = tracks.legacy_tracks(matches, len(sessions), params.min_gap_support)
    index = spark.createDataFrame([(s.session_id, s.session_index) for s in sessions], "session_id string, session_index int")
    placed = records.join(index, "session_id").select("session_index", "label", "is_edge")
    alone = placed.select("session_index", "label").join(nodes, ["session_index", "label"], "left_anti")
    nodes = store.write("track_nodes", nodes.unionByName(
        alone.withColumn("head_session", F.col("session_index")).withColumn("head_label", F.col("label"))
    ))
    table = tracks.legacy_track_table(nodes, links)
    edges = nodes.join(placed, ["session_index", "label"]).groupBy("head_session", "head_label").agg(
        F.bool_or("is_edge").alias("any_edge_roi")
    )
    table = table.join(edges, ["head_session", "head_label"], "left")
    order = [F.desc("n_days_present"), F.desc("mean_confidence"), F.asc("signature")]
    table = store.write("tracks", qc.legacy_flags(global_rank(table, order, out="cluster_id"), params.low_confidence))
    store.write("track_lengths", tracks.length_thresholds(table))
    wide = nodes.groupBy("head_session", "head_label").agg(*[
        F.max(F.when(F.col("session_index") == s.session_index, F.col("label"))).alias(f"{s.session_id}_roi") for s in sessions
    ])
    return store.write("tracks_wide", table.join(wide, ["head_session", "head_label"]))


def week_columns(columns: list[str]) -> list[str]:
    """Week names of a wide match table, in week order."""
    found = [m.group(1) for c in columns if (m := re.fullmatch(r"(week\d+)_roi", c))]
    if not found:
        raise ValueError("the match table has no week columns such as week1_roi")
    return sorted(found, key=lambda w: int(w.removeprefix("week")))


def week_mask(folder: Path, week: str, template: str = MASK_TEMPLATE) -> Path:
    """Mask file of a week; a singular or plural ``mask`` in the name are both accepted."""
    first = folder / template.format(week_name=week)
    name = first.name
    other = name.replace("_masks", "_mask") if "_masks" in name else name.replace("_mask", "_masks")
    for path in (first, folder / other):
        if path.exists():
            return path
    raise FileNotFoundError(f"no mask for {week}: {first}")


def run_weekly(
    spark: SparkSession, dataset_dir: str | Path, matches: DataFrame, out_dir: str | Path, start_date: str | None = None,
    params: RatioParams = RatioParams(), mask_template: str = MASK_TEMPLATE, csv: bool = False,
) -> Store:
    """Measure weekly tracks. ``matches`` is the wide table: ``cluster_id`` and one column per week."""
    folder, store, timer = Path(dataset_dir), Store(spark, out_dir, csv), StageTimer()
    parsed = listing.parse_names(listing.list_files(spark, str(folder)))
    start_date = start_date or listing.start_date(parsed).first()[0]
    lookup = store.write("registered_files", listing.registered_lookup(parsed, start_date, "syn"))
    missing = listing.missing_channels(lookup).limit(10).collect()
    if missing:
        raise FileNotFoundError(f"missing registered files: {[(r.day, r.channel) for r in missing]}")
    weeks = week_columns(matches.columns)
    # File names and week buckets number in days, so the driver may plan the reads.
    groups = listing.calendar_weeks(lookup).orderBy("week_start").collect()
    if len(groups) != len(weeks):
        raise ValueError(f"{len(weeks)} matched weeks but {len(groups)} calendar weeks")
    names = {(r.day, r.channel): r["name"] for r in lookup.collect()}
    specs, assignments = [], []
    for week, group in zip(weeks, groups):
        mask = week_mask(folder, week, mask_template)
        for day, key in zip(group.days, group.date_keys):
            specs.append({"session_id": str(day), "mask": str(mask), **{c: str(folder / names[day, c]) for c in ("red", "green")}})
            assignments.append((week, str(group.week_start), int(day), key, mask.name))
    assigned = store.write("week_assignments", spark.createDataFrame(
        assignments, "week_name string, week_start string, day int, date string, mask_name string"
    ))
    long = matches.unpivot(["cluster_id"], [f"{w}_roi" for w in weeks], "week_name", "week_roi_id")
    long = long.where(F.col("week_roi_id").isNotNull()).select(
        F.col("cluster_id").alias("roi_id"), F.regexp_replace("week_name", "_roi$", "").alias("week_name"),
        F.col("week_roi_id").cast("int").alias("label"),
    )
    twice = long.groupBy("week_name", "label").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"objects used by two clusters: {[(r.week_name, r.label) for r in twice]}")
    means = vox.label_means(tiff.read_voxels(spark, specs)).withColumn("day", F.col("session_id").cast("int"))
    raw = store.write("intensity_raw", means.join(assigned, "day").join(long, ["week_name", "label"]).drop("session_id"))
    timer.done("intensities")
    days = [a[2] for a in assignments]
    parts = analyse(raw, days, params, ["roi_id", "day"], [], store)
    observed = matches.select(F.col("cluster_id").alias("roi_id")).distinct()
    observed = observed.join(raw.select("roi_id", F.lit(True).alias("seen")).distinct(), "roi_id", "left").join(
        parts["complete"].select("roi_id", F.lit(True).alias("complete")).distinct(), "roi_id", "left"
    )
    store.write("filter_counts", qc.funnel(observed, {
        "matcher_clusters": F.lit(True), "observed_after_zero_filter": F.col("seen"), "complete_days": F.col("complete"),
    }))
    timer.done("analysis")
    write_json(store.path("run_log.json"), {"start_date": start_date, "params": params, **timer.record()})
    return store
