"""Daywise pipeline: match labelled sessions, build tracks, measure and analyse them.

Every step treats all session pairs and all policies at once; pair and policy are key columns. The
tables that several later steps read are written once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from longitrack.operators import assignment, candidates as cand, graph, qc, ratio, registration, review, tracks, trajectories, voxels as vox
from longitrack.operators.checks import checked_join
from longitrack.operators.fits import daily_fits, fit_intervals, fit_residuals
from longitrack.params import GeometryQC, GraphParams, OverlapParams, RatioParams, Spacing, resolve_policies
from longitrack.session import materialise
from longitrack.sources import manifest as man, tiff
from longitrack.sources.sinks import Store, StageTimer, digest, file_digests, plain, read_json, same_run, write_json

PAIR = ["day_a", "day_b"]
KEYS = [*PAIR, "label_a", "label_b"]
POLICY = ["match_policy"]


def pair_schedule(spark: SparkSession, sessions: Sequence[man.Session], max_pair_gap: int) -> DataFrame:
    """Session pairs up to ``max_pair_gap`` sessions apart."""
    if isinstance(max_pair_gap, bool) or not isinstance(max_pair_gap, int) or max_pair_gap not in (1, 2):
        raise ValueError("max_pair_gap must be 1 or 2")
    ids = [s.session_id for s in sessions]
    rows = [
        (ids[i], ids[j], j - i, i, j) for i in range(len(ids)) for j in range(i + 1, min(i + max_pair_gap, len(ids) - 1) + 1)
    ]
    return spark.createDataFrame(rows, "day_a string, day_b string, pair_gap int, index_a int, index_b int")


def pair_sides(
    features: DataFrame, pairs: DataFrame, transforms: DataFrame, spacing: Spacing,
) -> tuple[DataFrame, DataFrame]:
    """Aligned physical centroids of both sessions of every pair."""
    identity = {"a0": 0.0, "a1": 1.0, "b0": 0.0, "b1": 1.0, "b2": 0.0, "c0": 0.0, "c1": 0.0, "c2": 1.0}
    own = pairs.select(*PAIR)
    a = own.join(features, F.col("day_a") == F.col("session_id"))
    for name, value in identity.items():
        a = a.withColumn(name, F.lit(value))
    coefficients = transforms.select(*PAIR, *identity)
    b = own.join(coefficients, PAIR).join(features, F.col("day_b") == F.col("session_id"))
    columns = [*PAIR, "label", "z_um", "y_um", "x_um", "area_voxels"]
    return tuple(cand.apply_transform(side, spacing).select(*columns) for side in (a, b))


def renewed(store: Store, name: str, df: DataFrame, kept: Column | None) -> DataFrame:
    """Write a table of the run and return the rows of ``df`` as written.

    With ``kept`` the stored rows that fulfil it stay, and ``df`` takes the place of the others.
    """
    if kept is None:
        return store.write(name, df)
    fresh = materialise(df)
    store.write(name, materialise(store.read(name).where(kept).unionByName(fresh)))
    return fresh


def match_sessions(
    spark: SparkSession, sessions: Sequence[man.Session], store: Store, overlap: OverlapParams = OverlapParams(),
    spacing: Spacing = Spacing(), max_pair_gap: int = 2, timer: StageTimer | None = None, digests: dict[str, str] | None = None,
    changed: Sequence[str] | None = None,
) -> int:
    """Features, shifts, transforms, candidates and greedy matches; returns the number of session pairs computed.

    With ``changed``, the tables of an earlier run with the same parameters are brought up to date: only those
    sessions are read, and only pairs with one of them are computed again.
    """
    timer, digests = timer or StageTimer(), digests or {}
    stale = None if changed is None else [s.session_id for s in sessions if s.session_id in set(changed)]
    specs = [s for s in man.volume_specs(list(sessions)) if stale is None or s["session_id"] in stale]
    pairs = store.write("pairs", pair_schedule(spark, sessions, max_pair_gap))
    kept_session = kept_pair = None
    if stale is not None:
        kept_session = ~F.col("session_id").isin(stale)
        kept_pair = ~(F.col("day_a").isin(stale) | F.col("day_b").isin(stale))
        pairs = pairs.where(~kept_pair)
    voxels = tiff.read_voxels(spark, specs, columns=tiff.MASK_COLUMNS)
    voxels = store.write("voxels", voxels, ("session_id",)) if stale is None else materialise(voxels)
    volumes = renewed(store, "volumes", tiff.read_volumes(spark, specs), kept_session)
    bad = vox.invalid_masks(voxels, volumes)
    if not bad.isEmpty():
        raise ValueError(f"masks need background and regions: {[r[0] for r in bad.limit(10).collect()]}")
    index = spark.createDataFrame(
        [(s.session_id, s.session_index, s.required) for s in sessions],
        "session_id string, session_index int, required boolean",
    )
    features = renewed(
        store, "roi_features", vox.region_features(voxels, volumes, spacing).join(index, "session_id"), kept_session)
    if stale is not None:
        voxels = store.replace_partitions("voxels", voxels, ("session_id",))
        volumes, features = store.read("volumes"), store.read("roi_features")
        # The other session of a pair is read back from its table, not from its stack.
        ends = sorted({end for r in pairs.select(*PAIR).collect() for end in r})
        voxels = voxels.where(F.col("session_id").isin(ends))
    timer.done("features")

    z = vox.z_shifts(vox.z_profiles(voxels, volumes), pairs)
    xy = registration.xy_shifts(vox.occupancy_projection(voxels), volumes, pairs, overlap)
    shifts = renewed(store, "shifts", z.join(xy, PAIR), kept_pair)
    overlaps = renewed(store, "overlaps", vox.shifted_overlap(voxels, features, shifts), kept_pair)
    timer.done("overlaps")

    mutual = renewed(store, "mutual_overlaps", assignment.mutual_best_overlap(overlaps, PAIR), kept_pair)
    seeds = mutual.where(F.col("dice") >= overlap.seed_min_dice).select(*KEYS)
    for side in ("a", "b"):
        seeds = seeds.join(
            features.select(F.col("session_id").alias(f"day_{side}"), F.col("label").alias(f"label_{side}"),
                            *[F.col(f"centroid_{c}").alias(f"{c}{side}") for c in ("z", "y", "x")]),
            [f"day_{side}", f"label_{side}"],
        )
    transforms = renewed(store, "transforms", registration.restricted_transforms(seeds, shifts, overlap, spacing), kept_pair)
    timer.done("transforms")

    side_a, side_b = pair_sides(features, pairs, transforms, spacing)
    candidates = renewed(store, "candidates", cand.candidate_pairs(side_a, side_b, overlaps, overlap), kept_pair)
    matches = None
    for policy in ("high", "balanced"):
        part = assignment.greedy_one_to_one(candidates, f"{policy}_rule").withColumn("match_policy", F.lit(policy))
        matches = part if matches is None else matches.unionByName(part)
    renewed(store, "affine_matches", matches, kept_pair)
    known = spark.createDataFrame(
        [(s.session_id, digests.get(s.session_id)) for s in sessions], "session_id string, mask_sha256 string")
    origin = pairs.select(*PAIR)
    for side in ("a", "b"):
        origin = origin.join(
            known.select(F.col("session_id").alias(f"day_{side}"), F.col("mask_sha256").alias(f"mask_{side}_sha256")), f"day_{side}")
    origin = origin.withColumn("computed_at", F.lit(datetime.now(timezone.utc)).cast("timestamp"))
    computed = renewed(store, "pair_provenance", origin, kept_pair).count()
    timer.done("matches")
    return computed


def link_sessions(
    spark: SparkSession, sessions: Sequence[man.Session], store: Store, policies: Sequence[str] = ("high", "balanced"),
    overlap: OverlapParams = OverlapParams(), graph_params: GraphParams = GraphParams(), spacing: Spacing = Spacing(),
    timer: StageTimer | None = None,
) -> None:
    """Graph matches where asked for, tracks and cycle tables, all from the stored tables of :func:`match_sessions`."""
    timer = timer or StageTimer()
    pairs, features, transforms, candidates, matches = (
        store.read(name) for name in ("pairs", "roi_features", "transforms", "candidates", "affine_matches"))
    fit = transforms.select(
        *PAIR, F.col("method").alias("transform_method"), F.col("fallback_reason").alias("transform_fallback_reason"),
        F.col("residual_median_um").alias("transform_residual_median_um"),
        F.col("residual_p95_um").alias("transform_residual_p95_um"),
    )
    described = matches.join(fit, PAIR)
    if "graph" in policies:
        side_a, side_b = pair_sides(features, pairs, transforms, spacing)
        high, balanced = (matches.where(F.col("match_policy") == p) for p in ("high", "balanced"))
        anchors = store.write("graph_anchors", graph.graph_anchors(high, graph_params))
        scored = store.write("graph_candidates", graph.graph_scores(candidates, anchors, side_a, side_b, graph_params))
        chosen = store.write("graph_matches", graph.graph_assignment(scored, fallback=balanced))
        store.write("graph_match_changes", graph.compare_matches(balanced, chosen))
        # Graph matches stem from the candidate table; only pairs without anchors carry a transform.
        own = chosen.join(fit, PAIR)
        for c in fit.columns[2:]:
            own = own.withColumn(c, F.when(F.col("assignment_source") == "baseline_fallback", F.col(c)))
        described = described.unionByName(own.select(*described.columns))
    wanted = described.where(F.col("match_policy").isin(list(policies))).join(pairs, PAIR)
    wanted = store.write("pairwise_matches", wanted, ("match_policy",))
    timer.done("policies")

    nodes = features.select("session_index", "label").withColumn("match_policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    track_nodes, decisions = tracks.build_tracks(nodes, wanted, len(sessions), POLICY)
    track_nodes = store.write("track_nodes", track_nodes)
    decisions = store.write("track_edges", decisions)
    names = F.element_at(F.array(*[F.lit(s.session_id) for s in sessions]), F.col("session_index") + 1)
    checks = tracks.cycle_checks(wanted, POLICY)
    triplets = spark.createDataFrame(
        [(p, i) for p in policies for i in range(len(sessions) - 2)], "match_policy string, index_a int"
    )
    store.write("cycle_summary", tracks.cycle_summary(checks, wanted, triplets, POLICY))
    detail = store.write("cycle_edge_checks", tracks.cycle_detail(checks))
    table = tracks.track_table(track_nodes, decisions, names, POLICY)
    table = tracks.add_cycle_metadata(table, track_nodes, detail, POLICY)
    table = store.write("tracks", tracks.cluster_ids(table, POLICY))
    wide = tracks.wide_tracks(track_nodes, {s.session_index: s.session_id for s in sessions}, POLICY)
    store.write("tracks_wide", table.join(wide, [*POLICY, "track_session", "track_label"]))
    store.write("track_lengths", tracks.track_lengths(table, POLICY))
    overlaps, mutual, shifts = (store.read(name) for name in ("overlaps", "mutual_overlaps", "shifts"))
    store.write("pairwise_summary", pair_report(pairs, features, overlaps, mutual, shifts, transforms, wanted, overlap))
    timer.done("tracks")


def pair_report(
    pairs: DataFrame, features: DataFrame, overlaps: DataFrame, mutual: DataFrame, shifts: DataFrame, transforms: DataFrame,
    matches: DataFrame, overlap: OverlapParams,
) -> DataFrame:
    """Counts and quality figures per pair of sessions."""
    def count(df: DataFrame, name: str, *more) -> DataFrame:
        return df.groupBy(*PAIR).agg(F.count(F.lit(1)).alias(name), *more)

    out = pairs.join(shifts, PAIR, "left")
    sizes = features.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    for side in ("a", "b"):
        out = out.join(
            sizes.select(F.col("session_id").alias(f"day_{side}"), F.col("n").alias(f"n_{side}")), f"day_{side}", "left"
        )
    seeds = F.count(F.when(F.col("dice") >= overlap.seed_min_dice, 1)).alias("n_seed")
    out = out.join(count(overlaps, "n_overlap_pairs"), PAIR, "left").join(count(mutual, "n_mutual_overlap", seeds), PAIR, "left")
    yields = matches.groupBy(*PAIR).agg(*[
        F.count(F.when(F.col("match_policy") == p, 1)).alias(f"n_{p}") for p in ("high", "balanced", "graph")
    ])
    out = out.join(yields, PAIR, "left").join(
        transforms.select(*PAIR, F.col("method").alias("transform_method"), F.col("fallback_reason").alias("transform_fallback_reason"),
                          F.col("n_inlier").alias("n_transform_fit"), F.col("residual_median_um").alias("transform_residual_median_um"),
                          F.col("residual_p95_um").alias("transform_residual_p95_um")),
        PAIR, "left",
    )
    counts = [c for c in out.columns if c.startswith("n_")]
    out = out.na.fill(0, counts)
    smaller = F.least("n_a", "n_b")
    for p in ("high", "balanced", "graph"):
        out = out.withColumn(f"{p}_frac_smaller", F.col(f"n_{p}") / smaller)
    return out.withColumn(
        "refinement_method", F.when(F.col("transform_method") == "restricted_affine", "affine").otherwise("translation_only")
    )


def run_matching(
    spark: SparkSession, manifest_path: str | Path, out_dir: str | Path, policies: Sequence[str] = ("high", "balanced"),
    overlap: OverlapParams = OverlapParams(), graph_params: GraphParams = GraphParams(), spacing: Spacing = Spacing(),
    max_pair_gap: int = 2, resume: bool = False, overwrite: bool = False, csv: bool = False,
) -> Store:
    """Match all sessions of a manifest and write the run's tables.

    A finished run with the same inputs and parameters is reused with ``resume``; another run in the
    same folder is an error unless ``overwrite`` is set. With both, a run with the same manifest and matching
    parameters is brought up to date: only sessions whose mask changed are read, and only their pairs matched.
    """
    policies = resolve_policies(policies)
    sessions = man.load_manifest(manifest_path)
    pair_schedule(spark, sessions, max_pair_gap)
    store = Store(spark, out_dir, csv)
    digests = file_digests(spark, {s.session_id: s.mask_path for s in sessions})
    fingerprint = {
        "manifest": digest(manifest_path), "masks": digests, "overlap": overlap, "graph": graph_params, "spacing": spacing,
        "max_pair_gap": max_pair_gap, "policies": policies,
    }
    log = Path(store.path("run_log.json"))
    changed = None
    if log.exists():
        if resume and same_run(log, fingerprint):
            return store
        if not overwrite:
            raise FileExistsError(f"{out_dir} holds another run")
        before = read_json(log).get("fingerprint", {})
        if resume and all(before.get(k) == plain(fingerprint[k]) for k in ("manifest", "overlap", "spacing", "max_pair_gap")):
            changed = [i for i, found in digests.items() if before.get("masks", {}).get(i) != found]
        # Without its record the folder holds no finished run until the new tables are written.
        log.unlink()
    timer = StageTimer()
    store.write("manifest", man.manifest_frame(spark, sessions))
    computed = 0
    if changed is None or changed:
        computed = match_sessions(spark, sessions, store, overlap, spacing, max_pair_gap, timer, digests, changed)
    link_sessions(spark, sessions, store, policies, overlap, graph_params, spacing, timer)
    record_run(store, sessions, {"fingerprint": fingerprint, "pairs_computed": computed, **timer.record()})
    return store


def refine_matching(
    spark: SparkSession, manifest_path: str | Path, match_dir: str | Path, graph_params: GraphParams = GraphParams(), csv: bool = False,
) -> Store:
    """Add the graph policy to a finished run, or renew it with other parameters, from its tables.

    No stack is read and no session pair is matched again. The policies of the run stay, and its record
    is that of a run with the graph policy from the start. Without candidates there is nothing to refine.
    """
    store = Store(spark, match_dir, csv)
    log = Path(store.path("run_log.json"))
    before = read_json(log)
    if "fingerprint" not in before:
        raise FileNotFoundError(f"{match_dir} holds no finished run")
    fingerprint = before["fingerprint"]
    if fingerprint["manifest"] != digest(manifest_path):
        raise ValueError("the manifest differs from the one of the matching run")
    if store.read("candidates").isEmpty():
        raise ValueError("the matching run has no candidates to refine")
    sessions = man.load_manifest(manifest_path)
    policies = resolve_policies([*fingerprint["policies"], *({"graph"} - set(fingerprint["policies"]))])
    log.unlink()
    timer = StageTimer()
    link_sessions(spark, sessions, store, policies, OverlapParams(**fingerprint["overlap"]), graph_params,
                  Spacing(**fingerprint["spacing"]), timer)
    record_run(store, sessions, {
        **before, "fingerprint": {**fingerprint, "graph": graph_params, "policies": policies}, "pairs_computed": 0, **timer.record()})
    return store


def record_run(store: Store, sessions: Sequence[man.Session], record: dict) -> None:
    """The log and the summary of a finished matching run; the log goes last."""
    lengths = store.read("track_lengths").orderBy("match_policy", F.desc("n_days_present"), "missing_internal_days").collect()
    lines = ["# Daywise matching", "", f"Sessions: {len(sessions)}", "", "Tracks by policy, sessions present and internal gaps:"]
    lines += [f"- {r.match_policy}: {r.n_days_present} sessions, {r.missing_internal_days} gaps: {r.n_tracks}" for r in lengths]
    Path(store.path("SUMMARY.md")).write_text("\n".join(lines) + "\n", encoding="utf-8")
    write_json(store.path("run_log.json"), record)


# --- extraction and analysis --------------------------------------------------------------------

def observations(track_nodes: DataFrame, table: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per track and session it is present in, with the session's dates."""
    named = checked_join(
        track_nodes, table.select(*POLICY, "track_session", "track_label", "track_uid", "cluster_id"),
        [*POLICY, "track_session", "track_label"], "inner", what="the track table")
    return checked_join(
        named,
        manifest.select("session_index", "session_id", "acquisition_date", "elapsed_days", "required", "mask_path",
                        "red_image_path", "green_image_path"), ["session_index"], "inner", what="the session metadata"
    ).select(
        *POLICY, F.col("cluster_id").alias("roi_id"), "track_uid", "cluster_id", "session_index",
        F.col("session_index").alias("day"), "session_id", "acquisition_date", "elapsed_days",
        F.col("label").alias("mask_label"), "required", "mask_path", "red_image_path", "green_image_path",
    )


def analyse(long: DataFrame, required_days: Sequence[int] | None, params: RatioParams, keys: Sequence[str],
            by: Sequence[str], store: Store) -> dict[str, DataFrame]:
    """The shared intensity analysis: dark values to residual summaries. ``by`` separates policies."""
    by = list(by)
    corrected = store.write("intensity_dark_corrected", ratio.dark_correct(
        long, {"red": params.red_dark, "green": params.green_dark}
    ))
    wide = store.write("roi_day_all", ratio.pivot_channels(corrected, keys=keys))
    complete = store.write("roi_day_complete", ratio.complete_rois(wide, required_days, by))
    metrics = store.write("log_ratio_metrics", ratio.log_ratio_metrics(complete, params.epsilon, by))
    fits = store.write("daily_fits", fit_intervals(daily_fits(metrics, by=[*by, "day"])))
    residuals = store.write("fit_residuals", fit_residuals(metrics, fits, on=[*by, "day"], by=by))
    signs = store.write("residual_sign_changes", trajectories.residual_sign_changes(residuals, by=by))
    store.write("trajectory_classes", trajectories.trajectory_classes(metrics, by=by))
    return {"corrected": corrected, "wide": wide, "complete": complete, "metrics": metrics, "fits": fits,
            "residuals": residuals, "signs": signs}


def run_extraction(
    spark: SparkSession, manifest_path: str | Path, match_dir: str | Path, out_dir: str | Path,
    policies: Sequence[str] = ("high", "balanced"), params: RatioParams = RatioParams(), geometry_qc: GeometryQC = GeometryQC(),
    csv: bool = False,
) -> Store:
    """Measure the tracks of a matching run and write the analysis tables of all policies."""
    policies = resolve_policies(policies)
    sessions = man.load_manifest(manifest_path)
    man.check_sessions(sessions, intensity=True)
    matched, store = Store(spark, match_dir), Store(spark, out_dir, csv)
    manifest = store.write("manifest", man.manifest_frame(spark, sessions))
    if not man.same_rows(manifest, matched.read("manifest")):
        raise ValueError("the manifest differs from the one of the matching run")
    timer = StageTimer()
    table = matched.read("tracks").where(F.col("match_policy").isin(list(policies)))
    found = {r[0] for r in table.select("match_policy").distinct().collect()}
    if found != set(policies):
        raise FileNotFoundError(f"the matching run has no tracks for {sorted(set(policies) - found)}")
    nodes = matched.read("track_nodes").where(F.col("match_policy").isin(list(policies)))
    seen = store.write("observations", observations(nodes, table, manifest))
    # The stacks are read once for all policies and both channels.
    means = store.write("label_means", vox.label_means(tiff.read_voxels(spark, man.volume_specs(sessions))))
    per_channel = seen.withColumn("channel", F.explode(F.array(F.lit("red"), F.lit("green"))))
    raw = checked_join(
        per_channel, means.withColumnRenamed("label", "mask_label"), ["session_id", "mask_label", "channel"], what="the mean intensities"
    ).withColumn("zero_hit_pass", F.col("mean_intensity").isNotNull()).withColumn(
        "image_path", F.when(F.col("channel") == "red", F.col("red_image_path")).otherwise(F.col("green_image_path"))
    ).drop("red_image_path", "green_image_path")
    raw = store.write("intensity_raw", raw)
    timer.done("intensities")
    required = [s.session_index for s in sessions if s.required]
    keys = [*POLICY, "roi_id", "day", "track_uid", "cluster_id", "session_index", "session_id", "acquisition_date", "elapsed_days", "required"]
    parts = analyse(raw, required, params, keys, POLICY, store)
    timer.done("analysis")

    features = matched.read("roi_features").drop("session_index", "required")
    geometry = checked_join(
        seen, features.withColumnRenamed("label", "mask_label"), ["session_id", "mask_label"], what="the feature table")
    geometry = trajectories.centroid_steps(geometry, POLICY)
    geometry = store.write("geometry", qc.geometry_flags(geometry, geometry_qc, POLICY))
    shape = store.write("track_geometry", qc.track_geometry_summary(geometry, geometry_qc, POLICY))
    presence = qc.presence_summary(parts["wide"], required, POLICY)
    joined = checked_join(table.withColumn("roi_id", F.col("cluster_id")), shape, [*POLICY, "roi_id"], one_to_one=True)
    joined = checked_join(joined, presence, [*POLICY, "roi_id"], what="the presence table")
    n = len(required)
    joined = joined.na.fill(0, ["n_required_sessions_present", "missing_required_internal_days", "n_edge_sessions"]).na.fill(
        n, ["n_required_sessions_missing"]
    ).na.fill(False, ["all_required_sessions_present", "exactly_one_required_session_missing"])
    seg_pass = F.coalesce(F.col("segmentation_qc_pass_all_required_days"), F.lit(False))
    joined = joined.withColumn("segmentation_failure", (F.col("segmentation_qc_status") == "configured") & ~seg_pass)
    joined = joined.withColumn("edge_heavy", F.col("n_edge_sessions") > 0)
    joined = joined.withColumn(
        "review_reasons",
        qc.merge_reasons(F.col("review_reasons"), {"segmentation_failure": F.col("segmentation_failure"), "edge_heavy": F.col("edge_heavy")}),
    ).withColumn("review_required", F.col("review_required") | F.col("segmentation_failure") | F.col("edge_heavy"))
    complete = (F.col("n_required_sessions_present") >= n) & (F.col("missing_required_internal_days") == 0)
    no_conflict = ~F.col("has_cycle_conflict")
    judged = geometry_qc.mode == "fraction" or geometry_qc.configured
    joined = (
        joined.withColumn("is_complete", complete)
        .withColumn("is_cycle_qc", complete & no_conflict)
        .withColumn("is_segmentation_qc", complete & no_conflict & seg_pass if judged else F.lit(False))
        .withColumn(
            "is_one_gap",
            (F.col("n_required_sessions_present") == max(n - 1, 0)) & (F.col("missing_required_internal_days") == 1)
            & (F.col("n_days_present") >= 2) & no_conflict,
        )
    )
    final = store.write("matched_tracks", joined)
    high, balanced = F.col("match_policy") == "high", F.col("match_policy") == "balanced"
    store.write("primary_high_complete", final.where(high & F.col("is_cycle_qc")))
    store.write("primary_high_complete_full_qc", final.where(high & F.col("is_segmentation_qc")))
    store.write("sensitivity_balanced_complete", final.where(balanced & F.col("is_cycle_qc")))
    store.write("one_gap_tracks", final.where("is_one_gap"))
    store.write("review_flagged", final.where("review_required"))
    steps = {
        "all_tracks": F.lit(True), "at_least_two_sessions": F.col("n_days_present") >= 2,
        "complete_required_sessions": F.col("is_complete"), "zero_hit_complete": F.col("is_complete"),
        "cycle_qc": F.col("is_cycle_qc"), "segmentation_qc": F.col("is_segmentation_qc"),
        "primary_final": F.col("is_segmentation_qc"), "one_internal_gap": F.col("is_one_gap"),
    }
    funnel = store.write("filter_counts", qc.funnel(final, steps, POLICY))
    timer.done("tracks")
    write_json(store.path("run_log.json"), {"params": params, "geometry_qc": geometry_qc, "policies": policies, **timer.record()})
    lines = ["# Daywise extraction", "", f"Dark values: green {params.green_dark}, red {params.red_dark}", "", "Filter steps:"]
    lines += [
        f"- {r.match_policy} / {r.step}: {r['count']} ({r.pct_of_start:.1f} % of start)"
        for r in funnel.orderBy("match_policy", "step_order").collect()
    ]
    Path(store.path("SUMMARY.md")).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return store


def matching_qc(store: Store, limit: int = 20, seed: int = 0) -> Store:
    """Tables behind the matching quality figures: long pair summary, histograms and review sample."""
    table = store.read("tracks")
    summary = store.read("pairwise_summary")
    policies = [p for p in ("high", "balanced", "graph") if not table.where(F.col("match_policy") == p).isEmpty()]
    store.write("pairwise_summary_long", review.pair_summary_long(summary, [*PAIR, "pair_gap"], policies))
    store.write("cycle_conflicts", table.groupBy(*POLICY, "has_cycle_conflict").agg(F.count(F.lit(1)).alias("n_tracks")))
    bins = F.width_bucket(F.col("score"), F.lit(0.0), F.lit(1.0), F.lit(20)).alias("bin")
    store.write("score_histogram", store.read("pairwise_matches").groupBy(*POLICY, bins).agg(F.count(F.lit(1)).alias("n")))
    first = table.where(F.col("match_policy") == policies[0])
    other = table.where(F.col("match_policy") == "balanced") if "balanced" in policies[1:] else None
    store.write("review_sample", review.review_sample(first, other, limit, seed))
    return store
