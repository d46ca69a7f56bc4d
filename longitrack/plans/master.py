"""Master pipeline: graph matching, agreement with the balanced policy, extraction and panel tables."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from longitrack.operators import fits, ranking, ratio, tracks
from longitrack.params import GeometryQC, GraphParams, OverlapParams, RatioParams, Spacing
from longitrack.plans import daywise
from longitrack.sources import manifest as man
from longitrack.sources.sinks import Store, safe_name, write_json

AGREEMENT = ["track_match_source", "consensus_edge_fraction", "has_graph_only_edge"]


def default_run_name(dataset: str, sessions: Sequence[man.Session]) -> str:
    """Dataset, first and last date, and the number of sessions."""
    days = sorted(s.acquisition_date for s in sessions)
    return safe_name(f"{dataset}_{days[0]:%Y%m%d}_{days[-1]:%Y%m%d}_{len(sessions)}sessions")


def annotate_agreement(store: Store) -> dict:
    """Label graph matches, accepted edges and tracks by agreement with the balanced policy.

    The labelled tracks become a new table; the original one stays as it was.
    """
    matches = store.read("pairwise_matches")
    balanced = matches.where(F.col("match_policy") == "balanced").drop("match_policy")
    own = matches.where(F.col("match_policy") == "graph").drop("match_policy")
    table = store.read("tracks").where(F.col("match_policy") == "graph").drop("match_policy")
    if table.isEmpty():
        raise ValueError("there are no graph tracks to label")
    nodes = store.read("track_nodes").where(F.col("match_policy") == "graph").drop("match_policy")
    if not tracks.unique_owner(nodes).isEmpty():
        raise ValueError("a node belongs to two graph tracks")
    store.write("pairwise_matches_agreement", tracks.edge_agreement(own, balanced))
    edges = store.read("track_edges").where(F.col("match_policy") == "graph").drop("match_policy")
    labelled = store.write("accepted_edges_agreement", tracks.edge_agreement(edges.where("accepted_for_track"), balanced))
    annotated = store.write("tracks_agreement", tracks.track_agreement(table, nodes, labelled))
    sources = store.write(
        "agreement_summary", annotated.groupBy("track_match_source").agg(F.count(F.lit(1)).alias("n_tracks"))
    )
    counts = labelled.agg(
        F.count(F.lit(1)).alias("n_accepted_graph_edges"),
        F.count(F.when(F.col("agrees_with_affine_balanced"), 1)).alias("n_consensus_accepted_edges"),
    ).first()
    return {**counts.asDict(), "track_source_counts": {r[0]: r[1] for r in sources.collect()}}


def propagate_agreement(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach the agreement labels by the first key the table has."""
    key = next((k for k in ("track_uid", "cluster_id", "roi_id") if k in df.columns), None)
    if key is None:
        return df
    lookup = labels.withColumn("roi_id", F.col("cluster_id")).select(key, *AGREEMENT)
    return df.drop(*[c for c in AGREEMENT if c in df.columns]).join(lookup, key, "left")


def panel_tables(residuals: DataFrame, threshold: float = 1500.0) -> tuple[DataFrame, DataFrame]:
    """Rows drawn per day and the day's line, both without green artefacts; rows keep their label."""
    kept = fits.drop_artifacts(residuals.drop("slope", "intercept"), threshold)
    columns = [c for c in ("roi_id", "day", "red", "green", "track_match_source") if c in kept.columns]
    return kept.select(*columns), fits.daily_fits(kept)


def quick_tables(store: Store, metrics: DataFrame, residuals: DataFrame, top_n: int, seed: int | None) -> None:
    """Ranked (or, with ``seed``, sampled) objects with their days, one pair of tables per direction."""
    summary = ratio.roi_summary(metrics)
    for direction in ("decreasing", "increasing"):
        top = store.write(f"top_{direction}", ranking.top_changing(
            summary, direction, top_n, random_sample=seed is not None, seed=seed or 0
        ))
        store.write(f"top_{direction}_days", ranking.ranked_roi_days(residuals, top, top_n, ["selection_rank"]))


def run_master(
    spark: SparkSession, manifest_path: str | Path, out_dir: str | Path, overlap: OverlapParams = OverlapParams(),
    graph_params: GraphParams = GraphParams(), spacing: Spacing = Spacing(), params: RatioParams = RatioParams(),
    geometry_qc: GeometryQC = GeometryQC(), max_pair_gap: int = 2, top_n: int = 30, sample_seed: int | None = 0,
    resume: bool = False, overwrite: bool = False, csv: bool = False,
) -> tuple[Store, Store]:
    """The whole run: ``(matching store, analysis store)`` below ``out_dir``."""
    match_dir, analysis_dir = Path(out_dir, "matching"), Path(out_dir, "analysis")
    matched = daywise.run_matching(
        spark, manifest_path, match_dir, ("high", "balanced", "graph"), overlap, graph_params, spacing, max_pair_gap,
        resume, overwrite, csv,
    )
    agreement = annotate_agreement(matched)
    store = daywise.run_extraction(spark, manifest_path, match_dir, analysis_dir, ("graph",), params, geometry_qc, csv)
    labels = matched.read("tracks_agreement")
    residuals = store.write("fit_residuals_agreement", propagate_agreement(store.read("fit_residuals"), labels))
    store.write("matched_tracks_agreement", propagate_agreement(store.read("matched_tracks"), labels))
    points, lines = panel_tables(residuals)
    store.write("panel_points", points)
    store.write("panel_fits", lines)
    quick_tables(store, store.read("log_ratio_metrics"), residuals, top_n, sample_seed)
    write_json(Path(out_dir, "run_manifest.json"), {
        "agreement": agreement, "overlap": overlap, "graph": graph_params, "spacing": spacing, "params": params,
    })
    return matched, store
