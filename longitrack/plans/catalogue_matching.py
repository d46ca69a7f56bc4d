"""Catalogue: candidates, assignment, graph refinement, tracks, cycles and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from longitrack.operators import assignment, candidates as cand, graph, qc, review, tracks
from longitrack.params import GraphParams
from longitrack.plans import relations as rel
from longitrack.plans.catalogue_ratio import rounded
from longitrack.session import materialise

PAIR = rel.PAIR
GROUP = ["field_id"]
KEYS = [*PAIR, "label_a", "label_b"]


def knn2(spark: SparkSession, sf: str) -> DataFrame:
    a, b = rel.sides(rel.points(spark, sf))
    return rounded(cand.two_nearest(a, b, PAIR))


def knn2_mutual(spark: SparkSession, sf: str) -> DataFrame:
    a, b = rel.sides(rel.points(spark, sf))
    return rounded(cand.mutual_centroid_pairs(a, b, pair=PAIR))


def overlap_range_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rel.overlaps(*rel.sides(rel.points(spark, sf))))


def mutual_best_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assignment.mutual_best_overlap(rel.overlaps(*rel.sides(rel.points(spark, sf))), PAIR))


def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rel.candidates(spark, sf))


def high_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rel.candidates(spark, sf).where("high_rule").select(*KEYS, "candidate_source", "score"))


def balanced_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rel.candidates(spark, sf).where("balanced_rule").select(*KEYS, "candidate_source", "score"))


def _matches(rows: DataFrame) -> DataFrame:
    """High and balanced greedy matches in one table."""
    both = None
    for policy in ("high", "balanced"):
        part = assignment.greedy_one_to_one(rows, f"{policy}_rule", pair=PAIR)
        both = part if both is None else both.unionByName(part)
    return both


def greedy_matches(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_matches(materialise(rel.candidates(spark, sf))).select(*KEYS, "assignment_policy", "score"))


def pair_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Match yield per pair of sessions and policy."""
    pts = rel.points(spark, sf)
    sizes = pts.groupBy("field_id", "session_index").agg(F.count(F.lit(1)).alias("n"))
    m = _matches(materialise(rel.candidates(spark, sf))).groupBy(*PAIR).agg(
        F.count(F.when(F.col("assignment_policy") == "high", 1)).alias("n_high"),
        F.count(F.when(F.col("assignment_policy") == "balanced", 1)).alias("n_balanced"),
    )
    for side in ("a", "b"):
        m = m.join(
            sizes.select("field_id", F.col("session_index").alias(f"index_{side}"), F.col("n").alias(f"n_{side}")),
            ["field_id", f"index_{side}"],
        )
    smaller = F.least("n_a", "n_b")
    return rounded(
        m.withColumn("high_frac_smaller", F.col("n_high") / smaller).withColumn(
            "balanced_frac_smaller", F.col("n_balanced") / smaller
        )
    )


def pair_summary_long(spark: SparkSession, sf: str) -> DataFrame:
    """One row per pair and policy."""
    return review.pair_summary_long(pair_summary(spark, sf), PAIR)


def graph_anchors(spark: SparkSession, sf: str) -> DataFrame:
    high = assignment.greedy_one_to_one(rel.candidates(spark, sf), "high_rule", pair=PAIR)
    return rounded(graph.graph_anchors(high, pair=PAIR).select(*KEYS, "anchor_rank", "score"))


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    a, b = rel.sides(rel.points(spark, sf))
    rows = materialise(rel.candidates(spark, sf))
    high = assignment.greedy_one_to_one(rows, "high_rule", pair=PAIR)
    anchors = materialise(graph.anchor_filter(high))
    return a, b, rows, anchors, high


def graph_support(spark: SparkSession, sf: str) -> DataFrame:
    a, b, rows, anchors, _ = _graph(spark, sf)
    plain = rows.where("balanced_rule").join(anchors.select(*KEYS), KEYS, "left_anti")
    return rounded(graph.graph_support(plain, anchors, a, b, pair=PAIR))


GRAPH_COLUMNS = [*KEYS, "graph_status", "graph_support_count", "graph_score", "refined_score"]


def graph_scores(spark: SparkSession, sf: str) -> DataFrame:
    a, b, rows, anchors, _ = _graph(spark, sf)
    return rounded(graph.graph_scores(rows, anchors, a, b, GraphParams(), PAIR).select(*GRAPH_COLUMNS))


def _graph_matches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b, rows, anchors, _ = _graph(spark, sf)
    scored = graph.graph_scores(rows, anchors, a, b, GraphParams(), PAIR)
    balanced = materialise(assignment.greedy_one_to_one(rows, "balanced_rule", pair=PAIR))
    return materialise(graph.graph_assignment(scored, PAIR, fallback=balanced)), balanced, rows


def graph_matches(spark: SparkSession, sf: str) -> DataFrame:
    matches, _, _ = _graph_matches(spark, sf)
    return rounded(matches.select(*KEYS, "graph_status", "assignment_source", "refined_score"))


def match_diff_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    matches, balanced, _ = _graph_matches(spark, sf)
    return rounded(graph.compare_matches(balanced, matches, PAIR))


# --- tracks -----------------------------------------------------------------------------------

def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return rel.points(spark, sf).select("field_id", "session_index", "label")


def _policy_tracks(spark: SparkSession, sf: str, rows: DataFrame, policy: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    matches = materialise(
        assignment.greedy_one_to_one(rows, f"{policy}_rule", pair=PAIR).withColumn(
            "transform_fallback_reason", F.lit(None).cast("string")
        )
    )
    nodes, decisions = tracks.build_tracks(_nodes(spark, sf), matches, rel.SESSIONS, GROUP)
    return nodes, decisions, matches


def _balanced_tracks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _policy_tracks(spark, sf, materialise(rel.candidates(spark, sf)), "balanced")


def _track_table(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    session_id = F.concat(F.lit("d"), F.col("session_index").cast("string"))
    return tracks.track_table(nodes, decisions, session_id, GROUP)


def track_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _, _ = _balanced_tracks(spark, sf)
    return rounded(nodes)


def edge_decisions(spark: SparkSession, sf: str) -> DataFrame:
    _, decisions, _ = _balanced_tracks(spark, sf)
    return rounded(decisions.select(*KEYS, "pair_gap", "accepted_for_track", "rejection_reason", "score"))


def track_summary(spark: SparkSession, sf: str) -> DataFrame:
    nodes, decisions, _ = _balanced_tracks(spark, sf)
    return rounded(tracks.cluster_ids(_track_table(nodes, decisions)).drop("track_session", "track_label"))


def track_length_hist(spark: SparkSession, sf: str) -> DataFrame:
    nodes, decisions, _ = _balanced_tracks(spark, sf)
    return rounded(tracks.track_lengths(_track_table(nodes, decisions)))


def wide_tracks(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _, _ = _balanced_tracks(spark, sf)
    wide = tracks.wide_tracks(nodes, {i: f"d{i}" for i in range(rel.SESSIONS)}, GROUP)
    return rounded(wide.drop("track_session"))


def cycle_detail(spark: SparkSession, sf: str) -> DataFrame:
    matches = assignment.greedy_one_to_one(rel.candidates(spark, sf), "balanced_rule", pair=PAIR)
    return rounded(tracks.cycle_detail(tracks.cycle_checks(materialise(matches), GROUP)))


def cycle_summary(spark: SparkSession, sf: str) -> DataFrame:
    matches = materialise(assignment.greedy_one_to_one(rel.candidates(spark, sf), "balanced_rule", pair=PAIR))
    triplets = rel.points(spark, sf).select("field_id").distinct().select(
        "field_id", F.explode(F.sequence(F.lit(0), F.lit(rel.SESSIONS - 3))).alias("index_a")
    )
    return rounded(tracks.cycle_summary(tracks.cycle_checks(matches, GROUP), matches, triplets, GROUP))


def cycle_metadata(spark: SparkSession, sf: str) -> DataFrame:
    nodes, decisions, matches = _balanced_tracks(spark, sf)
    detail = tracks.cycle_detail(tracks.cycle_checks(matches, GROUP))
    table = tracks.add_cycle_metadata(_track_table(nodes, decisions), nodes, detail, GROUP)
    return rounded(table.select(
        "field_id", "track_uid", "n_cycle_comparable", "n_cycle_agree", "cycle_agreement_fraction",
        "has_cycle_conflict", "cycle_unchecked", "review_required", "review_reasons",
    ))


def agreement_labels(spark: SparkSession, sf: str) -> DataFrame:
    matches, balanced, _ = _graph_matches(spark, sf)
    matches = matches.withColumn("transform_fallback_reason", F.lit(None).cast("string"))
    nodes, decisions = tracks.build_tracks(_nodes(spark, sf), matches, rel.SESSIONS, GROUP)
    labelled = tracks.edge_agreement(decisions, balanced, GROUP)
    out = tracks.track_agreement(_track_table(nodes, decisions), nodes, labelled, GROUP)
    return rounded(out.select(
        "field_id", "track_uid", "n_accepted_graph_edges", "n_consensus_edges", "n_graph_only_edges",
        "consensus_edge_fraction", "has_graph_only_edge", "track_match_source",
    ))


# --- weekly matcher ---------------------------------------------------------------------------

def _legacy_matches(spark: SparkSession, sf: str) -> DataFrame:
    return assignment.reciprocal_best(rel.candidates(spark, sf).where(F.col("score") >= 0.45), PAIR)


def legacy_confidence_mutual_best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_legacy_matches(spark, sf).select(*KEYS, "score", "confidence"))


def pair_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Distances and deciles of scores and confidences per pair of sessions."""
    return rounded(review.pair_diagnostics(_legacy_matches(spark, sf), PAIR))


def _legacy_table(spark: SparkSession, sf: str) -> DataFrame:
    nodes, links = tracks.legacy_tracks(_legacy_matches(spark, sf), rel.SESSIONS, 0.70, GROUP)
    return tracks.legacy_track_table(nodes, links, GROUP).drop("head_session", "head_label")


def legacy_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_legacy_table(spark, sf))


def legacy_track_length_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.length_thresholds(_legacy_table(spark, sf), (2, 3, 4)))


def legacy_qc_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = qc.legacy_flags(_legacy_table(spark, sf).withColumn("any_edge_roi", F.lit(False)), 0.7)
    return rounded(flags.select(
        "field_id", "signature", "low_confidence", "gap_bridge_qc", "edge_qc", "fragmented_track_qc", "needs_review"
    ))


def example_tracks(spark: SparkSession, sf: str) -> DataFrame:
    flags = qc.legacy_flags(_legacy_table(spark, sf).withColumn("any_edge_roi", F.lit(False)), 0.7)
    rounds = flags.withColumn("mean_confidence", F.round("mean_confidence", 9)).withColumn(
        "min_confidence", F.round("min_confidence", 9)
    )
    return rounded(review.example_tracks(rounds, 5).select(
        "field_id", "signature", "example_group", "category_rank", "mean_confidence", "min_confidence"
    ))


def review_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Review categories of the high tracks, and balanced tracks the high policy does not have."""
    rows = materialise(rel.candidates(spark, sf))
    tables = {}
    for policy in ("high", "balanced"):
        nodes, decisions, matches = _policy_tracks(spark, sf, rows, policy)
        detail = tracks.cycle_detail(tracks.cycle_checks(matches, GROUP))
        tables[policy] = tracks.add_cycle_metadata(_track_table(nodes, decisions), nodes, detail, GROUP)
    sample = review.review_sample(tables["high"], tables["balanced"], 6, None, ("field_id", "track_uid"))
    return rounded(sample.select("field_id", "track_uid", "review_category", "category_rank"))


QUERIES = {
    f.__name__: f
    for f in (
        knn2, knn2_mutual, overlap_range_join, mutual_best_overlap, candidate_scores, high_rule, balanced_rule,
        greedy_matches, pair_summary, pair_summary_long, graph_anchors, graph_support, graph_scores, graph_matches,
        match_diff_full_outer, track_nodes, edge_decisions, track_summary, track_length_hist, wide_tracks, cycle_detail,
        cycle_summary, cycle_metadata, agreement_labels, legacy_confidence_mutual_best, pair_diagnostics, legacy_tracks,
        legacy_track_length_thresholds, legacy_qc_flags, example_tracks, review_sample,
    )
}
