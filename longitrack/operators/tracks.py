"""Multi-session tracks from pairwise matches, cycle checks and agreement labels.

A match table holds ``index_a``/``index_b`` (session order), ``label_a``/``label_b`` and the match
figures. Within one pair of sessions the matches are one-to-one. ``group`` columns (a policy, a
field of view) keep independent problems apart in one plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from longitrack.operators.ordering import global_rank
from longitrack.session import materialise


def path_heads(nodes: DataFrame, links: DataFrame, sessions: int, group: Sequence[str] = ()) -> DataFrame:
    """Head node of every node's path, given one-to-one links between sessions.

    Pointer doubling: every round replaces a node's pointer by the pointer of the node it points
    to, so paths over ``sessions`` sessions are done after log2(sessions) rounds. All joins are on
    unique node keys.
    """
    group = list(group)
    node = [*group, "session_index", "label"]
    back = links.select(
        *group, F.col("index_b").alias("session_index"), F.col("label_b").alias("label"),
        F.col("index_a").alias("head_session"), F.col("label_a").alias("head_label"),
    )
    state = nodes.select(*node).join(back, node, "left").select(
        *node,
        F.coalesce("head_session", "session_index").alias("head_session"),
        F.coalesce("head_label", "label").alias("head_label"),
    )
    for _ in range(max(1, math.ceil(math.log2(max(2, sessions))))):
        state = materialise(state)
        target = state.select(
            *group, F.col("session_index").alias("head_session"), F.col("label").alias("head_label"),
            F.col("head_session").alias("_s"), F.col("head_label").alias("_l"),
        )
        state = state.join(target, [*group, "head_session", "head_label"], "left").select(
            *node,
            F.coalesce("_s", "head_session").alias("head_session"),
            F.coalesce("_l", "head_label").alias("head_label"),
        )
    return state


def _edge_nodes(edges: DataFrame, lookup: DataFrame, group: list[str], columns: Sequence[str]) -> DataFrame:
    """Attach ``columns`` of both end nodes with suffixes ``_a`` and ``_b``."""
    for side in ("a", "b"):
        table = lookup.select(
            *group, F.col("session_index").alias(f"index_{side}"), F.col("label").alias(f"label_{side}"),
            *[F.col(c).alias(f"{c}_{side}") for c in columns],
        )
        edges = edges.join(table, [*group, f"index_{side}", f"label_{side}"], "left")
    return edges


def build_tracks(
    nodes: DataFrame, matches: DataFrame, sessions: int, group: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Tracks with at most one node per session: ``(track_nodes, edge_decisions)``.

    Adjacent matches are one-to-one, so they form paths over consecutive sessions and all of them
    are accepted. Matches over a gap are then taken in session order; one is accepted when its two
    tracks have no session in common. Two gap matches of the same pair of sessions never influence
    each other: an accepted match joins a track without a node in the later session to a track
    without a node in the earlier one, so neither track has a second match in that pair. Hence
    every session step is one join, and only paths that touch a still possible gap match take part.
    """
    group = list(group)
    node = [*group, "session_index", "label"]
    nodes = materialise(nodes.select(*node))
    known = _edge_nodes(matches, nodes.withColumn("known", F.lit(True)), group, ["known"])
    known = known.withColumn("_known", F.col("known_a").isNotNull() & F.col("known_b").isNotNull()).drop("known_a", "known_b")
    known = materialise(known)
    adjacent = known.where("_known").where(F.col("index_b") - F.col("index_a") == 1)
    heads = materialise(path_heads(nodes, adjacent, sessions, group))
    path = [*group, "head_session", "head_label"]
    spans = heads.groupBy(*path).agg(F.max("session_index").alias("path_end"))
    heads = materialise(heads.join(spans, path).withColumn(
        "path", F.struct(F.col("head_session").alias("s"), F.col("head_label").alias("l"))
    ))
    gaps = _edge_nodes(
        known.where("_known").where(F.col("index_b") - F.col("index_a") == 2), heads, group, ["path", "head_session", "path_end"]
    )
    same = (F.col("path_a") == F.col("path_b"))
    overlap = (F.col("head_session_a") <= F.col("path_end_b")) & (F.col("head_session_b") <= F.col("path_end_a"))
    gaps = materialise(gaps.withColumn(
        "rejection_reason",
        F.when(same, "already_connected").when(overlap, "same_session_component_conflict"),
    ))
    possible = gaps.where(F.col("rejection_reason").isNull())
    steps = [r[0] for r in possible.select("index_a").distinct().orderBy("index_a").collect()]

    def touched(side: str) -> DataFrame:
        return possible.select(
            *group, F.col(f"path_{side}").alias("path"),
            F.sequence(F.col(f"head_session_{side}"), F.col(f"path_end_{side}")).alias("held"),
        )

    parts = touched("a").unionByName(touched("b")).groupBy(*group, "path").agg(F.first("held").alias("held"))
    component = parts.select(*group, "path", F.col("path").alias("root"), "held")
    decisions = []
    for step in steps:
        component = materialise(component)
        edges = possible.where(F.col("index_a") == step).drop("rejection_reason")
        for side in ("a", "b"):
            state = component.select(
                *group, F.col("path").alias(f"path_{side}"), F.col("root").alias(f"root_{side}"),
                F.col("held").alias(f"held_{side}"),
            )
            edges = edges.join(state, [*group, f"path_{side}"])
        reason = F.when(F.col("root_a") == F.col("root_b"), "already_connected").when(
            F.arrays_overlap("held_a", "held_b"), "same_session_component_conflict"
        )
        edges = materialise(edges.withColumn("rejection_reason", reason))
        decisions.append(edges.select(*gaps.columns))
        merged = edges.where(F.col("rejection_reason").isNull())
        held = F.array_sort(F.concat("held_a", "held_b")).alias("_held")
        first = F.least("root_a", "root_b").alias("_root")
        update = merged.select(*group, F.col("root_a").alias("root"), first, held).unionByName(
            merged.select(*group, F.col("root_b").alias("root"), first, held)
        )
        component = component.join(update, [*group, "root"], "left").select(
            *group, "path", F.coalesce("_root", "root").alias("root"), F.coalesce("_held", "held").alias("held")
        )
    if steps:
        component = materialise(component)
    owned = heads.join(component.select(*group, "path", "root"), [*group, "path"], "left").select(
        *node, F.coalesce("root", "path").alias("root")
    )
    earliest = owned.groupBy(*group, "root").agg(F.min(F.struct("session_index", "label")).alias("first"))
    track_nodes = owned.join(earliest, [*group, "root"]).select(
        *node, F.col("first.session_index").alias("track_session"), F.col("first.label").alias("track_label")
    )
    track_nodes = materialise(track_nodes)
    shared = [c for c in known.columns if c != "_known"]
    none = F.lit(None).cast("string")
    decided = known.where(~F.col("_known")).select(*shared, F.lit("missing_node").alias("rejection_reason"))
    decided = decided.unionByName(adjacent.select(*shared, none.alias("rejection_reason")))
    decided = decided.unionByName(gaps.where(F.col("rejection_reason").isNotNull()).select(*shared, "rejection_reason"))
    for edges in decisions:
        decided = decided.unionByName(edges.select(*shared, "rejection_reason"))
    decided = decided.withColumn("accepted_for_track", F.col("rejection_reason").isNull()).withColumn(
        "pair_gap", F.col("index_b") - F.col("index_a")
    )
    return track_nodes, materialise(decided)


def legacy_tracks(
    matches: DataFrame, sessions: int, min_gap_support: float = 0.80, group: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The weekly matcher's tracks: ``(track_nodes, links)`` with the confidence of every link used.

    A bridge over one missing session needs enough confidence and both tracks to lack that session.
    The tracks of adjacent matches are unbroken, so this holds exactly when the bridge starts at the
    last node of one track and ends at the first node of another; then no two bridges compete, and
    all of them are accepted at once.
    """
    group = list(group)
    matches = materialise(matches)
    ends = [
        matches.select(*group, F.col(f"index_{s}").alias("session_index"), F.col(f"label_{s}").alias("label"))
        for s in ("a", "b")
    ]
    nodes = materialise(ends[0].unionByName(ends[1]).distinct())
    gap = F.col("index_b") - F.col("index_a")
    adjacent = matches.where(gap == 1)
    starts = adjacent.select(*group, "index_a", "label_a")
    stops = adjacent.select(*group, "index_b", "label_b")
    bridges = (
        matches.where((gap == 2) & (F.col("confidence") >= min_gap_support))
        .join(starts, [*group, "index_a", "label_a"], "left_anti")
        .join(stops, [*group, "index_b", "label_b"], "left_anti")
    )
    links = materialise(
        adjacent.withColumn("is_bridge", F.lit(False)).unionByName(bridges.withColumn("is_bridge", F.lit(True)))
    )
    return materialise(path_heads(nodes, links, sessions, group)), links


def legacy_track_table(track_nodes: DataFrame, links: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One row per weekly track: sessions present and missing, mean and minimum confidence, bridge use."""
    group = list(group)
    track = [*group, "head_session", "head_label"]
    spans = track_nodes.groupBy(*track).agg(
        F.count(F.lit(1)).alias("n_days_present"),
        (F.max("session_index") - F.min("session_index") + 1 - F.count(F.lit(1))).alias("missing_intermediate_days"),
        F.concat_ws("|", F.transform(
            F.array_sort(F.collect_list(F.struct("session_index", "label"))),
            lambda n: F.concat_ws(":", n["session_index"].cast("string"), n["label"].cast("string")),
        )).alias("signature"),
    )
    owned = links.join(
        track_nodes.select(*track, F.col("session_index").alias("index_a"), F.col("label").alias("label_a")),
        [*group, "index_a", "label_a"],
    )
    confidence = owned.groupBy(*track).agg(
        F.avg("confidence").alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.bool_or("is_bridge").alias("used_gap_bridge"),
    )
    return spans.join(confidence, track, "left").na.fill(0.0, ["mean_confidence", "min_confidence"]).na.fill(
        False, ["used_gap_bridge"]
    )


def track_table(
    track_nodes: DataFrame, decisions: DataFrame, session_id: Column, group: Sequence[str] = (),
) -> DataFrame:
    """One row per track: presence, figures over its accepted edges, and review flags.

    ``session_id`` names a session from ``session_index``. All aggregations per track are bounded by
    the number of sessions.
    """
    group = list(group)
    track = [*group, "track_session", "track_label"]
    named = track_nodes.withColumn("_name", F.concat_ws(":", session_id, F.col("label").cast("string")))
    spans = named.groupBy(*track).agg(
        F.count(F.lit(1)).alias("n_days_present"),
        F.min("session_index").alias("first_session_index"),
        F.max("session_index").alias("last_session_index"),
        (F.max("session_index") - F.min("session_index") + 1 - F.count(F.lit(1))).alias("missing_internal_days"),
        F.min_by("_name", "session_index").alias("track_uid"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("session_index", "_name"))), lambda n: n["_name"]), "|"
        ).alias("component_signature"),
    )
    owned = decisions.where("accepted_for_track").join(
        track_nodes.select(*track, F.col("session_index").alias("index_a"), F.col("label").alias("label_a")),
        [*group, "index_a", "label_a"],
    )
    fallback = F.length(F.trim(F.coalesce(F.col("transform_fallback_reason"), F.lit("")))) > 0
    edges = owned.groupBy(*track).agg(
        F.count(F.when(F.col("pair_gap") == 1, 1)).alias("n_adjacent_edges"),
        F.count(F.when(F.col("pair_gap") == 2, 1)).alias("n_gap_edges"),
        F.min("score").alias("min_score"),
        F.avg("score").alias("mean_score"),
        F.min("dice").alias("min_dice"),
        F.max("distance_um").alias("max_distance_um"),
        F.max("ambiguity").alias("max_ambiguity"),
        F.bool_or(~F.col("high_rule") & F.col("balanced_rule")).alias("contains_balanced_only_edge"),
        F.bool_or(fallback).alias("contains_transform_fallback_edge"),
    )
    out = spans.join(edges, track, "left").na.fill(0, ["n_adjacent_edges", "n_gap_edges"]).na.fill(
        False, ["contains_balanced_only_edge", "contains_transform_fallback_edge"]
    )
    out = out.withColumn("used_gap_bridge", F.col("n_gap_edges") > 0)
    return out.withColumn(
        "review_required", F.col("used_gap_bridge") | F.col("contains_transform_fallback_edge")
    ).withColumn(
        "review_reasons",
        F.concat_ws(
            ",",
            F.when(F.col("used_gap_bridge"), "gap_bridge"),
            F.when(F.col("contains_transform_fallback_edge"), "transform_fallback"),
        ),
    )


def cluster_ids(tracks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number the tracks: longest first, then fewest gaps, earliest start, identifier and signature."""
    order = [
        F.desc("n_days_present"), F.asc("missing_internal_days"), F.asc("first_session_index"), F.asc("track_uid"),
        F.asc("component_signature"),
    ]
    return global_rank(tracks, order, by, out="cluster_id")


def track_lengths(tracks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of tracks per length and number of internal gaps."""
    return tracks.groupBy(*by, "n_days_present", "missing_internal_days").agg(F.count(F.lit(1)).alias("n_tracks"))


def length_thresholds(tracks: DataFrame, thresholds: Sequence[int] = (4, 5, 6, 7)) -> DataFrame:
    """Tracks present in at least k sessions, one row per k; one pass over the tracks."""
    counts = tracks.agg(*[F.count(F.when(F.col("n_days_present") >= k, 1)).alias(f"_{k}") for k in thresholds])
    rows = F.array(*[F.struct(F.lit(k).alias("minimum_weeks_present"), F.col(f"_{k}").alias("n_tracks")) for k in thresholds])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def cycle_checks(matches: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Every composed match a to b to c beside the direct match a to c; NULL where there is none."""
    group = list(group)
    gap = F.col("index_b") - F.col("index_a")
    ab = matches.where(gap == 1).select(
        *group, "index_a", "label_a", F.col("index_b").alias("_b"), F.col("label_b").alias("label_b_composed")
    )
    bc = matches.where(gap == 1).select(
        *group, F.col("index_a").alias("_b"), F.col("label_a").alias("label_b_composed"),
        F.col("label_b").alias("label_c_composed"),
    )
    ac = matches.where(gap == 2).select(*group, "index_a", "label_a", F.col("label_b").alias("label_c_direct"))
    composed = ab.join(bc, [*group, "_b", "label_b_composed"]).drop("_b")
    return composed.join(ac, [*group, "index_a", "label_a"], "left").withColumn(
        "cycle_agrees", F.col("label_c_composed") == F.col("label_c_direct")
    )


def cycle_detail(checks: DataFrame) -> DataFrame:
    """Comparable cycles only."""
    return checks.where(F.col("label_c_direct").isNotNull())


def cycle_summary(checks: DataFrame, matches: DataFrame, triplets: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts and agreement per triplet of consecutive sessions.

    ``triplets`` has ``group`` and ``index_a``. A triplet with an empty match table counts zero.
    """
    group = list(group)
    sizes = matches.groupBy(*group, "index_a", "index_b").agg(F.count(F.lit(1)).alias("_n"))
    full = None
    for shift, gap in ((0, 1), (1, 1), (0, 2)):
        part = sizes.where(F.col("index_b") - F.col("index_a") == gap).select(
            *group, (F.col("index_a") - shift).alias("index_a")
        )
        full = part if full is None else full.join(part, [*group, "index_a"], "left_semi")
    counted = checks.groupBy(*group, "index_a").agg(
        F.count(F.lit(1)).alias("n_composed"),
        F.count("label_c_direct").alias("n_comparable"),
        F.count(F.when(F.col("cycle_agrees"), 1)).alias("n_agree"),
    ).join(full, [*group, "index_a"], "left_semi")
    out = triplets.join(counted, [*group, "index_a"], "left").na.fill(0, ["n_composed", "n_comparable", "n_agree"])
    return out.withColumn("agreement", F.try_divide("n_agree", F.when(F.col("n_comparable") > 0, F.col("n_comparable"))))


def add_cycle_metadata(tracks: DataFrame, track_nodes: DataFrame, detail: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per-track cycle counts, conflict flag and its effect on the review columns."""
    group = list(group)
    track = [*group, "track_session", "track_label"]
    owned = detail.join(
        track_nodes.select(*track, F.col("session_index").alias("index_a"), F.col("label").alias("label_a")),
        [*group, "index_a", "label_a"],
    ).groupBy(*track).agg(
        F.count(F.lit(1)).alias("n_cycle_comparable"), F.count(F.when(F.col("cycle_agrees"), 1)).alias("n_cycle_agree")
    )
    out = tracks.join(owned, track, "left").na.fill(0, ["n_cycle_comparable", "n_cycle_agree"])
    checked = F.col("n_cycle_comparable") > 0
    out = (
        out.withColumn("cycle_agreement_fraction", F.when(checked, F.col("n_cycle_agree") / F.col("n_cycle_comparable")))
        .withColumn("has_cycle_conflict", checked & (F.col("n_cycle_agree") < F.col("n_cycle_comparable")))
        .withColumn("cycle_unchecked", ~checked)
    )
    reasons = F.concat_ws(
        ",", F.when(F.col("review_reasons") != "", F.col("review_reasons")),
        F.when(F.col("has_cycle_conflict"), "cycle_conflict"),
    )
    return out.withColumn("review_required", F.col("review_required") | F.col("has_cycle_conflict")).withColumn(
        "review_reasons", reasons
    )


def edge_agreement(edges: DataFrame, balanced: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Label graph edges ``consensus`` when the balanced policy has them too, else ``graph_only``."""
    keys = [*group, "index_a", "index_b", "label_a", "label_b"]
    other = balanced.select(*keys).distinct().withColumn("agrees_with_affine_balanced", F.lit(True))
    out = edges.join(other, keys, "left").na.fill(False, ["agrees_with_affine_balanced"])
    return out.withColumn(
        "agreement_status", F.when(F.col("agrees_with_affine_balanced"), "consensus").otherwise("graph_only")
    )


def track_agreement(tracks: DataFrame, track_nodes: DataFrame, labelled: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per track: accepted edges by agreement, and the track's source label."""
    group = list(group)
    track = [*group, "track_session", "track_label"]
    owned = labelled.where("accepted_for_track").join(
        track_nodes.select(*track, F.col("session_index").alias("index_a"), F.col("label").alias("label_a")),
        [*group, "index_a", "label_a"],
    ).groupBy(*track).agg(
        F.count(F.lit(1)).alias("n_accepted_graph_edges"),
        F.count(F.when(F.col("agreement_status") == "consensus", 1)).alias("n_consensus_edges"),
        F.count(F.when(F.col("agreement_status") == "graph_only", 1)).alias("n_graph_only_edges"),
    )
    counts = ["n_accepted_graph_edges", "n_consensus_edges", "n_graph_only_edges"]
    out = tracks.join(owned, track, "left").na.fill(0, counts)
    accepted = F.col("n_accepted_graph_edges")
    return (
        out.withColumn("consensus_edge_fraction", F.when(accepted > 0, F.col("n_consensus_edges") / accepted))
        .withColumn("has_graph_only_edge", F.col("n_graph_only_edges") > 0)
        .withColumn(
            "track_match_source",
            F.when(accepted == 0, "unmatched").when(F.col("n_graph_only_edges") > 0, "graph_only").otherwise("consensus"),
        )
    )


def wide_tracks(track_nodes: DataFrame, sessions: dict[int, str], group: Sequence[str] = ()) -> DataFrame:
    """Export form: one ``{session}_roi`` column per session, with the sessions given by the manifest."""
    track = [*group, "track_session", "track_label"]
    return track_nodes.groupBy(*track).agg(*[
        F.max(F.when(F.col("session_index") == i, F.col("label"))).alias(f"{name}_roi") for i, name in sessions.items()
    ])


def long_tracks(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Back from the export form: one row per observed session."""
    columns = [c for c in wide.columns if c.endswith("_roi")]
    long = wide.unpivot(list(keys), columns, "session_id", "label")
    return long.withColumn("session_id", F.regexp_replace("session_id", "_roi$", "")).where(F.col("label").isNotNull())


def unique_owner(track_nodes: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Nodes that belong to more than one track; empty for a valid track table."""
    node = [*group, "session_index", "label"]
    return track_nodes.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


__all__ = [
    "path_heads", "build_tracks", "legacy_tracks", "legacy_track_table", "track_table", "cluster_ids", "track_lengths",
    "length_thresholds", "cycle_checks", "cycle_detail", "cycle_summary", "add_cycle_metadata", "edge_agreement",
    "track_agreement", "wide_tracks", "long_tracks", "unique_owner",
]
