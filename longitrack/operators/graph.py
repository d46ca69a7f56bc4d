"""Spatial-graph refinement: support of a candidate by the anchors around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longitrack.operators.assignment import GRAPH_ORDER, greedy_keys
from longitrack.operators.candidates import PAIR
from longitrack.operators.ordering import global_rank
from longitrack.operators.spatial import (
    AXES, LEAF_POINTS, MARGIN, bounding_box, box_distance, located, morton, packed_index, packed_leaves, start_level, start_nodes,
)
from longitrack.params import GraphParams
from longitrack.session import materialise

# Coordinates in the second session, where a row has those of both.
OTHER = ("other_z_um", "other_y_um", "other_x_um")


def anchor_filter(high_matches: DataFrame, params: GraphParams = GraphParams()) -> DataFrame:
    """High matches that are certain enough to support others."""
    rows = high_matches.where(
        (F.col("dice") >= params.anchor_min_dice)
        & (F.col("distance_um") <= params.anchor_max_um)
        & (F.col("area_ratio") >= params.anchor_min_area_ratio)
        & (F.col("ambiguity") <= params.anchor_max_ambiguity)
    )
    if params.anchor_needs_overlap:
        rows = rows.where(F.col("candidate_source").isin("both", "mutual_overlap"))
    return rows


def graph_anchors(high_matches: DataFrame, params: GraphParams = GraphParams(), pair: Sequence[str] = PAIR) -> DataFrame:
    """Anchors with their 0-based rank within the pair."""
    order = [F.desc("score"), F.desc("dice"), F.asc("distance_um"), F.asc("label_a"), F.asc("label_b")]
    ranked = global_rank(anchor_filter(high_matches, params), order, pair, out="anchor_rank")
    return ranked.withColumn("anchor_rank", F.col("anchor_rank") - 1).withColumn("is_graph_anchor", F.lit(True))


def _placed(pairs: DataFrame, a: DataFrame, b: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Attach both aligned positions: that in the first session under the plain names of the axes, the other under ``OTHER``."""
    side_a = a.select(*pair, F.col("label").alias("label_a"), *AXES)
    side_b = b.select(*pair, F.col("label").alias("label_b"), *[F.col(x).alias(o) for x, o in zip(AXES, OTHER)])
    return (
        pairs.select(*pair, "label_a", "label_b").join(side_a, [*pair, "label_a"]).join(side_b, [*pair, "label_b"])
    )


def _apart(anchor: Column, axes: Sequence[str]) -> Column:
    """Distance of the candidate from an anchor along ``axes``."""
    square = None
    for axis in axes:
        d = F.col(axis) - anchor[axis]
        square = d * d if square is None else square + d * d
    return F.sqrt(square)


def local_anchors(placed: DataFrame, anchors: DataFrame, params: GraphParams, pair: Sequence[str]) -> DataFrame:
    """Per candidate and tree node with local anchors: ``_local``, their number, and ``_close``, those among them
    that may be one of the nearest few in either session, as (``anchor_a``, ``d_a``, ``d_b``, ``residual``).

    Local anchors lie within the radius in both sessions. The anchors are packed along the Morton curve of their places
    in the first session, with bounds in both. A node outside either ball is left, one inside both whose
    places are all farther than the nearest few is counted as a whole, and only leaves between are opened.
    """
    k, radius = params.neighbours, params.radius_um
    keys = [*pair, "label_a", "label_b"]
    everywhere = [*AXES, *OTHER]
    points = materialise(anchors.select(*pair, F.col("label_a").alias("anchor_a"), *everywhere))
    box = bounding_box(points, pair)
    frame = [*[f"_min_{a}" for a in AXES], "_extent"]
    leaves = packed_leaves(points.join(box, pair).withColumn("_key", morton()).drop(*frame), pair, LEAF_POINTS, ["anchor_a"], OTHER)
    steps, top = packed_index(leaves, pair, everywhere)

    # Three places on the curve: that of the candidate and those of the corners of its ball.
    reach = radius * (1 + MARGIN) + F.col("_extent") * MARGIN
    probes = placed.join(box, pair).withColumn("_end", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    probes = probes.select(
        *keys, *everywhere, "_end", morton(F.col("_end") * reach).alias("_probe"), F.when(F.col("_end") < 0, -1).otherwise(1).alias("_side"),
        F.xxhash64("label_a", "label_b", "_end").alias("_id"))
    found = located(probes, leaves, pair).groupBy(*keys, *everywhere).agg(
        F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.max(F.when(F.col("_end") == 0, F.col("_at"))).alias("_home"))
    near, near_other = (lambda p: _apart(p, AXES)), (lambda p: _apart(p, OTHER))

    def local(p: Column) -> Column:
        return (near(p) <= radius) & (near_other(p) <= radius)

    at_home = found.join(leaves.select(*pair, F.col("_leaf").alias("_home"), "_points"), [*pair, "_home"])
    within = F.filter("_points", local)

    def least(far) -> Column:
        """The k-th least distance among the local anchors of the home leaf, else the radius."""
        return F.coalesce(F.get(F.sort_array(F.transform(within, far)), F.lit(k - 1)), F.lit(float(radius)))

    start = materialise(at_home.select(
        *keys, *everywhere, "_from", "_to", least(near).alias("_bound"), least(near_other).alias("_bound_other"), start_level(top).alias("_level")))
    own = [*keys, *everywhere, "_bound", "_bound_other"]
    begun = start.withColumn("_node", F.explode(start_nodes())).select(*own, "_level", "_node")
    limit = radius * radius * (1 + MARGIN)

    def touched(b: Column) -> Column:
        return (box_distance(b, AXES) <= limit) & (box_distance(b, OTHER) <= limit)

    def whole(b: Column) -> Column:
        """Inside both balls, and beyond both bounds."""
        inner, beyond = radius * radius * (1 - MARGIN), 1 + MARGIN
        return (
            (box_distance(b, AXES, farthest=True) <= inner) & (box_distance(b, OTHER, farthest=True) <= inner)
            & (box_distance(b, AXES) > F.col("_bound") * F.col("_bound") * beyond)
            & (box_distance(b, OTHER) > F.col("_bound_other") * F.col("_bound_other") * beyond))

    counted, open_ = None, None
    for j in range(top, 0, -1):
        here = begun.where(F.col("_level") == j).drop("_level")
        here = here if open_ is None else here.unionByName(open_)
        stepped = here.join(steps.where(F.col("_level") == j).select(*pair, "_node", "_kids"), [*pair, "_node"])
        stepped = stepped.withColumn("_kid", F.explode(F.filter("_kids", touched))).withColumn("_whole", whole(F.col("_kid")))
        stepped = stepped if j == 1 else materialise(stepped)
        sums = stepped.where("_whole").groupBy(*keys).agg(F.sum("_kid._n").alias("_local"))
        counted = sums if counted is None else counted.unionByName(sums)
        open_ = stepped.where(~F.col("_whole")).select(*own, F.col("_kid._node").alias("_node"))
    opened = open_.join(leaves.select(*pair, F.col("_leaf").alias("_node"), "_points"), [*pair, "_node"]).withColumn("_within", within)
    shift = [F.col(o) - F.col(x) for x, o in zip(AXES, OTHER)]

    def described(p: Column) -> Column:
        square = None
        for own_shift, x, o in zip(shift, AXES, OTHER):
            d = p[x] - p[o] + own_shift
            square = d * d if square is None else square + d * d
        return F.struct(p["anchor_a"].alias("anchor_a"), near(p).alias("d_a"), near_other(p).alias("d_b"), F.sqrt(square).alias("residual"))

    close = F.filter("_within", lambda p: (near(p) <= F.col("_bound")) | (near_other(p) <= F.col("_bound_other")))
    opened = opened.select(*keys, F.size("_within").cast("long").alias("_local"), F.transform(close, described).alias("_close"))
    return opened.unionByName(counted, allowMissingColumns=True)


def graph_support(
    candidates: DataFrame, anchors: DataFrame, a: DataFrame, b: DataFrame, params: GraphParams = GraphParams(),
    pair: Sequence[str] = PAIR,
) -> DataFrame:
    """Support figures per candidate with at least one local anchor.

    Local anchors lie within the radius of the candidate in both sessions. The support set is the
    intersection of the nearest few local anchors in the first and in the second session; its share is that of
    all local anchors, which are counted by ``local_anchors`` without being listed.
    """
    pair = list(pair)
    keys = [*pair, "label_a", "label_b"]
    found = local_anchors(_placed(candidates, a, b, pair), _placed(anchors, a, b, pair), params, pair)
    # The number of a node goes with the first of its close anchors.
    rows = found.select(*keys, "_local", F.posexplode_outer("_close").alias("_at", "_near")).select(
        *keys, F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, F.col("_local")).otherwise(0).alias("_local"), "_near.*")
    candidate = W.partitionBy(*keys)
    few = params.neighbours
    ranked = (
        rows.withColumn("_ra", F.row_number().over(candidate.orderBy(F.asc_nulls_last("d_a"), "anchor_a")))
        .withColumn("_rb", F.row_number().over(candidate.orderBy(F.asc_nulls_last("d_b"), "anchor_a")))
        .withColumn("_residual", F.when((F.col("_ra") <= few) & (F.col("_rb") <= few), F.col("residual")))
    )
    return ranked.groupBy(*keys).agg(
        F.count("_residual").alias("graph_support_count"),
        (F.count("_residual") / F.nullif(F.sum("_local"), F.lit(0))).alias("graph_support_fraction"),
        F.percentile("_residual", F.lit(0.5)).alias("graph_residual_median_um"),
        F.avg("_residual").alias("graph_residual_mean_um"),
        F.percentile("_residual", F.lit(0.9)).alias("graph_residual_p90_um"),
        F.avg((F.col("_residual") <= params.inlier_um).cast("double")).alias("graph_inlier_fraction"),
        F.sum("_local").alias("_local"),
    ).where(F.col("_local") > 0).drop("_local")


def graph_scores(
    candidates: DataFrame, anchors: DataFrame, a: DataFrame, b: DataFrame, params: GraphParams = GraphParams(),
    pair: Sequence[str] = PAIR,
) -> DataFrame:
    """Status, graph score and refined score of every candidate."""
    pair = list(pair)
    keys = [*pair, "label_a", "label_b"]
    balanced = candidates.where("balanced_rule")
    anchor_keys = anchors.select(*keys).withColumn("is_graph_anchor", F.lit(True))
    has_anchor = anchors.select(*pair).distinct().withColumn("_pair_anchored", F.lit(True))
    plain = balanced.join(anchor_keys, keys, "left_anti")
    support = graph_support(plain, anchors, a, b, params, pair)
    joined = candidates.join(anchor_keys, keys, "left").join(has_anchor, pair, "left").join(support, keys, "left")
    anchor = F.col("balanced_rule") & F.coalesce(F.col("is_graph_anchor"), F.lit(False))
    scored = F.col("graph_support_count") >= params.min_support
    status = (
        F.when(~F.col("balanced_rule"), "not_balanced")
        .when(F.col("_pair_anchored").isNull(), "no_anchor_fallback")
        .when(anchor, "anchor")
        .when(scored, "scored")
        .otherwise("insufficient_support")
    )
    median = F.col("graph_residual_median_um") / params.residual_scale_um
    support_term = F.least(F.lit(1.0), F.col("graph_support_count") / params.min_support)
    graph_score = support_term * F.exp(-(median * median)) * (0.5 + 0.5 * F.col("graph_inlier_fraction"))
    out = joined.withColumn("graph_status", status).withColumn("is_graph_anchor", anchor)
    for c in ("graph_residual_median_um", "graph_residual_mean_um", "graph_residual_p90_um", "graph_inlier_fraction"):
        out = out.withColumn(c, F.when(F.col("graph_status") == "scored", F.col(c)))
    return (
        out.withColumn("base_score", F.col("score"))
        .withColumn("graph_rule", F.col("balanced_rule"))
        .withColumn("graph_support_count", F.coalesce("graph_support_count", F.lit(0)))
        .withColumn("graph_support_fraction", F.coalesce("graph_support_fraction", F.lit(0.0)))
        .withColumn(
            "graph_score", F.when(anchor, 1.0).when(F.col("graph_status") == "scored", graph_score)
        )
        .withColumn(
            "refined_score",
            F.when(
                F.col("graph_status") == "scored",
                (1.0 - params.weight) * F.col("base_score") + params.weight * F.col("graph_score"),
            ).otherwise(F.col("base_score")),
        )
        .drop("_pair_anchored")
    )


def graph_assignment(
    scored: DataFrame, pair: Sequence[str] = PAIR, fallback: DataFrame | None = None,
) -> DataFrame:
    """Lock the anchors, then assign the rest greedily by refined score.

    A pair without anchors keeps its balanced candidates as they are, or only those that are among
    the ``fallback`` matches (the balanced one-to-one matches, in a full run).
    """
    pair = list(pair)
    keys = [*pair, "label_a", "label_b"]
    rows = materialise(scored.where("graph_rule"))
    anchored = rows.where(F.col("graph_status") != "no_anchor_fallback")
    baseline = rows.where(F.col("graph_status") == "no_anchor_fallback")
    if fallback is not None:
        baseline = baseline.join(fallback.select(*keys), keys, "left_semi").withColumn(
            "graph_status", F.lit("baseline_fallback")
        )
    baseline = baseline.withColumn("assignment_source", F.lit("baseline_fallback"))
    locked = anchored.where("is_graph_anchor").withColumn("assignment_source", F.lit("locked_anchor"))
    free = materialise(
        anchored.join(locked.select(*pair, "label_a"), [*pair, "label_a"], "left_anti").join(
            locked.select(*pair, "label_b"), [*pair, "label_b"], "left_anti"
        )
    )
    refined = free.join(greedy_keys(free, GRAPH_ORDER, pair), keys, "left_semi").withColumn(
        "assignment_source", F.lit("graph_refined")
    )
    out = baseline.unionByName(locked).unionByName(refined)
    return out.withColumn("assignment_policy", F.lit("graph")).withColumn("match_policy", F.lit("graph"))


def compare_matches(balanced: DataFrame, graph: DataFrame, pair: Sequence[str] = PAIR) -> DataFrame:
    """Full outer comparison of two match sets, with the pair keys."""
    keys = [*pair, "label_a", "label_b"]
    left = balanced.select(*keys).distinct().withColumn("in_balanced", F.lit(True))
    right = graph.select(*keys).distinct().withColumn("in_graph", F.lit(True))
    merged = left.join(right, keys, "full_outer").na.fill(False, ["in_balanced", "in_graph"])
    return merged.withColumn("changed", F.col("in_balanced") != F.col("in_graph"))
