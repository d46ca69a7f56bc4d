"""Nearest-neighbour and radius joins of 3D points.

``knn_join`` is exact and adapts to the density: targets are sorted along a Morton curve and cut into leaves of a
bounded number of points, so no cell, however crowded, is ever paired with itself as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longitrack.operators.ordering import cumulative, global_rank
from longitrack.session import materialise

AXES = ("z_um", "y_um", "x_um")
LEAF_POINTS = 64
# Bits of a Morton key per axis, and steps of three bits (one octant each) between the levels of the index.
BITS = 21
FAN = 8
# Shifts and masks that spread 21 bits to every third place.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
# Far below any real distance; covers rounding where a distance is compared with that to a box.
MARGIN = 1e-9


def distance(a: str = "a", b: str = "b") -> Column:
    """Euclidean distance of the points in structs or aliases ``a`` and ``b``."""
    square = None
    for axis in AXES:
        d = F.col(f"{a}.{axis}") - F.col(f"{b}.{axis}")
        square = d * d if square is None else square + d * d
    return F.sqrt(square)


def morton(shift: Column | None = None) -> Column:
    """Morton key of the row's point, moved by ``shift`` along all axes and into the box of its group.

    Cells are monotone in every axis, so the keys of two corners bound those of all points between them.
    """
    key = None
    for i, axis in enumerate(AXES):
        place = F.col(axis) if shift is None else F.col(axis) + shift
        cell = F.floor((place - F.col(f"_min_{axis}")) / F.col("_extent") * (1 << BITS))
        cell = F.least(F.greatest(cell, F.lit(0).cast("long")), F.lit((1 << BITS) - 1).cast("long"))
        for by, mask in _SPREAD:
            cell = cell.bitwiseOR(F.shiftleft(cell, by)).bitwiseAND(F.lit(mask))
        cell = F.shiftleft(cell, 2 - i)
        key = cell if key is None else key.bitwiseOR(cell)
    return key


def _distance_to(point: Column) -> Column:
    """Distance of the row's coordinates from those in a struct."""
    square = None
    for axis in AXES:
        d = F.col(axis) - point[axis]
        square = d * d if square is None else square + d * d
    return F.sqrt(square)


def box_distance(bounds: Column, axes: Sequence[str] = AXES, farthest: bool = False) -> Column:
    """Squared distance of the row's ``axes`` from the nearest, or to the farthest, point of a box."""
    square = None
    for axis in axes:
        low, high, at = bounds[f"_low_{axis}"], bounds[f"_high_{axis}"], F.col(axis)
        out = F.greatest(F.abs(at - low), F.abs(at - high)) if farthest else F.greatest(low - at, at - high, F.lit(0.0))
        square = out * out if square is None else square + out * out
    return square


def bounding_box(points: DataFrame, by: list[str]) -> DataFrame:
    """A written table of the cube around the points of every group: least corner and ``_extent``."""
    return materialise(points.groupBy(*by).agg(
        *[F.min(a).alias(f"_min_{a}") for a in AXES],
        F.greatest(*[F.max(a) - F.min(a) for a in AXES], F.lit(1e-9)).alias("_extent"),
    ))


def packed_leaves(
    points: DataFrame, by: list[str], leaf_points: int, payload: Sequence[str], more_axes: Sequence[str] = (),
) -> DataFrame:
    """Leaves (``by``, ``_leaf`` from 0, ``_key`` of the first point, ``_n``, bounds, ``_points``) along the curve.

    ``points`` have their ``_key``; ``payload`` names what a point keeps beside its coordinates, and
    makes the order strict. All leaves but the last hold ``leaf_points``; the last one holds less than twice as
    many, and at least as many if the group does. ``more_axes`` are bounded as well.
    """
    axes = [*AXES, *more_axes]
    ranked = global_rank(points, [F.col("_key"), *[F.col(c) for c in (*axes, *payload)]], by, out="_rank")
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    last = F.greatest(F.floor(F.col("_size") / leaf_points) - 1, F.lit(0).cast("long"))
    leaf = F.least(F.floor((F.col("_rank") - 1) / leaf_points), last)
    return materialise(
        ranked.join(sizes, by).withColumn("_leaf", leaf).groupBy(*by, "_leaf").agg(
            F.min("_key").alias("_key"), F.count(F.lit(1)).alias("_n"),
            *[F.min(a).alias(f"_low_{a}") for a in axes], *[F.max(a).alias(f"_high_{a}") for a in axes],
            F.collect_list(F.struct(*axes, *payload)).alias("_points"),
        )
    )


def packed_index(leaves: DataFrame, by: list[str], axes: Sequence[str] = AXES) -> tuple[DataFrame, int]:
    """Steps (``by``, ``_level``, ``_node``, ``_kids``) from a node to its at most ``FAN`` children, and the top level.

    Node n of a level holds the nodes ``FAN`` n to ``FAN`` n + ``FAN`` - 1 of the level below; level 0 are the leaves.
    """
    bounds = [*[f"_low_{a}" for a in axes], *[f"_high_{a}" for a in axes]]
    own = leaves.select(*by, F.col("_leaf").alias("_node"), "_n", *bounds)
    last = own.agg(F.max("_node")).first()[0] or 0
    steps, level = None, 0
    while last > 0 or level == 0:
        level, last = level + 1, last // FAN
        # Every level is FAN times smaller than the one below, which may as well be summed up again.
        above = own.groupBy(*by, F.floor(F.col("_node") / FAN).alias("_up")).agg(
            F.sum("_n").alias("_sum"), *[(F.min(n) if n.startswith("_low") else F.max(n)).alias(f"{n}_") for n in bounds],
            F.collect_list(F.struct("_node", "_n", *bounds)).alias("_kids"),
        )
        own = above.select(*by, F.col("_up").alias("_node"), F.col("_sum").alias("_n"), *[F.col(f"{n}_").alias(n) for n in bounds])
        found = above.select(*by, F.lit(level).alias("_level"), F.col("_up").alias("_node"), "_kids")
        steps = found if steps is None else steps.unionByName(found)
    return materialise(steps), level


def start_level(top: int) -> Column:
    """The lowest level at which the leaves ``_from`` to ``_to`` lie in at most ``FAN`` nodes."""
    level = F.lit(top)
    for j in range(top - 1, 0, -1):
        span = F.floor(F.col("_to") / FAN ** j) - F.floor(F.col("_from") / FAN ** j)
        level = F.when(span < FAN, j).otherwise(level)
    return level


def start_nodes() -> Column:
    """The nodes of ``_level`` that hold the leaves ``_from`` to ``_to``."""
    size = F.pow(F.lit(float(FAN)), F.col("_level"))
    return F.sequence(*[F.floor(F.col(c) / size).cast("long") for c in ("_from", "_to")])


def located(probes: DataFrame, leaves: DataFrame, by: list[str]) -> DataFrame:
    """``probes`` with ``_at``: the last leaf whose first key lies at or before ``_probe``, or strictly before it for
    probes of ``_side`` -1. Before the first leaf it is that one. ``_id`` makes the order of probes strict."""
    marks = leaves.select(*by, F.col("_key").alias("_probe"), F.lit(0).alias("_side"), F.col("_leaf").alias("_id"))
    both = probes.unionByName(marks, allowMissingColumns=True)
    count = cumulative(both, [F.col("_probe"), F.col("_side"), F.col("_id")], by, weight=F.when(F.col("_side") == 0, 1).otherwise(0), out="_count")
    return count.where(F.col("_side") != 0).withColumn("_at", F.greatest(F.col("_count") - 1, F.lit(0).cast("long"))).drop("_count")


def knn_join(
    queries: DataFrame, targets: DataFrame, k: int, by: Sequence[str] = (), leaf_points: int = LEAF_POINTS,
) -> DataFrame:
    """The ``k`` nearest targets of every query point within the same ``by`` group.

    Both inputs have a ``label``, unique in its group, and the three coordinates. Ties go to the lower
    target label. Result: ``by``, ``label``, ``rank`` (from 1), ``neighbour`` and ``distance_um``. Points with a
    missing coordinate neither find nor are found.

    Equal target positions are merged first, keeping the ``k`` lowest labels, which is all a
    nearest-``k`` list can use. A query starts in the leaf that its own place on the Morton curve falls into; the k-th
    distance there bounds the search. The keys of the two corners of that ball bound the keys of all closer
    points, hence a range of leaves. From the lowest level at which this range has few nodes, the search goes
    down to the leaves whose boxes the ball touches. Only balls across a high border of the
    curve start high, and no step is an explosion over levels.
    """
    by = list(by)
    if not by:
        return knn_join(
            queries.withColumn("_all", F.lit(0)), targets.withColumn("_all", F.lit(0)), k, ["_all"], leaf_points
        ).drop("_all")
    leaf_points = max(leaf_points, k)
    whole = F.lit(True)
    for axis in AXES:
        whole = whole & F.col(axis).isNotNull() & ~F.isnan(axis)
    place = W.partitionBy(*by, *AXES).orderBy("label")
    merged = materialise(
        targets.where(whole).select(*by, "label", *AXES)
        .withColumn("_r", F.row_number().over(place))
        .where(F.col("_r") <= k)
        .groupBy(*by, *AXES)
        .agg(F.sort_array(F.collect_list("label")).alias("_labels"))
    )
    box = bounding_box(merged, by)
    frame = [*[f"_min_{a}" for a in AXES], "_extent"]
    leaves = packed_leaves(merged.join(box, by).withColumn("_key", morton()).drop(*frame), by, leaf_points, ["_labels"])
    steps, top = packed_index(leaves, by)

    own = [*by, "label", *AXES]
    asked = queries.where(whole).select(*own).join(box, by)
    named = F.col("label").cast("long").alias("_id")
    home = located(asked.select("*", morton().alias("_probe"), F.lit(1).alias("_side"), named), leaves, by)
    near = F.sort_array(F.transform("_points", _distance_to))
    bounded = home.join(leaves.select(*by, F.col("_leaf").alias("_at"), "_points"), [*by, "_at"]).select(
        *own, *frame, F.get(near, F.lit(k - 1)).alias("_bound"))
    # A group with fewer than k positions is one leaf, which its queries search whole.
    reach = F.col("_bound") * (1 + MARGIN) + F.col("_extent") * MARGIN
    ends = bounded.withColumn("_end", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn(
        "_probe", F.when(F.col("_bound").isNull(), 0).otherwise(morton(F.col("_end") * reach)))
    ends = ends.select(*own, "_bound", "_probe", F.col("_end").alias("_side"), named)
    ranges = located(ends, leaves, by).groupBy(*own, "_bound").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    start = materialise(ranges.withColumn("_level", start_level(top)))
    begun = start.withColumn("_node", F.explode(start_nodes())).select(*own, "_bound", "_level", "_node")
    open_, limit = None, F.col("_bound") * F.col("_bound") * (1 + MARGIN)
    for j in range(top, 0, -1):
        here = begun.where(F.col("_level") == j).drop("_level")
        here = here if open_ is None else here.unionByName(open_)
        stepped = here.join(steps.where(F.col("_level") == j).select(*by, "_node", "_kids"), [*by, "_node"])
        stepped = stepped.withColumn("_kid", F.explode(F.filter("_kids", lambda b: F.coalesce(box_distance(b) <= limit, F.lit(True)))))
        open_ = stepped.select(*own, "_bound", F.col("_kid._node").alias("_node"))
    pairs = open_.withColumnRenamed("_node", "_leaf").join(leaves.select(*by, "_leaf", "_points"), [*by, "_leaf"])
    close = F.filter("_points", lambda p: F.coalesce(_distance_to(p) <= F.col("_bound") * (1 + MARGIN), F.lit(True)))
    found = pairs.select(*own, F.explode(close).alias("t")).select(
        *by, "label", _distance_to(F.col("t")).alias("distance_um"), F.explode("t._labels").alias("neighbour"))
    order = W.partitionBy(*by, "label").orderBy("distance_um", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def radius_join(
    left: DataFrame, right: DataFrame, radius: float | Column, cell_size: float, by: Sequence[str] = (),
    axes: Sequence[str] = AXES,
) -> DataFrame:
    """All pairs within ``radius`` (at most ``cell_size``), as structs ``a`` and ``b`` with the distance.

    The right side is copied to the neighbouring cells, so that the pairs come from an equi-join on
    the cell; a crowded cell is one join key, which adaptive execution splits.
    """
    by = list(by)
    size = F.lit(float(cell_size))
    names = [f"_g{i}" for i in range(len(axes))]
    here = left.select(F.struct("*").alias("a"), *by, *[F.floor(F.col(x) / size).alias(n) for x, n in zip(axes, names)])
    there = right.select(F.struct("*").alias("b"), *by, *[F.floor(F.col(x) / size).alias(n) for x, n in zip(axes, names)])
    for n in names:
        there = there.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    square = None
    for x in axes:
        d = F.col(f"a.{x}") - F.col(f"b.{x}")
        square = d * d if square is None else square + d * d
    joined = here.join(there, [*by, *names]).withColumn("distance_um", F.sqrt(square))
    return joined.where(F.col("distance_um") <= radius).drop(*names)
