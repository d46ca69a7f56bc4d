"""Ranks and exact quantiles that never sort a whole table, or a hot group, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longitrack.session import materialise

LARGEST = (1 << 63) - 1


def cumulative(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), weight: Column | None = None,
    out: str = "cum", partitions: int | None = None,
) -> DataFrame:
    """Add ``out``: the running sum of ``weight`` (default 1) over ``order`` within each ``by`` group.

    ``order`` must be a strict total order within a group. The rows are range-partitioned by
    (``by``, ``order``), so a hot group spreads over many partitions; each partition is summed on
    its own and shifted by the totals of the partitions before it. Only one row per (group,
    partition) meets in a single window. The range-partitioned rows are written once, because a
    partition number may not be computed twice.
    """
    by = list(by)
    weight = F.lit(1) if weight is None else weight
    keys = [*[F.col(c) for c in by], *order]
    weighted = df.withColumn("_w", weight.cast("long"))
    # Without a given number the session's setting applies and adaptive execution joins small neighbours.
    ranged = weighted.repartitionByRange(partitions, *keys) if partitions else weighted.repartitionByRange(*keys)
    ranged = materialise(ranged.withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_pid").agg(F.sum("_w").alias("_total"))
    before = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_pid", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    if by:
        keyed = ranged.alias("r").join(
            offsets.alias("o"),
            [F.col("r._pid") == F.col("o._pid")] + [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by],
        ).select("r.*", "o._offset")
    else:
        keyed = ranged.join(offsets, "_pid")
    local = W.partitionBy(*by, "_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return keyed.withColumn(out, F.col("_offset") + F.sum("_w").over(local)).drop("_w", "_pid", "_offset")


def global_rank(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "rank", partitions: int | None = None,
) -> DataFrame:
    """1-based position in the strict total order ``order``, within each ``by`` group."""
    return cumulative(df, order, by, out=out, partitions=partitions)


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a long that sorts like the double; both zeros are one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(LARGEST)))


def from_ordered_bits(bits: Column) -> Column:
    """The double whose ``ordered_bits`` these are."""
    raw = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(LARGEST)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def together(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null with null; the columns of ``left`` and those of ``right`` beside the keys."""
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def _digit(k: int) -> Column:
    """Digit k of 4 of the ordered bits, the highest first; that one has the sign."""
    shifted = F.shiftright(F.col("_b"), 48 - 16 * k)
    return shifted if k == 0 else shifted.bitwiseAND(F.lit(0xFFFF).cast("long"))


def _selected(bits: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """(``keys``, ``_size``, ``_t``, ``_v``): the values at the wanted positions.

    ``counts`` has the number ``_n`` of ``bits`` for every first ``_digit`` of a group, the ``_size`` of the group and
    ``_want``, an array of (t, rest) with positions from 0. Every pass narrows the positions down to one more digit.
    """
    open_ = counts.withColumn("_prefix", F.lit(0).cast("long"))
    for k in range(4):
        if k:
            shared = bits.withColumn("_prefix", F.shiftright(F.col("_b"), 64 - 16 * k))
            open_ = together(shared, open_.select(*keys, "_prefix", "_want", "_size"), [*keys, "_prefix"]).groupBy(
                *keys, "_prefix", _digit(k).alias("_digit")).agg(
                F.count(F.lit(1)).alias("_n"), F.any_value("_want").alias("_want"), F.any_value("_size").alias("_size"))
        upto = F.sum("_n").over(W.partitionBy(*keys, "_prefix").orderBy("_digit").rowsBetween(W.unboundedPreceding, 0))
        prefix = F.col("_digit") if k == 0 else F.shiftleft(F.col("_prefix"), 16).bitwiseOR(F.col("_digit"))
        below = F.col("_upto") - F.col("_n")
        inside = F.filter("_want", lambda w: (w["rest"] >= below) & (w["rest"] < F.col("_upto")))
        open_ = open_.withColumn("_upto", upto).select(
            *keys, "_size", prefix.alias("_prefix"),
            F.transform(inside, lambda w: F.struct(w["t"].alias("t"), (w["rest"] - below).alias("rest"))).alias("_want"),
        ).where(F.size("_want") > 0)
    return open_.select(*keys, "_size", from_ordered_bits(F.col("_prefix")).alias("_v"), F.explode("_want.t").alias("_t"))


def values_at(df: DataFrame, value: str, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(``by``, one column per position): the ``value`` at each of some positions of every group in ascending order.

    ``wanted`` has one row per group, whose further columns are positions from 0 within the rows of ``df``.
    The way is that of ``exact_quantiles``; ``df`` has no missing values.
    """
    by = list(by)
    names = [c for c in wanted.columns if c not in by]
    bits = materialise(df.select(*by, ordered_bits(F.col(value).cast("double")).alias("_b")))
    want = F.array(*[F.struct(F.lit(i).alias("t"), F.col(c).cast("long").alias("rest")) for i, c in enumerate(names)])
    counts = bits.groupBy(*by, _digit(0).alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
    counts = together(counts, wanted.select(*by, want.alias("_want"), F.lit(0).alias("_size")), by)
    found = _selected(bits, by, counts)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_t") == i, F.col("_v"))).alias(c) for i, c in enumerate(names)])


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per ``by`` group; missing values and NaN do not count.

    Selection by radix histograms: the values become longs that sort alike and are written once. Each of four
    passes counts one 16-bit digit of the values that share the digits found so far with a wanted position. A group
    has at most 65,536 counts for each such prefix, which the map side sums up, so neither a hot group nor
    a hot value moves as a whole, and one way serves every size. Without ``by`` an empty input gives one row of nulls.
    """
    by = list(by)
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    valid = F.col("_v").isNotNull() & ~F.isnan("_v")
    bits = materialise(
        rows.select(*keys, F.col(value).cast("double").alias("_v")).where(valid).select(*keys, ordered_bits(F.col("_v")).alias("_b")))

    counts = bits.groupBy(*keys, _digit(0).alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_size", F.sum("_n").over(W.partitionBy(*keys)))
    # The wanted positions of a group: two around every quantile, by number.
    at = [F.lit(p) * (F.col("_size") - 1) for p in probs.values()]
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("t"), rounded(position).alias("rest"))
                       for i, position in enumerate(at) for up, rounded in enumerate((F.floor, F.ceil))])
    found = _selected(bits, keys, counts.withColumn("_want", wanted))
    place = [[F.max(F.when(F.col("_t") == 2 * i + up, F.col("_v"))) for up in (0, 1)] for i in range(len(probs))]
    out = found.groupBy(*keys, "_size").agg(*[
        _between(low, high, p).alias(name) for (name, p), (low, high) in zip(probs.items(), place)])
    if by:
        return out.select(*by, *probs)
    one = bits.agg(F.count(F.lit(1)).alias("_count")).withColumn("_all", F.lit(0))
    return together(one, out.select("_all", *probs), ["_all"], "left").select(*probs)


def _between(low: Column, high: Column, p: float) -> Column:
    """Linear interpolation at the fractional position of quantile ``p``."""
    at = F.lit(p) * (F.col("_size") - 1)
    return low + (high - low) * (at - F.floor(at))
