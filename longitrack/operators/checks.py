"""Cardinality checks inside the plan of a join, for joins that must not multiply rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The rows of ``df``; running the plan fails, naming a key, if one occurs more than once (null counts as a key).

    The rows are grouped by the keys, which deals them as the join that follows needs them, so the check costs
    no job and no exchange of its own. As every row may be its key's only one, one row per key passes the
    map side; a key that repeats without end is one row after it.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = [F.any_value(F.struct(*rest)).alias("_row")] if rest else []
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *row)
    told = F.concat(F.lit(f"{what} has a repeated key ("), F.concat_ws(", ", *[
        F.concat(F.lit(f"{k} = "), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys]), F.lit(")"))
    single = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(told).cast("boolean"))
    return grouped.where(single).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", one_to_one: bool = False, what: str = "right side",
) -> DataFrame:
    """Join whose right side, and with ``one_to_one`` also its left side, has unique keys, or the plan fails."""
    on = list(on)
    return (unique(left, on, "left side") if one_to_one else left).join(unique(right, on, what), on, how)
