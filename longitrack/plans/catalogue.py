"""All catalogue queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from longitrack.plans import (
    catalogue_matching,
    catalogue_ratio,
    catalogue_voxels,
    sql_matching,
    sql_ratio,
    sql_voxels,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**catalogue_ratio.QUERIES, **catalogue_matching.QUERIES, **catalogue_voxels.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**sql_ratio.SQL, **sql_matching.SQL, **sql_voxels.SQL}
