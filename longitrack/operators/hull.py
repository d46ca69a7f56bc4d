"""Solidity of a projected region: its area over the area of its convex hull."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _half(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """One chain of the convex hull of sorted points."""
    chain: list[tuple[float, float]] = []
    for p in points:
        while len(chain) > 1:
            (ay, ax), (by, bx) = chain[-2], chain[-1]
            if (by - ay) * (p[1] - ax) - (bx - ax) * (p[0] - ay) > 0:
                break
            chain.pop()
        chain.append(p)
    return chain


def hull_pixels(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
    """Pixel centres inside the hull of the pixel edge midpoints, from the extent of every row."""
    corners = set()
    for y, a, b in zip(rows.tolist(), low.tolist(), high.tolist()):
        corners.update([(y - 0.5, a), (y + 0.5, a), (y, a - 0.5), (y - 0.5, b), (y + 0.5, b), (y, b + 0.5)])
    ordered = sorted(corners)
    left = np.array(_half(ordered))
    right = np.array(_half(ordered[::-1]))[::-1]
    ys = np.arange(int(rows.min()), int(rows.max()) + 1, dtype=float)
    one = np.interp(ys, left[:, 0], left[:, 1])
    two = np.interp(ys, right[:, 0], right[:, 1])
    start = np.ceil(np.minimum(one, two) - 1e-9)
    stop = np.floor(np.maximum(one, two) + 1e-9)
    return int(np.maximum(0, stop - start + 1).sum())


def solidity(voxels: DataFrame, by: Sequence[str] = ("session_id", "label")) -> DataFrame:
    """Projected area, hull area and solidity per region.

    The hull only depends on the first and last pixel of every row. These are aggregated first, so
    the grouped function sees at most as many rows per region as the image has lines.
    """
    by = list(by)
    lines = voxels.select(*by, "y", "x").distinct().groupBy(*by, "y").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")
    )
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in lines.select(*by).schema)}, proj_area_px long, hull_area_px long, solidity double"

    def region(group: pd.DataFrame) -> pd.DataFrame:
        area = int(group["n"].sum())
        hull = hull_pixels(group["y"].to_numpy(), group["low"].to_numpy(), group["high"].to_numpy())
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in by}, "proj_area_px": [area], "hull_area_px": [hull], "solidity": [area / hull]})

    return lines.groupBy(*by).applyInPandas(region, schema)
