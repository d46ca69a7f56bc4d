"""Coarse shift between two sessions and the restricted affine transform fitted on seed pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from longitrack.operators.ordering import exact_quantiles, values_at
from longitrack.operators.spatial import radius_join
from longitrack.params import OverlapParams, Spacing
from longitrack.session import materialise

PAIR = ("day_a", "day_b")
# Coordinates of a seed in both sessions, and the products whose moments the fit needs.
PLACES = ("za", "ya", "xa", "zb", "yb", "xb")
MOMENTS = {
    "zz": ("zb", "zb"), "zt": ("zb", "za"), "yy": ("yb", "yb"), "xx": ("xb", "xb"), "yx": ("yb", "xb"),
    "yt": ("yb", "ya"), "xt": ("xb", "ya"), "yu": ("yb", "xa"), "xu": ("xb", "xa"),
}
SUMS = ["n", *[f"t_{c}" for c in PLACES], *[f"q_{k}" for k in MOMENTS]]
# Bins of residuals up to the largest one that may stay; one more holds all beyond.
BINS = 256


# --- image correlation: NumPy on one pair's projections, whose size is fixed by the microscope ----

def smooth(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian filter, mirrored at the borders and cut off at four sigma."""
    reach = int(4.0 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=axis)
        image = windows @ kernel
    return image


def subpixel_shift(a: np.ndarray, b: np.ndarray, factor: int) -> np.ndarray:
    """Shift of ``b`` onto ``a`` at the peak of their cross correlation, to 1/``factor`` pixel.

    The whole-pixel peak is refined by evaluating the inverse transform on a fine grid around it
    with two matrix products (Guizar-Sicairos et al. 2008).
    """
    spectrum = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    shape = np.array(a.shape)
    peak = np.array(np.unravel_index(np.argmax(np.abs(np.fft.ifft2(spectrum))), a.shape), dtype=float)
    middle = np.fix(shape / 2)
    peak[peak > middle] -= shape[peak > middle]
    if factor > 1:
        count = math.ceil(factor * 1.5)
        grid = np.arange(count) - np.fix(count / 2)
        fine = [peak[i] + grid / factor for i in (0, 1)]
        rows = np.exp(2j * np.pi * np.outer(fine[0], np.fft.fftfreq(a.shape[0])))
        columns = np.exp(2j * np.pi * np.outer(np.fft.fftfreq(a.shape[1]), fine[1]))
        best = np.unravel_index(np.argmax(np.abs(rows @ spectrum @ columns)), (count, count))
        peak = np.array([fine[0][best[0]], fine[1][best[1]]])
    peak[shape == 1] = 0.0
    return peak


def window_shift(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Whole-pixel shift of ``b`` onto ``a`` with the highest correlation of the centred images."""
    size = [2 * n - 1 for n in a.shape]
    product = np.fft.rfft2(a - a.mean(), size) * np.conj(np.fft.rfft2(b - b.mean(), size))
    full = np.roll(np.fft.irfft2(product, size), (a.shape[0] - 1, a.shape[1] - 1), (0, 1))
    lags = []
    for n in a.shape:
        low, high = max(-reach, -(n // 2)), min(reach, (n - 1) // 2)
        lags.append(np.arange(low, high + 1))
    part = full[np.ix_(lags[0] + a.shape[0] - 1, lags[1] + a.shape[1] - 1)]
    # Correlations of 0/1 images are multiples of a small number; rounding makes ties exact.
    best = np.unravel_index(np.argmax(np.round(part, 6)), part.shape)
    return np.array([lags[0][best[0]], lags[1][best[1]]], dtype=float)


def xy_shifts(
    projection: DataFrame, volumes: DataFrame, pairs: DataFrame, params: OverlapParams = OverlapParams(),
    legacy_reach: int | None = None,
) -> DataFrame:
    """In-plane shift per pair from the occupancy projections.

    A group holds the projections of one pair: at most two pixels per image position, however large
    the table is. With ``legacy_reach`` the binary projections are correlated inside that window
    instead, as the weekly matcher does.
    """
    pairs = pairs.select("day_a", "day_b")
    shape = volumes.select("session_id", "ny", "nx")
    sides = None
    for side in ("a", "b"):
        part = (
            pairs.join(projection.withColumnRenamed("session_id", f"day_{side}"), f"day_{side}")
            .join(shape.withColumnRenamed("session_id", f"day_{side}"), f"day_{side}")
            .select("day_a", "day_b", F.lit(side).alias("side"), "y", "x", "n", "ny", "nx")
        )
        sides = part if sides is None else sides.unionByName(part)
    sigma, factor = params.occupancy_sigma_xy, params.upsample

    def shift(group: pd.DataFrame) -> pd.DataFrame:
        if group[["ny", "nx"]].drop_duplicates().shape[0] > 1:
            raise ValueError("the masks of a pair must have the same shape")
        size = (int(group["ny"].iloc[0]), int(group["nx"].iloc[0]))
        images = []
        for side in ("a", "b"):
            rows = group[group["side"] == side]
            image = np.zeros(size)
            image[rows["y"].to_numpy(), rows["x"].to_numpy()] = 1.0 if legacy_reach else rows["n"].to_numpy()
            images.append(image)
        reason, found = None, np.zeros(2)
        if legacy_reach:
            found = window_shift(*images, legacy_reach)
        else:
            images = [smooth(i, sigma) for i in images]
            if any(np.allclose(i, i.flat[0]) for i in images):
                reason = "constant_projection"
            else:
                found = subpixel_shift(*images, factor)
        return pd.DataFrame({
            "day_a": [group["day_a"].iloc[0]], "day_b": [group["day_b"].iloc[0]], "shift_y": [found[0]],
            "shift_x": [found[1]], "xy_fallback": [reason is not None], "xy_fallback_reason": [reason],
        })

    return sides.groupBy("day_a", "day_b").applyInPandas(
        shift, "day_a string, day_b string, shift_y double, shift_x double, xy_fallback boolean, xy_fallback_reason string"
    )


def legacy_shift(records: DataFrame, shifts: DataFrame, max_xy: float = 15.0, max_z: float = 5.0) -> DataFrame:
    """Choose between no shift and the correlation shift by how many centroids find a partner.

    ``records`` has ``session_id``, ``label`` and the centroid in pixels; ``shifts`` one row per pair.
    """
    zero = shifts.select("day_a", "day_b", F.lit(0).alias("option"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("sx"))
    found = shifts.select("day_a", "day_b", F.lit(1).alias("option"), F.col("shift_y").alias("sy"), F.col("shift_x").alias("sx"))
    options = materialise(zero.unionByName(found))
    a = options.join(records, F.col("day_a") == F.col("session_id")).select(
        "day_a", "day_b", "option", "label", "centroid_z", F.col("centroid_y").alias("py"), F.col("centroid_x").alias("px")
    )
    b = options.join(records, F.col("day_b") == F.col("session_id")).select(
        "day_a", "day_b", "option", "label", "centroid_z", (F.col("centroid_y") + F.col("sy")).alias("py"),
        (F.col("centroid_x") + F.col("sx")).alias("px"),
    )
    by = ["day_a", "day_b", "option"]
    near = radius_join(a, b, max_xy, max_xy, by, ("py", "px")).where(
        F.abs(F.col("a.centroid_z") - F.col("b.centroid_z")) <= max_z
    )
    best = near.groupBy(*by, F.col("a.label").alias("label")).agg(F.min("distance_um").alias("d"))
    counts = best.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    median = exact_quantiles(best, "d", {"m": 0.5}, by)
    scored = options.join(counts, by, "left").join(median, by, "left")
    score = (
        F.coalesce(F.col("n"), F.lit(0)) - 0.05 * F.coalesce(F.col("m"), F.lit(1e6)) - 0.02 * F.hypot("sy", "sx")
    )
    # The first option wins a tie.
    return scored.groupBy("day_a", "day_b").agg(
        F.max_by(F.struct(F.col("sy").alias("shift_y"), F.col("sx").alias("shift_x")), F.struct(score, -F.col("option"))).alias("s")
    ).select("day_a", "day_b", "s.*")


# --- restricted transform -----------------------------------------------------------------------

COEFFICIENTS = ("a0", "a1", "b0", "b1", "b2", "c0", "c1", "c2")


def _shifted(column: str) -> Column:
    return F.col(column) - F.col(f"o_{column}")


def _sums(rows: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """Number, sums and sums of products of the seeds' places about the pair's centre ``o_*``, which add up; and ``more``."""
    return rows.groupBy(*by).agg(
        *more,
        F.count(F.lit(1)).alias("n"), *[F.sum(_shifted(c)).alias(f"t_{c}") for c in PLACES],
        *[F.sum(_shifted(p) * _shifted(q)).alias(f"q_{k}") for k, (p, q) in MOMENTS.items()],
    )


def _added(parts: DataFrame, pair: list[str]) -> DataFrame:
    """The sums of several parts of a pair's seeds."""
    return parts.groupBy(*pair).agg(*[F.sum(c).alias(c) for c in (*SUMS, "moved")])


def _moments(sums: DataFrame, centres: DataFrame, pair: list[str]) -> DataFrame:
    """Means and centred second moments from the sums about the centre."""
    mean = {c: F.col(f"t_{c}") / F.col("n") for c in PLACES}
    return sums.join(centres, pair).select(
        *pair, F.col("n").alias("n_inlier"), *[(mean[c] + F.col(f"o_{c}")).alias(f"m_{c}") for c in PLACES],
        *[(F.col(f"q_{k}") / F.col("n") - mean[p] * mean[q]).alias(f"s_{k}") for k, (p, q) in MOMENTS.items()])


def _solve(sums: DataFrame) -> DataFrame:
    """Coefficients from the moments: z on z, and y and x each on (y, x)."""
    c = F.col
    det = c("s_yy") * c("s_xx") - c("s_yx") * c("s_yx")
    scale = c("s_yy") * c("s_xx")
    full = (c("s_zz") > 1e-12) & (det > 1e-12 * scale) & (scale > 0) & (c("n_inlier") >= 3)
    out = sums.withColumn("_full", F.coalesce(full, F.lit(False))).withColumn("_det", F.when(full, det))
    a1 = F.when(c("_full"), c("s_zt") / F.when(c("s_zz") > 0, c("s_zz")))
    out = out.withColumn("a1", a1).withColumn("a0", c("m_za") - c("a1") * c("m_zb"))
    for name, target, t, u in (("b", "ya", "yt", "xt"), ("c", "xa", "yu", "xu")):
        out = out.withColumn(f"{name}1", (c(f"s_{t}") * c("s_xx") - c(f"s_{u}") * c("s_yx")) / c("_det"))
        out = out.withColumn(f"{name}2", (c(f"s_{u}") * c("s_yy") - c(f"s_{t}") * c("s_yx")) / c("_det"))
        out = out.withColumn(f"{name}0", c(f"m_{target}") - c(f"{name}1") * c("m_yb") - c(f"{name}2") * c("m_xb"))
    return out.select(*[x for x in sums.columns if not x.startswith(("m_", "s_"))], "_full", *COEFFICIENTS)


def _residuals(spacing: Spacing, old: str = "") -> Column:
    """Distance of a seed from its fitted position; ``old`` prefixes the coefficients."""
    c = F.col
    k = {n: c(f"{old}{n}") for n in COEFFICIENTS}
    dz = (c("za") - (k["a0"] + k["a1"] * c("zb"))) * spacing.z_um
    dy = (c("ya") - (k["b0"] + k["b1"] * c("yb") + k["b2"] * c("xb"))) * spacing.y_um
    dx = (c("xa") - (k["c0"] + k["c1"] * c("yb") + k["c2"] * c("xb"))) * spacing.x_um
    return F.sqrt(dz * dz + dy * dy + dx * dx)


def _bin(residual: Column, largest: float) -> Column:
    """Bin of a residual; never smaller for a larger residual."""
    return F.when(residual >= largest, BINS).otherwise(F.least(F.floor(residual * (BINS / largest)), F.lit(BINS - 1).cast("long"))).cast("int")


def restricted_transforms(
    seeds: DataFrame, shifts: DataFrame, params: OverlapParams = OverlapParams(), spacing: Spacing = Spacing(),
    pair: Sequence[str] = PAIR,
) -> DataFrame:
    """One transform per pair: z on z, and y and x on (y, x), fitted with trimming.

    ``seeds`` holds the centroids ``za ya xa zb yb xb`` of the seed matches, ``shifts`` one row per
    pair with the coarse shift. The seeds are written once. A round sums them up by bins of the residual, each with its
    moments. The bins tell which of them holds the quantile; only its seeds are opened to find the value, and only those of
    the bin that the cut falls into to divide them. All other bins stay or go as a whole. Which seeds were kept
    before follows from the last coefficients and cut, so no seed is written again, and no pair's seeds are
    gathered in one task. Trimming is idempotent once a pair has settled, so all pairs take the same number
    of rounds. Failing pairs fall back to the shift alone.
    """
    pair = list(pair)
    largest = params.max_residual_um
    seeds = materialise(seeds.select(*pair, *PLACES))
    centres = materialise(seeds.groupBy(*pair).agg(*[F.avg(c).alias(f"o_{c}") for c in PLACES]))
    sums = _sums(seeds.join(centres, pair), pair)
    before = seeds.select(*pair).distinct().select(
        *pair, *[F.lit(None).cast("double").alias(f"old_{c}") for c in COEFFICIENTS], F.lit(None).cast("double").alias("old_cut"))
    kept = F.coalesce(_residuals(spacing, "old_") <= F.col("old_cut"), F.lit(True))
    failed = None
    for _ in range(params.trim_iterations):
        solved = materialise(_solve(_moments(sums, centres, pair)).join(before, pair).join(centres, pair))
        broken = solved.where(~F.col("_full")).select(*pair, "n_inlier", F.lit("rank_deficient").alias("_reason"))
        failed = broken if failed is None else failed.unionByName(broken)
        measured = seeds.join(solved.where("_full"), pair).withColumn("residual", _residuals(spacing)).withColumn("keep", kept)
        measured = measured.withColumn("bin", _bin(F.col("residual"), largest))
        bins = materialise(_sums(measured, [*pair, "bin"], F.count_if("keep").alias("kept")))
        # The two kept seeds around the quantile, and the bins they lie in.
        upto = W.partitionBy(*pair).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
        ranked = bins.select(*pair, "bin", "kept", F.sum("kept").over(upto).alias("_upto"), F.sum("kept").over(W.partitionBy(*pair)).alias("_all"))
        at, below = params.trim_quantile * (F.col("_all") - 1), F.col("_upto") - F.col("kept")
        ends = ranked.groupBy(*pair).agg(*[
            F.max(F.when((position >= below) & (position < F.col("_upto")), F.struct("bin", below.alias("below"), position.alias("at"), (at - F.floor(at)).alias("part")))).alias(name)
            for name, position in (("low", F.floor(at)), ("high", F.ceil(at)))])
        ends = materialise(ends)
        opened = measured.where("keep").join(ends, pair).where(F.col("bin").isin(F.col("low.bin"), F.col("high.bin")) & (F.col("low.bin") < BINS))
        positions = ends.select(*pair, (F.col("low.at") - F.col("low.below")).alias("v_low"), (F.col("high.at") - F.col("low.below")).alias("v_high"))
        values = values_at(opened.select(*pair, "residual"), "residual", positions, pair)
        quantile = F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("low.part")
        cuts = materialise(ends.join(values, pair, "left").select(*pair, F.coalesce(F.least(quantile, F.lit(largest)), F.lit(largest)).alias("cut")))
        border = _bin(F.col("cut"), largest)
        sided = bins.join(cuts, pair).withColumn("_border", border)
        stay = sided.where(F.col("bin") < F.col("_border")).withColumn("moved", F.col("n") - F.col("kept"))
        gone = sided.where(F.col("bin") > F.col("_border")).select(*pair, F.col("kept").alias("moved"))
        divided = measured.join(cuts, pair).where(F.col("bin") == border).withColumn("_new", F.col("residual") <= F.col("cut"))
        part = _sums(divided, [*pair, "_new"], F.count_if(F.col("_new") != F.col("keep")).alias("moved"))
        part = part.select(*pair, "moved", *[F.when(F.col("_new"), F.col(c)).alias(c) for c in SUMS])
        parts = stay.select(*pair, "moved", *SUMS).unionByName(gone, allowMissingColumns=True).unionByName(part)
        seen = Observation()
        sums = materialise(_added(parts, pair).observe(seen, F.sum("moved").alias("moved")))
        before = solved.where("_full").join(cuts, pair).select(*pair, *[F.col(c).alias(f"old_{c}") for c in COEFFICIENTS], F.col("cut").alias("old_cut"))
        if not seen.get["moved"]:
            break
    final = materialise(_solve(_moments(sums, centres, pair)))
    settled = seeds.join(before, pair).where(kept).join(final.where("_full").select(*pair, *COEFFICIENTS), pair)
    spread = exact_quantiles(
        settled.withColumn("residual", _residuals(spacing)), "residual",
        {"residual_median_um": 0.5, "residual_p95_um": params.trim_quantile}, pair)
    counts = seeds.groupBy(*pair).agg(F.count(F.lit(1)).alias("_seeds"))
    early = failed.groupBy(*pair).agg(F.first("_reason").alias("_early"), F.first("n_inlier").alias("_early_n"))
    out = (
        shifts.join(counts, pair, "left").join(final, pair, "left").join(early, pair, "left").join(spread, pair, "left")
    )
    n_seed = F.coalesce(F.col("_seeds"), F.lit(0))
    n_keep = F.coalesce(F.col("n_inlier"), F.lit(0))
    reason = (
        F.when(n_seed < params.min_seeds, "insufficient_seeds")
        .when(F.col("_early").isNotNull(), F.col("_early"))
        .when(n_keep < 3, "insufficient_final_inliers")
        .when(~F.col("_full"), "rank_deficient_final")
    )
    out = out.withColumn("fallback_reason", reason)
    good = F.col("fallback_reason").isNull()
    plain = {"a0": F.col("shift_z"), "a1": 1.0, "b0": F.col("shift_y"), "b1": 1.0, "b2": 0.0, "c0": F.col("shift_x"), "c1": 0.0, "c2": 1.0}
    inliers = F.when(n_seed < params.min_seeds, F.lit(0)).otherwise(F.coalesce(F.col("_early_n"), n_keep))
    return out.select(
        *pair,
        *[F.when(good, F.col(k)).otherwise(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in plain.items()],
        F.when(good, "restricted_affine").otherwise("translation_only").alias("method"),
        "fallback_reason",
        n_seed.alias("n_seed"),
        inliers.alias("n_inlier"),
        *[F.when(good, F.col(c)).alias(c) for c in ("residual_median_um", "residual_p95_um")],
    )
