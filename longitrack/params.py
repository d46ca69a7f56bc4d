"""Parameter bundles. The numbers are fixed default values of the methods."""

from __future__ import annotations

import math
from dataclasses import dataclass


def _positive(**values: float) -> None:
    for name, value in values.items():
        if not math.isfinite(value) or value <= 0:
            raise ValueError(f"{name} must be finite and positive")


def _unit(**values: float) -> None:
    for name, value in values.items():
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"{name} must lie in [0, 1]")


@dataclass(frozen=True)
class Spacing:
    """Voxel edge lengths in micrometres."""

    z_um: float = 5.0
    y_um: float = 710.0 / 1024.0
    x_um: float = 710.0 / 1024.0

    def __post_init__(self) -> None:
        _positive(z_um=self.z_um, y_um=self.y_um, x_um=self.x_um)


@dataclass(frozen=True)
class OverlapParams:
    """Daywise matcher: shift, transform, candidates, scores and rules."""

    occupancy_sigma_xy: float = 2.0
    upsample: int = 10
    seed_min_dice: float = 0.50
    min_seeds: int = 50
    trim_iterations: int = 4
    trim_quantile: float = 0.95
    max_residual_um: float = 8.0
    centroid_max_um: float = 10.0
    overlap_min_dice: float = 0.10
    overlap_only_ambiguity: float = 1.25
    score_scale_um: float = 4.0
    weight_spatial: float = 0.40
    weight_dice: float = 0.32
    weight_area_ratio: float = 0.15
    weight_ambiguity: float = 0.13

    def __post_init__(self) -> None:
        _positive(
            occupancy_sigma_xy=self.occupancy_sigma_xy,
            max_residual_um=self.max_residual_um,
            centroid_max_um=self.centroid_max_um,
            overlap_only_ambiguity=self.overlap_only_ambiguity,
            score_scale_um=self.score_scale_um,
        )
        _unit(seed_min_dice=self.seed_min_dice, overlap_min_dice=self.overlap_min_dice)
        if min(self.upsample, self.min_seeds, self.trim_iterations) < 1:
            raise ValueError("upsample, min_seeds and trim_iterations must be at least 1")
        if not 0.0 < self.trim_quantile < 1.0:
            raise ValueError("trim_quantile must lie in (0, 1)")
        weights = (self.weight_spatial, self.weight_dice, self.weight_area_ratio, self.weight_ambiguity)
        if min(weights) < 0 or abs(sum(weights) - 1.0) > 1e-6:
            raise ValueError("score weights must be nonnegative and sum to 1")


@dataclass(frozen=True)
class GraphParams:
    """Spatial-graph refinement of the balanced matches."""

    neighbours: int = 6
    radius_um: float = 45.0
    min_support: int = 3
    anchor_min_dice: float = 0.40
    anchor_max_um: float = 5.0
    anchor_min_area_ratio: float = 0.40
    anchor_max_ambiguity: float = 0.65
    anchor_needs_overlap: bool = True
    residual_scale_um: float = 4.0
    inlier_um: float = 6.0
    weight: float = 0.20

    def __post_init__(self) -> None:
        _positive(radius_um=self.radius_um, residual_scale_um=self.residual_scale_um, inlier_um=self.inlier_um)
        _unit(weight=self.weight, anchor_min_dice=self.anchor_min_dice)
        if self.neighbours < 1 or self.min_support < 1:
            raise ValueError("neighbours and min_support must be at least 1")


@dataclass(frozen=True)
class LegacyParams:
    """Weekly matcher."""

    patch_radius: int = 12
    patch_size: int = 64
    patch_overlap: int = 16
    max_dist_xy: float = 15.0
    max_dist_z: float = 5.0
    min_score: float = 0.45
    min_gap_support: float = 0.80
    edge_margin: int = 20
    edge_relax: float = 3.0
    edge_bonus: float = 0.02
    max_shift: int = 32
    low_confidence: float = 0.55


@dataclass(frozen=True)
class GeometryQC:
    """Segmentation quality control; every unset threshold is skipped."""

    mode: str = "all_required"
    min_pass_fraction: float = 1.0
    min_volume_um3: float | None = None
    max_volume_um3: float | None = None
    min_bbox_depth_planes: float | None = None
    max_bbox_depth_planes: float | None = None
    max_volume_ratio_from_track_median: float | None = None
    exclude_xy_edge: bool = False
    exclude_z_edge: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("all_required", "fraction"):
            raise ValueError("mode must be all_required or fraction")
        _unit(min_pass_fraction=self.min_pass_fraction)

    @property
    def configured(self) -> bool:
        limits = (
            self.min_volume_um3,
            self.max_volume_um3,
            self.min_bbox_depth_planes,
            self.max_bbox_depth_planes,
            self.max_volume_ratio_from_track_median,
        )
        return self.exclude_xy_edge or self.exclude_z_edge or any(v is not None for v in limits)


@dataclass(frozen=True)
class RatioParams:
    """Dark values, log-ratio offset and selection thresholds of the intensity analysis."""

    green_dark: float = 319.0
    red_dark: float = 534.0
    epsilon: float = 1.0
    red_cv_max: float = 0.10
    brightness_quantile: float = 0.25
    top_n: int = 30


@dataclass(frozen=True)
class TrajectoryParams:
    """Thresholds of the trajectory classes, in log2 units."""

    stable_abs: float = 0.25
    directional: float = 0.35
    oscillation_abs: float = 0.25
    return_abs: float = 0.15

    def __post_init__(self) -> None:
        if min(self.stable_abs, self.directional, self.oscillation_abs, self.return_abs) < 0:
            raise ValueError("trajectory thresholds must be nonnegative")


POLICIES = ("high", "balanced", "graph")


def resolve_policies(requested: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """Normalise, validate and deduplicate policy names, keeping the given order."""
    seen: dict[str, None] = {}
    for name in requested:
        policy = str(name).strip().lower()
        if policy not in POLICIES:
            raise ValueError(f"unknown match policy: {name!r}")
        seen[policy] = None
    if not seen:
        raise ValueError("at least one match policy is needed")
    return tuple(seen)
