"""Command line: ``python -m longitrack.plans match|refine|extract|master|registered ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from longitrack.params import GeometryQC, RatioParams, Spacing
from longitrack.plans import daywise, master, registered
from longitrack.sources import listing


def add_fields(parser: argparse.ArgumentParser, bundle: type, names: tuple[str, ...]) -> None:
    """One option for each named number of a parameter bundle, with its default."""
    for name in names:
        parser.add_argument(f"--{name.replace('_', '-')}", type=float, default=getattr(bundle, name))


def chosen(args: argparse.Namespace, bundle: type, names: tuple[str, ...]):
    return bundle(**{name: getattr(args, name) for name in names})


RATIO = ("green_dark", "red_dark", "epsilon", "red_cv_max", "brightness_quantile")
SPACING = ("z_um", "y_um", "x_um")
GEOMETRY = ("min_pass_fraction", "min_volume_um3", "max_volume_um3", "min_bbox_depth_planes", "max_bbox_depth_planes",
            "max_volume_ratio_from_track_median")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="longitrack")
    commands = parser.add_subparsers(dest="command", required=True)
    match = commands.add_parser("match", help="match the sessions of a manifest")
    refine = commands.add_parser("refine", help="add the graph policy to a finished matching run, from its tables")
    extract = commands.add_parser("extract", help="measure the tracks of a matching run")
    whole = commands.add_parser("master", help="graph matching, extraction and agreement labels")
    reg = commands.add_parser("registered", help="measure one mask over registered days")
    for p in (match, refine, extract, whole):
        p.add_argument("manifest")
        p.add_argument("out")
    for p in (match, extract):
        p.add_argument("--policies", nargs="+", default=["high", "balanced"])
    for p in (match, whole):
        p.add_argument("--max-pair-gap", type=int, default=2)
        p.add_argument("--resume", action="store_true")
        p.add_argument("--overwrite", action="store_true")
    extract.add_argument("--matches", required=True)
    reg.add_argument("dataset")
    reg.add_argument("mask")
    reg.add_argument("out")
    reg.add_argument("--start-date")
    reg.add_argument("--root", help="folder of the datasets; the dataset is then one of them or a short name")
    match.add_argument("--qc-examples", type=int, default=0, help="also write the matching quality tables, with so many examples")
    for p in (match, whole):
        add_fields(p, Spacing, SPACING)
    for p in (extract, whole, reg):
        add_fields(p, RatioParams, RATIO)
    for p in (extract, whole):
        add_fields(p, GeometryQC, GEOMETRY)
        p.add_argument("--qc-mode", choices=["all_required", "fraction"], default=GeometryQC.mode)
        p.add_argument("--exclude-xy-edge", action="store_true")
        p.add_argument("--exclude-z-edge", action="store_true")
    for p in (match, refine, extract, whole, reg):
        p.add_argument("--csv", action="store_true", help="also write CSV tables")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("longitrack").getOrCreate()
    ratio = chosen(args, RatioParams, RATIO) if args.command not in ("match", "refine") else None
    quality = None
    if args.command in ("extract", "master"):
        quality = GeometryQC(mode=args.qc_mode, exclude_xy_edge=args.exclude_xy_edge, exclude_z_edge=args.exclude_z_edge,
                             **{name: getattr(args, name) for name in GEOMETRY})
    if args.command == "match":
        store = daywise.run_matching(
            spark, args.manifest, args.out, args.policies, spacing=chosen(args, Spacing, SPACING), max_pair_gap=args.max_pair_gap,
            resume=args.resume, overwrite=args.overwrite, csv=args.csv)
        if args.qc_examples:
            daywise.matching_qc(store, args.qc_examples)
    elif args.command == "refine":
        daywise.refine_matching(spark, args.manifest, args.out, csv=args.csv)
    elif args.command == "extract":
        daywise.run_extraction(spark, args.manifest, args.matches, args.out, args.policies, ratio, quality, csv=args.csv)
    elif args.command == "master":
        master.run_master(
            spark, args.manifest, args.out, spacing=chosen(args, Spacing, SPACING), params=ratio, geometry_qc=quality,
            max_pair_gap=args.max_pair_gap, resume=args.resume, overwrite=args.overwrite, csv=args.csv)
    else:
        folder = listing.dataset_folder(spark, args.root, args.dataset) if args.root else args.dataset
        registered.run_registered(spark, folder, args.mask, args.out, args.start_date, ratio, csv=args.csv)


if __name__ == "__main__":
    main()
