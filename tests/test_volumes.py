import dataclasses
import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import VOXELS, voxel_rows, write_blocks, write_tiff
from longitrack.operators import hull, legacy, registration, voxels as vox
from longitrack.params import LegacyParams, OverlapParams, Spacing
from longitrack.sources import listing, manifest as man, sinks, tiff

SIZES = "session_id string, nz int, ny int, nx int"
SHIFT = "day_a string, day_b string, shift_z double, shift_y double, shift_x double"


def volume(spark, **stacks):
    rows = [r for name, s in stacks.items() for r in voxel_rows(name, s)]
    sizes = [(name, *s.shape) for name, s in stacks.items()]
    return spark.createDataFrame(rows, VOXELS), spark.createDataFrame(sizes, SIZES)


@pytest.mark.parametrize("order,compress", [("<", False), (">", True)])
def test_tiff_source(spark, tmp_path, order, compress):
    rng = np.random.default_rng(0)
    mask = rng.integers(0, 4, (7, 5, 6)).astype(np.uint16)
    red = rng.integers(0, 900, mask.shape).astype(np.uint16)
    green = rng.random(mask.shape).astype(np.float32)
    for name, stack in (("m", mask), ("r", red), ("g", green)):
        write_tiff(tmp_path / f"{name}.tif", stack, compress, order)
    spec = [{"session_id": "s", "mask": str(tmp_path / "m.tif"), "red": str(tmp_path / "r.tif"), "green": str(tmp_path / "g.tif")}]
    df = tiff.read_voxels(spark, spec, 2)
    assert df.rdd.getNumPartitions() == 4
    got = {(r.z, r.y, r.x): (r.label, r.red, r.green) for r in df.collect()}
    want = {(int(z), int(y), int(x)): (int(mask[z, y, x]), float(red[z, y, x]), float(green[z, y, x])) for z, y, x in zip(*np.nonzero(mask))}
    assert got == want
    assert tuple(tiff.read_volumes(spark, spec).first()) == ("s", 7, 5, 6)
    write_tiff(tmp_path / "small.tif", red[:, :4])
    with pytest.raises(Exception, match="differ in shape"):
        tiff.read_voxels(spark, [{**spec[0], "red": str(tmp_path / "small.tif")}]).collect()


def test_tiff_layouts(spark, tmp_path):
    rng = np.random.default_rng(1)
    mask = rng.integers(0, 60000, (3, 4, 5)).astype(np.uint16)
    steps = np.diff(mask, axis=2, prepend=np.zeros((3, 4, 1), np.uint16))
    for order in "<>":
        write_tiff(tmp_path / "p.tif", steps, True, order, [(317, 3, 2)])
        got = np.stack([tiff.read_page(str(tmp_path / "p.tif"), page) for page in tiff.read_pages(str(tmp_path / "p.tif"))])
        assert (got == mask).all()
    for more, message in (([(277, 3, 3)], "samples"), ([(322, 4, 16)], "tiled"), ([(317, 3, 3)], "predictor")):
        write_tiff(tmp_path / "x.tif", mask, more=more)
        with pytest.raises(ValueError, match=message):
            tiff.read_pages(str(tmp_path / "x.tif"))
    write_tiff(tmp_path / "s.tif", mask)
    page = tiff.read_pages(str(tmp_path / "s.tif"))[0]
    with pytest.raises(ValueError, match="bytes instead of"):
        tiff.read_page(str(tmp_path / "s.tif"), dataclasses.replace(page, height=3))
    write_tiff(tmp_path / "big.tif", np.full((1, 2, 2), 3_000_000_000, np.uint32))
    with pytest.raises(Exception, match="mask label over"):
        tiff.read_voxels(spark, [{"session_id": "s", "mask": str(tmp_path / "big.tif")}]).collect()


def test_tiles_and_strips(tmp_path):
    rng = np.random.default_rng(2)
    stack = rng.integers(0, 60000, (3, 37, 45)).astype(np.uint16)
    layouts = [(5, False), (37, False), (16, False), ((16, 16), True), ((16, 48), True), ((64, 16), True)]
    for block, tiled in layouts:
        for compress, order, predictor in ((False, "<", False), (True, ">", True)):
            path = tmp_path / "blocks.tif"
            write_blocks(path, stack, block, tiled, compress, order, predictor)
            pages = tiff.read_pages(str(path))
            assert (np.stack([tiff.read_page(str(path), page) for page in pages]) == stack).all()
            with open(path, "rb") as f:  # any range of rows, also across blocks
                pixels = tiff.Pixels(f, pages[1], str(path))
                for first, last in ((0, 1), (3, 20), (20, 37), (15, 17), (36, 37)):
                    assert (pixels.rows(first, last) == stack[1, first:last]).all()
    offsets = tiff.page_offsets(str(path))
    assert len(offsets) == 3 and tiff.read_pages(str(path), offsets[1], 1) == pages[1:2]
    raw = bytearray(path.read_bytes())
    raw[-4:] = offsets[0].to_bytes(4, "big")
    path.write_bytes(bytes(raw))
    with pytest.raises(ValueError, match="circle"):
        tiff.page_offsets(str(path))


def test_tiff_pushdown(spark, tmp_path):
    """Columns and filters reach the reader: what they exclude is not opened, and the rows stay the same."""
    rng = np.random.default_rng(4)
    mask = rng.integers(0, 5, (9, 24, 20)).astype(np.uint16)
    red = rng.integers(1, 900, mask.shape).astype(np.uint16)
    specs = []
    for name in ("s", "t"):
        write_blocks(tmp_path / f"{name}.tif", mask, (16, 16), True, True)
        write_tiff(tmp_path / f"{name}_R.tif", red)
        specs.append({"session_id": name, "mask": str(tmp_path / f"{name}.tif"), "red": str(tmp_path / f"{name}_R.tif"), "green": None})
    every = sorted(tuple(r) for r in tiff.read_voxels(spark, specs, 2).select("session_id", "z", "y", "x", "label", "red").collect())
    assert len(every) == 2 * np.count_nonzero(mask)
    cases = {
        "session_id = 't'": lambda r: r[0] == "t", "session_id IN ('s', 'none')": lambda r: r[0] == "s", "z = 3": lambda r: r[1] == 3,
        "z >= 2 AND z < 5 AND label IN (1, 4)": lambda r: 2 <= r[1] < 5 and r[4] in (1, 4), "y > 17 AND x <= 4": lambda r: r[2] > 17 and r[3] <= 4,
        "session_id > 's' AND label = 2": lambda r: r[0] > "s" and r[4] == 2, "z = 99": lambda r: False, "red > 450": lambda r: r[5] > 450,
        "z IS NOT NULL AND (y = 1 OR x = 1)": lambda r: 1 in r[2:4],
    }
    for text, test in cases.items():
        got = tiff.read_voxels(spark, specs, 2).where(text)
        assert sorted(tuple(r) for r in got.select("session_id", "z", "y", "x", "label", "red").collect()) == [r for r in every if test(r)], text
    assert tiff.read_voxels(spark, specs, 2).where("z = 3").rdd.getNumPartitions() == 2
    assert tiff.read_voxels(spark, specs, 2).where("session_id = 't'").rdd.getNumPartitions() == 5
    # Intensities that are no TIFF at all do not matter to a scan without them.
    for name in ("s", "t"):
        (tmp_path / f"{name}_R.tif").write_bytes(b"no image")
    bare = tiff.read_voxels(spark, specs, 2, tiff.MASK_COLUMNS)
    assert bare.columns == list(tiff.MASK_COLUMNS) and sorted(tuple(r) for r in bare.collect()) == [r[:5] for r in every]
    with pytest.raises(Exception, match="not a TIFF"):
        tiff.read_voxels(spark, specs, 2).collect()


def test_features_and_overlap(spark):
    mask = np.zeros((2, 3, 4), dtype=int)
    mask[0, 0, 0], mask[1, 2, 3] = 5, 9
    v, sizes = volume(spark, s=mask)
    rows = {r.label: r for r in vox.region_features(v, sizes, Spacing(5, 1, 1)).collect()}
    assert set(rows) == {5, 9}
    assert (rows[5].bbox_z1, rows[5].bbox_y1, rows[5].bbox_x1) == (1, 1, 1)
    assert (rows[9].bbox_z0, rows[9].bbox_y0, rows[9].bbox_x0) == (1, 2, 3) and rows[9].touches_z_edge and rows[9].volume_um3 == 5
    assert vox.invalid_masks(v, sizes).isEmpty()
    full, full_sizes = volume(spark, s=np.ones((2, 2, 2), dtype=int))
    assert vox.invalid_masks(full, full_sizes).count() == 1


def test_shifted_overlap_against_arrays(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 4, (5, 8, 9)), rng.integers(0, 4, (5, 8, 9))
    v, sizes = volume(spark, a=a, b=b)
    areas = v.groupBy("session_id", "label").agg(F.count(F.lit(1)).alias("area_voxels"))
    for shift in ((1, -2, 3), (0, 0, 0), (-1, 2.5, 0), (5, 0, 0)):
        got = {(r.label_a, r.label_b): r.intersection_voxels for r in vox.shifted_overlap(
            v, areas, spark.createDataFrame([("a", "b", *map(float, shift))], SHIFT)).collect()}
        want = {}
        dz, dy, dx = (int(np.rint(s)) for s in shift)
        for (z, y, x), label in np.ndenumerate(b):
            p = (z + dz, y + dy, x + dx)
            if label and all(0 <= c < n for c, n in zip(p, a.shape)) and a[p]:
                key = (int(a[p]), int(label))
                want[key] = want.get(key, 0) + 1
        assert got == want


def test_zero_exclusion(spark):
    mask = np.zeros((2, 2, 3), dtype=int)
    mask[:, 0, :2], mask[:, 1, 1:] = 1, 2
    image = np.full(mask.shape, 13.0)
    image[mask == 2] = 22.0
    image[0, 1, 1] = 0.0
    df = spark.createDataFrame(voxel_rows("s", mask, image, image), VOXELS)
    kept = {r.label: r.mean_intensity for r in vox.label_means(df, ["red"]).collect()}
    every = {r.label: r.mean_intensity for r in vox.label_means(df, ["red"], exclude_zero=False).collect()}
    assert kept == {1: 13.0} and every == {1: 13.0, 2: 16.5}


def test_shift_recovery(spark):
    rng = np.random.default_rng(1)
    base = np.zeros((8, 64, 60), dtype=int)
    for n in range(25):
        z, y, x = rng.integers(1, 5), rng.integers(8, 50), rng.integers(8, 46)
        base[z:z + 2, y:y + 4 + n % 3, x:x + 5] = n + 1
    moved = np.roll(base, (1, -3, 2), (0, 1, 2))
    v, sizes = volume(spark, a=base, b=moved)
    pairs = spark.createDataFrame([("a", "b")], "day_a string, day_b string")
    z = vox.z_shifts(vox.z_profiles(v, sizes), pairs).first()
    xy = registration.xy_shifts(vox.occupancy_projection(v), sizes, pairs).first()
    assert z.shift_z == -1.0 and not z.z_fallback
    assert (xy.shift_y, xy.shift_x) == pytest.approx((3.0, -2.0), abs=0.1) and not xy.xy_fallback
    old = registration.xy_shifts(vox.occupancy_projection(v), sizes, pairs, legacy_reach=32).first()
    assert (old.shift_y, old.shift_x) == (3.0, -2.0)
    flat = np.ones((4, 6, 6), dtype=int)
    f, fs = volume(spark, a=flat, b=flat)
    assert vox.z_shifts(vox.z_profiles(f, fs), pairs).first().z_fallback_reason == "constant_profile"
    assert registration.xy_shifts(vox.occupancy_projection(f), fs, pairs).first().xy_fallback_reason == "constant_projection"


def test_subpixel_shift():
    y, x = np.mgrid[:48, :40]

    def blob(cy, cx):
        return np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 20)

    found = registration.subpixel_shift(blob(20.0, 18.0) + blob(33, 9), blob(22.3, 16.6) + blob(35.3, 7.6), 10)
    assert found == pytest.approx([-2.3, 1.4], abs=0.051)


def lstsq_transform(za, zb, limit, rounds, q):
    """Reference fit with NumPy on one pair's arrays."""
    keep = np.ones(len(za), dtype=bool)

    def fit():
        one = np.column_stack([np.ones(keep.sum()), zb[keep, 0]])
        two = np.column_stack([np.ones(keep.sum()), zb[keep, 1], zb[keep, 2]])
        c = [np.linalg.lstsq(one, za[keep, 0], rcond=None)[0]] + [np.linalg.lstsq(two, za[keep, i], rcond=None)[0] for i in (1, 2)]
        pred = np.column_stack([c[0][0] + c[0][1] * zb[:, 0], *[c[i][0] + zb[:, 1:] @ c[i][1:] for i in (1, 2)]])
        return np.concatenate(c), np.linalg.norm(za - pred, axis=1)

    for _ in range(rounds):
        _, res = fit()
        new = res <= min(limit, np.quantile(res[keep], q))
        if (new == keep).all():
            break
        keep = new
    coefficients, res = fit()
    return coefficients, int(keep.sum()), float(np.median(res[keep]))


def test_restricted_transform(spark):
    rng = np.random.default_rng(9)
    n = 80
    b = rng.uniform(0, 100, (n, 3))
    a = np.column_stack([1 + 1.01 * b[:, 0], 2 + 0.99 * b[:, 1] + 0.02 * b[:, 2], -3 - 0.01 * b[:, 1] + 1.02 * b[:, 2]]) + rng.normal(0, 0.3, (n, 3))
    a[:5] += 40
    rows = [("a", "b", *map(float, p), *map(float, q)) for p, q in zip(a, b)]
    rows += [("a", "c", 1.0, 1.0, 1.0, 2.0, 2.0, 2.0)]
    rows += [("b", "c", float(i), 5.0, float(i), float(i), 5.0, float(i)) for i in range(60)]
    seeds = spark.createDataFrame(rows, "day_a string, day_b string, za double, ya double, xa double, zb double, yb double, xb double")
    shifts = spark.createDataFrame([("a", "b", 0.0, 0.0, 0.0), ("a", "c", 1.0, 2.0, 3.0), ("b", "c", 4.0, 5.0, 6.0), ("c", "d", 7.0, 8.0, 9.0)], SHIFT)
    out = {(r.day_a, r.day_b): r for r in registration.restricted_transforms(seeds, shifts, OverlapParams(), Spacing(1, 1, 1)).collect()}
    c, kept, median = lstsq_transform(a, b, 8.0, 4, 0.95)
    r = out["a", "b"]
    assert [r[k] for k in registration.COEFFICIENTS] == pytest.approx(list(c), abs=1e-8)
    assert (r.method, r.n_seed, r.n_inlier) == ("restricted_affine", n, kept) and r.residual_median_um == pytest.approx(median)
    few = out["a", "c"]
    assert (few.method, few.fallback_reason, few.n_seed) == ("translation_only", "insufficient_seeds", 1)
    assert (few.a0, few.a1, few.b0, few.b1, few.b2, few.c0, few.c1, few.c2) == (1, 1, 2, 1, 0, 3, 0, 1)
    assert out["b", "c"].fallback_reason == "rank_deficient" and out["c", "d"].n_seed == 0


def test_hull_and_shape(spark):
    yy, xx = np.mgrid[:60, :60]
    mask = np.zeros((1, 60, 60), dtype=int)
    mask[0, (yy - 20) ** 2 + (xx - 20) ** 2 <= 144] = 1
    mask[0, 40:50, 5:35] = 2
    mask[0, 40:44, 40:56], mask[0, 44:58, 40:44] = 3, 3
    v, _ = volume(spark, s=mask)
    solid = {r.label: r for r in hull.solidity(v).collect()}
    shape = {r.label: r for r in vox.projected_shape(v).collect()}
    assert solid[2].solidity == 1.0 and solid[1].solidity > 0.94 and solid[3].solidity < 0.75
    # A disc of radius 12 and a 10 x 30 rectangle.
    assert shape[1].proj_perimeter_px == pytest.approx(2 * math.pi * 12.3, rel=0.03) and shape[1].circularity == pytest.approx(1, abs=0.06)
    assert shape[2].proj_area_px == 300 and shape[2].axis_ratio == pytest.approx(math.sqrt((900 - 1) / (100 - 1)))
    assert shape[2].eccentricity == pytest.approx(math.sqrt(1 - 99 / 899))
    # The hull against a direct test of every pixel centre.
    rng = np.random.default_rng(4)
    for _ in range(20):
        pts = rng.integers(0, 9, (6, 2))
        pixels = {tuple(map(int, p)) for p in pts}
        rows = sorted({y for y, _ in pixels})
        low = np.array([min(x for q, x in pixels if q == y) for y in rows])
        high = np.array([max(x for q, x in pixels if q == y) for y in rows])
        corners = np.array([(y + dy, x + dx) for y, x in pixels for dy, dx in ((-.5, 0), (.5, 0), (0, -.5), (0, .5))])
        inside = 0
        angles = np.linspace(0, 2 * np.pi, 721)
        normals = np.column_stack([np.cos(angles), np.sin(angles)])
        support = (corners @ normals.T).max(axis=0)
        for y in range(rows[0], rows[-1] + 1):
            for x in range(low.min(), high.max() + 1):
                inside += bool((np.array([y, x]) @ normals.T <= support + 1e-9).all())
        assert abs(hull.hull_pixels(np.array(rows), low, high) - inside) <= 1


def test_crops(spark):
    mask = np.zeros((3, 93, 157), dtype=int)
    mask[1, 16:77, 18:139] = 1
    v, sizes = volume(spark, s=mask)
    out = vox.center_crop(v, sizes, 61, 121).agg(F.min("y"), F.max("y"), F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    assert tuple(out) == (0, 60, 0, 120, 61 * 121)
    with pytest.raises(Exception, match="larger than the image"):
        vox.center_crop(v, sizes, 100, 10).collect()
    one = spark.range(1)
    start, stop = vox.fixed_crop(F.lit(256.0), 384, F.lit(512))
    left, right = vox.fixed_crop(F.lit(384.0), 640, F.lit(768))
    assert tuple(one.select(start, stop, left, right).first()) == (64, 448, 64, 704)
    start, stop = vox.fixed_crop(F.lit(5.0), 100, F.lit(512))
    assert tuple(one.select(start, stop).first()) == (0, 100)


def test_legacy_record_and_score(spark):
    mask = np.zeros((4, 40, 40), dtype=int)
    mask[1, 10:15, 10:15], mask[2, 10:15, 10:15], mask[0, 12, 12] = 1, 1, 1
    v, sizes = volume(spark, a=mask, b=mask)
    rec = legacy.records(v, sizes, LegacyParams())
    r = rec.where("session_id = 'a'").first()
    assert (r.center_plane, r.area_center, r.area_total) == (1, 25, 51) and r.is_edge
    assert len(r.patch) == 25 and sum(r.radial_profile) == pytest.approx(1.0)
    out = legacy.scored_pairs(rec, spark.createDataFrame([("a", "b", 0.0, 0.0, 0.0)], SHIFT)).first()
    assert (out.patch_cos, out.iou, out.bbox_iou, out.radial_l1) == pytest.approx((1, 1, 1, 0)) and out.score == 1.0
    far = legacy.scored_pairs(rec, spark.createDataFrame([("a", "b", 0.0, 30.0, 0.0)], SHIFT))
    assert far.isEmpty()


def test_listing(spark):
    names = [
        "20260511_R.tif", "20260511_G_crop_256_SyN.tif", "20260512_R_SyN.tif", "20260512_R_crop_SyN.tif", "20260510_R.tif",
        "20260512_G_SyN_crop.tif", "20260512_R_ROI_mask_SyN.tif", "mean_image_R_SyN.tif", "20260513_B.tif", "20260513_R.tiff",
        "20260513_G_cp_masks.tif", "2026051_R.tif",
    ]
    parsed = listing.parse_names(spark.createDataFrame([(n,) for n in names], "name string"))
    got = {r["name"]: (r.date_key, r.channel, r.is_syn) for r in parsed.collect()}
    assert got == {
        "20260511_R.tif": ("20260511", "red", False), "20260511_G_crop_256_SyN.tif": ("20260511", "green", True),
        "20260512_R_SyN.tif": ("20260512", "red", True), "20260512_R_crop_SyN.tif": ("20260512", "red", True),
        "20260510_R.tif": ("20260510", "red", False),
    }
    look = {(r.day, r.channel): r["name"] for r in listing.registered_lookup(parsed, "20260511").collect()}
    assert look == {(0, "red"): "20260511_R.tif", (1, "red"): "20260512_R_crop_SyN.tif"} or look[1, "red"] == "20260512_R_crop_SyN.tif"
    assert listing.start_date(parsed).first()[0] == "20260510"
    assert {(r.day, r.channel) for r in listing.missing_channels(listing.registered_lookup(parsed, "20260511")).collect()} == {
        (0, "green"), (1, "green")}
    masks = spark.createDataFrame([("20260512_R_ROI_mask_SyN_inversed.tif",), ("20260512_G_ROI_mask_SyN_inversed.tif",)], "name string")
    assert listing.inverse_masks(masks, "20260511", channel="green").first()["name"].startswith("20260512_G")
    with pytest.raises(Exception, match="ambiguous"):
        listing.inverse_masks(masks, "20260511").collect()


def manifest_text(tmp_path, rows):
    for n in ("a.tif", "b.tif", "r.tif", "g.tif"):
        (tmp_path / n).write_bytes(b"x")
    path = tmp_path / "manifest.csv"
    path.write_text("session_index,session_id,acquisition_date,mask_path,red_image_path,green_image_path,required\n" + "\n".join(rows))
    return path


def test_manifest(spark, tmp_path):
    good = manifest_text(tmp_path, ["1,two,2026-05-13,b.tif,r.tif,g.tif,TRUE", "0,one,2026-05-11,a.tif,,,false"])
    sessions = man.load_manifest(good)
    assert [s.session_id for s in sessions] == ["one", "two"] and man.elapsed_days(sessions) == {"one": -2, "two": 0}
    with pytest.raises(ValueError, match="image"):
        man.check_sessions(sessions, intensity=True)
    assert man.manifest_frame(spark, sessions).first().acquisition_date == date(2026, 5, 11)
    frame = man.manifest_frame(spark, sessions)
    assert man.same_rows(frame, frame) and not man.same_rows(frame, frame.limit(1))
    for row, text in (
        ("1,two,2026-05-13,b.tif,r.tif,g.tif,maybe", "required"), ("2,two,2026-05-13,b.tif,r.tif,g.tif,true", "session_index"),
        ("1,one,2026-05-13,b.tif,r.tif,g.tif,true", "unique"), ("1,two,2026-05-10,b.tif,r.tif,g.tif,true", "decrease"),
        ("1,two,13.5.2026,b.tif,r.tif,g.tif,true", "row 3"), ("1,two,2026-05-13,,r.tif,g.tif,true", "mask_path"),
    ):
        with pytest.raises(ValueError, match=text):
            man.load_manifest(manifest_text(tmp_path, ["0,one,2026-05-11,a.tif,,,true", row]))


def test_sinks(spark, tmp_path):
    store = sinks.Store(spark, tmp_path / "s", csv=True)
    df = spark.createDataFrame([(1, "high"), (2, "balanced")], "roi_id int, match_policy string")
    assert store.write("t", df).count() == 2 and store.read("t").count() == 2
    assert store.read("missing", df.schema).isEmpty()
    with pytest.raises(FileNotFoundError):
        store.read("missing")
    both = df.withColumnRenamed("match_policy", "match_policy_x").withColumn("match_policy_y", F.lit("high"))
    assert [r.roi_id for r in sinks.filter_policy(both, "high").collect()] == [1]
    with pytest.raises(ValueError):
        sinks.filter_policy(df, "graph")
    many = spark.range(300).select((F.col("id") * 7 % 300).cast("int").alias("roi_id"), F.lit("high").alias("match_policy"), F.array("id").alias("l"))
    store.write("many", many.repartition(5))
    lines = [x for f in sorted((tmp_path / "s" / "many.csv").glob("part-*.csv")) for x in f.read_text().splitlines()[1:]]
    assert [int(x.split(",")[0]) for x in lines] == list(range(300))
    assert sinks.read_csv_table(spark, tmp_path / "none.csv", df.schema).isEmpty()
    assert sinks.read_csv_table(spark, tmp_path / "s" / "t.csv", df.schema).count() == 2
    sinks.write_json(tmp_path / "log.json", {"fingerprint": {"a": OverlapParams()}})
    assert sinks.same_run(tmp_path / "log.json", {"a": OverlapParams()}) and not sinks.same_run(tmp_path / "log.json", {"a": 1})
    assert sinks.hms(3725) == "01:02:05" and sinks.safe_name("a b/c") == "a_b_c"
    flags = spark.createDataFrame([(" Yes",), ("0",), ("TRUE",)], "v string").select(sinks.tolerant_bool("v"))
    assert [r[0] for r in flags.collect()] == [True, False, True]


def test_dataset_names(spark, tmp_path):
    for folder in ("1050_data", "920_data", "other"):
        (tmp_path / folder).mkdir()
    (tmp_path / "file.tif").write_bytes(b"x")
    assert listing.dataset_folder(spark, str(tmp_path)) == listing.dataset_folder(spark, f"{tmp_path}/", "1050") == f"{tmp_path}/1050_data"
    assert listing.dataset_folder(spark, str(tmp_path), "other") == listing.dataset_folder(spark, "/nowhere", f"{tmp_path}/other")
    assert listing.analysis_folder(spark, str(tmp_path), "920") == f"{tmp_path}/920_data/analysis"
    with pytest.raises(FileNotFoundError):
        listing.dataset_folder(spark, str(tmp_path), "none")
    with pytest.raises(NotADirectoryError):
        listing.dataset_folder(spark, str(tmp_path), "file.tif")
    names = {"1050": "red", "920": "green", None: "red", "/x/920_run": "green", "/x/920_data/a": "green", "/x/other": "red"}
    assert {k: listing.inverse_mask_channel(k) for k in names} == names
