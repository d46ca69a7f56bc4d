import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import write_tiff
from longitrack.operators.checks import checked_join, unique
from longitrack.params import GraphParams, OverlapParams, RatioParams
from longitrack.plans import daywise, master, registered, weekly
from longitrack.sources import manifest as man
from longitrack.sources.sinks import read_json

DARKLESS = RatioParams(green_dark=0.0, red_dark=0.0)


def small_session(folder, name, mask, red, green):
    write_tiff(folder / f"{name}_mask.tif", mask.astype(np.uint16))
    write_tiff(folder / f"{name}_R.tif", red.astype(np.uint16))
    write_tiff(folder / f"{name}_G.tif", green.astype(np.uint16), compress=True)


def write_manifest(folder, names, dates):
    lines = ["session_index,session_id,acquisition_date,mask_path,red_image_path,green_image_path,required"]
    for i, (n, d) in enumerate(zip(names, dates)):
        lines.append(f"{i},{n},{d},{n}_mask.tif,{n}_R.tif,{n}_G.tif,TRUE")
    path = folder / "manifest.csv"
    path.write_text("\n".join(lines) + "\n")
    return path


@pytest.fixture(scope="module")
def two_days(tmp_path_factory):
    """Two sessions with the same 2 x 3 x 3 mask of three regions."""
    folder = tmp_path_factory.mktemp("two_days")
    mask = np.zeros((2, 3, 3), dtype=int)
    mask[:, 0, 0], mask[:, 1, 1], mask[:, 2, 2] = 1, 2, 3
    red, green = np.zeros(mask.shape), np.zeros(mask.shape)
    for label in (1, 2, 3):
        red[mask == label] = 10 * label
        green[mask == label] = 30 + 10 * label
    for name in ("d0", "d1"):
        small_session(folder, name, mask, red, green)
    return folder, write_manifest(folder, ["d0", "d1"], ["2026-05-11", "2026-05-12"])


def test_daywise_two_days(spark, two_days, tmp_path):
    folder, manifest = two_days
    matched = daywise.run_matching(spark, manifest, tmp_path / "match")
    assert matched.read("pairwise_matches").groupBy("match_policy").count().collect() == [
        r for r in matched.read("pairwise_matches").groupBy("match_policy").count().collect() if r["count"] == 3
    ]
    assert daywise.run_matching(spark, manifest, tmp_path / "match", resume=True).has("tracks")
    with pytest.raises(FileExistsError):
        daywise.run_matching(spark, manifest, tmp_path / "match")
    store = daywise.run_extraction(spark, manifest, tmp_path / "match", tmp_path / "out", params=DARKLESS)
    days = store.read("roi_day_all")
    assert days.count() == 12
    assert {r[0] for r in days.select("elapsed_days").distinct().collect()} == {0, 1}
    assert store.read("matched_tracks").count() == 6
    assert store.read("primary_high_complete").count() == 3
    assert store.read("primary_high_complete_full_qc").count() == 0
    first = days.where((F.col("match_policy") == "high") & (F.col("day") == 0)).orderBy("red").collect()
    assert [(r.red, r.green) for r in first] == [(10.0, 40.0), (20.0, 50.0), (30.0, 60.0)]
    fit = store.read("daily_fits").where(F.col("match_policy") == "high").orderBy("day").first()
    assert fit.slope == pytest.approx(1.0) and fit.intercept == pytest.approx(30.0)
    funnel = {(r.match_policy, r.step): r["count"] for r in store.read("filter_counts").collect()}
    assert funnel["high", "cycle_qc"] == 3 and funnel["high", "segmentation_qc"] == 0
    daywise.matching_qc(matched, 5)
    assert matched.read("review_sample").count() > 0
    # A region that the feature table lists twice would double its geometry rows.
    matched.read("roi_features").limit(1).coalesce(1).write.mode("append").parquet(str(matched.path("roi_features")))
    with pytest.raises(Exception, match="the feature table has a repeated key"):
        daywise.run_extraction(spark, manifest, tmp_path / "match", tmp_path / "twice", params=DARKLESS)


def test_checked_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    got = checked_join(left, right, ["k"]).collect()
    assert sorted((r.k, r.v, r.w) for r in got if r.w) == [(1, "a", 10), (1, "b", 10), (2, "c", 20)] and len(got) == 4
    with pytest.raises(Exception, match="right side has a repeated key .k = 1"):
        checked_join(left, right.unionByName(right.limit(1)), ["k"]).collect()
    with pytest.raises(Exception, match="left side has a repeated key"):
        checked_join(left, right, ["k"], one_to_one=True).collect()
    assert checked_join(right, left.where("v = 'c'"), ["k"], "inner", one_to_one=True).select("w", "v").collect()[0][:] == (20, "c")
    with pytest.raises(Exception, match="k = null"):  # also where no other column is used
        unique(spark.createDataFrame([(None,), (None,)], "k int"), ["k"]).count()


@pytest.fixture(scope="module")
def moving(tmp_path_factory):
    """Four sessions of about sixty boxes, shifted from day to day, some missing in one session."""
    folder = tmp_path_factory.mktemp("moving")
    rng = np.random.default_rng(3)
    shifts = [(0, 0, 0), (0, 2, -1), (0, 3, 1), (0, -1, 2)]
    spots = [(2 + (i + j) % 3, 8 + 12 * i, 8 + 12 * j) for i in range(8) for j in range(8)]
    names = []
    for s, (dz, dy, dx) in enumerate(shifts):
        mask = np.zeros((9, 108, 110), dtype=int)
        for n, (z, y, x) in enumerate(spots):
            if (n + s) % 17 == 0 and s:
                continue
            jitter = rng.integers(-1, 2, 2)
            size = 3 + n % 3
            mask[z + dz:z + dz + 3, y + dy + jitter[0]:y + dy + jitter[0] + size, x + dx + jitter[1]:x + dx + jitter[1] + size] = 100 * s + n + 1
        red = 600 + rng.integers(50, 400, mask.shape)
        green = 400 + rng.integers(50, 400, mask.shape)
        small_session(folder, f"s{s}", mask, red, green)
        names.append(f"s{s}")
    return folder, write_manifest(folder, names, [f"2026-05-{11 + s}" for s in range(4)]), shifts


def test_master_run(spark, moving, tmp_path):
    folder, manifest, shifts = moving
    matched, store = master.run_master(
        spark, manifest, tmp_path / "run", OverlapParams(min_seeds=20), GraphParams(), top_n=5
    )
    found = {(r.day_a, r.day_b): (r.shift_z, r.shift_y, r.shift_x) for r in matched.read("shifts").collect()}
    for (a, b), (z, y, x) in found.items():
        want = np.array(shifts[int(a[1])]) - np.array(shifts[int(b[1])])
        assert z == want[0] and abs(y - want[1]) <= 1 and abs(x - want[2]) <= 1
    assert {r.method for r in matched.read("transforms").collect()} == {"restricted_affine"}
    matches = matched.read("pairwise_matches")
    wrong = matches.where((F.col("label_a") % 100) != (F.col("label_b") % 100)).count()
    assert matches.where(F.col("match_policy") == "graph").count() > 250 and wrong <= 0.02 * matches.count()
    nodes = matched.read("track_nodes")
    twice = nodes.groupBy("match_policy", "track_session", "track_label", "session_index").count().where("count > 1")
    assert twice.isEmpty()
    assert nodes.where(F.col("match_policy") == "graph").count() == matched.read("roi_features").count()
    ids = [r[0] for r in matched.read("tracks").where(F.col("match_policy") == "graph").select("cluster_id").orderBy("cluster_id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    assert matched.read("track_edges").where((F.col("pair_gap") == 2) & F.col("accepted_for_track")).count() > 0
    labels = {r[0] for r in matched.read("tracks_agreement").select("track_match_source").distinct().collect()}
    assert labels <= {"consensus", "graph_only", "unmatched"} and "consensus" in labels
    counts = [r["count"] for r in store.read("filter_counts").orderBy("step_order").collect()]
    assert counts[0] >= counts[1] >= counts[2] >= counts[4]
    assert "track_match_source" in store.read("fit_residuals_agreement").columns
    assert store.read("panel_fits").count() == 4


def boxes(rng, number):
    """A mask of 25 boxes with a little noise in place, and labels of its own."""
    mask = np.zeros((6, 60, 60), dtype=int)
    for n in range(25):
        y, x = 3 + 11 * (n // 5) + rng.integers(0, 2), 3 + 11 * (n % 5) + rng.integers(0, 2)
        mask[1:4, y:y + 4 + n % 2, x:x + 4 + n % 3] = 100 * number + n + 1
    return mask


def test_stored_run(spark, tmp_path):
    """A finished run is brought up to date when one mask changes, and refined from its tables."""
    folder, rng = tmp_path / "data", np.random.default_rng(5)
    folder.mkdir()
    names = ["d0", "d1", "d2"]
    masks = [boxes(rng, i).astype(np.uint16) for i in range(3)]
    for name, mask in zip(names, [*masks[:2], boxes(rng, 7).astype(np.uint16)]):
        write_tiff(folder / f"{name}_mask.tif", mask)
        for channel in "RG":  # matching reads no image
            (folder / f"{name}_{channel}.tif").write_bytes(b"no image")
    manifest = write_manifest(folder, names, [f"2026-05-1{i}" for i in range(3)])
    params = {"overlap": OverlapParams(trim_iterations=1), "max_pair_gap": 1}

    def computed(store):
        return read_json(store.path("run_log.json"))["pairs_computed"]

    with pytest.raises(FileNotFoundError, match="no finished run"):
        daywise.refine_matching(spark, manifest, tmp_path / "nothing")
    run = daywise.run_matching(spark, manifest, tmp_path / "run", ("high",), **params)
    before = {(r.day_a, r.day_b): r.computed_at for r in run.read("pair_provenance").collect()}
    assert computed(run) == 2
    write_tiff(folder / "d2_mask.tif", masks[2])
    with pytest.raises(FileExistsError):
        daywise.run_matching(spark, manifest, tmp_path / "run", ("high",), resume=True, **params)
    run = daywise.run_matching(spark, manifest, tmp_path / "run", ("high",), resume=True, overwrite=True, **params)
    assert computed(run) == 1
    after = {(r.day_a, r.day_b): r.computed_at for r in run.read("pair_provenance").collect()}
    assert after["d0", "d1"] == before["d0", "d1"] and after["d1", "d2"] > before["d1", "d2"]

    kept = {name: (folder / f"{name}_mask.tif").read_bytes() for name in names}
    for name in names:  # refinement reads no stack
        (folder / f"{name}_mask.tif").write_bytes(b"no mask")
    run = daywise.refine_matching(spark, manifest, tmp_path / "run")
    for name in names:
        (folder / f"{name}_mask.tif").write_bytes(kept[name])
    # The record is that of a run with both policies, so that it can be resumed as one.
    assert daywise.run_matching(spark, manifest, tmp_path / "run", ("high", "graph"), resume=True, **params).folder == run.folder
    assert computed(run) == 0 and run.read("tracks").where("match_policy = 'graph'").count() > 0
    sizes = {r.session_id: r["count"] for r in run.read("voxels").groupBy("session_id").count().collect()}
    assert sizes == {name: np.count_nonzero(mask) for name, mask in zip(names, masks)}
    labels = {(r.session_id, r.label) for r in run.read("roi_features").collect()}
    assert labels == {(name, int(i)) for name, mask in zip(names, masks) for i in np.unique(mask) if i}
    found = run.read("affine_matches").where("match_policy = 'high'").collect()
    assert len(found) == len({(r.day_a, r.day_b, r.label_a) for r in found}) > 40 and {(r.day_a, r.day_b) for r in found} == set(after)
    assert all(r.label_a % 100 == r.label_b % 100 and f"d{r.label_a // 100}" == r.day_a and f"d{r.label_b // 100}" == r.day_b for r in found)


def test_weekly_run(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    mask = np.zeros((2, 3, 3), dtype=np.uint16)
    mask[0, 0, :], mask[0, 1, :], mask[1, 2, :] = 1, 2, 3
    for week in ("week1", "week2"):
        write_tiff(folder / f"{week}_average_cp_masks.tif", mask)
    for i, day in enumerate(("20260511", "20260512", "20260518", "20260519")):
        red = np.full(mask.shape, 600 + i, dtype=np.uint16) + 10 * mask
        green = np.full(mask.shape, 400 + i, dtype=np.uint16) + 20 * mask
        if day == "20260519":
            green[mask == 2] = 0
        write_tiff(folder / f"{day}_R_SyN.tif", red.astype(np.uint16))
        write_tiff(folder / f"{day}_G_SyN.tif", green.astype(np.uint16))
    write_tiff(folder / "20260511_R.tif", mask)
    matches = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 3)], "cluster_id int, week1_roi int, week2_roi int")
    store = weekly.run_weekly(spark, folder, matches, tmp_path / "out")
    assert [r["count"] for r in store.read("filter_counts").orderBy("step_order").collect()] == [3, 3, 2]
    assert {r[0] for r in store.read("roi_day_complete").select("roi_id").distinct().collect()} == {1, 3}
    weeks = {(r.week_name, r.day) for r in store.read("week_assignments").collect()}
    assert weeks == {("week1", 0), ("week1", 1), ("week2", 7), ("week2", 8)}
    last = store.read("intensity_raw").where((F.col("roi_id") == 2) & (F.col("day") == 8)).collect()
    assert [r.channel for r in last] == ["red"]
    assert weekly.week_columns(["cluster_id", "week10_roi", "week2_roi", "weekx_roi"]) == ["week2", "week10"]


def test_registered_run(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    mask = np.zeros((2, 40, 40), dtype=np.uint16)
    yy, xx = np.mgrid[:40, :40]
    for label, (cy, cx) in enumerate([(8, 8), (8, 28), (28, 8), (28, 28)], start=1):
        mask[:, (yy - cy) ** 2 + (xx - cx) ** 2 <= 25 + label] = label
    write_tiff(folder / "mask.tif", mask)
    rng = np.random.default_rng(0)
    for i, name in enumerate(("20260511_{}.tif", "20260512_{}_SyN.tif", "20260513_{}_SyN.tif")):
        write_tiff(folder / name.format("R"), (700 + 20 * mask + rng.integers(0, 5, mask.shape)).astype(np.uint16))
        write_tiff(folder / name.format("G"), (400 + 30 * i * mask + 40 * mask).astype(np.uint16))
    store = registered.run_registered(spark, folder, "mask.tif", tmp_path / "out")
    assert store.read("intensity_raw").count() == 24
    counts = [r["count"] for r in store.read("filter_counts").orderBy("step_order").collect()]
    assert counts[:2] == [4, 4] and counts == sorted(counts, reverse=True)
    sizes = store.read("sizes").collect()
    assert all(0.85 < r.circularity < 1.2 and r.solidity > 0.9 and r.axis_ratio == pytest.approx(1, abs=0.05) for r in sizes)
    assert store.read("population_quartiles").count() == 3
    assert store.read("top_increasing").count() >= 1


def test_match_weeks(spark, tmp_path):
    """Weekly matcher: one object in all weeks, one missing in week 3, one seen once."""
    def box(mask, label, z, y, x, h, w):
        mask[z:z + 2, y:y + h, x:x + w] = label

    sessions = []
    for week in range(4):
        mask = np.zeros((4, 40, 40), dtype=np.uint16)
        box(mask, 11 + 10 * week, 1, 8, 8, 5, 5)
        if week != 2:
            box(mask, 12 + 10 * week, 1, 25, 24, 4, 7)
        else:
            box(mask, 33, 0, 5, 30, 3, 4)
        path = tmp_path / f"week{week + 1}.tif"
        write_tiff(path, mask)
        sessions.append(man.Session(week, f"week{week + 1}", __import__("datetime").date(2026, 5, 1 + week), path, None, None, True))
    from longitrack.sources.sinks import Store

    wide = weekly.match_weeks(spark, sessions, Store(spark, tmp_path / "out"))
    rows = {tuple(r[f"week{w}_roi"] for w in range(1, 5)): r for r in wide.collect()}
    assert set(rows) == {(11, 21, 31, 41), (12, 22, None, 42), (None, None, 33, None)}
    assert rows[12, 22, None, 42].used_gap_bridge and not rows[11, 21, 31, 41].used_gap_bridge
    assert rows[11, 21, 31, 41].cluster_id == 1
    assert rows[None, None, 33, None].mean_confidence == 0.0
