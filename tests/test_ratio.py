import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from longitrack.functions import student
from longitrack.operators import fits, qc, ranking, ratio, sessions, trajectories
from longitrack.operators.ordering import (
    cumulative, exact_quantiles, from_ordered_bits, global_rank, ordered_bits,
)
from longitrack.params import GeometryQC
from longitrack.plans import catalogue_ratio

LONG = "roi_id int, day int, channel string, mean_intensity double"


@pytest.fixture
def long(spark):
    red = {1: [100, 102, 98], 2: [120, 121, 119], 3: [140, 141, 142]}
    green = {1: [40, 20, 5], 2: [60, 61, 60]}
    rows = [(r, d, c, float(v)) for c, t in (("red", red), ("green", green)) for r, vs in t.items() for d, v in enumerate(vs)]
    return spark.createDataFrame(rows, LONG)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_complete_and_log_ratio(long):
    wide = ratio.pivot_channels(long, "mean_intensity")
    assert wide.where("green is null").count() == 3
    rows = by_key(ratio.log_ratio_metrics(ratio.complete_rois(wide)), "roi_id", "day")
    assert {k[0] for k in rows} == {1, 2} and len(rows) == 6
    assert rows[1, 0].brightness == 140
    assert rows[1, 0].log2_green_over_red == pytest.approx(math.log2(41 / 101))
    assert rows[1, 2].log2_green_over_red == pytest.approx(math.log2(6 / 99))
    assert rows[1, 0].delta_log2_green_over_red == 0


def test_day0_normalised(long):
    wide = ratio.pivot_channels(long, "mean_intensity")
    rows = by_key(ratio.day0_normalised(wide, "green"), "roi_id", "day")
    assert [rows[1, d].green_day0_normalized for d in range(3)] == [1.0, 0.5, 0.125]


def test_missing_baseline_uses_first_present_value(spark):
    wide = spark.createDataFrame([(1, 0, 5.0, -9.0), (1, 1, 5.0, 5.0), (1, 2, 5.0, 11.0)], "roi_id int, day int, red double, green double")
    rows = by_key(ratio.log_ratio_metrics(wide), "day")
    assert rows[0,].log2_green_over_red is None
    assert rows[2,].day0_log2_green_over_red == pytest.approx(0.0) and rows[2,].delta_log2_green_over_red == pytest.approx(1.0)
    assert ratio.day0_normalised(wide, "green").where("green_day0_normalized is not null").count() == 0


def test_required_subset_keeps_extra_days(spark):
    rows = [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (3, 2)]
    wide = spark.createDataFrame([(r, d, 1.0, 1.0) for r, d in rows], "roi_id int, day int, red double, green double")
    kept = ratio.complete_rois(wide, [0, 1]).groupBy("roi_id").count().collect()
    assert {r.roi_id: r["count"] for r in kept} == {1: 3, 2: 2}


def test_dark_correction(spark):
    long = spark.createDataFrame(
        [(1, 0, "green", 330.0), (1, 0, "red", 600.0), (1, 1, "green", 300.0), (1, 1, "red", 520.0)], LONG
    )
    out = ratio.dark_correct(long, {"green": 319, "red": 534})
    assert [r.mean_intensity_corrected for r in out.orderBy("day", "channel").collect()] == [11, 66, -19, -14]
    assert ratio.dark_correct(long, {"green": 319, "red": 534}, floor=0).agg(F.min("mean_intensity_corrected")).first()[0] == 0
    with pytest.raises(Exception, match="unsupported channel"):
        ratio.dark_correct(long.withColumn("channel", F.lit("blue")), {"red": 1}).collect()


def test_daily_fits(spark):
    rows = [(0, r, g) for r, g in ((1, 5), (2, 7), (3, 9))] + [(1, r, g) for r, g in ((2, 0), (4, -1), (6, -2))]
    df = spark.createDataFrame([(d, float(r), float(g)) for d, r, g in rows], "day int, red double, green double")
    out = by_key(fits.fit_intervals(fits.daily_fits(df)), "day")
    assert (out[0,].slope, out[0,].intercept) == pytest.approx((2, 3)) and out[0,].n_rois == 3
    assert (out[1,].slope, out[1,].intercept, out[1,].r_squared) == pytest.approx((-0.5, 1, 1))


def test_fit_skips_missing_and_infinite(spark):
    rows = [(0, 1.0, 3.0), (0, 2.0, 5.0), (0, float("nan"), 7.0), (0, 4.0, float("inf"))]
    df = spark.createDataFrame(rows, "day int, red double, green double")
    r = fits.fit_intervals(fits.daily_fits(df)).first()
    assert r.n_rois == 2 and (r.slope, r.intercept) == pytest.approx((2, 1)) and r.slope_ci_low is None
    with pytest.raises(Exception, match="identical"):
        fits.daily_fits(df.withColumn("red", F.lit(1.0)).where("green < 6")).collect()


def test_student_equals_a_library(spark):
    """Probabilities, densities and critical values against the JVM's statistics library, from 1 to 10^7 degrees."""
    library = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    cases = [(float(t), d) for d in (1, 2, 3, 7, 30, 299, 10_000, 10_000_000) for t in (0.0, 1e-6, 0.3, 1.0, 1.96, 4.0, 30.0)]
    df = spark.createDataFrame(cases, "t double, d long").select(
        "t", "d", student.two_sided_p(F.col("t"), F.col("d")).alias("p"), student.density(F.col("t"), F.col("d")).alias("f"),
        *[student.critical_value(F.col("d"), a).alias(f"c{i}") for i, a in enumerate((0.05, 0.001))])
    for r in df.collect():
        own = library(float(r.d))
        assert r.p == pytest.approx(2 * own.cumulativeProbability(-r.t), rel=1e-7, abs=1e-6 if r.t < 1e-3 else 1e-14)
        assert r.f == pytest.approx(own.density(r.t), rel=1e-7, abs=1e-14)
        assert [r.c0, r.c1] == pytest.approx([own.inverseCumulativeProbability(1 - a / 2) for a in (0.05, 0.001)], rel=1e-6)
    odd = spark.createDataFrame([(float("inf"), 5), (None, 5), (1.0, 0)], "t double, d long").select(
        student.two_sided_p(F.col("t"), F.col("d")).alias("p"), student.critical_value(F.col("d"), 0.05).alias("c")).collect()
    assert [r.p for r in odd] == [0.0, None, None] and odd[2].c is None


def test_fit_inference(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=12)
    y = 2 * x + rng.normal(size=12)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y)], "day int, red double, green double")
    r = fits.fit_intervals(fits.daily_fits(df)).first()
    design = np.column_stack([x, np.ones(12)])
    coef, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    cov = np.linalg.inv(design.T @ design) * rss[0] / 10
    assert (r.slope, r.intercept) == pytest.approx(tuple(coef))
    assert (r.slope_stderr, r.intercept_stderr) == pytest.approx(tuple(np.sqrt(np.diag(cov))))
    assert r.slope_ci_high - r.slope == pytest.approx(2.2281388519649385 * r.slope_stderr)
    assert 0 < r.p_value < 0.05


def test_residuals_and_signs(spark):
    wide = spark.createDataFrame(
        [(1, 0, 10.0, 6.0), (1, 1, 10.0, 3.0), (2, 0, 20.0, 8.0), (2, 1, 20.0, 11.0)], "roi_id int, day int, red double, green double"
    )
    lines = spark.createDataFrame([(0, 0.2, 3.0), (1, 0.4, 1.0)], "day int, slope double, intercept double")
    rows = by_key(fits.fit_residuals(wide, lines), "roi_id", "day")
    assert [rows[1, d].green_fit_residual for d in (0, 1)] == pytest.approx([1, -2])
    assert rows[1, 1].delta_green_fit_residual == pytest.approx(-3) and rows[2, 1].green_fit_residual == pytest.approx(2)
    with pytest.raises(Exception, match="no fit"):
        fits.fit_residuals(wide, lines.where("day = 0")).collect()
    values = {1: [2, -1, -3], 2: [-2, -1, -0.5], 3: [0, 0, 1, 0, -1]}
    res = spark.createDataFrame(
        [(k, d, float(v)) for k, vs in values.items() for d, v in enumerate(vs)], "roi_id int, day int, green_fit_residual double"
    )
    out = by_key(trajectories.residual_sign_changes(res), "roi_id")
    assert [out[k,].green_fit_residual_sign_change_count for k in (1, 2, 3)] == [1, 0, 2]
    assert out[1,].green_fit_residual_range == 5 and out[3,].last_green_fit_residual == -1


def test_trajectory_classes(spark):
    series = {
        1: [0, 0.08, -0.10, 0.12, -0.06], 2: [0, -0.12, -0.42, -0.55, -0.38], 3: [0, 0.10, 0.36, 0.48, 0.40],
        4: [0, 0.34, -0.30, 0.42, -0.28],
    }
    df = spark.createDataFrame(
        [(k, d, float(v)) for k, vs in series.items() for d, v in enumerate(vs)],
        "roi_id int, day int, delta_log2_green_over_red double",
    )
    out = by_key(trajectories.trajectory_classes(df), "roi_id")
    assert [out[k,].trajectory_category for k in (1, 2, 3, 4)] == ["stable", "mostly_down", "mostly_up", "oscillatory"]
    assert out[4,].significant_sign_change_count >= 2


def test_size_and_shape(spark):
    sizes = spark.createDataFrame([(i + 1, float(a)) for i, a in enumerate((10, 20, 30, 40, 500))], "roi_id int, proj_area_px double")
    b = qc.size_bounds(sizes, lower=0.20).first()
    assert (b.lower_bound, b.upper_bound) == pytest.approx((18, 70))
    kept = qc.within_size_bounds(sizes, qc.size_bounds(sizes, lower=0.20))
    assert sorted(r.roi_id for r in kept.collect()) == [2, 3, 4]
    shapes = spark.createDataFrame(
        [(1, 0.90, 0.95, 1.20), (2, 0.50, 0.70, 2.60), (3, 0.80, 0.92, 1.80)],
        "roi_id int, circularity double, solidity double, axis_ratio double",
    )
    assert [r.shape_qc_pass for r in qc.shape_flags(shapes).orderBy("roi_id").collect()] == [True, False, True]


def test_ranking(spark):
    summary = spark.createDataFrame(
        [(1, 100.0, 10.0, 0.05, -0.1, 0.3, 0.4), (2, 100.0, 10.0, 0.05, -0.2, 1.2, 1.4), (3, 100.0, 10.0, 0.05, -0.3, 0.7, 1.0)],
        "roi_id int, day0_brightness double, day0_green double, red_cv double, min_delta_log2_green_over_red double, "
        "max_delta_log2_green_over_red double, delta_log2_range double",
    )
    top = ranking.top_changing(summary, "increasing", 2).orderBy("selection_rank")
    assert [r.roi_id for r in top.collect()] == [2, 3]
    assert [r.roi_id for r in ranking.top_changing(summary, "decreasing", 1).collect()] == [3]
    one = ranking.top_changing(summary, top_n=2, random_sample=True, seed=5).orderBy("selection_rank").collect()
    two = ranking.top_changing(summary, "increasing", 2, random_sample=True, seed=5).orderBy("selection_rank").collect()
    assert [r.roi_id for r in one] == [r.roi_id for r in two] and len(one) == 2
    order = spark.createDataFrame([(3, 1), (1, 2), (2, 3)], "roi_id int, selection_rank int")
    days = spark.createDataFrame([(r, d) for r in (1, 2, 3) for d in (0, 1)], "roi_id int, day int")
    rows = ranking.ranked_roi_days(days, order, 2, ["selection_rank"]).collect()
    assert len(rows) == 4 and {r.roi_id for r in rows} == {1, 3}


def test_geometry_flags(spark):
    rows = [(1, f"d{i}", i, v, 3, False, i == 2, True, 0.0, 0.0, 3.0 * i) for i, v in enumerate((10.0, 20.0, 90.0))]
    geo = spark.createDataFrame(
        rows, "roi_id int, session_id string, session_index int, volume_um3 double, bbox_depth_planes int, touches_z_edge boolean, "
        "touches_xy_edge boolean, required boolean, centroid_z_um double, centroid_y_um double, centroid_x_um double",
    )
    plain = qc.track_geometry_summary(qc.geometry_flags(geo)).first()
    assert plain.segmentation_qc_status == "not_configured" and plain.segmentation_qc_pass_all_required_days is None
    conf = GeometryQC(max_volume_ratio_from_track_median=2.0)
    flags = by_key(qc.geometry_flags(geo, conf), "session_index")
    assert [flags[i,].geometry_qc_pass for i in range(3)] == [True, True, False]
    out = qc.track_geometry_summary(qc.geometry_flags(geo, conf), conf).first()
    assert out.n_geometry_qc_pass == 2 and not out.segmentation_qc_pass_all_required_days and out.n_edge_sessions == 1
    loose = GeometryQC(mode="fraction", min_pass_fraction=0.6, max_volume_ratio_from_track_median=2.0)
    assert qc.track_geometry_summary(qc.geometry_flags(geo, loose), loose).first().segmentation_qc_pass_all_required_days
    steps = by_key(trajectories.centroid_steps(geo), "session_index")
    assert steps[0,].centroid_step_um_from_previous_observed_session is None
    assert steps[2,].centroid_step_um_from_previous_observed_session == pytest.approx(3.0)


def test_merge_reasons(spark):
    df = spark.createDataFrame([("gap_bridge, edge_heavy", True), ("", True), (None, False)], "r string, e boolean")
    out = [x[0] for x in df.select(qc.merge_reasons(F.col("r"), {"edge_heavy": F.col("e"), "other": ~F.col("e")})).collect()]
    assert out == ["gap_bridge,edge_heavy", "edge_heavy", "other"]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=400), 1: np.repeat(rng.integers(0, 5, 60), 7).astype(float), 2: np.array([3.0])}
    groups[0][:150] = 1.25
    groups[3] = np.concatenate([rng.normal(size=50) * 10.0 ** rng.integers(-300, 300, 50), [0.0, -0.0, 5e-324, -5e-324]])
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(0, None), (1, float("nan")), (None, 4.0), (None, 8.0), (7, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    probs = {"a": 0.05, "b": 0.5, "c": 0.913}
    got = by_key(exact_quantiles(df, "v", probs, ["g"]), "g")
    for g, vs in groups.items():
        assert [got[g,][k] for k in probs] == pytest.approx(np.quantile(vs, list(probs.values())), rel=1e-12, abs=0)
    assert got[None,]["b"] == 6.0 and (7,) not in got
    one = exact_quantiles(df.where("g = 0"), "v", {"q": 0.25}).first()
    assert one.q == pytest.approx(np.quantile(groups[0], 0.25))
    assert [r.q for r in exact_quantiles(df.where("false"), "v", {"q": 0.25}).collect()] == [None]


def test_bits_sort_like_doubles(spark):
    values = [float("-inf"), -1e300, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1e-9, 1.0, 2.5, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in [*values, -0.0]], "v double").select("v", ordered_bits(F.col("v")).alias("b"))
    df = df.select("v", "b", from_ordered_bits(F.col("b")).alias("back"))
    rows = df.collect()
    assert [r.b for r in rows[:-1]] == sorted({r.b for r in rows[:-1]}) and rows[-1].b == rows[5].b == 0
    assert all(r.back == r.v for r in rows)


def test_quantiles_at_every_group_size(spark):
    """Positions between ranks, for groups of one to forty values, some of them equal."""
    rng = np.random.default_rng(8)
    groups = {n: np.round(rng.normal(size=n), 1 + n % 2) for n in range(1, 41)}
    df = spark.createDataFrame([(n, float(v)) for n, vs in groups.items() for v in vs], "g int, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.95, "f": 1.0}
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        assert [r[k] for k in probs] == pytest.approx(np.quantile(groups[r.g], list(probs.values())))


@pytest.mark.parametrize("partitions", [None, 6])
def test_ranks_over_partitions(spark, partitions):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), (-F.col("id") % 10).alias("k"))
    ranked = global_rank(df, [F.desc("k"), F.asc("id")], partitions=partitions).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 1001))
    assert [r.id for r in ranked] == [r.id for r in sorted(ranked, key=lambda r: (-r.k, r.id))]
    grouped = global_rank(df, [F.asc("id")], ["g"], partitions=partitions).collect()
    assert all(r["rank"] == r.id // 3 + 1 for r in grouped)
    total = cumulative(df, [F.asc("id")], weight=F.col("id"), partitions=partitions).agg(F.max("cum")).first()[0]
    assert total == 999 * 1000 // 2


def object_rows(spark, folder, prices):
    """A lineitem table with one row for every object and day 0 .. 6, of quantity 20."""
    rows = [(roi, 20.0, float(price), f"{1995 + day}-03-01 00:00:00") for roi, own in prices.items() for day, price in enumerate(own)]
    table = spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_extendedprice double, shipped string")
    table.withColumn("l_shipdate", F.to_timestamp("shipped")).drop("shipped").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_components_leave_out_infinite_changes(spark, tmp_path):
    rnd = np.random.default_rng(5)
    prices = {roi: rnd.uniform(20_000, 90_000, 7) for roi in range(30)}
    log2 = np.log2((np.array(list(prices.values())) / 777.0 - 10 + 1) / 16)
    values = np.linalg.eigvalsh(np.cov((log2 - log2[:, :1]).T))[::-1]
    late, early = prices[0].copy(), prices[1].copy()
    late[4] = early[0] = 6993.0  # green + 1 is zero there: the changes are infinite
    sf = object_rows(spark, tmp_path, {**prices, 98: late, 99: early})
    shares = {r["component"]: r["explained_variance"] for r in catalogue_ratio.object_components(spark, sf).collect()}
    assert shares == pytest.approx({i + 1: values[i] / values.sum() for i in range(3)}, abs=2e-6)


def test_components_need_two_objects(spark, tmp_path):
    sf = object_rows(spark, tmp_path, {1: [30_000, 40_000, 50_000, 35_000, 45_000, 55_000, 60_000], 2: [30_000]})
    assert catalogue_ratio.object_components(spark, sf).collect() == []
    wide = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 1.0)], "roi_id long, day int, v double")
    scores, shares = sessions.object_components(wide, "v", [0, 1])
    assert [tuple(r) for r in scores.collect()] == [(1, None)] and shares == []
