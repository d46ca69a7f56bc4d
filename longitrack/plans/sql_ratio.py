"""SQL twins of the intensity queries, for the side-by-side check in DuckDB."""

from __future__ import annotations

MEANS = """
means AS (
  SELECT l_partkey AS roi_id, year(l_shipdate) - 1995 AS day,
         avg(l_quantity) AS red, avg(l_extendedprice) / 777.0 AS green
  FROM lineitem GROUP BY 1, 2)"""

ROI_DAY = MEANS + """,
roi_day AS (SELECT roi_id, day, red - 5.0 AS red, green - 10.0 AS green FROM means)"""

METRICS = ROI_DAY + """,
complete AS (
  SELECT * FROM roi_day
  WHERE roi_id IN (SELECT roi_id FROM roi_day GROUP BY roi_id
                   HAVING count(DISTINCT day) = (SELECT count(DISTINCT day) FROM roi_day))),
ratios AS (
  SELECT *, red + green AS brightness,
         CASE WHEN red + green > 0 THEN green / (red + green) END AS green_fraction,
         CASE WHEN red + 1.0 <> 0 AND (green + 1.0) / (red + 1.0) > 0
              THEN log2((green + 1.0) / (red + 1.0)) END AS log2_green_over_red
  FROM complete),
based AS (
  SELECT *, first_value(log2_green_over_red IGNORE NULLS) OVER (
           PARTITION BY roi_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING
         ) AS day0_log2_green_over_red
  FROM ratios),
metrics AS (SELECT *, log2_green_over_red - day0_log2_green_over_red AS delta_log2_green_over_red FROM based)"""

FITS = METRICS + """,
sums AS (
  SELECT day, count(*) AS n_rois, avg(red) AS x_mean, avg(green) AS y_mean, min(red) AS x_min, max(red) AS x_max,
         regr_sxx(green, red) AS sxx, regr_syy(green, red) AS syy, regr_sxy(green, red) AS sxy,
         regr_slope(green, red) AS slope, regr_intercept(green, red) AS intercept, corr(green, red) AS r_value
  FROM metrics GROUP BY day),
fits AS (
  SELECT *, r_value * r_value AS r_squared,
         sqrt((1 - r_value * r_value) * syy / sxx / (n_rois - 2)) AS slope_stderr,
         sqrt((1 - r_value * r_value) * syy / sxx / (n_rois - 2)) * sqrt(sxx / n_rois + x_mean * x_mean) AS intercept_stderr
  FROM sums)"""

# Student's t with d degrees of freedom lies within t of 0 by the finite trigonometric sums for whole d.
WITHIN_T = """CASE WHEN d % 2 = 0 THEN sin(atan(t / sqrt(d))) * list_sum(list_transform(range(0, d // 2),
           lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0) + 2 * k * ln(cos(atan(t / sqrt(d)))))))
         ELSE 2 / pi() * (atan(t / sqrt(d)) + coalesce(sin(atan(t / sqrt(d))) * list_sum(list_transform(range(0, (d - 1) // 2),
           lambda k: exp(lgamma(1.5) + lgamma(k + 1.0) - lgamma(k + 1.5) + (2 * k + 1) * ln(cos(atan(t / sqrt(d))))))), 0)) END"""
LIMITS = "WITH RECURSIVE " + FITS + f""",
newton AS (
  SELECT day, n_rois - 2 AS d, 1.959963984540054::DOUBLE AS t, 0 AS i FROM fits
  UNION ALL
  SELECT day, d, t + ((1 - ({WITHIN_T})) - 0.05) / (2 * exp(lgamma((d + 1) / 2.0) - lgamma(d / 2.0) - 0.5 * ln(d * pi())
         - (d + 1) / 2.0 * ln(1 + t * t / d))), i + 1 FROM newton WHERE i < 40),
ends AS (SELECT day, t AS t_critical FROM newton WHERE i = 40),
tests AS (SELECT *, n_rois - 2 AS d, abs(r_value) * sqrt((n_rois - 2) / ((1 - r_value) * (1 + r_value))) AS t FROM fits),
limits AS (
  SELECT day, n_rois, greatest(0.0, 1 - ({WITHIN_T})) AS p_value, t_critical,
         slope - t_critical * slope_stderr AS slope_ci_low, slope + t_critical * slope_stderr AS slope_ci_high,
         intercept - t_critical * intercept_stderr AS intercept_ci_low, intercept + t_critical * intercept_stderr AS intercept_ci_high
  FROM tests JOIN ends USING (day))"""

RESIDUALS = FITS + """,
res AS (
  SELECT m.roi_id, m.day, intercept + slope * red AS predicted_green_from_fit,
         green - (intercept + slope * red) AS green_fit_residual,
         (green - (intercept + slope * red)) / sqrt(1 + slope * slope) AS green_fit_signed_distance
  FROM metrics m JOIN fits USING (day))"""

SUMMARY = METRICS + """,
roi_summary AS (
  SELECT roi_id, count(*) AS n_days, arg_min(red, day) AS day0_red, arg_min(green, day) AS day0_green,
         arg_min(brightness, day) AS day0_brightness,
         max(log2_green_over_red) FILTER (day = 0) AS day0_log2_green_over_red,
         CASE WHEN abs(avg(red)) > 1e-8 THEN stddev_pop(red) / avg(red) END AS red_cv,
         CASE WHEN abs(avg(green)) > 1e-8 THEN stddev_pop(green) / avg(green) END AS green_cv,
         CASE WHEN abs(avg(brightness)) > 1e-8 THEN stddev_pop(brightness) / avg(brightness) END AS brightness_cv,
         CASE WHEN count(delta_log2_green_over_red) = count(*) THEN min(delta_log2_green_over_red) END
           AS min_delta_log2_green_over_red,
         coalesce(min(day) FILTER (delta_log2_green_over_red IS NULL), arg_min(day, delta_log2_green_over_red))
           AS day_of_min_delta,
         CASE WHEN count(delta_log2_green_over_red) = count(*) THEN max(delta_log2_green_over_red) END
           AS max_delta_log2_green_over_red,
         CASE WHEN count(delta_log2_green_over_red) = count(*)
              THEN max(delta_log2_green_over_red) - min(delta_log2_green_over_red) END AS delta_log2_range,
         max(delta_log2_green_over_red) FILTER (day = 6) AS day_last_delta_log2_green_over_red
  FROM metrics GROUP BY roi_id)"""


def top(direction: str) -> str:
    metric = "min_delta_log2_green_over_red" if direction == "decreasing" else "max_delta_log2_green_over_red"
    order = f"{metric} {'ASC' if direction == 'decreasing' else 'DESC'} NULLS LAST"
    return SUMMARY + f""",
thr AS (SELECT quantile_cont(day0_brightness, 0.25) AS brightness_threshold FROM roi_summary),
cand AS (
  SELECT * FROM roi_summary, thr
  WHERE red_cv <= 0.35 AND day0_brightness >= brightness_threshold AND day0_green > 0),
top AS (
  SELECT *, row_number() OVER (
           ORDER BY {order}, delta_log2_range DESC NULLS LAST, day0_brightness DESC NULLS LAST, roi_id) AS selection_rank
  FROM cand QUALIFY selection_rank <= 30)"""


def top_query(direction: str) -> str:
    metric = "min_delta_log2_green_over_red" if direction == "decreasing" else "max_delta_log2_green_over_red"
    return f"""WITH {top(direction)}
SELECT roi_id, selection_rank, round(min_delta_log2_green_over_red, 6) AS min_delta_log2_green_over_red,
       round(max_delta_log2_green_over_red, 6) AS max_delta_log2_green_over_red,
       round(delta_log2_range, 6) AS delta_log2_range, round(day0_brightness, 6) AS day0_brightness,
       round(brightness_threshold, 6) AS brightness_threshold,
       '{direction}' AS selection_direction, '{metric}' AS selection_metric_column
FROM top"""


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


GEOMETRY = """
geo AS (
  SELECT l_partkey AS roi_id, year(l_shipdate) - 1995 AS session_index, sum(l_quantity) AS volume_um3,
         count(*) AS bbox_depth_planes, min(l_linenumber) = 1 AS touches_z_edge, max(l_linenumber) = 7 AS touches_xy_edge,
         avg(l_quantity) AS cz, avg(l_extendedprice) / 1000 AS cy, avg(l_discount) * 100 AS cx,
         year(l_shipdate) - 1995 <> 3 AS required
  FROM lineitem GROUP BY 1, 2),
med AS (SELECT *, median(volume_um3) OVER (PARTITION BY roi_id) AS track_median_volume_um3 FROM geo),
flags AS (
  SELECT *, greatest(volume_um3 / track_median_volume_um3, track_median_volume_um3 / volume_um3)
              AS volume_fold_change_to_track_median,
         volume_um3 >= 20 AS geometry_min_volume_pass, volume_um3 <= 400 AS geometry_max_volume_pass,
         bbox_depth_planes >= 2 AS geometry_min_bbox_depth_pass, NOT touches_xy_edge AS geometry_xy_edge_pass,
         greatest(volume_um3 / track_median_volume_um3, 1.0 / (volume_um3 / track_median_volume_um3)) <= 2.0
           AS geometry_volume_ratio_pass
  FROM med),
qc AS (
  SELECT *, geometry_min_volume_pass AND geometry_max_volume_pass AND geometry_min_bbox_depth_pass
            AND geometry_xy_edge_pass AND geometry_volume_ratio_pass AS geometry_qc_pass
  FROM flags)"""

METRIC_COLUMNS = (
    "red", "green", "brightness", "green_fraction", "log2_green_over_red", "day0_log2_green_over_red",
    "delta_log2_green_over_red",
)
FIT_SELECT = "day, n_rois, " + r("slope", "intercept", "r_value", "r_squared", "slope_stderr", "intercept_stderr")

SQL = {
    "dark_correction": f"""WITH {MEANS}
SELECT roi_id, day, 'red' AS channel, round(red, 6) AS mean_intensity, 5.0::DOUBLE AS dark_value,
       round(red - 5.0, 6) AS mean_intensity_corrected FROM means
UNION ALL
SELECT roi_id, day, 'green', round(green, 6), 10.0::DOUBLE, round(green - 10.0, 6) FROM means""",
    "pivot_channels_first": f"WITH {ROI_DAY} SELECT roi_id, day, {r('red', 'green')} FROM roi_day",
    "complete_rois": f"WITH {METRICS} SELECT roi_id, day, {r('red', 'green')} FROM complete",
    "complete_rois_required_subset": f"""WITH {ROI_DAY}
SELECT roi_id, day, {r('red', 'green')} FROM roi_day WHERE roi_id IN (
  SELECT roi_id FROM roi_day WHERE day IN (0, 2, 4) GROUP BY roi_id HAVING count(DISTINCT day) = 3)""",
    "log_ratio_metrics": f"WITH {METRICS} SELECT roi_id, day, {r(*METRIC_COLUMNS)} FROM metrics",
    "day0_normalized": f"""WITH {ROI_DAY},
b AS (SELECT *, first_value(green) OVER (PARTITION BY roi_id ORDER BY day) AS day0_green FROM roi_day)
SELECT roi_id, day, {r('red', 'green', 'day0_green')},
       round(CASE WHEN day0_green > 0 THEN green / day0_green END, 6) AS green_day0_normalized FROM b""",
    "roi_summary": f"""WITH {SUMMARY}
SELECT roi_id, n_days, day_of_min_delta, {r('day0_red', 'day0_green', 'day0_brightness', 'day0_log2_green_over_red',
       'red_cv', 'green_cv', 'brightness_cv', 'min_delta_log2_green_over_red', 'max_delta_log2_green_over_red',
       'delta_log2_range', 'day_last_delta_log2_green_over_red')} FROM roi_summary""",
    "population_quartiles": f"""WITH {METRICS}
SELECT day, {', '.join(
    f"round(quantile_cont({c}, {p}), 6) AS {k}_{q}"
    for k, c in (('raw_log2', 'log2_green_over_red'), ('delta_log2', 'delta_log2_green_over_red'),
                 ('green_fraction', 'green_fraction'))
    for q, p in (('median', 0.5), ('q25', 0.25), ('q75', 0.75)))}
FROM metrics GROUP BY day""",
    "event_channels": """WITH wide AS (
  SELECT user_id AS roi_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day,
         avg(value) FILTER (event_type IN ('view', 'click')) AS red,
         avg(value) FILTER (event_type IS NULL OR event_type NOT IN ('view', 'click')) AS green
  FROM events GROUP BY 1, 2),
ratios AS (
  SELECT *, red + green AS brightness, CASE WHEN red + green > 0 THEN green / (red + green) END AS green_fraction,
         CASE WHEN red + 1.0 <> 0 AND (green + 1.0) / (red + 1.0) > 0
              THEN log2((green + 1.0) / (red + 1.0)) END AS log2_green_over_red FROM wide),
b AS (
  SELECT *, first_value(log2_green_over_red IGNORE NULLS) OVER (
    PARTITION BY roi_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS day0_log2_green_over_red
  FROM ratios)
SELECT roi_id, day, """ + r("red", "green", "brightness", "green_fraction", "log2_green_over_red", "day0_log2_green_over_red")
    + ", round(log2_green_over_red - day0_log2_green_over_red, 6) AS delta_log2_green_over_red FROM b",
    "daily_linear_fit": f"WITH {FITS} SELECT {FIT_SELECT} FROM fits",
    "fit_limits": f"{LIMITS} SELECT day, n_rois, " + r(
        "p_value", "t_critical", "slope_ci_low", "slope_ci_high", "intercept_ci_low", "intercept_ci_high") + " FROM limits",
    "fit_residuals": f"""WITH {RESIDUALS},
d AS (SELECT *, first_value(green_fit_residual) OVER w AS r0, first_value(green_fit_signed_distance) OVER w AS s0
      FROM res WINDOW w AS (PARTITION BY roi_id ORDER BY day))
SELECT roi_id, day, {r('predicted_green_from_fit', 'green_fit_residual', 'green_fit_signed_distance')},
       round(green_fit_residual - r0, 6) AS delta_green_fit_residual,
       round(green_fit_signed_distance - s0, 6) AS delta_green_fit_signed_distance FROM d""",
    "residual_sign_changes": f"""WITH {RESIDUALS},
s AS (SELECT *, coalesce(last_value(nullif(sign(green_fit_residual), 0) IGNORE NULLS) OVER (
        PARTITION BY roi_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sg FROM res),
t AS (SELECT *, lag(sg) OVER (PARTITION BY roi_id ORDER BY day) AS prev FROM s)
SELECT roi_id, round(min(green_fit_residual), 6) AS min_green_fit_residual,
       round(max(green_fit_residual), 6) AS max_green_fit_residual,
       round(max(green_fit_residual) - min(green_fit_residual), 6) AS green_fit_residual_range,
       round(arg_max(green_fit_residual, day), 6) AS last_green_fit_residual,
       count(*) FILTER (sg <> prev) AS green_fit_residual_sign_change_count
FROM t GROUP BY roi_id""",
    "artifact_filter_refit": f"""WITH {FITS.replace('FROM metrics GROUP BY day', 'FROM metrics WHERE green <= 60 GROUP BY day')}
SELECT {FIT_SELECT} FROM fits""",
    "mean_line": f"WITH {FITS} SELECT round(avg(slope), 6) AS mean_slope, round(avg(intercept), 6) AS mean_intercept FROM fits",
    "ci_band": f"""WITH {FITS},
g AS (SELECT *, grid_index, x_min + (x_max - x_min) * grid_index / 199 AS x
      FROM fits, (SELECT unnest(range(200)) AS grid_index)),
h AS (SELECT *, intercept + slope * x AS y_hat,
             sqrt((syy - slope * sxy) / (n_rois - 2)) * sqrt(1.0 / n_rois + (x - x_mean) * (x - x_mean) / sxx) AS half FROM g)
SELECT day, grid_index, {r('x', 'y_hat')}, round(y_hat - half, 6) AS y_low, round(y_hat + half, 6) AS y_high FROM h""",
    "trajectory_classes": f"""WITH {METRICS},
s AS (SELECT *, delta_log2_green_over_red AS d,
             CASE WHEN abs(delta_log2_green_over_red) >= 0.25 THEN sign(delta_log2_green_over_red) END AS sg FROM metrics),
t AS (SELECT *, last_value(sg IGNORE NULLS) OVER (
        PARTITION BY roi_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
f AS (
  SELECT roi_id, CASE WHEN count(d) = count(*) THEN max(abs(d)) END AS mx,
         CASE WHEN count(d) = count(*) THEN min(d) END AS lo, CASE WHEN count(d) = count(*) THEN max(d) END AS hi,
         max(d) FILTER (day = 6) AS fin, count(*) FILTER (sg <> prev) AS turns
  FROM t GROUP BY roi_id)
SELECT roi_id, round(mx, 6) AS max_abs_delta_log2_green_over_red, round(lo, 6) AS min_delta_log2_green_over_red,
       round(hi, 6) AS max_delta_log2_green_over_red, round(fin, 6) AS final_delta_log2_green_over_red,
       turns AS significant_sign_change_count,
       CASE WHEN mx < 0.25 THEN 'stable'
            WHEN lo <= -0.25 AND hi >= 0.25 AND turns >= 1 THEN 'oscillatory'
            WHEN lo <= -0.35 AND fin <= -0.15 AND abs(lo) >= hi THEN 'mostly_down'
            WHEN hi >= 0.35 AND fin >= 0.15 AND hi >= abs(lo) THEN 'mostly_up'
            ELSE 'stable' END AS trajectory_category
FROM f""",
    "top_decreasing": top_query("decreasing"),
    "top_increasing": top_query("increasing"),
    "ranked_roi_days": f"""WITH {top('decreasing')}
SELECT d.roi_id, d.day, round(d.red, 6) AS red, round(d.green, 6) AS green, t.selection_rank
FROM roi_day d JOIN top t USING (roi_id)""",
    "ranked_heatmap": f"""WITH {top('decreasing')}
SELECT CASE WHEN selection_rank < 10 THEN '0' ELSE '' END || selection_rank || ':' || roi_id AS row_label,
       {', '.join(f"round(max(m.delta_log2_green_over_red) FILTER (m.day = {d}), 6) AS day_{d}" for d in range(7))}
FROM metrics m JOIN (SELECT roi_id, selection_rank FROM top) t USING (roi_id) GROUP BY roi_id, selection_rank""",
    "size_bounds": """WITH s AS (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
q AS (SELECT quantile_cont(v, 0.05) AS lower_bound, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM s)
SELECT round(lower_bound, 6) AS lower_bound, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound FROM q""",
    "size_filter": """WITH s AS (SELECT l_partkey AS roi_id, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
q AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM s)
SELECT roi_id, round(v, 6) AS proj_area_px FROM s, q WHERE v >= lo AND v <= q3 + 1.5 * (q3 - q1)""",
    "display_range": f"WITH {ROI_DAY} SELECT day, round(quantile_cont(green, 0.995), 6) AS vmax FROM roi_day GROUP BY day",
    "shape_flags": """WITH s AS (
  SELECT l_partkey AS roi_id, round(avg(l_discount) / 0.07, 6) AS circularity, round(1 - avg(l_tax) / 0.9, 6) AS solidity,
         round(max(l_quantity) / min(l_quantity), 6) AS axis_ratio FROM lineitem GROUP BY 1)
SELECT *, circularity >= 0.65 AND solidity >= 0.95 AND axis_ratio <= 8.0 AS shape_qc_pass FROM s""",
    "geometry_qc": f"""WITH {GEOMETRY}
SELECT roi_id, session_index, {r('track_median_volume_um3', 'volume_fold_change_to_track_median')},
       geometry_min_volume_pass, geometry_max_volume_pass, geometry_min_bbox_depth_pass, geometry_xy_edge_pass,
       geometry_volume_ratio_pass, geometry_qc_pass FROM qc""",
    "track_geometry_summary": f"""WITH {GEOMETRY},
a AS (
  SELECT roi_id, 'configured' AS segmentation_qc_status, count(*) FILTER (required) AS n_required_sessions,
         count(*) FILTER (required AND geometry_qc_pass) AS n_geometry_qc_pass,
         count(*) FILTER (touches_z_edge OR touches_xy_edge) AS n_edge_sessions, count(*) AS n,
         median(volume_um3) AS m, min(volume_um3) AS lo, max(volume_um3) AS hi
  FROM qc GROUP BY roi_id)
SELECT roi_id, segmentation_qc_status, n_required_sessions, n_geometry_qc_pass, n_edge_sessions,
       round(m, 6) AS track_median_volume_um3, round(lo, 6) AS min_volume_um3, round(hi, 6) AS max_volume_um3,
       round(CASE WHEN n_required_sessions > 0 THEN n_geometry_qc_pass / n_required_sessions END, 6)
         AS segmentation_qc_pass_fraction,
       n_required_sessions > 0 AND n_geometry_qc_pass = n_required_sessions AS segmentation_qc_pass_all_required_days,
       round(CASE WHEN n >= 2 AND lo > 0 THEN hi / lo END, 6) AS max_volume_fold_change FROM a""",
    "centroid_steps": f"""WITH {GEOMETRY}
SELECT roi_id, session_index, round(sqrt(power(cz - lag(cz) OVER w, 2) + power(cy - lag(cy) OVER w, 2)
       + power(cx - lag(cx) OVER w, 2)), 6) AS centroid_step_um_from_previous_observed_session
FROM geo WINDOW w AS (PARTITION BY roi_id ORDER BY session_index)""",
    "presence_summary": f"""WITH {ROI_DAY},
p AS (SELECT roi_id, CASE WHEN day < 3 THEN day + 1 WHEN day > 3 THEN day END AS p FROM roi_day),
a AS (SELECT roi_id, count(p) AS n, coalesce(max(p) - min(p) + 1 - count(p), 0) AS gap FROM p GROUP BY roi_id)
SELECT roi_id, n AS n_required_sessions_present, 6 - n AS n_required_sessions_missing,
       gap AS missing_required_internal_days, n = 6 AS all_required_sessions_present,
       n = 5 AS exactly_one_required_session_missing FROM a""",
    "filter_funnel": f"""WITH {ROI_DAY},
a AS (SELECT roi_id, count(*) AS n, max(day) - min(day) + 1 - count(*) AS gap FROM roi_day GROUP BY roi_id),
c AS (
  SELECT 0 AS step_order, 'all_tracks' AS step, count(*) AS count FROM a
  UNION ALL SELECT 1, 'at_least_two_sessions', count(*) FROM a WHERE n >= 2
  UNION ALL SELECT 2, 'complete_required_sessions', count(*) FROM a WHERE n = 7
  UNION ALL SELECT 3, 'one_internal_gap', count(*) FROM a WHERE n = 6 AND gap = 1)
SELECT step_order, step, count,
       round(100.0 * count / first_value(count) OVER (ORDER BY step_order), 6) AS pct_of_start,
       round(coalesce(100.0 * count / nullif(lag(count, 1, count) OVER (ORDER BY step_order), 0), 0.0), 6) AS pct_of_previous
FROM c""",
    "green_histogram": f"""WITH {MEANS}
SELECT CASE WHEN green >= 140 THEN 21 ELSE floor(green / 140.0 * 20)::BIGINT + 1 END AS bin, count(*) AS n FROM means GROUP BY 1""",
    "display_composite": f"""WITH {MEANS}
SELECT roi_id, day, {r('red', 'green')}, round(least(1.0, greatest(0.0, red / 40.0::DOUBLE)), 6) AS r,
       round(least(1.0, greatest(0.0, green / 100.0::DOUBLE)), 6) AS g, 0.0::DOUBLE AS b FROM means""",
    "day_date_labels": f"""WITH {MEANS}
SELECT roi_id, day, 'Day ' || day || ' ' || strftime(DATE '2026-05-11' + day::INT, '%m-%d') AS label,
       CASE WHEN day = 3 THEN 'z' WHEN day > 3 THEN 'z+' || (day - 3) ELSE 'z' || (day - 3) END AS plane FROM means""",
    "session_similarity": f"""WITH {ROI_DAY}
SELECT a.day AS session_a, b.day AS session_b, round(-corr(a.green, b.green), 6) AS similarity
FROM roi_day a JOIN roi_day b USING (roi_id) GROUP BY ALL""",
    "session_medoid": f"""WITH {ROI_DAY},
s AS (SELECT a.day AS d, b.day AS e, -corr(a.green, b.green) AS v FROM roi_day a JOIN roi_day b USING (roi_id) GROUP BY ALL),
t AS (SELECT d, sum(v) AS total FROM s GROUP BY d)
SELECT d AS medoid_session, round(total, 6) AS total_similarity FROM t ORDER BY total, d LIMIT 1""",
}
