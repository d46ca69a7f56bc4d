"""SQL twins of the voxel, registration and listing queries, for the side-by-side check in DuckDB."""

from __future__ import annotations

from longitrack.plans.sql_ratio import r

GRID = """
o AS (SELECT l_orderkey AS k, min(l_suppkey) AS s, sum(l_tax) AS red, sum(l_discount) AS green FROM lineitem GROUP BY 1),
vox AS (
  SELECT session_id, k % 16 AS z, (k // 16) % 128 AS y, k // 2048 AS x, red, green,
         CASE WHEN session_id = 'b' AND k % 5 = 0 THEN s + 1 ELSE s END AS label
  FROM o, (SELECT unnest(['a', 'b']) AS session_id)),
area AS (SELECT session_id, label, count(*) AS n FROM vox GROUP BY ALL)"""

BLOCK = """
vox AS (
  SELECT o_orderkey % 4 AS z, (o_orderkey // 4) % 64 AS y, o_orderkey // 256 AS x,
         1 + ((o_orderkey // 4) % 64) // 8 + 8 * ((o_orderkey // 256) // 8) * 3
           + 8 * CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, o_totalprice AS red
  FROM orders),
dims AS (SELECT max(x) + 1 AS nx FROM vox),
feat AS (
  SELECT label, count(*) AS n, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, min(z) AS z0, min(y) AS y0, min(x) AS x0,
         max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM vox GROUP BY 1)"""


def overlap(z: int, y: int, x: int) -> str:
    return f"""WITH {GRID},
j AS (
  SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM vox a
  JOIN vox b ON a.session_id = 'a' AND b.session_id = 'b' AND a.z = b.z + ({z}) AND a.y = b.y + ({y}) AND a.x = b.x + ({x})
  GROUP BY ALL)
SELECT 'a' AS day_a, 'b' AS day_b, label_a, label_b, j.n AS intersection_voxels, round(2.0 * j.n / (p.n + q.n), 6) AS dice,
       round(j.n / (p.n + q.n - j.n), 6) AS iou
FROM j JOIN area p ON p.session_id = 'a' AND p.label = label_a JOIN area q ON q.session_id = 'b' AND q.label = label_b"""


def rint(e: str) -> str:
    return f"round_even({e}, 0)::BIGINT"


CROPS = BLOCK + """,
pad AS (
  SELECT feat.*, nx, greatest(0, z0 - {zp}) AS z_start, least(4, z1 + {zp}) AS z_stop,
         greatest(0, y0 - {p}) AS ys, least(64, y1 + {p}) AS ye, greatest(0, x0 - {p}) AS xs, least(nx, x1 + {p}) AS xe
  FROM feat, dims),
grow AS (
  SELECT *, greatest(0, {m} - (ye - ys)) AS my, greatest(0, {m} - (xe - xs)) AS mx FROM pad),
wide AS (
  SELECT *, greatest(0, ys - my // 2) AS ya, least(64, ye + my - my // 2) AS yb,
         greatest(0, xs - mx // 2) AS xa, least(nx, xe + mx - mx // 2) AS xb FROM grow),
crop AS (
  SELECT label, z_start, z_stop,
         CASE WHEN my > 0 AND yb - ya < {m} AND ya > 0 AND yb = 64 THEN greatest(0, 64 - {m}) ELSE ya END AS y_start,
         CASE WHEN my > 0 AND yb - ya < {m} AND ya = 0 THEN least(64, {m}) ELSE yb END AS y_stop,
         CASE WHEN mx > 0 AND xb - xa < {m} AND xa > 0 AND xb = nx THEN greatest(0, nx - {m}) ELSE xa END AS x_start,
         CASE WHEN mx > 0 AND xb - xa < {m} AND xa = 0 THEN least(nx, {m}) ELSE xb END AS x_stop
  FROM wide)"""


def crops(p: int, m: int, zp: int) -> str:
    return CROPS.replace("{p}", str(p)).replace("{m}", str(m)).replace("{zp}", str(zp))


SHAPE = BLOCK + """,
pix AS (SELECT label, y, x, count(*) AS n, min(z) AS za, max(z) AS zb FROM vox GROUP BY ALL),
win AS (
  SELECT label, y - dy AS wy, x - dx AS wx, sum(bit) AS code
  FROM pix, (VALUES (0, 0, 8), (0, 1, 4), (1, 0, 2), (1, 1, 1)) AS c(dy, dx, bit) GROUP BY ALL),
peri AS (
  SELECT label, sum(
    pi() / 4 * ((code & 2 = 0 AND code & 1 > 0)::INT + (code & 2 = 0 AND code & 8 > 0)::INT)
    + pi() / 4 / sqrt(2) * ((code & 8 = 0 AND code & 1 > 0)::INT + (code & 4 = 0 AND code & 2 > 0)::INT)) AS p
  FROM (SELECT label, code::BIGINT AS code FROM win) GROUP BY label),
mom AS (
  SELECT label, sum(n)::BIGINT AS voxel_count, count(*) AS proj_area_px, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(y, x) AS yx,
         max(zb) - min(za) + 1 AS z_span_px, max(y) - min(y) + 1 AS y_span_px, max(x) - min(x) + 1 AS x_span_px FROM pix GROUP BY label),
eig AS (
  SELECT *, (yy + xx) / 2 + sqrt(power((yy - xx) / 2, 2) + yx * yx) AS big,
         greatest((yy + xx) / 2 - sqrt(power((yy - xx) / 2, 2) + yx * yx), 0.0) AS small FROM mom JOIN peri USING (label))"""


def transform_sql() -> str:
    """The trimmed fit unrolled: four rounds of moments, residuals and cut-off, then the final fit."""
    def fit(rows: str, out: str, target: str) -> str:
        return f"""
{out}_m AS (
  SELECT day_a, day_b, count(*) FILTER (keep) AS n, regr_slope(za, zb) FILTER (keep) AS a1, regr_intercept(za, zb) FILTER (keep) AS a0,
         avg(ya) FILTER (keep) AS mya, avg(xa) FILTER (keep) AS mxa, avg(yb) FILTER (keep) AS myb, avg(xb) FILTER (keep) AS mxb,
         var_pop(yb) FILTER (keep) AS yy, var_pop(xb) FILTER (keep) AS xx, covar_pop(yb, xb) FILTER (keep) AS yx,
         covar_pop(yb, ya) FILTER (keep) AS yt, covar_pop(xb, ya) FILTER (keep) AS xt, covar_pop(yb, xa) FILTER (keep) AS yu,
         covar_pop(xb, xa) FILTER (keep) AS xu
  FROM {rows} GROUP BY ALL),
{out}_c AS (
  SELECT *, (yt * xx - xt * yx) / (yy * xx - yx * yx) AS b1, (xt * yy - yt * yx) / (yy * xx - yx * yx) AS b2,
         (yu * xx - xu * yx) / (yy * xx - yx * yx) AS c1, (xu * yy - yu * yx) / (yy * xx - yx * yx) AS c2 FROM {out}_m),
{out} AS (SELECT *, mya - b1 * myb - b2 * mxb AS b0, mxa - c1 * myb - c2 * mxb AS c0 FROM {out}_c),
{target} AS (
  SELECT s.*, sqrt(power(za - (a0 + a1 * zb), 2) + power(ya - (b0 + b1 * yb + b2 * xb), 2) + power(xa - (c0 + c1 * yb + c2 * xb), 2)) AS res
  FROM {rows} s JOIN {out} USING (day_a, day_b))"""

    parts = ["""
s0 AS (
  SELECT l_returnflag AS day_a, l_linestatus AS day_b, l_linenumber::DOUBLE AS zb, l_quantity AS yb, (l_suppkey % 97)::DOUBLE AS xb,
         1.02::DOUBLE * l_linenumber + 0.3 + l_tax AS za,
         0.98::DOUBLE * l_quantity + 0.05::DOUBLE * (l_suppkey % 97) + 2 + 20 * l_discount AS ya,
         1.01::DOUBLE * (l_suppkey % 97) - 0.03::DOUBLE * l_quantity - 1 + 30 * l_tax AS xa, true AS keep
  FROM lineitem)"""]
    for i in range(4):
        parts.append(fit(f"s{i}", f"f{i}", f"r{i}"))
        parts.append(f"""
q{i} AS (SELECT day_a, day_b, least(2.4, quantile_cont(res, 0.95) FILTER (keep)) AS cut FROM r{i} GROUP BY ALL),
s{i + 1} AS (SELECT r.* EXCLUDE (res) REPLACE (r.res <= q.cut AS keep) FROM r{i} r JOIN q{i} q USING (day_a, day_b))""")
    parts.append(fit("s4", "ff", "rf"))
    cols = ", ".join(f"round({c}, 5) AS {c}" for c in ("a0", "a1", "b0", "b1", "b2", "c0", "c1", "c2"))
    return f"""WITH {','.join(parts)},
sp AS (SELECT day_a, day_b, count(*) AS n_seed, quantile_cont(res, 0.5) FILTER (keep) AS med, quantile_cont(res, 0.95) FILTER (keep) AS p95
       FROM rf GROUP BY ALL)
SELECT day_a, day_b, {cols}, 'restricted_affine' AS method, n_seed, n AS n_inlier, round(med, 5) AS residual_median_um,
       round(p95, 5) AS residual_p95_um FROM ff JOIN sp USING (day_a, day_b)"""


TWO_WEEKS = """
vox AS (
  SELECT session_id, o_orderkey % 4 AS z, (o_orderkey // 4) % 64 AS y, o_orderkey // 256 AS x,
         1 + ((o_orderkey // 4) % 64) // 8 + 8 * ((o_orderkey // 256) // 8) * 3
           + 8 * CASE WHEN o_orderstatus = 'F' OR (session_id = 'b' AND o_orderstatus = 'P' AND o_orderkey % 3 = 0) THEN 0
                      WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS label
  FROM orders, (SELECT unnest(['a', 'b']) AS session_id)),
dims AS (SELECT session_id, max(x) + 1 AS nx FROM vox GROUP BY 1),
base AS (
  SELECT session_id, label, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS area_total
  FROM vox GROUP BY ALL),
pl AS (SELECT session_id, label, z, count(*) AS n, row_number() OVER (PARTITION BY session_id, label ORDER BY count(*) DESC, z) AS q
       FROM vox GROUP BY session_id, label, z),
rec AS (
  SELECT b.*, pl.z AS center_plane, pl.n AS area_center, least(cy, cx, 63 - cy, nx - 1 - cx) AS dist_to_edge,
         least(cy, cx, 63 - cy, nx - 1 - cx) < 6 AS is_edge
  FROM base b JOIN pl ON pl.session_id = b.session_id AND pl.label = b.label AND q = 1 JOIN dims ON dims.session_id = b.session_id),
px AS (
  SELECT v.session_id, v.label, v.y - round_even(cy, 0) AS dy, v.x - round_even(cx, 0) AS dx,
         round_even((v.y - cy)::FLOAT + 20::FLOAT, 0) AS ky, round_even((v.x - cx)::FLOAT + 20::FLOAT, 0) AS kx
  FROM vox v JOIN rec r ON r.session_id = v.session_id AND r.label = v.label AND v.z = r.center_plane),
pat AS (SELECT DISTINCT session_id, label, dy, dx FROM px WHERE abs(dy) <= 4 AND abs(dx) <= 4),
can AS (SELECT DISTINCT session_id, label, ky, kx FROM px WHERE ky BETWEEN 0 AND 40 AND kx BETWEEN 0 AND 40),
sq AS (SELECT y, x, least(7, floor(sqrt(y * y + x * x) / ((sqrt(32.0) + 1e-6) / 8)))::BIGINT AS ring
       FROM (SELECT unnest(range(-4, 5)) AS y), (SELECT unnest(range(-4, 5)) AS x)),
rs AS (SELECT ring, count(*) AS size FROM sq GROUP BY 1),
occ AS (SELECT session_id, label, ring, count(*) / any_value(size) AS f FROM pat JOIN sq ON sq.y = dy AND sq.x = dx JOIN rs USING (ring) GROUP BY ALL),
ringp AS (SELECT session_id, label, ring, f / sum(f) OVER (PARTITION BY session_id, label) AS f FROM occ)"""

LEGACY_PAIRS = TWO_WEEKS + """,
pr AS (
  SELECT a.label AS label_a, b.label AS label_b, a.is_edge OR b.is_edge AS e, abs(a.cz - b.cz) AS dz,
         sqrt(power(a.cy - (b.cy + 0.5), 2) + power(a.cx - (b.cx + 0.25), 2)) AS dxy,
         least(a.area_center, b.area_center) / greatest(a.area_center, b.area_center) AS area_ratio,
         (greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1))::DOUBLE AS box,
         (a.y1 - a.y0 + 1) * (a.x1 - a.x0 + 1) AS sa, (b.y1 - b.y0 + 1) * (b.x1 - b.x0 + 1) AS sb
  FROM rec a JOIN rec b ON a.session_id = 'a' AND b.session_id = 'b'),
g AS (SELECT *, CASE WHEN e THEN 8.0::DOUBLE ELSE 5.0::DOUBLE END AS lim FROM pr WHERE dxy <= CASE WHEN e THEN 8.0 ELSE 5.0 END AND dz <= 2),
np AS (SELECT session_id, label, count(*) AS n FROM pat GROUP BY ALL),
nc AS (SELECT session_id, label, count(*) AS n FROM can GROUP BY ALL),
c AS (
  SELECT g.*,
    coalesce((SELECT count(*) FROM pat p JOIN pat q ON p.dy = q.dy AND p.dx = q.dx WHERE p.session_id = 'a' AND q.session_id = 'b' AND p.label = label_a AND q.label = label_b)
      / sqrt((SELECT n FROM np WHERE session_id = 'a' AND label = label_a)::DOUBLE * (SELECT n FROM np WHERE session_id = 'b' AND label = label_b)), 0.0) AS patch_cos,
    (SELECT count(*) FROM can p JOIN can q ON p.ky = q.ky AND p.kx = q.kx WHERE p.session_id = 'a' AND q.session_id = 'b' AND p.label = label_a AND q.label = label_b) AS ci,
    (SELECT n FROM nc WHERE session_id = 'a' AND label = label_a) + (SELECT n FROM nc WHERE session_id = 'b' AND label = label_b) AS cs,
    (SELECT sum(abs(coalesce(p.f, 0.0) - coalesce(q.f, 0.0)))
     FROM (SELECT * FROM ringp WHERE session_id = 'a' AND label = label_a) p
     FULL JOIN (SELECT * FROM ringp WHERE session_id = 'b' AND label = label_b) q ON p.ring = q.ring) AS radial_l1
  FROM g),
s AS (
  SELECT *, ci / (cs - ci) AS iou, box / (sa + sb - box) AS bbox_iou,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.28::DOUBLE * exp(-power(dxy / greatest(1.0, 0.45::DOUBLE * lim), 2)) + 0.12::DOUBLE * exp(-power(dz / 1.1::DOUBLE, 2))
           + 0.14::DOUBLE * patch_cos + 0.24::DOUBLE * (ci / (cs - ci)) + 0.08::DOUBLE * area_ratio + 0.04::DOUBLE * exp(-2.0::DOUBLE * radial_l1)
           + 0.10::DOUBLE * (box / (sa + sb - box)) + CASE WHEN e THEN 0.02::DOUBLE ELSE 0.0 END)) AS score FROM c)"""

FILES = """
files AS (
  SELECT strftime(o_orderdate, '%Y%m%d') || '_' || CASE WHEN o_custkey % 3 = 0 THEN 'G' ELSE 'R' END
         || ['', '_SyN', '_crop_256_SyN', '_SyN_crop', '_ROI_mask_SyN_inversed', '_cp_masks'][o_orderkey % 6 + 1] || '.tif' AS name
  FROM orders),
parsed AS (
  SELECT name, name[1:8] AS date_key, CASE WHEN name[10:10] = 'R' THEN 'red' ELSE 'green' END AS channel, name LIKE '%_SyN.tif' AS is_syn
  FROM files WHERE name NOT LIKE '%mask%' AND name NOT LIKE '%SyN_crop%'),
dated AS (SELECT *, date_diff('day', DATE '1996-01-01', strptime(date_key, '%Y%m%d')::DATE) AS day FROM parsed)"""

SYN_LOOKUP = FILES + """,
look AS (SELECT day, channel, max(name) AS name FROM dated WHERE day >= 0 AND is_syn GROUP BY ALL)"""

SQL = {
    "roi_features": f"""WITH {GRID},
d AS (SELECT session_id, max(x) + 1 AS nx FROM vox GROUP BY 1),
f AS (SELECT session_id, label, count(*)::DOUBLE AS area_voxels, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, min(z) AS bbox_z0,
             min(y) AS bbox_y0, min(x) AS bbox_x0, max(z) + 1 AS bbox_z1, max(y) + 1 AS bbox_y1, max(x) + 1 AS bbox_x1 FROM vox GROUP BY ALL)
SELECT session_id, label, area_voxels, round(cz, 6) AS centroid_z, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x,
       bbox_z0, bbox_y0, bbox_x0, bbox_z1, bbox_y1, bbox_x1, round(area_voxels * 2.45, 6) AS volume_um3,
       round(cz * 5.0, 6) AS centroid_z_um, round(cy * 0.7::DOUBLE, 6) AS centroid_y_um, round(cx * 0.7::DOUBLE, 6) AS centroid_x_um,
       bbox_z1 - bbox_z0 AS bbox_depth_planes, bbox_y1 - bbox_y0 AS bbox_height_px, bbox_x1 - bbox_x0 AS bbox_width_px,
       bbox_z0 = 0 OR bbox_z1 = 16 AS touches_z_edge, bbox_y0 = 0 OR bbox_y1 = 128 OR bbox_x0 = 0 OR bbox_x1 = nx AS touches_xy_edge
FROM f JOIN d USING (session_id)""",
    "mask_validation": f"""WITH {GRID}
SELECT count(*) AS n_invalid FROM (
  SELECT session_id FROM vox GROUP BY session_id HAVING count(*) = 0 OR count(*) >= 16 * 128 * (max(x) + 1))""",
    "label_mean_zero_excluded": """WITH v AS (
  SELECT min(l_partkey) AS label, sum(l_tax) / 0.7::DOUBLE AS red, sum(l_discount) / 0.7::DOUBLE AS green FROM lineitem GROUP BY l_orderkey)
SELECT label, 'red' AS channel, round(avg(red), 6) AS mean_intensity FROM v GROUP BY label HAVING NOT bool_or(red = 0)
UNION ALL SELECT label, 'green', round(avg(green), 6) FROM v GROUP BY label HAVING NOT bool_or(green = 0)""",
    "overlap_dice_iou": overlap(0, 0, 0),
    "shifted_overlap": overlap(0, 2, 0),
    "occupancy_projection": f"WITH {BLOCK} SELECT 'f' AS session_id, y, x, count(*) AS n FROM vox GROUP BY ALL",
    "z_shift_xcorr": """WITH a AS (SELECT o_custkey % 16 AS z, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT (o_custkey + 3) % 16 AS z, count(*) AS n FROM orders GROUP BY 1),
ca AS (SELECT z, n - (SELECT sum(n) / 16 FROM a) AS v FROM a),
cb AS (SELECT z, n - (SELECT sum(n) / 16 FROM b) AS v FROM b),
k AS (SELECT ca.z - cb.z AS lag, sum(ca.v * cb.v) AS c FROM ca, cb GROUP BY 1)
SELECT 'a' AS day_a, 'b' AS day_b, (SELECT lag FROM k ORDER BY c DESC, lag LIMIT 1)::DOUBLE AS shift_z, false AS z_fallback,
       NULL::VARCHAR AS z_fallback_reason""",
    "projected_shape": f"""WITH {SHAPE}
SELECT 'f' AS session_id, label, voxel_count, proj_area_px, z_span_px, y_span_px, x_span_px, round(p, 6) AS proj_perimeter_px,
       round(4 * pi() * proj_area_px / (p * p), 6) AS circularity,
       round(CASE WHEN big > 0 THEN sqrt(1 - small / big) ELSE 0.0 END, 6) AS eccentricity,
       round(CASE WHEN small > 1e-12 THEN sqrt(big / small) END, 6) AS axis_ratio, round(sqrt(4 * proj_area_px / pi()), 6) AS eq_diam_px,
       round(proj_area_px * (0.7::DOUBLE * 0.7::DOUBLE), 6) AS proj_area_um2, round(sqrt(4 * proj_area_px / pi()) * 0.7, 6) AS eq_diam_um,
       round(z_span_px * 5.0::DOUBLE, 6) AS z_span_um FROM eig""",
    "center_crop": f"""WITH {BLOCK}
SELECT 'f' AS session_id, z, y - 15 AS y, x - (nx - 5) // 2 AS x, label FROM vox, dims
WHERE y >= 15 AND y < 48 AND x >= (nx - 5) // 2 AND x < (nx - 5) // 2 + 5""",
    "roi_crop_bounds": f"WITH {crops(3, 20, 1)} SELECT 'f' AS session_id, * FROM crop",
    "fixed_crop_bounds": f"""WITH {BLOCK}
SELECT label, greatest(0, least({rint('cy - 12')}, 40)) AS y_start, greatest(0, least({rint('cy - 12')}, 40)) + 24 AS y_stop FROM feat""",
    "crop_projection": f"""WITH {crops(2, 12, 0)}
SELECT c.label AS roi_id, v.y - y_start AS y, v.x - x_start AS x, round(max(greatest(v.red - 1000, 0)), 6) AS value,
       bool_or(v.label = c.label) AS is_roi
FROM crop c JOIN vox v ON v.z >= z_start AND v.z < z_stop AND v.y >= y_start AND v.y < y_stop AND v.x >= x_start AND v.x < x_stop
GROUP BY ALL""",
    "neighbour_slices": f"""WITH {BLOCK}, c AS (SELECT label, least(greatest({rint('cz')}, 0), 3) AS z_center FROM feat)
SELECT label, greatest(0, z_center - 1) AS z_minus1, z_center, least(3, z_center + 1) AS z_plus1 FROM c""",
    "raw_space_geometry": f"""WITH {BLOCK}
SELECT label, {rint('cz')} AS z_center, {rint('cy')} AS y_center, {rint('cx')} AS x_center, x1 - x0 AS width_px, y1 - y0 AS height_px FROM feat""",
    "group_geometry": f"""WITH {BLOCK},
g AS (SELECT (label - 1) // 8 AS group_id, {rint(f"avg({rint('cz')})")} AS z_center, {rint(f"avg({rint('cy')})")} AS y_center,
             {rint(f"avg({rint('cx')})")} AS x_center, min(y0) AS ya, max(y1) - 1 AS yb, min(x0) AS xa, max(x1) - 1 AS xb FROM feat GROUP BY 1)
SELECT group_id, z_center, y_center, x_center, greatest(8, 2 * (greatest(x_center - xa, xb - x_center) + 2) + 1) AS width_px,
       greatest(8, 2 * (greatest(y_center - ya, yb - y_center) + 2) + 1) AS height_px FROM g""",
    "restricted_transform": transform_sql(),
    "legacy_shift_support": """WITH p AS (
  SELECT vec_id // 1000 AS f, vec_id % 4 AS s, vec_id AS label, list_sum(embedding[1:-:3]::DOUBLE[]) * 100.0 / 4.6 / 5 AS z,
         list_sum(embedding[2:-:3]::DOUBLE[]) * 100.0 / 4.6 AS y, list_sum(embedding[3:-:3]::DOUBLE[]) * 100.0 / 4.6 AS x FROM embeddings),
o AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.5::DOUBLE, -0.5::DOUBLE)) AS t(opt, sy, sx)),
b AS (
  SELECT a.f, a.s, opt, sy, sx, a.label, min(sqrt(power(a.y - (b.y + sy), 2) + power(a.x - (b.x + sx), 2))) AS d
  FROM p a JOIN p b ON a.f = b.f AND a.s + 1 = b.s AND abs(a.z - b.z) <= 5, o
  WHERE sqrt(power(a.y - (b.y + sy), 2) + power(a.x - (b.x + sx), 2)) <= 15 GROUP BY ALL),
sc AS (SELECT f, s, opt, sy, sx, count(*) - 0.05 * median(d) - 0.02 * sqrt(sy * sy + sx * sx) AS score FROM b GROUP BY f, s, opt, sy, sx)
SELECT 'f' || f || 's' || s AS day_a, 'f' || f || 's' || (s + 1) AS day_b, round(sy, 6) AS shift_y, round(sx, 6) AS shift_x
FROM sc QUALIFY row_number() OVER (PARTITION BY f, s ORDER BY score DESC, opt) = 1""",
    "legacy_records": f"""WITH {TWO_WEEKS}
SELECT r.session_id, r.label, round(cz, 6) AS centroid_z, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x, center_plane, area_center,
       area_total, round(dist_to_edge, 6) AS dist_to_edge, is_edge,
       (SELECT count(*) FROM pat WHERE pat.session_id = r.session_id AND pat.label = r.label) AS n_patch,
       (SELECT count(*) FROM can WHERE can.session_id = r.session_id AND can.label = r.label) AS n_canvas,
       round(coalesce((SELECT f FROM ringp q WHERE q.session_id = r.session_id AND q.label = r.label AND ring = 0), 0.0), 6) AS ring0,
       round(coalesce((SELECT f FROM ringp q WHERE q.session_id = r.session_id AND q.label = r.label AND ring = 5), 0.0), 6) AS ring5
FROM rec r""",
    "legacy_candidates": f"""WITH {LEGACY_PAIRS}
SELECT label_a, label_b, {r('dxy', 'dz', 'area_ratio', 'patch_cos', 'radial_l1', 'iou', 'bbox_iou')}, 0.5::DOUBLE AS shift_y, 0.25::DOUBLE AS shift_x,
       e::INT::DOUBLE AS edge_case, {r('score')} FROM s WHERE score >= 0.30""",
    "filename_listing_parse": f"WITH {FILES} SELECT date_key, channel, is_syn, count(*) AS n FROM parsed GROUP BY ALL",
    "infer_start_date": f"WITH {FILES} SELECT min(date_key) AS start_date FROM parsed WHERE NOT is_syn",
    "registered_lookup": f"""WITH {FILES}
SELECT day, channel, max(name) AS name FROM dated WHERE day >= 0 AND CASE WHEN day = 0 THEN NOT is_syn ELSE is_syn END GROUP BY ALL""",
    "raw_lookup": f"WITH {FILES} SELECT day, channel, max(name) AS name FROM dated WHERE day >= 0 AND NOT is_syn GROUP BY ALL",
    "inverse_mask_lookup": f"""WITH {FILES},
m AS (SELECT DISTINCT name, date_diff('day', DATE '1995-01-01', strptime(name[1:8], '%Y%m%d')::DATE) AS day FROM files WHERE name LIKE '%_ROI_mask_SyN_inversed.tif')
SELECT day, CASE WHEN count(*) = 1 THEN min(name) ELSE min(name) FILTER (name LIKE '%\\_R\\_%' ESCAPE '\\') END AS name FROM m GROUP BY day""",
    "missing_channels": f"""WITH {SYN_LOOKUP}
SELECT day, c AS channel FROM (SELECT DISTINCT day FROM look), (SELECT unnest(['red', 'green']) AS c)
WHERE NOT EXISTS (SELECT 1 FROM look l WHERE l.day = look.day AND l.channel = c)""".replace("(SELECT DISTINCT day FROM look)", "(SELECT DISTINCT day FROM look) look"),
    "week_buckets": f"""WITH {SYN_LOOKUP},
d AS (SELECT DISTINCT day, DATE '1996-01-01' + day::INT AS dt FROM look)
SELECT strftime(date_trunc('week', dt), '%Y-%m-%d') AS week_start, count(*) AS n_days, string_agg(day::VARCHAR, ',' ORDER BY day) AS days,
       string_agg(strftime(dt, '%Y%m%d'), ',' ORDER BY day) AS date_keys FROM d GROUP BY date_trunc('week', dt)""",
    "elapsed_days": """SELECT o_orderkey, date_diff('day', (SELECT min(o_orderdate)::DATE FROM orders WHERE o_orderstatus = 'F'), o_orderdate::DATE)
  AS elapsed_days FROM orders""",
    "manifest_order_check": """WITH g AS (
  SELECT o_custkey, year(o_orderdate) - 1995 AS session_index, min(o_orderdate)::DATE AS d FROM orders GROUP BY ALL)
SELECT o_custkey, session_index FROM (
  SELECT *, lag(session_index, 1, -1) OVER w AS i, lag(d) OVER w AS p FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY session_index))
WHERE session_index - i <> 1 OR p > d""",
    "legacy_match_distances": f"""WITH {LEGACY_PAIRS},
k AS (SELECT * FROM s WHERE score >= 0.30),
w AS (
  SELECT *, max(score) OVER (PARTITION BY label_a) AS ba, max(score) OVER (PARTITION BY label_b) AS bb,
         coalesce(nth_value(score, 2) OVER (PARTITION BY label_a ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS sa2,
         coalesce(nth_value(score, 2) OVER (PARTITION BY label_b ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS sb2
  FROM k)
SELECT label_a, label_b, round(dxy, 6) AS distance_xy_px, round(dxy * 0.7::DOUBLE, 6) AS distance_xy_um, round(dz, 6) AS distance_z_planes,
       round(dz * 5.0::DOUBLE, 6) AS distance_z_um, round(score, 6) AS match_score,
       round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.70::DOUBLE * score + 0.15::DOUBLE * (score - sa2) + 0.15::DOUBLE * (score - sb2))), 6) AS confidence
FROM w WHERE score + 1e-9 >= ba AND score + 1e-9 >= bb""",
    "track_display": f"""WITH {TWO_WEEKS}
SELECT label, round_even(median(center_plane), 0)::BIGINT AS display_plane, greatest(0, min(y0) - 3) AS y_start, greatest(0, min(x0) - 3) AS x_start,
       least(64, max(y1) + 1 + 3) AS y_stop, least(1000000, max(x1) + 1 + 3) AS x_stop FROM rec GROUP BY label""",
    "plane_labels": f"WITH {BLOCK} SELECT z, y, x, label, CASE WHEN label = 9 THEN 2 ELSE 1 END AS layer FROM vox",
}
