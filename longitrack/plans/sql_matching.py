"""SQL twins of the matching queries, for the side-by-side check in DuckDB."""

from __future__ import annotations

from longitrack.plans.sql_ratio import r

PAIRS = """
pts AS MATERIALIZED (
  SELECT vec_id // 1000 AS field_id, (vec_id % 4)::BIGINT AS s, vec_id AS label, list_sum(embedding[1:-:3]::DOUBLE[]) * 100.0 / 4.6 AS z,
         list_sum(embedding[2:-:3]::DOUBLE[]) * 100.0 / 4.6 AS y, list_sum(embedding[3:-:3]::DOUBLE[]) * 100.0 / 4.6 AS x, (label + 1)::DOUBLE AS area
  FROM embeddings),
dist AS MATERIALIZED (
  SELECT a.field_id, a.s AS index_a, b.s AS index_b, a.label AS label_a, b.label AS label_b, a.area AS area_a, b.area AS area_b,
         sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d,
         a.z AS az, a.y AS ay, a.x AS ax, b.z AS bz, b.y AS by_, b.x AS bx
  FROM pts a JOIN pts b ON a.field_id = b.field_id AND b.s > a.s AND b.s <= a.s + 2),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY field_id, index_a, index_b, label_a ORDER BY d, label_b) AS ra,
         row_number() OVER (PARTITION BY field_id, index_a, index_b, label_b ORDER BY d, label_a) AS rb
  FROM dist),
na AS MATERIALIZED (SELECT field_id, index_a, index_b, label_a, max(label_b) FILTER (ra = 1) AS nb, max(d) FILTER (ra = 1) AS d1,
              max(d) FILTER (ra = 2) AS d2 FROM ranked WHERE ra <= 2 GROUP BY ALL),
nb AS MATERIALIZED (SELECT field_id, index_a, index_b, label_b, max(label_a) FILTER (rb = 1) AS na, max(d) FILTER (rb = 1) AS d1,
              max(d) FILTER (rb = 2) AS d2 FROM ranked WHERE rb <= 2 GROUP BY ALL),
cent AS MATERIALIZED (
  SELECT na.field_id, na.index_a, na.index_b, na.label_a, nb.label_b, na.d1 AS distance_um,
         greatest(CASE WHEN na.d2 > 0 THEN na.d1 / na.d2 ELSE 1.25 END, CASE WHEN nb.d2 > 0 THEN nb.d1 / nb.d2 ELSE 1.25 END)
           AS ambiguity
  FROM na JOIN nb ON na.field_id = nb.field_id AND na.index_a = nb.index_a AND na.index_b = nb.index_b
       AND na.nb = nb.label_b AND nb.na = na.label_a
  WHERE na.d1 <= 10),
ovl AS MATERIALIZED (
  SELECT field_id, index_a, index_b, label_a, label_b, 1.0::DOUBLE - d / 8.0 AS dice,
         (1.0::DOUBLE - d / 8.0) / (2.0::DOUBLE - (1.0::DOUBLE - d / 8.0)) AS iou
  FROM dist WHERE d <= 8)"""

CANDIDATES = PAIRS + """,
uni AS MATERIALIZED (
  SELECT d.field_id, d.index_a, d.index_b, d.label_a, d.label_b,
         CASE WHEN c.label_a IS NOT NULL AND o.label_a IS NOT NULL THEN 'both'
              WHEN c.label_a IS NOT NULL THEN 'mutual_centroid' ELSE 'mutual_overlap' END AS candidate_source,
         d.d AS distance_um, coalesce(c.ambiguity, 1.25) AS ambiguity, coalesce(o.dice, 0.0) AS dice,
         coalesce(o.iou, 0.0) AS iou, least(area_a, area_b) / greatest(area_a, area_b) AS area_ratio
  FROM dist d
  LEFT JOIN cent c USING (field_id, index_a, index_b, label_a, label_b)
  LEFT JOIN ovl o USING (field_id, index_a, index_b, label_a, label_b)
  WHERE c.label_a IS NOT NULL OR o.dice >= 0.10),
sc AS MATERIALIZED (
  SELECT *, exp(-((distance_um / 4.0) * (distance_um / 4.0))) AS spatial_term,
         greatest(0.0::DOUBLE, 1.0::DOUBLE - least(ambiguity::DOUBLE, 1.0::DOUBLE)) AS ambiguity_term FROM uni),
cand AS MATERIALIZED (
  SELECT *, 0.40::DOUBLE * spatial_term + 0.32::DOUBLE * dice + 0.15::DOUBLE * area_ratio + 0.13::DOUBLE * ambiguity_term AS score,
         (dice >= 0.40 AND distance_um <= 8 AND area_ratio >= 0.30)
           OR (distance_um <= 3.5 AND area_ratio >= 0.55 AND ambiguity <= 0.70) AS high_rule,
         (dice >= 0.40 AND distance_um <= 8 AND area_ratio >= 0.30)
           OR (distance_um <= 3.5 AND area_ratio >= 0.55 AND ambiguity <= 0.70)
           OR (dice >= 0.20 AND distance_um <= 7 AND area_ratio >= 0.30)
           OR (distance_um <= 5 AND area_ratio >= 0.40 AND ambiguity <= 0.85) AS balanced_rule
  FROM sc)"""

K = "field_id, index_a, index_b, label_a, label_b"
P = "field_id, index_a, index_b"


def greedy(name: str, source: str, where: str, order: str) -> str:
    """A greedy pass as a recursive CTE: the n-th candidate is taken when both labels are still free."""
    return f""",
{name}_o AS (SELECT {K}, row_number() OVER (PARTITION BY {P} ORDER BY {order}) AS rn FROM {source} WHERE {where}),
{name}_g AS (
  SELECT DISTINCT {P}, 0::BIGINT AS rn, NULL::BIGINT AS label_a, NULL::BIGINT AS label_b, false AS ok,
         []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM {name}_o
  UNION ALL
  SELECT g.field_id, g.index_a, g.index_b, o.rn, o.label_a, o.label_b,
         NOT list_contains(g.ua, o.label_a) AND NOT list_contains(g.ub, o.label_b),
         CASE WHEN NOT list_contains(g.ua, o.label_a) AND NOT list_contains(g.ub, o.label_b)
              THEN list_append(g.ua, o.label_a) ELSE g.ua END,
         CASE WHEN NOT list_contains(g.ua, o.label_a) AND NOT list_contains(g.ub, o.label_b)
              THEN list_append(g.ub, o.label_b) ELSE g.ub END
  FROM {name}_g g JOIN {name}_o o ON o.field_id = g.field_id AND o.index_a = g.index_a AND o.index_b = g.index_b AND o.rn = g.rn + 1),
{name} AS (SELECT {K} FROM {name}_g WHERE ok)"""


BASE_ORDER = "score DESC, dice DESC, distance_um, label_a, label_b"
HIGH = greedy("high", "cand", "high_rule", BASE_ORDER)
BALANCED = greedy("bal", "cand", "balanced_rule", BASE_ORDER)

ANCHORS = CANDIDATES + HIGH + f""",
anchors AS (
  SELECT c.* FROM cand c JOIN high h USING ({K})
  WHERE dice >= 0.40 AND distance_um <= 5 AND area_ratio >= 0.40 AND ambiguity <= 0.65
        AND candidate_source IN ('both', 'mutual_overlap'))"""

SUPPORT = ANCHORS + f""",
plain AS (
  SELECT c.{K.replace(', ', ', c.')}, d.az, d.ay, d.ax, d.bz, d.by_, d.bx
  FROM cand c JOIN dist d USING ({K}) LEFT JOIN anchors n USING ({K})
  WHERE c.balanced_rule AND n.label_a IS NULL),
placed AS (SELECT n.{K.replace(', ', ', n.')}, d.az, d.ay, d.ax, d.bz, d.by_, d.bx FROM anchors n JOIN dist d USING ({K})),
near AS (
  SELECT p.{K.replace(', ', ', p.')}, q.label_a AS anchor_a,
         sqrt((p.az - q.az) * (p.az - q.az) + (p.ay - q.ay) * (p.ay - q.ay) + (p.ax - q.ax) * (p.ax - q.ax)) AS d_a,
         sqrt((p.bz - q.bz) * (p.bz - q.bz) + (p.by_ - q.by_) * (p.by_ - q.by_) + (p.bx - q.bx) * (p.bx - q.bx)) AS d_b,
         sqrt(power(q.az - p.az - q.bz + p.bz, 2) + power(q.ay - p.ay - q.by_ + p.by_, 2) + power(q.ax - p.ax - q.bx + p.bx, 2)) AS res
  FROM plain p JOIN placed q ON p.field_id = q.field_id AND p.index_a = q.index_a AND p.index_b = q.index_b),
local AS (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY d_a, anchor_a) AS ra,
         row_number() OVER (PARTITION BY {K} ORDER BY d_b, anchor_a) AS rb
  FROM near WHERE d_a <= 45 AND d_b <= 45),
support AS (
  SELECT {K}, count(*) FILTER (ra <= 6 AND rb <= 6) AS graph_support_count,
         count(*) FILTER (ra <= 6 AND rb <= 6) / count(*) AS graph_support_fraction,
         quantile_cont(res, 0.5) FILTER (ra <= 6 AND rb <= 6) AS graph_residual_median_um,
         avg(res) FILTER (ra <= 6 AND rb <= 6) AS graph_residual_mean_um,
         quantile_cont(res, 0.9) FILTER (ra <= 6 AND rb <= 6) AS graph_residual_p90_um,
         avg(CASE WHEN res <= 6 THEN 1.0 ELSE 0.0 END) FILTER (ra <= 6 AND rb <= 6) AS graph_inlier_fraction
  FROM local GROUP BY {K})"""

SCORES = SUPPORT + f""",
st AS (
  SELECT c.*, n.label_a IS NOT NULL AS is_anchor, coalesce(s.graph_support_count, 0) AS sc_count,
         CASE WHEN NOT c.balanced_rule THEN 'not_balanced'
              WHEN NOT EXISTS (SELECT 1 FROM anchors q WHERE q.field_id = c.field_id AND q.index_a = c.index_a AND q.index_b = c.index_b)
                THEN 'no_anchor_fallback'
              WHEN n.label_a IS NOT NULL THEN 'anchor'
              WHEN s.graph_support_count >= 3 THEN 'scored' ELSE 'insufficient_support' END AS graph_status,
         s.graph_residual_median_um AS med, s.graph_inlier_fraction AS inl
  FROM cand c LEFT JOIN anchors n USING ({K}) LEFT JOIN support s USING ({K})),
gs AS (
  SELECT *, CASE WHEN graph_status = 'anchor' THEN 1.0::DOUBLE
                 WHEN graph_status = 'scored' THEN exp(-((med / 4.0) * (med / 4.0))) * (0.5::DOUBLE + 0.5::DOUBLE * inl) END AS graph_score
  FROM st),
scored AS (
  SELECT *, CASE WHEN graph_status = 'scored' THEN 0.8::DOUBLE * score + 0.2::DOUBLE * graph_score ELSE score END AS refined_score,
         CASE WHEN graph_status = 'scored' THEN med END AS med_s
  FROM gs)"""

GRAPH = SCORES + BALANCED + f""",
free AS (
  SELECT * FROM scored f WHERE balanced_rule AND graph_status IN ('scored', 'insufficient_support')
    AND NOT EXISTS (SELECT 1 FROM anchors q WHERE q.field_id = f.field_id AND q.index_a = f.index_a AND q.index_b = f.index_b
                    AND (q.label_a = f.label_a OR q.label_b = f.label_b)))""" + greedy(
    "ref", "free", "true",
    "refined_score DESC, sc_count DESC, med_s ASC NULLS LAST, dice DESC, distance_um, label_a, label_b",
) + f""",
gm AS (
  SELECT s.* REPLACE (replace(graph_status, 'no_anchor_fallback', 'baseline_fallback') AS graph_status),
         CASE WHEN graph_status = 'no_anchor_fallback' THEN 'baseline_fallback'
              WHEN graph_status = 'anchor' THEN 'locked_anchor' ELSE 'graph_refined' END AS assignment_source
  FROM scored s LEFT JOIN (SELECT *, true AS rn_ok FROM ref) ref USING ({K}) LEFT JOIN (SELECT *, true AS in_bal FROM bal) bal USING ({K})
  WHERE s.balanced_rule AND (graph_status = 'anchor' OR ref.rn_ok OR (graph_status = 'no_anchor_fallback' AND in_bal)))"""


def track_sql(base: str, matches: str) -> str:
    """Tracks over four sessions: paths of adjacent matches, then the gap matches 0-2 and 1-3 in turn."""
    return base + f""",
nodes AS (SELECT field_id, s, label FROM pts),
m AS ({matches}),
adj AS (SELECT * FROM m WHERE index_b - index_a = 1),
walk AS (
  SELECT n.field_id, n.s AS hs, n.label AS hl, n.s, n.label FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.field_id = n.field_id AND adj.index_b = n.s AND adj.label_b = n.label)
  UNION ALL
  SELECT w.field_id, w.hs, w.hl, a.index_b, a.label_b FROM walk w
  JOIN adj a ON a.field_id = w.field_id AND a.index_a = w.s AND a.label_a = w.label),
c0 AS (SELECT field_id, s, label, hs * 1000000000 + hl AS c FROM walk),
e0 AS (
  SELECT m.*, a.c AS ca, b.c AS cb FROM m
  JOIN c0 a ON a.field_id = m.field_id AND a.s = m.index_a AND a.label = m.label_a
  JOIN c0 b ON b.field_id = m.field_id AND b.s = m.index_b AND b.label = m.label_b
  WHERE m.index_a = 0 AND m.index_b = 2),
d0 AS (
  SELECT e.*, CASE WHEN ca = cb THEN 'already_connected'
                   WHEN EXISTS (SELECT 1 FROM c0 p JOIN c0 q USING (field_id, s)
                                WHERE p.field_id = e.field_id AND p.c = e.ca AND q.c = e.cb)
                     THEN 'same_session_component_conflict' END AS reason FROM e0 e),
c1 AS (
  SELECT c0.field_id, s, label, coalesce(least(d.ca, d.cb), c0.c) AS c FROM c0
  LEFT JOIN d0 d ON d.field_id = c0.field_id AND d.reason IS NULL AND (d.ca = c0.c OR d.cb = c0.c)),
e1 AS (
  SELECT m.*, a.c AS ca, b.c AS cb FROM m
  JOIN c1 a ON a.field_id = m.field_id AND a.s = m.index_a AND a.label = m.label_a
  JOIN c1 b ON b.field_id = m.field_id AND b.s = m.index_b AND b.label = m.label_b
  WHERE m.index_a = 1 AND m.index_b = 3),
d1 AS (
  SELECT e.*, CASE WHEN ca = cb THEN 'already_connected'
                   WHEN EXISTS (SELECT 1 FROM c1 p JOIN c1 q USING (field_id, s)
                                WHERE p.field_id = e.field_id AND p.c = e.ca AND q.c = e.cb)
                     THEN 'same_session_component_conflict' END AS reason FROM e1 e),
c2 AS (
  SELECT c1.field_id, s, label, coalesce(least(d.ca, d.cb), c1.c) AS c FROM c1
  LEFT JOIN d1 d ON d.field_id = c1.field_id AND d.reason IS NULL AND (d.ca = c1.c OR d.cb = c1.c)),
tn AS (
  SELECT field_id, s, label, c, min(s) OVER w AS track_session, arg_min(label, s) OVER w AS track_label
  FROM c2 WINDOW w AS (PARTITION BY field_id, c)),
dec AS (
  SELECT {K}, NULL::VARCHAR AS reason FROM adj
  UNION ALL SELECT {K}, reason FROM d0 UNION ALL SELECT {K}, reason FROM d1),
tedge AS (
  SELECT t.track_session, t.track_label, dec.index_b - dec.index_a AS pair_gap, c.*
  FROM dec JOIN tn t ON t.field_id = dec.field_id AND t.s = dec.index_a AND t.label = dec.label_a
  JOIN cand c ON c.field_id = dec.field_id AND c.index_a = dec.index_a AND c.index_b = dec.index_b
       AND c.label_a = dec.label_a AND c.label_b = dec.label_b
  WHERE dec.reason IS NULL),
tspan AS (
  SELECT field_id, track_session, track_label, count(*) AS n_days_present, min(s) AS first_session_index,
         max(s) AS last_session_index, max(s) - min(s) + 1 - count(*) AS missing_internal_days,
         'd' || track_session || ':' || track_label AS track_uid,
         string_agg('d' || s || ':' || label, '|' ORDER BY s) AS component_signature
  FROM tn GROUP BY ALL),
tsum AS (
  SELECT p.*, coalesce(n_adj, 0) AS n_adjacent_edges, coalesce(n_gap, 0) AS n_gap_edges, min_score, mean_score, min_dice,
         max_distance_um, max_ambiguity, coalesce(bo, false) AS contains_balanced_only_edge, coalesce(n_gap, 0) > 0 AS used_gap_bridge
  FROM tspan p LEFT JOIN (
    SELECT field_id, track_session, track_label, count(*) FILTER (pair_gap = 1) AS n_adj, count(*) FILTER (pair_gap = 2) AS n_gap,
           min(score) AS min_score, avg(score) AS mean_score, min(dice) AS min_dice, max(distance_um) AS max_distance_um,
           max(ambiguity) AS max_ambiguity, bool_or(NOT high_rule AND balanced_rule) AS bo
    FROM tedge GROUP BY ALL) e USING (field_id, track_session, track_label))"""


BAL_TRACKS = track_sql(CANDIDATES + BALANCED, f"SELECT {K} FROM bal")
HIGH_TRACKS = track_sql(CANDIDATES + HIGH, f"SELECT {K} FROM high")


def cycles(matches: str) -> str:
    return f""",
cyc AS (
  SELECT ab.field_id, ab.index_a, ab.label_a, ab.label_b AS label_b_composed, bc.label_b AS label_c_composed,
         ac.label_b AS label_c_direct, bc.label_b = ac.label_b AS cycle_agrees
  FROM {matches} ab
  JOIN {matches} bc ON bc.field_id = ab.field_id AND bc.index_a = ab.index_b AND bc.index_b = ab.index_b + 1 AND bc.label_a = ab.label_b
  LEFT JOIN {matches} ac ON ac.field_id = ab.field_id AND ac.index_a = ab.index_a AND ac.index_b = ab.index_a + 2 AND ac.label_a = ab.label_a
  WHERE ab.index_b = ab.index_a + 1),
det AS (SELECT * FROM cyc WHERE label_c_direct IS NOT NULL)"""


META = """,
meta AS (
  SELECT t.*, coalesce(n, 0) AS n_cycle_comparable, coalesce(ok, 0) AS n_cycle_agree,
         CASE WHEN n > 0 THEN ok / n END AS cycle_agreement_fraction,
         coalesce(n, 0) > 0 AND coalesce(ok, 0) < coalesce(n, 0) AS has_cycle_conflict, coalesce(n, 0) = 0 AS cycle_unchecked
  FROM tsum t LEFT JOIN (
    SELECT tn.field_id, track_session, track_label, count(*) AS n, count(*) FILTER (cycle_agrees) AS ok
    FROM det JOIN tn ON tn.field_id = det.field_id AND tn.s = det.index_a AND tn.label = det.label_a GROUP BY ALL) d
  USING (field_id, track_session, track_label))"""

LEGACY = CANDIDATES + f""",
lc AS (SELECT * FROM cand WHERE score >= 0.45),
l2 AS (
  SELECT *, max(score) OVER (PARTITION BY {P}, label_a) AS ba, max(score) OVER (PARTITION BY {P}, label_b) AS bb,
         coalesce(nth_value(score, 2) OVER (PARTITION BY {P}, label_a ORDER BY score DESC
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS sa,
         coalesce(nth_value(score, 2) OVER (PARTITION BY {P}, label_b ORDER BY score DESC
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS sb
  FROM lc),
l3 AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.70::DOUBLE * score + 0.15::DOUBLE * (score - sa) + 0.15::DOUBLE * (score - sb))) AS confidence
  FROM l2 WHERE score + 1e-9 >= ba AND score + 1e-9 >= bb)""" + greedy(
    "lk", "l3", "true", "score DESC, confidence DESC, label_a, label_b"
) + f""",
lm AS (SELECT l3.* FROM l3 JOIN lk USING ({K}))"""

LEGACY_TRACKS = LEGACY + f""",
ladj AS (SELECT * FROM lm WHERE index_b - index_a = 1),
lbr AS (
  SELECT * FROM lm g WHERE index_b - index_a = 2 AND confidence >= 0.70
    AND NOT EXISTS (SELECT 1 FROM ladj a WHERE a.field_id = g.field_id AND a.index_a = g.index_a AND a.label_a = g.label_a)
    AND NOT EXISTS (SELECT 1 FROM ladj a WHERE a.field_id = g.field_id AND a.index_b = g.index_b AND a.label_b = g.label_b)),
lnk AS (SELECT *, false AS is_bridge FROM ladj UNION ALL SELECT *, true FROM lbr),
lnodes AS (SELECT field_id, index_a AS s, label_a AS label FROM lm UNION SELECT field_id, index_b, label_b FROM lm),
lw AS (
  SELECT n.field_id, n.s AS hs, n.label AS hl, n.s, n.label, NULL::DOUBLE AS conf, false AS br FROM lnodes n
  WHERE NOT EXISTS (SELECT 1 FROM lnk WHERE lnk.field_id = n.field_id AND lnk.index_b = n.s AND lnk.label_b = n.label)
  UNION ALL
  SELECT w.field_id, w.hs, w.hl, k.index_b, k.label_b, k.confidence, k.is_bridge FROM lw w
  JOIN lnk k ON k.field_id = w.field_id AND k.index_a = w.s AND k.label_a = w.label),
lt AS (
  SELECT field_id, count(*) AS n_days_present, max(s) - min(s) + 1 - count(*) AS missing_intermediate_days,
         string_agg(s || ':' || label, '|' ORDER BY s) AS signature, coalesce(avg(conf), 0.0) AS mean_confidence,
         coalesce(min(conf), 0.0) AS min_confidence, bool_or(br) AS used_gap_bridge
  FROM lw GROUP BY field_id, hs, hl)"""

LEGACY_FLAGS = LEGACY_TRACKS + """,
lf AS (
  SELECT *, min_confidence < 0.7 AS low_confidence, used_gap_bridge AS gap_bridge_qc, false AS edge_qc,
         missing_intermediate_days > 0 AS fragmented_track_qc,
         min_confidence < 0.7 OR used_gap_bridge OR missing_intermediate_days > 0 AS needs_review
  FROM lt)"""

REC = "WITH RECURSIVE "

PAIR_SUMMARY = CANDIDATES + HIGH + BALANCED + f""",
sz AS (SELECT field_id, s, count(*) AS n FROM pts GROUP BY ALL),
ps AS (
  SELECT {P}, count(*) FILTER (p = 'h') AS n_high, count(*) FILTER (p = 'b') AS n_balanced
  FROM (SELECT *, 'h' AS p FROM high UNION ALL SELECT *, 'b' FROM bal) GROUP BY ALL)"""


def _review() -> str:
    parts = []
    for name, where, order in (
        ("lowest_score_high", "true", "min_score ASC NULLS LAST, "),
        ("largest_distance_high", "true", "max_distance_um DESC NULLS LAST, "),
        ("lowest_dice_high", "true", "min_dice ASC NULLS LAST, "),
        ("cycle_conflict", "has_cycle_conflict", ""),
        ("gap_bridge", "used_gap_bridge", ""),
        ("edge_or_truncated", "missing_internal_days > 0", "n_days_present, "),
    ):
        parts.append(
            f"SELECT field_id, track_uid, '{name}' AS review_category, "
            f"row_number() OVER (ORDER BY {order}field_id, track_uid) AS category_rank FROM h_meta WHERE {where} QUALIFY category_rank <= 6"
        )
    parts.append(
        "SELECT field_id, track_uid, 'balanced_only' AS review_category, row_number() OVER (ORDER BY field_id, track_uid) AS category_rank "
        "FROM b_sig WHERE (field_id, component_signature) NOT IN (SELECT (field_id, component_signature) FROM h_meta) QUALIFY category_rank <= 6"
    )
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


SQL = {
    "knn2": f"""WITH {PAIRS}
SELECT {P}, label_a AS label, nb AS neighbour, {r('d1', 'd2')} FROM na""",
    "knn2_mutual": f"WITH {PAIRS} SELECT {K}, {r('distance_um', 'ambiguity')} FROM cent",
    "overlap_range_join": f"WITH {PAIRS} SELECT {K}, {r('dice', 'iou')} FROM ovl",
    "mutual_best_overlap": f"""WITH {PAIRS},
b AS (SELECT *, row_number() OVER (PARTITION BY {P}, label_a ORDER BY dice DESC, label_b) AS qa,
             row_number() OVER (PARTITION BY {P}, label_b ORDER BY dice DESC, label_a) AS qb FROM ovl)
SELECT {K}, {r('dice', 'iou')} FROM b WHERE qa = 1 AND qb = 1""",
    "candidate_scores": f"""WITH {CANDIDATES}
SELECT {K}, candidate_source, {r('distance_um', 'ambiguity', 'dice', 'iou', 'area_ratio', 'spatial_term', 'ambiguity_term', 'score')},
       high_rule, balanced_rule FROM cand""",
    "high_rule": f"WITH {CANDIDATES} SELECT {K}, candidate_source, {r('score')} FROM cand WHERE high_rule",
    "balanced_rule": f"WITH {CANDIDATES} SELECT {K}, candidate_source, {r('score')} FROM cand WHERE balanced_rule",
    "greedy_matches": f"""{REC}{CANDIDATES}{HIGH}{BALANCED}
SELECT {K}, p AS assignment_policy, {r('score')} FROM (
  SELECT *, 'high' AS p FROM high UNION ALL SELECT *, 'balanced' FROM bal) JOIN cand USING ({K})""",
    "pair_summary": f"""{REC}{PAIR_SUMMARY}
SELECT ps.*, a.n AS n_a, b.n AS n_b, round(n_high / least(a.n, b.n), 6) AS high_frac_smaller,
       round(n_balanced / least(a.n, b.n), 6) AS balanced_frac_smaller
FROM ps JOIN sz a ON a.field_id = ps.field_id AND a.s = ps.index_a JOIN sz b ON b.field_id = ps.field_id AND b.s = ps.index_b""",
    "pair_summary_long": f"""{REC}{PAIR_SUMMARY}
SELECT {P}, 'high' AS match_policy, n_high AS n_matches FROM ps UNION ALL SELECT {P}, 'balanced', n_balanced FROM ps""",
    "graph_anchors": f"""{REC}{ANCHORS}
SELECT {K}, row_number() OVER (PARTITION BY {P} ORDER BY {BASE_ORDER}) - 1 AS anchor_rank, {r('score')} FROM anchors""",
    "graph_support": f"""{REC}{SUPPORT}
SELECT {K}, graph_support_count, {r('graph_support_fraction', 'graph_residual_median_um', 'graph_residual_mean_um',
       'graph_residual_p90_um', 'graph_inlier_fraction')} FROM support""",
    "graph_scores": f"""{REC}{SCORES}
SELECT {K}, graph_status, sc_count AS graph_support_count, {r('graph_score', 'refined_score')} FROM scored""",
    "graph_matches": f"""{REC}{GRAPH}
SELECT {K}, graph_status, assignment_source, {r('refined_score')} FROM gm""",
    "match_diff_full_outer": f"""{REC}{GRAPH}
SELECT {K}, coalesce(i, false) AS in_balanced, coalesce(j, false) AS in_graph, coalesce(i, false) <> coalesce(j, false) AS changed
FROM (SELECT {K}, true AS i FROM bal) FULL JOIN (SELECT {K}, true AS j FROM gm) USING ({K})""",
    "track_nodes": f"""{REC}{BAL_TRACKS}
SELECT field_id, s AS session_index, label, track_session, track_label FROM tn""",
    "edge_decisions": f"""{REC}{BAL_TRACKS}
SELECT {K}, index_b - index_a AS pair_gap, reason IS NULL AS accepted_for_track, reason AS rejection_reason, {r('score')}
FROM dec JOIN cand USING ({K})""",
    "track_summary": f"""{REC}{BAL_TRACKS}
SELECT field_id, n_days_present, first_session_index, last_session_index, missing_internal_days, track_uid, component_signature,
       n_adjacent_edges, n_gap_edges, {r('min_score', 'mean_score', 'min_dice', 'max_distance_um', 'max_ambiguity')},
       contains_balanced_only_edge, false AS contains_transform_fallback_edge, used_gap_bridge, used_gap_bridge AS review_required,
       CASE WHEN used_gap_bridge THEN 'gap_bridge' ELSE '' END AS review_reasons,
       row_number() OVER (ORDER BY n_days_present DESC, missing_internal_days, first_session_index, track_uid, component_signature) AS cluster_id
FROM tsum""",
    "track_length_hist": f"""{REC}{BAL_TRACKS}
SELECT n_days_present, missing_internal_days, count(*) AS n_tracks FROM tspan GROUP BY ALL""",
    "wide_tracks": f"""{REC}{BAL_TRACKS}
SELECT field_id, track_label, {', '.join(f"max(label) FILTER (s = {i}) AS d{i}_roi" for i in range(4))}
FROM tn GROUP BY field_id, track_session, track_label""",
    "cycle_detail": f"{REC}{CANDIDATES}{BALANCED}{cycles('bal')} SELECT * FROM det",
    "cycle_summary": f"""{REC}{CANDIDATES}{BALANCED}{cycles('bal')},
f AS (SELECT DISTINCT field_id, unnest([0, 1])::BIGINT AS index_a FROM pts),
full_ AS (SELECT f.* FROM f WHERE (SELECT count(*) FROM bal WHERE bal.field_id = f.field_id AND bal.index_a = f.index_a AND bal.index_b = f.index_a + 1) > 0
  AND (SELECT count(*) FROM bal WHERE bal.field_id = f.field_id AND bal.index_a = f.index_a + 1 AND bal.index_b = f.index_a + 2) > 0
  AND (SELECT count(*) FROM bal WHERE bal.field_id = f.field_id AND bal.index_a = f.index_a AND bal.index_b = f.index_a + 2) > 0),
a AS (SELECT field_id, index_a, count(*) AS n1, count(label_c_direct) AS n2, count(*) FILTER (cycle_agrees) AS n3
      FROM cyc JOIN full_ USING (field_id, index_a) GROUP BY ALL)
SELECT f.field_id, f.index_a, coalesce(n1, 0) AS n_composed, coalesce(n2, 0) AS n_comparable, coalesce(n3, 0) AS n_agree,
       round(CASE WHEN n2 > 0 THEN n3 / n2 END, 6) AS agreement FROM f LEFT JOIN a USING (field_id, index_a)""",
    "cycle_metadata": f"""{REC}{BAL_TRACKS}{cycles('bal')}{META}
SELECT field_id, track_uid, n_cycle_comparable, n_cycle_agree, {r('cycle_agreement_fraction')}, has_cycle_conflict, cycle_unchecked,
       used_gap_bridge OR has_cycle_conflict AS review_required,
       concat_ws(',', CASE WHEN used_gap_bridge THEN 'gap_bridge' END, CASE WHEN has_cycle_conflict THEN 'cycle_conflict' END) AS review_reasons
FROM meta""",
    "agreement_labels": f"""{REC}{track_sql(GRAPH, f"SELECT {K} FROM gm")},
lab AS (SELECT t.*, b.label_a IS NOT NULL AS con FROM tedge t LEFT JOIN bal b USING ({K})),
ag AS (SELECT field_id, track_session, track_label, count(*) AS n, count(*) FILTER (con) AS nc, count(*) FILTER (NOT con) AS ng
       FROM lab GROUP BY ALL)
SELECT field_id, track_uid, coalesce(n, 0) AS n_accepted_graph_edges, coalesce(nc, 0) AS n_consensus_edges,
       coalesce(ng, 0) AS n_graph_only_edges, round(CASE WHEN n > 0 THEN nc / n END, 6) AS consensus_edge_fraction,
       coalesce(ng, 0) > 0 AS has_graph_only_edge,
       CASE WHEN coalesce(n, 0) = 0 THEN 'unmatched' WHEN ng > 0 THEN 'graph_only' ELSE 'consensus' END AS track_match_source
FROM tspan LEFT JOIN ag USING (field_id, track_session, track_label)""",
    "legacy_confidence_mutual_best": f"{REC}{LEGACY} SELECT {K}, {r('score', 'confidence')} FROM lm",
    "pair_diagnostics": f"""{REC}{LEGACY}
SELECT {P}, count(*) AS accepted_reciprocal_matches, round(max(distance_um), 6) AS max_distance_um,
       round(median(distance_um), 6) AS median_distance_um, {', '.join(
           f"round(quantile_cont({v}, {p}), 6) AS {v}_{n}"
           for v in ('score', 'confidence') for n, p in (('p10', 0.1), ('median', 0.5), ('p90', 0.9)))}
FROM lm GROUP BY {P}""",
    "legacy_tracks": f"""{REC}{LEGACY_TRACKS}
SELECT field_id, n_days_present, missing_intermediate_days, signature, {r('mean_confidence', 'min_confidence')}, used_gap_bridge FROM lt""",
    "legacy_track_length_thresholds": f"""{REC}{LEGACY_TRACKS}
SELECT k AS minimum_weeks_present, count(*) FILTER (n_days_present >= k) AS n_tracks
FROM lt, (SELECT unnest([2, 3, 4]) AS k) GROUP BY k""",
    "legacy_qc_flags": f"""{REC}{LEGACY_FLAGS}
SELECT field_id, signature, low_confidence, gap_bridge_qc, edge_qc, fragmented_track_qc, needs_review FROM lf""",
    "example_tracks": f"""{REC}{LEGACY_FLAGS},
e AS (SELECT * REPLACE (round(mean_confidence, 9) AS mean_confidence, round(min_confidence, 9) AS min_confidence)
      FROM lf WHERE n_days_present >= 2),
c AS (SELECT *, round(abs(mean_confidence - (SELECT median(mean_confidence) FROM e WHERE NOT needs_review)), 9) AS dm
      FROM e WHERE NOT needs_review),
u AS (
  (SELECT field_id, signature, 'high' AS example_group, row_number() OVER (ORDER BY mean_confidence DESC, min_confidence DESC, field_id, signature) AS category_rank, mean_confidence, min_confidence FROM c)
  UNION ALL
  (SELECT field_id, signature, 'medium', row_number() OVER (ORDER BY dm, mean_confidence DESC, field_id, signature), mean_confidence, min_confidence FROM c)
  UNION ALL
  (SELECT field_id, signature, 'low', row_number() OVER (ORDER BY min_confidence, mean_confidence, field_id, signature), mean_confidence, min_confidence FROM e)
  UNION ALL
  (SELECT field_id, signature, 'review', row_number() OVER (ORDER BY min_confidence, mean_confidence, field_id, signature), mean_confidence, min_confidence FROM e WHERE needs_review))
SELECT field_id, signature, example_group, category_rank, {r('mean_confidence', 'min_confidence')} FROM u WHERE category_rank <= 5""",
    "review_sample": f"""WITH h_meta AS (SELECT * FROM ({REC}{HIGH_TRACKS}{cycles('high')}{META} SELECT * FROM meta)),
b_sig AS (SELECT * FROM ({REC}{BAL_TRACKS} SELECT * FROM tspan))
{_review()}""",
}
