import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import greedy
from longitrack.operators import assignment, candidates as cand, graph, tracks
from longitrack.operators.spatial import FAN, bounding_box, knn_join, morton, packed_index, packed_leaves, radius_join
from longitrack.params import GraphParams, OverlapParams, resolve_policies
from longitrack.plans.daywise import pair_schedule

POINT = "g int, label int, z_um double, y_um double, x_um double"


def brute(queries, targets, k):
    out = {}
    for g, label, *q in queries:
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(q, t)))), other) for h, other, *t in targets if h == g)
        out[g, label] = near[:k]
    return out


@pytest.mark.parametrize("leaf,k", [(2, 2), (4, 3), (64, 2)])
def test_knn_matches_brute_force(spark, leaf, k):
    """Sparse points, a clump far denser than the rest, equal positions and a group with one target."""
    rng = np.random.default_rng(leaf)

    def cloud(n, first):
        spread = [(0, first + i, *map(float, rng.uniform(0, 100, 3))) for i in range(n)]
        clump = [(0, first + 500 + i, *map(float, 40 + rng.normal(0, 1e-3, 3))) for i in range(n)]
        same = [(0, first + 900 + i, 7.0, 7.0, 7.0) for i in range(9)]
        return spread + clump + same + [(1, first + 2000 + i, *map(float, rng.uniform(0, 5, 3))) for i in range(6)]

    a, b = cloud(40, 0), cloud(50, 10000)
    b = [r for r in b if r[0] == 0] + [(1, 777, 1.0, 2.0, 3.0)]
    a += [(0, 5000, -300.0, 50.0, 1e4), (0, 5001, 40.0, 40.0, 40.0)]
    got = {}
    for r in knn_join(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT), k, ["g"], leaf).collect():
        got.setdefault((r.g, r.label), []).append((r["rank"], r.distance_um, r.neighbour))
    want = brute(a, b, k)
    assert set(got) == set(want)
    for key, rows in got.items():
        rows.sort()
        assert [r[2] for r in rows] == [w[1] for w in want[key]]
        assert [r[1] for r in rows] == pytest.approx([w[0] for w in want[key]])


def test_knn_of_a_crowded_clump(spark):
    """Half of the targets within a nanometre, queries in and far from it; the leaves stay bounded."""
    rng = np.random.default_rng(11)
    b = [(0, i, *map(float, rng.uniform(0, 1000, 3))) for i in range(400)]
    b += [(0, 1000 + i, *map(float, 500 + rng.uniform(0, 1e-3, 3))) for i in range(400)]
    a = [(0, i, *map(float, rng.uniform(-100, 1100, 3))) for i in range(80)] + [(0, 100 + i, *map(float, 500 + rng.normal(0, 1e-3, 3))) for i in range(80)]
    a += [(0, 900, 500.0, 500.0, None), (2, 1, 0.0, 0.0, 0.0)]
    targets = spark.createDataFrame(b + [(0, 5000, None, 1.0, 1.0)], POINT)
    got = {}
    for r in knn_join(spark.createDataFrame(a, POINT), targets, 3, ["g"], 16).collect():
        got.setdefault((r.g, r.label), []).append((r["rank"], r.neighbour))
    want = brute(a[:-2], b, 3)
    assert {key: [n for _, n in sorted(rows)] for key, rows in got.items()} == {key: [n for _, n in rows] for key, rows in want.items()}
    box = bounding_box(targets.na.drop(), ["g"])
    keyed = targets.na.drop().join(box, "g").withColumn("_key", morton())
    leaves = packed_leaves(keyed, ["g"], 16, ["label"])
    assert leaves.where("_n >= 32 or size(_points) <> _n").isEmpty() and leaves.count() == 50
    steps, top = packed_index(leaves, ["g"])
    assert top == 2 and steps.where(f"size(_kids) > {FAN}").isEmpty()


def test_greedy_follows_a_long_chain_in_one_round(spark, monkeypatch):
    """Every candidate but the last has one better rival: 100,000 of them are decided by doubling, not round by round."""
    n, rounds = 100_000, []
    decided = assignment._decided
    monkeypatch.setattr(assignment, "_decided", lambda *a: rounds.append(1) or decided(*a))
    i = F.col("id")
    rows = spark.range(n).select(
        F.lit("x").alias("day_a"), F.lit("y").alias("day_b"), F.floor(i / 2).cast("int").alias("label_a"),
        F.floor((i + 1) / 2).cast("int").alias("label_b"), i.cast("double").alias("score"), F.lit(0.5).alias("dice"), F.lit(1.0).alias("distance_um"))
    got = assignment.greedy_keys(rows).select((F.col("label_a") + F.col("label_b")).alias("i"))
    assert len(rounds) == 1
    assert got.agg(F.count("i"), F.min("i"), F.sum(F.col("i") % 2)).first()[:] == (n // 2, 1, n // 2)


def test_radius_join(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, *map(float, rng.uniform(-20, 20, 3))) for i in range(120)]
    df = spark.createDataFrame(rows, POINT)
    got = {(r.a.label, r.b.label) for r in radius_join(df, df, 6.0, 6.0, ["g"]).collect()}
    want = {(p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and sum((a - b) ** 2 for a, b in zip(p[2:], q[2:])) <= 36}
    assert got == want


CAND = "day_a string, day_b string, label_a int, label_b int, score double, dice double, distance_um double, rule boolean"


def test_greedy_equals_sequential(spark):
    """Tie-heavy candidates in several pairs, among them a long chain of ever better scores."""
    rnd = random.Random(4)
    rows = []
    for pair in range(5):
        seen = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(60)}
        rows += [("d%d" % pair, "e", a, b, rnd.randrange(4) / 4, rnd.randrange(3) / 3, float(rnd.randrange(3)), True) for a, b in seen]
    chain = [("chain", "e", i // 2, (i + 1) // 2, i / 40, 0.5, 1.0, True) for i in range(12)]
    rows += chain + [("d0", "e", 99, 99, 1.0, 1.0, 0.0, False)]
    got = assignment.greedy_one_to_one(spark.createDataFrame(rows, CAND), "rule")
    found = {}
    for r in got.collect():
        found.setdefault(r.day_a, []).append((r.label_a, r.label_b))
    names = [c.split()[0] for c in CAND.split(", ")]
    for pair in {r[0] for r in rows}:
        dicts = [dict(zip(names, r)) for r in rows if r[0] == pair and r[7]]
        want = greedy(dicts, lambda r: (-r["score"], -r["dice"], r["distance_um"], r["label_a"], r["label_b"]))
        assert sorted(found[pair]) == want


def test_reciprocal_assignment(spark):
    rows = [("a", "b", 10, 20, 0.90), ("a", "b", 10, 21, 0.70), ("a", "b", 11, 20, 0.85)]
    out = assignment.reciprocal_best(spark.createDataFrame(rows, "day_a string, day_b string, label_a int, label_b int, score double"))
    r = out.collect()
    assert [(x.label_a, x.label_b, x.score) for x in r] == [(10, 20, 0.90)]
    assert r[0].confidence == pytest.approx(0.7 * 0.9 + 0.15 * 0.2 + 0.15 * 0.05)


def test_mutual_overlap_ties(spark):
    rows = [("a", "b", 1, 1, 0.5), ("a", "b", 1, 2, 0.5), ("a", "b", 2, 2, 0.5), ("a", "b", 3, 2, 0.9)]
    out = assignment.mutual_best_overlap(spark.createDataFrame(rows, "day_a string, day_b string, label_a int, label_b int, dice double"))
    assert sorted((r.label_a, r.label_b) for r in out.collect()) == [(1, 1), (3, 2)]


def test_candidates_rules_and_sources(spark):
    schema = "day_a string, day_b string, label int, z_um double, y_um double, x_um double, area_voxels double"
    a = spark.createDataFrame([("a", "b", 1, 0.0, 0.0, 0.0, 10.0), ("a", "b", 2, 0.0, 30.0, 0.0, 10.0)], schema)
    b = spark.createDataFrame([("a", "b", 5, 0.0, 3.0, 0.0, 8.0), ("a", "b", 6, 0.0, 60.0, 0.0, 10.0)], schema)
    o = spark.createDataFrame(
        [("a", "b", 1, 5, 0.05, 0.02), ("a", "b", 2, 6, 0.30, 0.2), ("a", "b", 2, 5, 0.05, 0.02)],
        "day_a string, day_b string, label_a int, label_b int, dice double, iou double",
    )
    rows = {(r.label_a, r.label_b): r for r in cand.candidate_pairs(a, b, o).collect()}
    assert set(rows) == {(1, 5), (2, 6)}
    assert rows[1, 5].candidate_source == "both" and rows[2, 6].candidate_source == "mutual_overlap"
    r = rows[1, 5]
    assert r.distance_um == 3.0 and r.area_ratio == 0.8 and r.high_rule and r.balanced_rule
    # the nearest distance over the second one, the worse of the two directions
    assert r.ambiguity == pytest.approx(max(3 / 60, 3 / 27))
    want = 0.40 * np.exp(-9 / 16) + 0.32 * 0.05 + 0.15 * 0.8 + 0.13 * (1 - r.ambiguity)
    assert r.score == pytest.approx(want)
    assert rows[2, 6].ambiguity == 1.25 and not rows[2, 6].balanced_rule
    alone = cand.candidate_pairs(a.where("label = 1"), b.where("label = 5"), o.limit(0)).first()
    assert alone.ambiguity == 1.25 and alone.candidate_source == "mutual_centroid"


NODE = "session_index int, label int"
EDGE = ("index_a int, index_b int, label_a int, label_b int, score double, dice double, distance_um double, ambiguity double, "
        "high_rule boolean, balanced_rule boolean, transform_fallback_reason string")


def edge(i, j, a, b, score=0.9):
    return (i, j, a, b, score, 0.8, 1.0, 0.2, True, True, None)


def union_find(nodes, edges):
    """Plain sequential track building: adjacent matches, then gap matches in session order."""
    owner = {n: {n} for n in nodes}
    reasons = {}
    ordered = [e for e in edges if e[1] - e[0] == 1] + sorted((e for e in edges if e[1] - e[0] == 2), key=lambda e: (e[0], -e[4], e[2], e[3]))
    for e in ordered:
        p, q = (e[0], e[2]), (e[1], e[3])
        if p not in owner or q not in owner:
            reasons[e[:4]] = "missing_node"
        elif owner[p] is owner[q]:
            reasons[e[:4]] = "already_connected"
        elif {s for s, _ in owner[p]} & {s for s, _ in owner[q]}:
            reasons[e[:4]] = "same_session_component_conflict"
        else:
            merged = owner[p] | owner[q]
            for n in merged:
                owner[n] = merged
            reasons[e[:4]] = None
    return owner, reasons


def test_tracks_equal_sequential_union_find(spark):
    rnd = random.Random(11)
    seen = set()
    for sessions, size in ((6, 14), (9, 5)):
        nodes = [(s, l) for s in range(sessions) for l in range(size)]
        edges = []
        for i in range(sessions):
            for gap in (1, 2):
                if i + gap < sessions:
                    left, right = rnd.sample(range(size), size), rnd.sample(range(size + 1), size)
                    edges += [edge(i, i + gap, a, b, rnd.randrange(5) / 5) for a, b in zip(left, right) if rnd.random() < 0.6]
        owner, reasons = union_find(nodes, edges)
        track, decided = tracks.build_tracks(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), sessions)
        got = {(r.session_index, r.label): (r.track_session, r.track_label) for r in track.collect()}
        assert got == {n: min(group) for n, group in owner.items()}
        found = {(r.index_a, r.index_b, r.label_a, r.label_b): r.rejection_reason for r in decided.collect()}
        assert found == reasons
        seen |= set(reasons.values())
    assert {"already_connected", "same_session_component_conflict", "missing_node"} <= seen


def session_name():
    return F.concat(F.lit("d"), F.col("session_index").cast("string"))


def test_track_table_and_cycles(spark):
    nodes = spark.createDataFrame([(0, 1), (0, 2), (1, 11), (1, 22), (2, 111), (2, 222)], NODE)
    edges = spark.createDataFrame([edge(0, 1, 1, 11), edge(1, 2, 11, 111), edge(0, 2, 1, 222)], EDGE)
    owned, decided = tracks.build_tracks(nodes, edges, 3)
    table = tracks.track_table(owned, decided, session_name())
    checks = tracks.cycle_checks(edges)
    table = tracks.cluster_ids(tracks.add_cycle_metadata(table, owned, tracks.cycle_detail(checks)))
    rows = {r.track_uid: r for r in table.collect()}
    first = rows["d0:1"]
    assert first.cluster_id == 1 and first.n_days_present == 3 and first.component_signature == "d0:1|d1:11|d2:111"
    assert first.has_cycle_conflict and first.review_required and first.review_reasons == "cycle_conflict"
    assert sum(r.n_days_present == 1 for r in rows.values()) == 3
    triplets = spark.createDataFrame([(0,)], "index_a int")
    s = tracks.cycle_summary(checks, edges, triplets).first()
    assert (s.n_composed, s.n_comparable, s.n_agree, s.agreement) == (1, 1, 0, 0.0)
    partial = edges.where("index_b - index_a = 1")
    s = tracks.cycle_summary(tracks.cycle_checks(partial), partial, triplets).first()
    assert (s.n_composed, s.n_comparable, s.agreement) == (0, 0, None)
    wide = tracks.wide_tracks(owned, {0: "d0", 1: "d1", 2: "d2"})
    back = tracks.long_tracks(wide, ["track_session", "track_label"])
    assert back.count() == nodes.count()


LINK = "index_a int, index_b int, label_a int, label_b int, confidence double"


def legacy_sequential(sessions, links, least):
    track = {}
    for i, j, a, b, _ in links:
        for n in ((i, a), (j, b)):
            track.setdefault(n, {n})
    def join(p, q):
        merged = track[p] | track[q]
        for n in merged:
            track[n] = merged
    for i, j, a, b, c in links:
        if j - i == 1:
            join((i, a), (j, b))
    for i, j, a, b, c in sorted((k for k in links if k[1] - k[0] == 2 and k[4] >= least), key=lambda k: -k[4]):
        p, q = track[i, a], track[j, b]
        held = {s for s, _ in p} | {s for s, _ in q}
        if p is q or i + 1 in held or {s for s, _ in p} & {s for s, _ in q}:
            continue
        join((i, a), (j, b))
    return track


def test_legacy_tracks(spark):
    rnd = random.Random(3)
    sessions, size, links = 7, 9, []
    for i in range(sessions):
        for gap in (1, 2):
            if i + gap < sessions:
                left, right = rnd.sample(range(size), size), rnd.sample(range(size), size)
                links += [(i, i + gap, a, b, rnd.random()) for a, b in zip(left, right) if rnd.random() < 0.5]
    nodes, used = tracks.legacy_tracks(spark.createDataFrame(links, LINK), sessions, 0.3)
    got = {(r.session_index, r.label): (r.head_session, r.head_label) for r in nodes.collect()}
    assert got == {n: min(group) for n, group in legacy_sequential(sessions, links, 0.3).items()}
    fixed = [(0, 1, 1, 2, 0.9), (1, 2, 2, 3, 0.9), (1, 3, 2, 4, 0.95)]
    nodes, used = tracks.legacy_tracks(spark.createDataFrame(fixed, LINK), 4, 0.88)
    assert sum(r.head_session == 0 for r in nodes.collect()) == 3 and used.where("is_bridge").isEmpty()


def test_graph_fallback_and_scores(spark):
    schema = ("day_a string, day_b string, label_a int, label_b int, candidate_source string, distance_um double, ambiguity double, "
              "dice double, iou double, area_ratio double, score double, high_rule boolean, balanced_rule boolean")
    grid = [(float(20 * i), float(20 * j)) for i in range(3) for j in range(3)]
    side = "day_a string, day_b string, label int, z_um double, y_um double, x_um double"
    a = spark.createDataFrame([("a", "b", n, 0.0, y, x) for n, (y, x) in enumerate(grid)], side)
    b = spark.createDataFrame([("a", "b", n, 0.0, y + 1, x) for n, (y, x) in enumerate(grid)], side)
    rows = [("a", "b", n, n, "both", 1.0, 0.05, 0.9 if n != 4 else 0.3, 0.8, 1.0, 0.9, n != 4, True) for n in range(9)]
    df = spark.createDataFrame(rows, schema)
    anchors = graph.graph_anchors(df.where("high_rule"))
    scored = {r.label_a: r for r in graph.graph_scores(df, anchors, a, b).collect()}
    assert scored[0].graph_status == "anchor" and scored[4].graph_status == "scored"
    assert scored[4].graph_support_count == 6 and scored[4].graph_support_fraction == pytest.approx(6 / 8)
    assert scored[4].graph_score == pytest.approx(1.0) and scored[4].refined_score == pytest.approx(0.8 * 0.9 + 0.2)
    assert sorted(r.anchor_rank for r in anchors.collect()) == list(range(8))
    out = graph.graph_assignment(graph.graph_scores(df, anchors, a, b))
    assert {r.label_a: r.assignment_source for r in out.collect()}[4] == "graph_refined" and out.count() == 9
    none = anchors.limit(0)
    plain = graph.graph_scores(df, none, a, b)
    assert {r.graph_status for r in plain.collect()} == {"no_anchor_fallback"}
    kept = graph.graph_assignment(plain, fallback=df.where("label_a < 3"))
    assert {(r.label_a, r.graph_status) for r in kept.collect()} == {(n, "baseline_fallback") for n in range(3)}
    diff = graph.compare_matches(df.where("label_a < 3"), df.where("label_a > 1"))
    assert diff.where("changed").count() == 8


def test_policies_and_schedule(spark):
    assert resolve_policies(["graph", "high", "graph", "Balanced "]) == ("graph", "high", "balanced")
    for wrong in (["", "high"], ["high", "invalid"], []):
        with pytest.raises(ValueError):
            resolve_policies(wrong)
    for gap in (0, -1, 3, 1.5):
        with pytest.raises(ValueError):
            pair_schedule(spark, [], gap)
    with pytest.raises(ValueError):
        OverlapParams(weight_dice=0.9)


def support_by_brute_force(pairs, anchors, a, b, params):
    def apart(p, q):
        return float(np.sqrt(((p - q) ** 2).sum()))

    out = {}
    for la, lb in pairs:
        near = []
        for ka, kb in anchors:
            d_a, d_b = apart(a[la], a[ka]), apart(b[lb], b[kb])
            if d_a <= params.radius_um and d_b <= params.radius_um:
                near.append((d_a, d_b, ka, apart(a[ka] - a[la], b[kb] - b[lb])))
        if near:
            first = {n[2] for n in sorted(near, key=lambda n: (n[0], n[2]))[:params.neighbours]}
            second = {n[2] for n in sorted(near, key=lambda n: (n[1], n[2]))[:params.neighbours]}
            res = [n[3] for n in near if n[2] in first & second]
            out[la, lb] = (len(res), len(res) / len(near), np.median(res) if res else None)
    return out


@pytest.mark.parametrize("leaf", [8, 64])
def test_graph_support_counts_crowds_without_listing_them(spark, monkeypatch, leaf):
    """Anchors with a clump that whole balls hold: the shares match brute force, and only close anchors are listed."""
    monkeypatch.setattr(graph, "LEAF_POINTS", leaf)
    rng = np.random.default_rng(leaf)
    params = GraphParams(radius_um=20.0, neighbours=4)
    a = {i: rng.uniform(0, 120, 3) for i in range(260)} | {i: 60 + rng.uniform(-4, 4, 3) for i in range(260, 560)}
    b = {i: p + rng.normal(0, 1.5, 3) for i, p in a.items()}
    anchors = [(i, i) for i in a if i % 2 == 0]
    pairs = [(i, i) for i in a if i % 2][:220] + [(1, 3), (5, 300), (300, 5)] + [(i, i) for i in range(301, 321, 2)]
    side = "day_a string, day_b string, label int, z_um double, y_um double, x_um double"
    df_a = spark.createDataFrame([("p", "q", i, *map(float, p)) for i, p in a.items()], side)
    df_b = spark.createDataFrame([("p", "q", i, *map(float, p)) for i, p in b.items()], side)
    keys = "day_a string, day_b string, label_a int, label_b int"
    cands = spark.createDataFrame([("p", "q", *k) for k in pairs] + [("none", "q", 1, 1)], keys)
    marks = spark.createDataFrame([("p", "q", *k) for k in anchors], keys)
    want = support_by_brute_force(pairs, anchors, a, b, params)
    got = {(r.label_a, r.label_b): r for r in graph.graph_support(cands, marks, df_a, df_b, params).collect()}
    assert set(got) == set(want)
    for key, (count, share, median) in want.items():
        r = got[key]
        assert r.graph_support_count == count and r.graph_support_fraction == pytest.approx(share)
        assert r.graph_residual_median_um == (None if median is None else pytest.approx(median))
    if leaf == 8:
        found = graph.local_anchors(graph._placed(cands, df_a, df_b, ["day_a", "day_b"]), graph._placed(marks, df_a, df_b, ["day_a", "day_b"]), params, ["day_a", "day_b"])
        listed, local = found.agg(F.sum(F.size("_close")), F.sum("_local")).first()
        assert listed < local / 2
