import heapq
import random

import pytest
from pyspark.sql import functions as F

from roadspark.operators import graph, reroute, routing, topology, trips, turns

P = "struct<x:double,y:double>"


def random_graph(spark, seed=20260925, n=12, m=40):
    rng = random.Random(seed)
    rows = []
    for k in range(m):
        a, b = rng.sample(range(n), 2)
        rows.append((k, a, b, float(rng.randrange(50, 200)), float(rng.randrange(5, 25)), k))
    t = [(i, j, v == 0, float(rng.randrange(25)) if v == 1 else 0.0) for i in range(m) for j in range(m) if rows[i][2] == rows[j][1] for v in [rng.randrange(5)] if v < 2]
    e = spark.createDataFrame(rows, "edge long, from_node long, to_node long, length_m double, speed_limit_mps double, road_id long")
    return rows, t, routing.edge_costs(e), spark.createDataFrame(t, "from_edge long, to_edge long, prohibited boolean, penalty_s double")


def dijkstra_turns(rows, t, start, extra):
    cost = {r[0]: r[3] / max(0.1, r[4]) for r in rows}
    turn = {(a, b): None if no else p for a, b, no, p in t}
    best, heap = {}, [(extra, start)]
    while heap:
        c, e = heapq.heappop(heap)
        if e in best:
            continue
        best[e] = c
        for r in rows:
            if r[1] == rows[e][2]:
                p = turn.get((e, r[0]), 0.0)
                if p is not None:
                    heapq.heappush(heap, (c + p + cost[r[0]], r[0]))
    return best


def test_turn_search_equals_dijkstra(spark):
    rows, t, edges, turn_rows = random_graph(spark)
    starts = [(k, k, rows[k][2], 1.0) for k in range(4)]
    s = spark.createDataFrame(starts, "od_id long, edge long, node long, extra double")
    got = {(r.od_id, r.edge): r.cost for r in routing.sssp_turns(s, s.where("false"), edges, turn_rows).collect()}
    for k in range(4):
        want = dijkstra_turns(rows, t, k, 1.0)
        assert {e for o, e in got if o == k} == set(want)
        assert all(got[k, e] == pytest.approx(c) for e, c in want.items())


def test_node_search_and_landmarks_bound(spark):
    rows, _, edges, _ = random_graph(spark, seed=5, n=8, m=24)
    s = spark.createDataFrame([(k, -1, k, 0.0) for k in range(8)], "od_id long, edge long, node long, extra double")
    dist = {(r.od_id, r.node): r.cost for r in routing.sssp_nodes(s, s.where("false"), edges).collect()}
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(8) if a != b], "from_node long, to_node long")
    for r in routing.lower_bound(pairs, routing.landmark_tables(edges, 2)).collect():
        true = dist.get((r.from_node, r.to_node), float("inf"))
        assert r.bound <= true + 1e-9


def test_detour_has_two_paths(spark):
    rows = [(0, 0, 1, 1.0), (1, 1, 4, 9.0), (2, 1, 2, 1.0), (3, 2, 3, 1.0), (4, 3, 4, 1.0)]
    edges = spark.createDataFrame(rows, "edge long, from_node long, to_node long, cost double")
    s, g = spark.createDataFrame([(1, 0)], "od_id long, node long"), spark.createDataFrame([(1, 4)], "od_id long, node long")
    got = [(r["rank"], r.edges) for r in routing.k_shortest(s, g, edges, 4).orderBy("rank").collect()]
    assert got == [(1, [0, 2, 3, 4]), (2, [0, 1])]


def test_components(spark):
    nodes = spark.createDataFrame([(k,) for k in range(40)], "node long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 29), (29, 31), (35, 35)], "from_node long, to_node long")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert all(got[k] == 0 for k in range(21)) and got[30] == got[31] == 29 and got[35] == 35
    assert graph.component_summary(graph.components(nodes, edges)).first()["largest"] == 21


def test_build_crossing_and_snap(spark):
    pt = lambda *xs: [{"x": float(x), "y": float(y)} for x, y in xs]
    rows = [(0, "A", "p", "both", 10.0, 1, 0, pt((0, 0), (100, 0))), (1, "B", "s", "forward", 10.0, 1, 0, pt((50, -50), (50, 50))), (2, "C", "l", "both", 10.0, 1, 0, pt((100.2, 0), (200, 0)))]
    roads = spark.createDataFrame(rows, f"road long, source_id string, road_class string, direction string, speed_limit_mps double, lane_count int, z_level int, points array<{P}>")
    nodes, edges, issues = topology.build(roads, 0.5, 100.0)
    assert nodes.count() == 6  # both ends of B, the crossing, 0, 100 (shared with C), 200
    assert edges.count() == 2 * 2 + 2 + 2
    assert issues.count() == 0
    assert sorted(r.node for r in nodes.collect()) == list(range(6))


def test_generated_penalties(spark):
    pt = lambda *xs: [{"x": float(x), "y": float(y)} for x, y in xs]
    lines = {"maj": ((0, -100), (0, 0), (0, 100)), "min": ((-100, 0), (0, 0), (100, 0))}
    rows, node = [], {}
    number = lambda p: node.setdefault(p, len(node))
    for name, (a, b, c) in lines.items():
        for k, (p, q) in enumerate(((a, b), (b, c))):
            for x, y in ((p, q), (q, p)):
                rows.append((len(rows), number(x), number(y), f"{name}{k}", "primary" if name == "maj" else "residential", pt(x, y)))
    diag = (len(rows), number((0, 0)), number((-70, 70)), "diag", "residential", pt((0, 0), (-70, 70)))
    edges = spark.createDataFrame([*rows, diag], f"edge long, from_node long, to_node long, road_id string, road_class string, points array<{P}>")
    got = {(r.from_edge, r.to_edge): r.penalty_s for r in turns.generated_penalties(edges).collect()}
    at = {(r[1], r[2]): r[0] for r in [*rows, diag]}
    west, mid, north, south, out = (node[p] for p in ((-100, 0), (0, 0), (0, 100), (0, -100), (-70, 70)))
    east = node[100, 0]
    assert got[at[south, mid], at[mid, south]] == 5.0
    assert got[at[west, mid], at[mid, north]] == 3.0
    assert got[at[east, mid], at[mid, out]] == 2.0 if (at[east, mid], at[mid, out]) in got else True
    assert got[at[west, mid], at[mid, out]] == 2.0
    assert (at[south, mid], at[mid, north]) not in got and (at[south, mid], at[mid, west]) not in got


def fold(rows):
    state = {}
    return [reroute.fold_reversals(state, r) for r in rows]


def change(old, new, success=True, known=True, old_edges=(1, 2, 9), new_edges=None, **more):
    edges = {"A": [1, 2, 9], "B": [1, 3, 9], "C": [1, 4, 9]}
    return {"success": success, "known": known, "changed": old != new, "old_route_id": old, "new_route_id": new, "old_edges": edges[old], "new_edges": edges[new], "t": 0.0, "old_start": 0.0, "old_end": 50.0, "index": 0, "offset": 0.0, "new_start": 0.0, "new_end": 50.0} | more


def test_reversal_goldens():
    assert fold([change("A", "B"), change("B", "A"), change("A", "B")]) == [False, True, True]
    assert fold([change("A", "B"), change("B", "C"), change("C", "A")]) == [False, False, False]
    assert fold([change("A", "B"), change("B", "B", success=False), change("B", "B"), change("B", "A")]) == [False, None, False, True]
    assert fold([change("A", "B"), change("B", "A", new_end=40.0)]) == [False, False]
    assert fold([change("A", "B", known=False), change("B", "A"), change("A", "B")]) == [None, None, True]


def test_edge_kpis_of_one_corridor(spark):
    rows = [(1, float(t), t, 7 + min(t // 2, 2), 0.0, 25.0) for t in range(7)]
    s = spark.createDataFrame(rows, "vehicle_id long, t double, seq long, edge long, offset_m double, advance_m double")
    got = {r.edge: r for r in trips.edge_kpis(trips.traversals(s)).collect()}
    assert [got[e].entries for e in (7, 8, 9)] == [1, 1, 1]
    assert (got[7].vehicle_seconds, got[7].distance_m, got[7].mean_speed) == (2.0, 50.0, 25.0)
    assert got[9].vehicle_seconds == 0.0 and got[9].mean_speed == 0.0


def test_overlap_nulls_for_invalid_evidence(spark):
    routes = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 5), (2, 1, 7)], "route_id long, pos int, edge long")
    ends = spark.createDataFrame([(1, 20.0, 50.0, 0), (2, 20.0, 50.0, 0)], "route_id long, start_offset_m double, end_offset_m double, from_pos int")
    lengths = spark.createDataFrame([(5, 100.0), (6, 50.0), (7, 50.0)], "edge long, length_m double")
    covered = reroute.coverage(reroute.intervals(routes, ends, lengths))
    listed = spark.createDataFrame([(1, [5, 6], 20.0, 50.0), (2, [5, 7], 20.0, 50.0)], "route_id long, edges array<long>, start_offset_m double, end_offset_m double")
    asked = spark.createDataFrame([(1, 1, 2, True), (2, 1, 1, True), (3, 1, 2, False)], "reroute_id long, old_route_id long, new_route_id long, valid boolean")
    got = {r.reroute_id: (r.changed, r.overlap) for r in reroute.compare(asked, covered, listed).collect()}
    assert got == {1: (True, pytest.approx(80 / 180)), 2: (False, 1.0), 3: (None, None)}


def test_timed_duration_crosses_a_change(spark):
    changes = F.array(F.struct(F.lit(10.0).alias("t"), F.lit(1).cast("long").alias("seq"), F.lit(0.5).alias("factor")))
    d = spark.range(1).select(routing.timed_duration(F.lit(200.0), F.lit(10.0), changes, F.lit(0.0)).alias("d")).first().d
    assert d == pytest.approx(10 + 100 / 5)


def plain_snap(points, tolerance):
    """Each point in order takes the nearest node so far, else makes one."""
    made, out = [], {}
    for key, x, y in sorted(points):
        cell = lambda p: (p[0] // tolerance, p[1] // tolerance)
        near = [(((n[1] - x) ** 2 + (n[2] - y) ** 2) ** 0.5, tuple(-c for c in cell(n[1:])), -k) for k, n in enumerate(made)]
        near = [n for n in near if n[0] <= tolerance]
        if near:
            out[key] = made[-min(near)[2]]
        else:
            made.append((key, x, y))
            out[key] = made[-1]
    return out


@pytest.mark.parametrize("kind", ["crowded", "line", "grid"])
def test_snapping_equals_the_plain_greedy(spark, kind):
    rng = random.Random(kind)
    spots = {"crowded": lambda k: (rng.uniform(0, 3), rng.uniform(0, 3)), "line": lambda k: (0.3 * k, 0.0), "grid": lambda k: (rng.randrange(6) * 0.25, rng.randrange(6) * 0.25)}[kind]
    rows, points = [], []
    for k in range(120 if kind != "line" else 25):
        a, b = spots(2 * k), spots(2 * k + 1)
        rows.append((k % 40, k // 40, [{"x": a[0], "y": a[1]}, {"x": b[0], "y": b[1]}]))
        points += [((k % 40, k // 40, 0), *a), ((k % 40, k // 40, 1), *b)]
    parts = spark.createDataFrame(rows, f"road long, piece int, points array<{P}>")
    got = {(r.road, r.piece, r.end): ((r.first_road, r.first_piece, r.first_end), r.node_x, r.node_y) for r in topology.snap_nodes(parts, 0.5).collect()}
    assert got == plain_snap(points, 0.5)


def test_snapping_of_a_hub(spark):
    n = 150_000
    angle, far = F.rand(3) * 6.28, F.sqrt(F.rand(4)) * 0.2
    at = spark.range(n).select(F.col("id").alias("road"), F.lit(0).alias("piece"), (far * F.cos(angle)).alias("x"), (far * F.sin(angle)).alias("y"))
    parts = at.select("road", "piece", F.array(F.struct("x", "y"), F.struct((F.col("x") + 9).alias("x"), F.col("y"))).alias("points")).persist()
    got = topology.snap_nodes(parts, 0.5).groupBy("first_road", "first_end").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, n), (0, 1, n)]
    parts.unpersist()


def test_goal_directed_searches_settle_fewer_states_and_find_the_same(spark):
    wide, high = 6, 6
    rows = []
    for k in range(wide * high):
        for other in ([k + 1] if k % wide < wide - 1 else []) + ([k + wide] if k + wide < wide * high else []):
            c = 8.0 + k * 37 % 11
            rows += [(len(rows), k, other, c, len(rows)), (len(rows) + 1, other, k, c, len(rows))]
    edges = spark.createDataFrame(rows, "edge long, from_node long, to_node long, cost double, road_id long")
    turns_table = spark.createDataFrame([(r[0], q[0], r[0] % 7 == 0, 2.0) for r in rows for q in rows if r[2] == q[1] and (r[0] + q[0]) % 5 == 0], "from_edge long, to_edge long, prohibited boolean, penalty_s double")
    od = [(1, 0, 35), (2, 5, 30)]
    starts = spark.createDataFrame([(o, r[0], r[2], 1.0) for o, a, _ in od for r in rows if r[1] == a], "od_id long, edge long, node long, extra double")
    goals = spark.createDataFrame([(o, r[0], r[1], 1.0) for o, _, b in od for r in rows if r[1] == b], "od_id long, edge long, node long, extra double")
    marks = routing.landmark_tables(edges, 3)
    pairs = routing.pair_table(edges, turns_table)
    for by, search in (("node", lambda m: routing.sssp_nodes(starts, goals, edges, m)), ("edge", lambda m: routing.sssp_turns(starts, goals, edges, turns_table, m))):
        plain, directed = search(None).persist(), search(marks).persist()
        asked = (goals, by, pairs if by == "edge" else None)
        want = {r.od_id: (r.cost, r.edges) for r in routing.finish(plain, *asked).collect()}
        got = {r.od_id: (r.cost, r.edges) for r in routing.finish(directed, *asked).collect()}
        assert got == want and len(want) == 2
        assert directed.count() < plain.count() if by == "node" else directed.count() <= plain.count()
    lower = routing.sssp_nodes(starts, goals, edges.withColumn("cost", F.col("cost") * 1.5), marks, exact=False)
    want = routing.finish(routing.sssp_nodes(starts, goals, edges.withColumn("cost", F.col("cost") * 1.5), None), goals, "node")
    assert sorted(map(tuple, routing.finish(lower, goals, "node").collect())) == sorted(map(tuple, want.collect()))


def test_chained_search_equals_the_plain_one(spark):
    rng = random.Random(11)
    rows, number = [], iter(range(10_000, 20_000))
    link = lambda a, b, both: rows.extend([(len(rows), a, b, float(rng.randrange(1, 9)))] + ([(len(rows) + 1, b, a, float(rng.randrange(1, 9)))] if both else []))
    for _ in range(25):
        a, b = rng.sample(range(9), 2)
        inner = [next(number) for _ in range(rng.choice([0, 0, 1, 4, 9]))]
        both = rng.random() < 0.6
        for p, q in zip([a, *inner], [*inner, b], strict=True):
            link(p, q, both)
    ring = [next(number) for _ in range(5)]
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        link(p, q, True)
    link(next(number), 3, True)
    edges = spark.createDataFrame(rows, "edge long, from_node long, to_node long, cost double").withColumn("road_id", F.col("edge"))
    ends = [(1, -1, 0, 1.0), (2, -2, 10_001, 0.5), (3, -3, ring[0], 0.0)]
    starts = spark.createDataFrame(ends, "od_id long, edge long, node long, extra double")
    states, _ = routing.sssp_chained(starts, starts.where("false"), edges)
    want = {(r.od_id, r.node): r.cost for r in routing.sssp_nodes(starts, starts.where("false"), edges).collect()}
    assert {(r.od_id, r.node): r.cost for r in states.collect()} == pytest.approx(want)
    goals = spark.createDataFrame([(1, 900, 10_003, 1.0), (2, 901, 5, 1.0)], "od_id long, edge long, node long, extra double")
    got = {r.od_id: (r.cost, r.edges) for r in routing.sssp_chained(starts, goals, edges)[1].collect()}
    plain = {r.od_id: (r.cost, r.edges) for r in routing.finish(routing.sssp_nodes(starts, goals, edges), goals, "node").collect()}
    cost = {r[0]: r[3] for r in rows}
    assert set(got) == set(plain) and all(got[o][0] == pytest.approx(plain[o][0]) for o in plain)
    assert all(sum(cost[k] for k in got[o][1][1:-1]) == pytest.approx(sum(cost[k] for k in plain[o][1][1:-1])) for o in plain)


def test_a_road_of_ten_thousand_edges_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    kept = routing.stored
    monkeypatch.setattr(routing, "stored", lambda df, what: (rounds.append(what), kept(df, what))[1])
    along = spark.range(n).select(F.col("id").alias("edge"), F.col("id").alias("from_node"), (F.col("id") + 1).alias("to_node"), F.lit(2.0).alias("cost"))
    back = along.select((F.col("edge") + n).alias("edge"), F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "cost")
    edges = along.union(back).withColumn("road_id", F.col("edge"))
    starts = spark.createDataFrame([(1, -1, 0, 0.0)], "od_id long, edge long, node long, extra double")
    goals = spark.createDataFrame([(1, -2, n, 0.0)], "od_id long, edge long, node long, extra double")
    states, routes = routing.sssp_chained(starts, goals, edges)
    assert states.agg(F.count("*"), F.sum("cost")).first()[:] == (n + 1, float(n * (n + 1)))
    assert routes.first()["edges"] == [-1, *range(n), -2]
    assert rounds.count("ranks") + rounds.count("settled") < 50


def test_timed_arrival_equals_the_fold(spark):
    rng = random.Random(21)
    rows = []
    for k in range(60):
        times = sorted(float(rng.randrange(0, 40)) for _ in range(rng.choice([0, 1, 2, 7, 30])))
        rows.append((k, float(rng.randrange(0, 900)), float(rng.randrange(1, 30)), float(rng.randrange(0, 60)), [(t, i, rng.choice([0.05, 0.5, 1.0, 3.0])) for i, t in enumerate(times)]))
    df = spark.createDataFrame(rows, "edge long, length_m double, speed double, depart double, changes array<struct<t:double,seq:long,factor:double>>")
    want = df.select("edge", (F.col("depart") + routing.timed_duration(F.col("length_m"), F.col("speed"), F.col("changes"), F.col("depart"))).alias("at"))
    gains = routing.with_gains(df.select("edge", "changes"))
    got = df.drop("changes").join(gains, "edge", "left").select("edge", routing.timed_arrival(F.col("length_m"), F.col("speed"), F.col("changes"), F.col("depart")).alias("at"))
    assert {r.edge: r["at"] for r in got.collect()} == pytest.approx({r.edge: r["at"] for r in want.collect()})


@pytest.mark.parametrize("crowded", [20, 4096])
def test_pairs_of_crowded_cells_equal_all_touching_boxes(spark, monkeypatch, crowded):
    monkeypatch.setattr(topology, "CROWDED", crowded)
    rng = random.Random(14)
    rows = []
    for k in range(260):
        near = k % 10 > 0  # nine of ten lie in one cell of the first size
        x, y = (rng.uniform(1, 90), rng.uniform(1, 90)) if near else (rng.uniform(-400, 400), rng.uniform(-400, 400))
        far = rng.choice([0.0, 3.0, 12.5, 25.0]) if near else 150.0
        points = [{"x": x, "y": y}, {"x": x + rng.choice([-1, 1]) * far, "y": y + far / 2}, {"x": x, "y": 25.0}]
        rows.append((k, k % 2, points))
    roads = spark.createDataFrame(rows, f"road long, z_level int, points array<{P}>")
    segs = topology.segments(roads).persist()
    got = [tuple(r) for r in topology.candidate_pairs(segs, 100.0).select("i_road", "i_idx", "j_road", "j_idx").collect()]
    listed = [(r.road, r.idx, r.z_level, min(r.a.x, r.b.x), max(r.a.x, r.b.x), min(r.a.y, r.b.y), max(r.a.y, r.b.y)) for r in segs.collect()]
    want = {(*p[:2], *q[:2]) for p in listed for q in listed if p[2] == q[2] and (p[0] < q[0] or p[0] == q[0] and p[1] + 1 < q[1]) and p[3] <= q[4] and q[3] <= p[4] and p[5] <= q[6] and q[5] <= p[6]}
    assert len(got) == len(set(got)) and set(got) == want
    segs.unpersist()


def test_matches_where_segments_and_points_crowd(spark, monkeypatch):
    """Nine tenths of the segments in one cell, and most points beside them, against all pairs."""
    import random

    from roadspark.operators import spatial, topology

    monkeypatch.setattr(topology, "CROWDED", 40)
    monkeypatch.setattr(spatial, "BLOCK", 50)
    rng = random.Random(4)
    lines = []
    for k in range(300):
        x, y = (rng.uniform(0, 99), rng.uniform(0, 99)) if k < 270 else (rng.uniform(-900, 900), rng.uniform(-900, 900))
        lines.append((k, [(x + d * rng.uniform(-4, 4), y + d * rng.uniform(-4, 4)) for d in range(3)]))
    asks = [(k, rng.uniform(-20, 120), rng.uniform(-20, 120)) if k < 180 else (k, rng.uniform(-900, 900), rng.uniform(-900, 900)) for k in range(200)]
    edges = spark.createDataFrame(lines, "edge long, points array<struct<x:double,y:double>>")
    points = spark.createDataFrame(asks, "point_id long, x double, y double")

    def lateral(p, line):
        def to(a, b):
            dx, dy = b[0] - a[0], b[1] - a[1]
            n = dx * dx + dy * dy
            t = min(1, max(0, ((p[1] - a[0]) * dx + (p[2] - a[1]) * dy) / n)) if n else 0
            return ((p[1] - a[0] - t * dx) ** 2 + (p[2] - a[1] - t * dy) ** 2) ** 0.5

        return min(map(to, line, line[1:]))

    want = {(p[0], k): far for p in asks for k, line in lines if (far := lateral(p, line)) <= 100}
    splits = []
    spatial.leaf_cells(spark.createDataFrame([(0.5 * k, 1.0, 0.5 * k, 1.0, 0) for k in range(100)], "low_x double, low_y double, high_x double, high_y double, z_level int"), 100.0, splits)
    assert splits
    got = {(r.point_id, r.edge): r.lateral_m for r in spatial.match_points(points, edges, 1000).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
