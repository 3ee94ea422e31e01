"""Queries over trips, controls and experiments, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions.tables import table
from roadspark.operators import controls as ctl
from roadspark.operators import experiments as exp
from roadspark.operators import trips
from roadspark.plans import derive
from roadspark.plans.derive import with_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = with_sql(sql)
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def visits(spark: SparkSession, d: str) -> DataFrame:
    return trips.traversals(derive.samples(spark, d))


def midway(spark: SparkSession, d: str) -> float:
    """Half of the time that the events span."""
    e = table(spark, d, "events").agg(((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 1e6 / 2).alias("at")).first()
    return float(e.at or 0.0)


@query("SELECT vehicle_id, CAST(visit AS BIGINT) AS visit, edge, round(enter_t, 6) AS enter_t, round(exit_t, 6) AS exit_t, round(distance_m, 6) AS distance_m FROM visits")
def i1_traversals(spark, d):
    return rounded(visits(spark, d), "enter_t", "exit_t", "distance_m")


@query("SELECT edge, entries, round(vehicle_seconds, 3) AS vehicle_seconds, round(distance_m, 3) AS distance_m, round(mean_speed, 6) AS mean_speed FROM kpis")
def i2_edge_kpis(spark, d):
    return rounded(rounded(trips.edge_kpis(visits(spark, d)), "vehicle_seconds", "distance_m", digits=3), "mean_speed", digits=6)


@query("SELECT edge, round(t, 6) AS t, CAST(sum(d) OVER (PARTITION BY edge ORDER BY t) AS BIGINT) AS vehicles FROM (SELECT edge, t, sum(d) AS d FROM (SELECT edge, enter_t AS t, 1 AS d FROM visits UNION ALL SELECT edge, exit_t, -1 FROM visits WHERE exit_t IS NOT NULL) GROUP BY edge, t)")
def i3_occupancy(spark, d):
    return rounded(trips.occupancy(visits(spark, d)), "t")


@query("SELECT edge, count(*) AS vehicles FROM visits, midway WHERE enter_t <= mid AND (exit_t IS NULL OR exit_t > mid) GROUP BY edge")
def i3_occupancy_at(spark, d):
    return trips.occupancy_at(visits(spark, d), midway(spark, d))


@query("SELECT count(arrive_t) AS arrived, count(*) FILTER (unroutable) AS unroutable, count(*) FILTER (NOT unroutable AND arrive_t IS NULL AND depart_t IS NULL) AS waiting, count(*) FILTER (NOT unroutable AND arrive_t IS NULL AND depart_t IS NOT NULL) AS driving, round(avg(arrive_t - depart_t), 6) AS avg_travel_s, round(min(arrive_t - depart_t), 6) AS min_travel_s, round(max(arrive_t - depart_t), 6) AS max_travel_s, round(sum(distance_m), 3) AS distance_m FROM vehicles")
def i4_summary(spark, d):
    return rounded(rounded(trips.summary(derive.vehicles(spark, d)), "avg_travel_s", "min_travel_s", "max_travel_s"), "distance_m", digits=3)


def asks(spark, d):
    """Each vehicle asked at four times of the span."""
    half = midway(spark, d)
    times = F.explode(F.array(*(F.lit(half * k / 2) for k in range(1, 5))))
    return derive.vehicles(spark, d).select("vehicle_id", times.alias("t"))


@query("""WITH asked AS (SELECT vehicle_id, mid * k / 2 AS t FROM vehicles, midway, (VALUES (1), (2), (3), (4)) ks(k)),
around AS (SELECT vehicle_id, t,
  (SELECT max_by({'t': s.t, 'o': s.offset_m}, {'t': s.t, 'q': s.seq}) FROM samples s WHERE s.vehicle_id = asked.vehicle_id AND s.t <= asked.t) AS a,
  (SELECT min_by({'t': s.t, 'o': s.offset_m}, {'t': s.t, 'q': s.seq}) FROM samples s WHERE s.vehicle_id = asked.vehicle_id AND s.t > asked.t) AS b FROM asked)
SELECT vehicle_id, round(t, 6) AS t, round(CASE WHEN a IS NULL THEN b.o WHEN b IS NULL THEN a.o ELSE a.o + (b.o - a.o) * (t - a.t) / (b.t - a.t) END, 6) AS offset_m FROM around""")
def i5_interpolate(spark, d):
    return rounded(trips.interpolate(derive.samples(spark, d), asks(spark, d), ["offset_m"]), "t", "offset_m")


@query("""WITH spans AS (SELECT v.*, mid / 8 AS step, least(coalesce(arrive_t, mid * 2), mid * 2) AS until FROM vehicles v, midway WHERE depart_t IS NOT NULL),
ticks AS (SELECT vehicle_id, step, unnest(range(CAST(ceil(depart_t / step) AS BIGINT), CAST(floor(until / step) AS BIGINT) + 1)) AS k FROM spans WHERE ceil(depart_t / step) <= floor(until / step)),
asked AS (SELECT vehicle_id, k * step AS t FROM ticks),
around AS (SELECT vehicle_id, t,
  (SELECT max_by({'t': s.t, 'o': s.offset_m, 'e': s.edge}, {'t': s.t, 'q': s.seq}) FROM samples s WHERE s.vehicle_id = asked.vehicle_id AND s.t <= asked.t) AS a,
  (SELECT min_by({'t': s.t, 'o': s.offset_m, 'e': s.edge}, {'t': s.t, 'q': s.seq}) FROM samples s WHERE s.vehicle_id = asked.vehicle_id AND s.t > asked.t) AS b FROM asked),
held AS (SELECT target_id AS vehicle_id, coalesce(max_by(action = 'hold', {'t': t, 'q': seq}) FILTER (action IN ('hold', 'release')), false) AS held FROM controls, midway WHERE scope = 'vehicle' AND t <= mid GROUP BY target_id)
SELECT vehicle_id, round(t, 6) AS t, round(CASE WHEN a IS NULL THEN b.o WHEN b IS NULL THEN a.o ELSE a.o + (b.o - a.o) * (t - a.t) / (b.t - a.t) END, 6) AS offset_m, coalesce(held, false) AS held, 1.0::DOUBLE AS speed_factor FROM around LEFT JOIN held USING (vehicle_id)""")
def i6_frames(spark, d):
    half = midway(spark, d)
    shown = trips.frames(derive.samples(spark, d), derive.vehicles(spark, d), half / 8, half * 2, ["offset_m"])
    state = ctl.vehicle_state_at(derive.controls(spark, d), half)
    shown = shown.join(state, "vehicle_id", "left").fillna({"held": False, "speed_factor": 1.0})
    return rounded(shown.select("vehicle_id", "t", "offset_m", "held", "speed_factor"), "t", "offset_m")


@query("SELECT vehicle_id, round(s.t, 6) AS t, s.seq AS seq, s.edge AS edge, s.offset_m AS offset_m FROM (SELECT vehicle_id, min_by({'t': t, 'seq': seq, 'edge': edge, 'offset_m': offset_m}, {'t': t, 'seq': seq}) AS s FROM samples GROUP BY vehicle_id, floor(t / 3600))")
def i7_downsample(spark, d):
    return rounded(trips.downsample(derive.samples(spark, d), 3600.0), "t")


@query("""WITH steps AS (SELECT vehicle_id, t, sqrt((edge - lag(edge) OVER w) ** 2 + (offset_m - lag(offset_m) OVER w) ** 2) AS step FROM samples WINDOW w AS (PARTITION BY vehicle_id ORDER BY t, edge, offset_m))
SELECT vehicle_id, count(*) AS n_points, round(min(t), 6) AS depart_t, round(max(t), 6) AS arrive_t, round(max(t) - min(t), 6) AS travel_s, round(sum(step), 3) AS distance_m FROM steps GROUP BY vehicle_id HAVING count(*) >= 2""")
def i8_trajectories(spark, d):
    lines = trips.trajectories(derive.samples(spark, d).select("vehicle_id", "t", F.col("edge").cast("double").alias("x"), F.col("offset_m").alias("y")))
    lines = lines.select("vehicle_id", F.size("line").cast("long").alias("n_points"), "depart_t", "arrive_t", "travel_s", "distance_m")
    return rounded(rounded(lines, "depart_t", "arrive_t", "travel_s"), "distance_m", digits=3)


@query("SELECT DISTINCT v.vehicle_id FROM vehicles v JOIN routes r ON r.route_id = v.vehicle_id WHERE v.arrive_t IS NULL AND r.pos > CASE WHEN v.depart_t IS NULL THEN -1 ELSE v.vehicle_id % 3 END AND r.edge IN (SELECT edge FROM kpis WHERE mean_speed < 0.001 OR entries > 10)")
def i9_affected_vehicles(spark, d):
    progress = derive.vehicles(spark, d).where("arrive_t IS NULL").select("vehicle_id", F.col("vehicle_id").alias("route_id"), F.when(F.col("depart_t").isNotNull(), F.col("vehicle_id") % 3).alias("pos"))
    slow = trips.edge_kpis(visits(spark, d)).where("mean_speed < 0.001 OR entries > 10").select("edge", F.lit(False).alias("improved"))
    return trips.affected_vehicles(progress, derive.routes(spark, d), slow)


def offers(spark, d):
    s = derive.samples(spark, d)
    return s.select("vehicle_id", "t", (F.col("seq") % 17 == 0).alias("blocked"), (F.col("seq") % 3 == 0).alias("same_path"), F.col("offset_m").alias("new_s"), (F.col("edge") + 20.0).alias("remaining_s"))


@query("""WITH offers AS (SELECT vehicle_id, t, seq % 17 = 0 AS blocked, seq % 3 <> 0 AND offset_m + 30 + 1e-9 < edge + 20 AS gain, row_number() OVER (PARTITION BY vehicle_id ORDER BY t, seq % 17 = 0, seq % 3 = 0, offset_m, edge) AS n FROM samples),
fold(vehicle_id, n, last, t, accepted, reason) AS (SELECT DISTINCT vehicle_id, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false, '' FROM offers
UNION ALL SELECT o.vehicle_id, o.n, CASE WHEN blocked OR (gain AND (last IS NULL OR o.t - last >= 7200)) THEN o.t ELSE last END, o.t, blocked OR (gain AND (last IS NULL OR o.t - last >= 7200)),
  CASE WHEN blocked THEN 'blocked' WHEN gain AND (last IS NULL OR o.t - last >= 7200) THEN 'gain' WHEN gain THEN 'cooldown' ELSE 'no_gain' END FROM fold f JOIN offers o ON o.vehicle_id = f.vehicle_id AND o.n = f.n + 1)
SELECT vehicle_id, round(t, 6) AS t, accepted, reason FROM fold WHERE n > 0""")
def i10_reroute_benefit(spark, d):
    return rounded(trips.reroute_benefit(offers(spark, d), 30.0, 7200.0), "t")


@query("SELECT user_id AS vehicle_id, count(*) AS attempts, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ROLLUP (user_id)")
def i11_reroute_counts(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("vehicle_id"), (F.col("event_type") != "error").alias("success"))
    return trips.reroute_counts(e)


@query("SELECT seq, CASE WHEN t < 0 OR t >= mid THEN 'time_out_of_range' WHEN target_id >= 90 THEN 'unknown_target' WHEN action = 'speed_factor' AND NOT value BETWEEN 0.05 AND 3.0 THEN 'value_out_of_range' END AS reason FROM controls, midway")
def h1_validate(spark, d):
    c = derive.controls(spark, d)
    targets = c.where("target_id < 90").select("scope", "target_id").distinct()
    return ctl.validate(c, midway(spark, d), targets).select("seq", "reason")


@query("SELECT count(*) AS events, count(*) > 10000 AS over_budget FROM controls")
def h1_budget(spark, d):
    return ctl.over_budget(derive.controls(spark, d))


@query("SELECT seq, greatest(0, ceil((t - 1e-9) / 30) * 30.0) AS applied_t FROM controls")
def h2_effective_time(spark, d):
    return derive.controls(spark, d).select("seq", ctl.effective_time(F.col("t"), 30.0).alias("applied_t"))


@query("""SELECT target_id AS vehicle_id, coalesce(max_by(action = 'hold', {'t': t, 'q': seq}) FILTER (action IN ('hold', 'release')), false) AS held, CAST(1 AS DOUBLE) AS speed_factor
FROM controls, midway WHERE scope = 'vehicle' AND t <= mid GROUP BY target_id""")
def h3_vehicle_state(spark, d):
    return ctl.vehicle_state_at(derive.controls(spark, d), midway(spark, d))


EDGE_STATE = """WITH e AS (SELECT target_id AS edge, max_by(action = 'close', {'t': t, 'q': seq}) FILTER (action IN ('close', 'open')) AS closed, max_by(value, {'t': t, 'q': seq}) FILTER (action = 'speed_factor') AS sf,
  max_by(value, {'t': t, 'q': seq}) FILTER (action = 'capacity_factor') AS cf FROM controls, midway WHERE scope = 'edge' AND t <= mid GROUP BY target_id),
j AS (SELECT target_id AS from_node, max_by(action = 'close', {'t': t, 'q': seq}) FILTER (action IN ('close', 'open')) AS shut FROM controls, midway WHERE scope = 'junction' AND t <= mid GROUP BY target_id),
state AS (SELECT edge, coalesce(closed, false) AS closed, coalesce(sf, 1) AS speed_factor, coalesce(cf, 1) AS capacity_factor, NOT coalesce(closed, false) AND NOT coalesce(shut, false) AS routable
FROM edges LEFT JOIN e USING (edge) LEFT JOIN j USING (from_node))"""


def edge_state(spark, d):
    return ctl.edge_state_at(derive.controls(spark, d), derive.edges(spark, d), midway(spark, d))


@query(EDGE_STATE + " SELECT edge, closed, round(speed_factor, 6) AS speed_factor, round(capacity_factor, 6) AS capacity_factor, routable FROM state")
def h4_edge_state(spark, d):
    return rounded(edge_state(spark, d), "speed_factor", "capacity_factor", digits=6)


@query("""WITH k AS (SELECT *, CASE WHEN action IN ('hold', 'release') THEN 'held' WHEN action IN ('close', 'open') THEN 'closed' ELSE action END AS kind FROM controls),
l AS (SELECT scope, target_id, kind, t, max_by(action, seq) AS action, max_by(value, seq) AS value FROM k GROUP BY ALL)
SELECT scope, target_id, kind, round(t, 6) AS valid_from, round(lead(t) OVER (PARTITION BY scope, target_id, kind ORDER BY t), 6) AS valid_to, action, round(value, 6) AS value FROM l""".replace("GROUP BY ALL", "GROUP BY scope, target_id, kind, t"))
def h5_state_intervals(spark, d):
    return rounded(rounded(ctl.state_intervals(derive.controls(spark, d)), "valid_from", "valid_to"), "value", digits=6)


@query("SELECT scope, count(*) AS applied FROM controls, midway WHERE t <= mid GROUP BY ROLLUP (scope)")
def h6_applied_counts(spark, d):
    return ctl.applied_counts(derive.controls(spark, d), midway(spark, d))


CAPACITY = "greatest(1, floor(length_m / 7.5) * lane_count)"


def capacities(spark, d):
    """Edges with state, vehicles at the middle of the span, and capacities."""
    at = trips.occupancy_at(visits(spark, d), midway(spark, d))
    e = edge_state(spark, d).join(derive.edges(spark, d), "edge").join(at, "edge", "left").fillna({"vehicles": 0})
    e = e.withColumn("capacity", ctl.capacity(F.col("length_m"), F.col("lane_count")))
    return e.withColumn("effective", ctl.effective_capacity(F.col("capacity"), F.col("capacity_factor")))


STATE_CAPACITY = EDGE_STATE + f""", occ AS (SELECT edge, count(*) AS vehicles FROM visits, midway WHERE enter_t <= mid AND (exit_t IS NULL OR exit_t > mid) GROUP BY edge),
caps AS (SELECT *, CAST(greatest(1, floor(capacity * capacity_factor)) AS BIGINT) AS effective FROM (SELECT edge, closed, speed_factor, capacity_factor, coalesce(vehicles, 0) AS vehicles, CAST({CAPACITY} AS BIGINT) AS capacity
  FROM state JOIN edges USING (edge) LEFT JOIN occ USING (edge))),
factors AS (SELECT *, greatest(1, (1 / greatest(0.01, speed_factor)) * (1 / least(1, capacity_factor)) / greatest(0.1, least(1, 1 - greatest(0, vehicles - 1) / effective))) AS cost_factor, 1.4 + 0.6 * least(1, vehicles / effective) AS headway_s FROM caps)"""


def factors(spark, d):
    c = [F.col(x) for x in ("speed_factor", "capacity_factor", "vehicles", "effective")]
    out = capacities(spark, d).withColumn("cost_factor", ctl.routing_cost_factor(*c))
    return out.withColumn("headway_s", ctl.exit_headway(*c[2:]))


@query(STATE_CAPACITY + " SELECT edge, capacity, effective FROM caps")
def h7_capacity(spark, d):
    return capacities(spark, d).select("edge", "capacity", "effective")


@query(STATE_CAPACITY + " SELECT edge, round(cost_factor, 5) AS cost_factor FROM factors")
def h8_routing_cost_factor(spark, d):
    return rounded(factors(spark, d).select("edge", "cost_factor"), "cost_factor", digits=5)


@query(STATE_CAPACITY + " SELECT edge, round(headway_s, 6) AS headway_s FROM factors")
def h9_exit_headway(spark, d):
    return rounded(factors(spark, d).select("edge", "headway_s"), "headway_s", digits=6)


PUBLISHED = """WITH costs AS (SELECT target_id AS edge, t, seq, 1 / value AS factor, seq % 5 = 0 AS explicit, row_number() OVER (PARTITION BY target_id ORDER BY t, seq) AS n FROM controls WHERE action = 'speed_factor'),
fold(edge, n, last, old, yes, t, new) AS (SELECT DISTINCT edge, CAST(0 AS BIGINT), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), false, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM costs
UNION ALL SELECT c.edge, c.n, CASE WHEN p THEN factor ELSE last END, last, p, t, factor FROM (SELECT c.*, last, CASE WHEN explicit THEN abs(factor - last) > 1e-9 ELSE greatest(factor / last, last / factor) >= 1.25 END AS p FROM (SELECT edge, n, last FROM fold) f JOIN costs c ON c.edge = f.edge AND c.n = f.n + 1) c)
SELECT edge, round(t, 6) AS t, round(old, 6) AS old, round(new, 6) AS new, new < old AS improved FROM fold WHERE yes"""


@query(PUBLISHED)
def h10_published_cost_changes(spark, d):
    c = derive.controls(spark, d).where("action = 'speed_factor'")
    rows = ctl.published_cost_changes(c.select(F.col("target_id").alias("edge"), "t", "seq", (1 / F.col("value")).alias("factor"), (F.col("seq") % 5 == 0).alias("explicit")))
    return rounded(rounded(rows, "t"), "old", "new", digits=6)


def signals(spark, d):
    """A plan for each node that is divisible by 3: a phase for each edge that comes in."""
    e = derive.edges(spark, d)
    into = e.select(F.col("edge").alias("from_edge"), F.col("to_node").alias("node")).where("node % 3 = 0")
    out = e.select(F.col("edge").alias("to_edge"), F.col("from_node").alias("node"))
    rows = into.join(out, "node")
    return rows.select(
        "node", (F.col("from_edge") % 4).cast("int").alias("phase"), (20.0 + F.col("from_edge") % 4).alias("green_s"), F.lit(3.0).alias("yellow_s"), F.lit(2.0).alias("all_red_s"),
        (F.col("node") % 7).cast("double").alias("offset_s"), "from_edge", "to_edge", F.lit(1800.0).alias("saturation_flow_vph"),
    )


SIGNALS = """signals AS (SELECT a.to_node AS node, a.edge % 4 AS phase, 20.0 + a.edge % 4 AS green_s, 3.0 AS yellow_s, 2.0 AS all_red_s, a.to_node % 7 AS offset_s, a.edge AS from_edge, b.edge AS to_edge
FROM edges a JOIN edges b ON a.to_node = b.from_node WHERE a.to_node % 3 = 0),
phases AS (SELECT node, phase, sum(w) OVER (PARTITION BY node ORDER BY phase) - w AS begin_s, sum(w) OVER (PARTITION BY node) AS cycle_s, green_s, offset_s FROM (SELECT DISTINCT node, phase, green_s, offset_s, green_s + 5 AS w FROM signals))"""


@query(f"""WITH {SIGNALS}, asked AS (SELECT b.from_node AS node, a.edge AS from_edge, b.edge AS to_edge, (a.edge * 13 + b.edge) % 200 + 0.25 AS t FROM edges a JOIN edges b ON a.to_node = b.from_node)
SELECT q.node, q.from_edge, q.to_edge, CAST(q.t AS DOUBLE) AS t, CASE WHEN q.node % 3 <> 0 THEN 'open' WHEN bool_or((q.t + p.offset_s) % p.cycle_s >= p.begin_s AND (q.t + p.offset_s) % p.cycle_s < p.begin_s + p.green_s) THEN 'green' ELSE 'red' END AS state
FROM asked q LEFT JOIN (SELECT DISTINCT node, phase, from_edge, to_edge FROM signals) s USING (node, from_edge, to_edge) LEFT JOIN phases p ON p.node = s.node AND p.phase = s.phase GROUP BY q.node, q.from_edge, q.to_edge, q.t""")
def h11_signal_state(spark, d):
    e = derive.edges(spark, d)
    pairs = e.select(F.col("edge").alias("from_edge"), F.col("to_node").alias("node")).join(e.select(F.col("edge").alias("to_edge"), F.col("from_node").alias("node")), "node")
    asked = pairs.select("node", "from_edge", "to_edge", ((F.col("from_edge") * 13 + F.col("to_edge")) % 200 + 0.25).cast("double").alias("t"))
    return ctl.signal_state(signals(spark, d), asked)


@query("SELECT from_edge, to_edge, round(t, 6) AS t, 2.0 AS headway_s, coalesce(t - lag(t) OVER (PARTITION BY from_edge, to_edge ORDER BY t) < 2, false) AS saturated FROM (SELECT edge AS from_edge, edge % 3 AS to_edge, enter_t AS t FROM visits)")
def h12_saturation(spark, d):
    passes = visits(spark, d).select(F.col("edge").alias("from_edge"), (F.col("edge") % 3).alias("to_edge"), F.col("enter_t").alias("t"), F.lit(1800.0).alias("saturation_flow_vph"))
    return rounded(ctl.saturation(passes).drop("saturation_flow_vph"), "t")


@query(f"WITH {SIGNALS} SELECT DISTINCT node, CAST(phase AS INTEGER) AS phase, from_edge, to_edge, 'movement_prohibited' AS reason FROM signals JOIN (SELECT * FROM turns WHERE prohibited) USING (from_edge, to_edge)")
def h13_validate_signals(spark, d):
    return ctl.validate_signals(signals(spark, d), derive.edges(spark, d), derive.turns(spark, d))


@query(STATE_CAPACITY + " SELECT edge, closed, vehicles, round(speed_factor, 6) AS speed_factor FROM caps WHERE vehicles > 0 OR closed OR abs(speed_factor - 1) > 1e-9 OR abs(capacity_factor - 1) > 1e-9")
def h14_hot_edges(spark, d):
    at = trips.occupancy_at(visits(spark, d), midway(spark, d))
    return rounded(ctl.hot_edges(edge_state(spark, d), at).select("edge", "closed", "vehicles", "speed_factor"), "speed_factor", digits=6)


@query(STATE_CAPACITY + " SELECT edge, CASE WHEN closed THEN 'closed' ELSE 'congested' END AS event FROM factors WHERE closed OR cost_factor > 1 + 1e-9 ORDER BY edge LIMIT 64")
def h15_active_events(spark, d):
    return ctl.active_events(factors(spark, d))


@query("""SELECT o_orderpriority || ':' || c || ':' || s || ':' || r AS run_id, o_orderpriority AS name, c AS scenario_id, s AS strategy_id, r AS repetition
FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT c_mktsegment AS c FROM customer), (SELECT DISTINCT 's' || l_linenumber AS s FROM lineitem), (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS r)""")
def k1_matrix(spark, d):
    names = table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    scenarios = table(spark, d, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("scenarios"))
    strategies = table(spark, d, "lineitem").agg(F.collect_set(F.struct(F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("dijkstra").alias("algorithm"))).alias("strategies"))
    manifests = names.join(F.broadcast(scenarios), how="cross").join(F.broadcast(strategies), how="cross").withColumn("repetitions", F.lit(3))
    return exp.matrix(manifests).drop("algorithm")


@query("""WITH listed AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS number FROM edges),
grid AS (SELECT there, high, CAST(ceil(there / high) AS BIGINT) AS wide FROM (SELECT count(*) AS there, CAST(ceil(sqrt(count(*))) AS BIGINT) AS high FROM listed)),
draws AS (SELECT 'c' || n_regionkey AS scenario_id, n_nationkey AS repetition, 42 + n_nationkey - 1 AS key, k FROM nation, (VALUES (0), (1)) ks(k)),
walk AS (SELECT scenario_id, repetition, key, k, 0 AS turn, k // wide AS l, k % wide AS r FROM draws, grid
  UNION ALL SELECT scenario_id, repetition, key, k, turn + 1, CASE WHEN turn % 2 = 0 THEN (l + CAST('0x' || md5(key || ':' || turn % 8 || ':' || r)[1:12] AS BIGINT)) % high ELSE l END,
  CASE WHEN turn % 2 = 1 THEN (r + CAST('0x' || md5(key || ':' || turn % 8 || ':' || l)[1:12] AS BIGINT)) % wide ELSE r END FROM walk, grid WHERE turn = 0 OR turn % 8 > 0 OR l * wide + r >= there),
drawn AS (SELECT scenario_id, repetition, edge, 5 + CAST('0x' || md5(key || ':tick:' || k)[1:12] AS BIGINT) % 41 AS tick FROM walk, grid JOIN listed ON number = l * wide + r WHERE turn > 0 AND turn % 8 = 0)
SELECT scenario_id, repetition, edge, CAST(tick * 2 + d AS DOUBLE) AS t, 'speed_factor' AS action, CAST(v AS DOUBLE) AS value FROM drawn, (VALUES (0, 0.3), (6, 1.0)) e(d, v)""")
def k2_random_events(spark, d):
    spec = table(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("scenario_id"), F.col("n_nationkey").alias("repetition"), F.lit(42).alias("seed"), F.lit(2).alias("count"), F.lit(10.0).alias("start_s"), F.lit(90.0).alias("end_s"), F.lit(5.0).alias("duration_s"), F.lit(2.0).alias("step_s"), F.lit(0.3).alias("factor"))
    return exp.random_events(spec, derive.edges(spark, d))


@query("SELECT event_id AS run_id, event_type <> 'error' AS success, CASE WHEN event_id % 4 > 0 THEN value / (event_id % 4) END AS latency_per_decision_ms, round((value * 3 + value * 0.5 * 15) / 1e6, 10) AS model_cost, CASE WHEN event_id % 5 > 0 THEN round(value / (event_id % 5), 6) ELSE 0 END AS real_time_factor FROM events")
def k3_run_metrics(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    traces = e.select(
        k.alias("run_id"), F.lit(True).alias("arrived"), F.lit(True).alias("finished"), F.when(F.col("event_type") == "error", "x").alias("error"), F.col("value").alias("latency_ms"), (k % 4).alias("decisions"),
        F.col("value").alias("tokens_in"), (F.col("value") * 0.5).alias("tokens_out"), F.lit(3.0).alias("price_in"), F.lit(15.0).alias("price_out"), F.col("value").alias("simulated_s"), (k % 5).cast("double").alias("wall_s"),
    )
    m = exp.run_metrics(traces).select("run_id", "success", "latency_per_decision_ms", "model_cost", "real_time_factor")
    return rounded(rounded(m, "model_cost", digits=10), "real_time_factor", digits=6)


@query("SELECT edge % 7 AS run_id, round(sum(CASE WHEN mean_speed < 0.004 THEN vehicle_seconds ELSE 0 END), 2) AS congestion_exposure_s FROM kpis GROUP BY edge % 7")
def k4_congestion_exposure(spark, d):
    k = trips.edge_kpis(visits(spark, d)).withColumn("run_id", F.col("edge") % 7)
    return rounded(exp.congestion_exposure(k, 0.004), "congestion_exposure_s", digits=2)


@query("""WITH r AS (SELECT user_id AS run_id, event_type <> 'error' AS ok, event_id % 3 = 0 AS changed, CASE WHEN event_id % 97 > 0 THEN (event_id % 10) / 10.0 END AS overlap FROM events WHERE event_id % 2 = 0)
SELECT run_id, count(*) FILTER (ok) AS applied, count(*) FILTER (NOT ok) AS failed, CASE WHEN v THEN count(*) FILTER (ok AND changed) END AS changed, CASE WHEN v THEN count(*) FILTER (ok AND NOT changed) END AS unchanged,
CASE WHEN v AND count(*) FILTER (ok) > 0 THEN round(avg(overlap) FILTER (ok), 6) END AS overlap, count(*) FILTER (ok AND changed) AS reversals FROM (SELECT *, coalesce(bool_and(overlap IS NOT NULL) FILTER (ok) OVER (PARTITION BY run_id), true) AS v FROM r) GROUP BY run_id, v""")
def k5_native_route_metrics(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    rows = e.select(
        F.col("user_id").alias("run_id"), (k % 2).alias("vehicle_id"), F.lit(0).alias("own_vehicle"), (F.col("event_type") != "error").alias("success"), (k % 3 == 0).alias("changed"),
        F.when(k % 97 > 0, (k % 10) / 10.0).alias("overlap"), (k % 3 == 0).alias("reversal"), F.lit(1).alias("reversal_version"),
    )
    return rounded(exp.native_route_metrics(rows), "overlap", digits=6)


@query("SELECT o_orderkey AS run_id, coalesce(n > 3, false) AS success, coalesce(n, 0) AS attempts, CASE WHEN n > 0 THEN round(p, 6) END AS overlap, n IS NULL AS failed FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n, avg(l_tax) AS p FROM lineitem GROUP BY l_orderkey) USING (o_orderkey)")
def k6_failed_runs(spark, d):
    planned = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"))
    done = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("attempts"), F.round(F.avg("l_tax"), 6).alias("overlap")).withColumn("success", F.col("attempts") > 3)
    return exp.failed_runs(planned, done, ["attempts"], ["overlap"])


def _aggregate_sql() -> str:
    out = ["count(*) AS runs", "count(*) FILTER (success) AS successes", "round(avg(CAST(success AS INTEGER)), 6) AS success_rate"]
    for m in ("travel_time_s", "rejections", "route_overlap_ratio"):
        f = " FILTER (success)" if m == "travel_time_s" else ""
        out += [f"round({fn}{f}, 6) AS {m}_{n}" for n, fn in (("mean", f"avg({m})"), ("p50", f"quantile_cont({m}, 0.5)"), ("p95", f"quantile_cont({m}, 0.95)"), ("min", f"min({m})"), ("max", f"max({m})"))]
    return f"SELECT scenario_id, strategy_id, {', '.join(out)} FROM runs GROUP BY scenario_id, strategy_id"


@query(_aggregate_sql())
def k7_aggregate(spark, d):
    metrics = ["travel_time_s", "rejections", "route_overlap_ratio"]
    out = exp.aggregate(derive.runs(spark, d), metrics)
    return rounded(rounded(out, *(c for c in out.columns if c.startswith(tuple(metrics)))), "success_rate", digits=6)


@query("""SELECT user_id AS run_id, count(*) AS attempts, count(*) FILTER (s BETWEEN 400 AND 499) AS rejections, count(*) FILTER (s >= 500) AS failures, count(*) FILTER (event_type = 'error') AS fallbacks,
count(*) FILTER (event_id % 2 > 0) AS change_requests, count(*) FILTER (event_id % 2 = 0) AS unchanged_requests FROM (SELECT *, 200 + event_id % 4 * 100 AS s FROM events) GROUP BY user_id""")
def k8_request_counters(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    rows = e.select(F.col("user_id").alias("run_id"), (200 + k % 4 * 100).alias("status"), (F.col("event_type") == "error").alias("fallback"), F.array(k % 2, k).alias("candidate_edges"), F.array(F.lit(0).cast("long"), k).alias("remaining_edges"))
    return exp.request_counters(rows)


@query("SELECT l_orderkey AS job_id, l_linenumber AS cell, 3 AS repetitions, least(greatest(l_orderkey % 20 - coalesce(3 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1), 0), 0), 3) AS done, round(least(greatest(l_orderkey % 20 - 3 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1), 0), 3) * 100.0 / 3, 6) AS percent FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def k9_progress_matrix(spark, d):
    jobs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("cell")).distinct()
    out = exp.progress_matrix(jobs.withColumns({"repetitions": F.lit(3), "completed": F.col("job_id") % 20}))
    return rounded(out.select("job_id", "cell", "repetitions", "done", "percent"), "percent")


@query("SELECT user_id AS thread_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS checkpoint_step, event_type AS task_id, max(event_id) AS written FROM events GROUP BY 1, 2, 3")
def k10_trace_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("checkpoint_step"), F.col("event_type").alias("task_id"), F.col("event_id").alias("written"))
    return exp.trace_events(e)


@query("SELECT user_id AS run_id, event_type AS status, count(*) AS decisions, count(*) FILTER (event_id % 6 = 0) AS fallbacks, round(quantile_cont(event_id % 500, 0.5), 6) AS latency_p50_ms, round(quantile_cont(event_id % 500, 0.95), 6) AS latency_p95_ms FROM events GROUP BY 1, 2")
def k15_decision_outcomes(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    rows = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), k.alias("opened_ms"), (k + k % 500).alias("resolved_ms"), (k % 6 == 0).alias("fallback"))
    return rounded(exp.decision_outcomes(rows), "latency_p50_ms", "latency_p95_ms")


@query("SELECT p_partkey AS run_id, CASE WHEN p_size > 5 THEN sha256(p_name) END AS strategy_revision, sha256(p_type) AS scenario_revision FROM part")
def k16_revisions(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("run_id"), *exp.revisions(F.when(F.col("p_size") > 5, F.col("p_name")), F.col("p_type")))
