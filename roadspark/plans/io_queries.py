"""Queries over readers, sinks and streams, and their SQL.  Files are derived from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roadspark.functions.tables import shared_dir, table
from roadspark.operators import experiments as exp
from roadspark.operators import quality, routing, trips
from roadspark.plans import derive
from roadspark.plans.derive import with_sql
from roadspark.plans.road_queries import REVERSALS, changes
from roadspark.plans.trip_queries import PUBLISHED
from roadspark.plans.trip_queries import rounded, visits
from roadspark.sources import readers, sinks
from roadspark.streaming import feeds

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = with_sql(sql)
        return fn

    return add


def place(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def features(spark, d):
    """Lines of the grid as GeoJSON text, one Feature a row."""
    e = derive.lined_edges(spark, d).withColumn("highway", F.col("road_class"))
    return e.select(sinks.feature("LineString", sinks.line("points"), ["edge", "highway", F.lit("50").alias("MaxSpeed")]))


@query("SELECT edge, CAST(2 AS BIGINT) AS n, ax AS x, road_class AS highway FROM lined")
def a1_read_roads_geojson(spark, d):
    sinks.write_geojson(features(spark, d), path := place(spark, "roads"))
    rows = readers.read_roads_geojson(spark, path, lines=True)
    part = F.col("parts")[0]
    return rows.select(F.element_at("properties", "edge").cast("long").alias("edge"), F.size(part).cast("long").alias("n"), part[0]["x"].alias("x"), F.element_at("properties", "highway").alias("highway"))


@query("SELECT edge, CAST(row_number() OVER (PARTITION BY road_id ORDER BY edge) - 1 AS BIGINT) AS feature_ordinal, CAST(2 AS BIGINT) AS n, bx AS x, road_class AS highway FROM lined")
def a1_read_feature_collection(spark, d):
    """One FeatureCollection for each road, in a file of its own line."""
    text = features(spark, d).select("value", F.get_json_object("value", "$.properties.edge").cast("long").alias("edge"))
    road = derive.edges(spark, d).select("edge", "road_id")
    whole = text.join(road, "edge").groupBy("road_id").agg(F.array_sort(F.collect_list(F.struct("edge", "value"))).alias("f"))
    whole = whole.select("road_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda x: x["value"]), ",\n"), F.lit("]}")).alias("value"))
    whole.repartition("road_id").select("value").write.option("maxRecordsPerFile", 1).text(path := place(spark, "collections"))
    rows = readers.read_roads_geojson(spark, path)
    part = F.col("parts")[0]
    return rows.select(F.element_at("properties", "edge").cast("long").alias("edge"), "feature_ordinal", F.size(part).cast("long").alias("n"), F.element_at(part, -1)["x"].alias("x"), F.element_at("properties", "highway").alias("highway"))


@query("SELECT CAST(edge AS VARCHAR) AS source_id, road_class, 50.0::DOUBLE AS speed_kph FROM lined")
def a2_apply_mapping(spark, d):
    sinks.write_geojson(features(spark, d), path := place(spark, "roads"))
    rows = readers.apply_mapping(readers.read_roads_geojson(spark, path, lines=True), {"id_field": "edge", "road_class_field": "highway", "speed_field": "MaxSpeed", "oneway_field": ""})
    return rows.select("source_id", "road_class", "speed_kph")


@query("SELECT l_orderkey || '-' || l_linenumber AS from_source_id, CASE l_linenumber % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'only_via' WHEN 2 THEN 'penalty' ELSE 'maybe' END AS kind, CASE WHEN l_linenumber % 4 = 3 THEN 'unknown_kind' WHEN l_linenumber % 4 = 1 AND l_orderkey % 5 = 0 THEN 'invalid_via' END AS error FROM lineitem")
def a3_read_turn_rules(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("no", "only_via", "penalty", "maybe"))), (n % 4 + 1).cast("int"))
    extra = F.when(n % 4 == 2, "2.5").when((n % 4 == 1) & (k % 5 > 0), "7;8").otherwise("")
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", k, n).alias("a"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit("b").alias("b"), kind.alias("kind"), extra.alias("extra"))
    rows.write.csv(path := place(spark, "turns"))
    return readers.read_turn_rules(spark, path).select("from_source_id", "kind", "error")


@query("SELECT c_custkey % 180 AS lon, c_acctbal AS depart_s, CASE WHEN c_custkey % 2 = 0 THEN 'astar' ELSE 'dijkstra' END AS algorithm, c_custkey % 3 = 0 AS agent FROM customer")
def a4_read_od(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select((k % 180).cast("double").alias("a"), F.lit(1.5), F.lit(2.5), F.lit(3.5), "c_acctbal", F.when(k % 2 == 0, "astar").otherwise(""), F.when(k % 3 == 0, "Agent").otherwise("no"))
    rows.toDF(*"abcdefg").write.csv(path := place(spark, "od"))
    return readers.read_od(spark, path).select("lon", "depart_s", "algorithm", "agent")


@query("SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, round(t, 6) AS t, CASE scope WHEN 'junction' THEN 'junction' ELSE scope END AS scope, target_id, action, CASE WHEN action IN ('hold', 'release') THEN 1.0 ELSE round(value, 6) END AS value FROM controls")
def a5_read_controls(spark, d):
    c = derive.controls(spark, d)
    value = F.when(~F.col("action").isin("hold", "release"), F.col("value").cast("string")).otherwise("")
    c.orderBy("seq").select("t", F.when(F.col("scope") == "edge", "road").otherwise(F.col("scope")).alias("scope"), "target_id", "action", value.alias("value")).write.csv(path := place(spark, "controls"))
    return rounded(rounded(readers.read_controls(spark, path), "t"), "value", digits=6)


@query("SELECT l_partkey AS node, CAST(l_linenumber AS INTEGER) AS phase, l_quantity AS green_s, CASE WHEN l_linenumber % 2 = 0 THEN 1800.0 ELSE 900.0 END AS saturation_flow_vph, max(l_quantity) OVER (PARTITION BY l_partkey, l_linenumber) = min(l_quantity) OVER (PARTITION BY l_partkey, l_linenumber) AS consistent FROM lineitem")
def a6_read_signals(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", F.lit(3.0), F.lit(2.0), F.lit(0.0), F.lit(1), F.lit(2), F.when(n % 2 == 0, "").otherwise("900"))
    rows.toDF(*"abcdefghi").write.csv(path := place(spark, "signals"))
    return readers.read_signals(spark, path).select("node", "phase", "green_s", "saturation_flow_vph", "consistent")


@query("""WITH ways AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey - 1 IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0))
SELECT 'way' AS kind, id FROM ways UNION ALL SELECT 'relation', o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'node', o_orderkey FROM orders WHERE o_orderkey IN (SELECT id FROM ways) OR o_orderkey - 1 IN (SELECT id FROM ways)""")
def a7_read_osm_elements(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    member = lambda i: F.struct(i.alias("id"), F.lit("way").alias("type"), F.lit("from").alias("role"))
    relations = o.select(k.alias("id"), F.create_map(F.lit("type"), F.when(k % 3 == 0, "restriction").otherwise("route")).alias("tags"), F.array(member(k), member(k + 1)).alias("members"))
    ways = o.select(k.alias("id"), F.array(k, k + 1).alias("nodes"))
    kept = zip(("node", "way", "relation"), readers.read_osm_elements(o.select(k.alias("id")), ways, relations), strict=True)
    nodes, ways, relations = (rows.select(F.lit(kind).alias("kind"), "id") for kind, rows in kept)
    return nodes.unionByName(ways).unionByName(relations)


@query("SELECT DISTINCT o_orderpriority AS name, 3 AS repetitions, 5 AS n_scenarios FROM orders")
def a8_read_manifest(spark, d):
    names = table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    scenarios = table(spark, d, "customer").agg(F.collect_set(F.struct(F.col("c_mktsegment").alias("id"))).alias("scenarios"))
    rows = names.crossJoin(F.broadcast(scenarios)).withColumns({"repetitions": F.lit(3), "strategies": F.array(F.struct(F.lit("s").alias("id"), F.lit("alt").alias("algorithm")))})
    rows.repartition("name").write.option("maxRecordsPerFile", 1).json(path := place(spark, "manifests"))
    return readers.read_manifest(spark, path).select("name", "repetitions", F.size("scenarios").alias("n_scenarios"))


def sections(spark, d):
    """Runs of ten vehicles and their sections; edges and controls go to the runs by tens of their keys."""
    run = lambda c: F.floor(F.col(c) / 10).cast("string").alias("run_id")
    s = derive.samples(spark, d)
    points = s.groupBy("vehicle_id").agg(F.array_sort(F.collect_list(F.array("t", F.col("edge").cast("double"), "offset_m"))).alias("samples"))
    vehicles = derive.vehicles(spark, d).join(points, "vehicle_id").select(run("vehicle_id"), "vehicle_id", F.col("depart_t").alias("depart_s"), F.col("arrive_t").alias("arrive_s"), "distance_m", "samples")
    kpis = trips.edge_kpis(visits(spark, d)).select(run("edge"), "*")
    events = derive.controls(spark, d).select(run("seq"), F.col("t").alias("time_s"), "scope", "target_id", "action", "value")
    return vehicles.select("run_id").distinct(), {"vehicles": vehicles, "edge_kpis": kpis, "controls": events}


def documents(spark, d):
    """One playback document for each run."""
    return sinks.playback(*sections(spark, d))


@query("SELECT CAST(vehicle_id // 10 AS VARCHAR) AS run_id, vehicle_id, count(*) AS n, round(sum(t), 2) AS t FROM samples GROUP BY vehicle_id")
def a9_read_playback(spark, d):
    documents(spark, d).select("value").write.text(path := place(spark, "playback"))
    rows = readers.read_playback(spark, path)["samples"]
    return rounded(rows.groupBy("run_id", "vehicle_id").agg(F.count("*").alias("n"), F.sum("t").alias("t")), "t", digits=2)


@query("SELECT count(*) AS features, 'road-network' AS layer, true AS osm FROM edges")
def a10_inspect(spark, d):
    sinks.write_geojson(features(spark, d), path := place(spark, "roads"))
    return readers.inspect(readers.read_roads_geojson(spark, path, lines=True)).select("features", "layer", "osm")


@query("SELECT edge, from_node, to_node FROM edges")
def a11_tables(spark, d):
    readers.write_tables({"edges": derive.edges(spark, d), "nodes": derive.nodes(spark, d)}, path := place(spark, "map"))
    return readers.read_tables(spark, path)["edges"].select("edge", "from_node", "to_node")


@query("SELECT c_custkey, CAST(i AS INTEGER) AS vehicle, i * 20.0 AS depart_s FROM customer, (VALUES (0), (1), (2), (3)) v(i)")
def a12_expand_od(spark, d):
    return readers.expand_od(table(spark, d, "customer").select("c_custkey"), 4, 60.0)


@query("SELECT scenario_id, strategy_id, count(*) AS runs FROM runs GROUP BY 1, 2")
def k11_report(spark, d):
    out = exp.aggregate(derive.runs(spark, d), ["travel_time_s"])
    sinks.write_report(out, path := place(spark, "report"))
    rows = spark.read.csv(f"{path}/csv", header=True)
    return rows.select("scenario_id", "strategy_id", F.col("runs").cast("long").alias("runs"))


@query("SELECT road_id, 'both' AS direction, CAST(count(*) AS BIGINT) AS edges FROM edges GROUP BY road_id")
def k12_geojson_roads(spark, d):
    e = derive.lined_edges(spark, d).withColumn("geometry_reversed", F.col("edge") % 2 == 1)
    sinks.write_geojson(sinks.roads_geojson(e), path := place(spark, "roads"))
    doc = F.from_json("value", "properties STRUCT<road_id: BIGINT, edges: ARRAY<BIGINT>, direction: STRING>")
    return spark.read.text(path).select(doc.alias("f")).select("f.properties.road_id", "f.properties.direction", F.size("f.properties.edges").cast("long").alias("edges"))


def text_of(features):
    """GeoJSON features written and read back as text."""
    sinks.write_geojson(features, path := place(features.sparkSession, "geojson"))
    return features.sparkSession.read.text(path)


@query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']},"properties":{"node":' || node || ',"in_degree":' || count(*) FILTER (e.to_node = node) || ',"out_degree":' || count(*) FILTER (e.from_node = node) || '}}' AS value
FROM nodes LEFT JOIN edges e ON e.from_node = node OR e.to_node = node GROUP BY node, x, y""")
def k12_geojson_nodes(spark, d):
    return text_of(sinks.nodes_geojson(quality.node_degree(derive.nodes(spark, d), derive.edges(spark, d))))


@query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']},"properties":{"code":"ORPHAN_NODE","severity":"warning","subject":"' || node || '"}}' AS value FROM nodes WHERE node NOT IN (SELECT from_node FROM edges WHERE from_node % 5 <> 0) AND node NOT IN (SELECT to_node FROM edges WHERE from_node % 5 <> 0)
UNION ALL SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']},"properties":{"code":"NO_OUTGOING_EDGE","severity":"warning","subject":"' || node || '"}}' FROM nodes WHERE node NOT IN (SELECT from_node FROM edges WHERE from_node % 5 <> 0) AND node IN (SELECT to_node FROM edges WHERE from_node % 5 <> 0)""")
def k12_geojson_issues(spark, d):
    """Issues of nodes, and issues of edges, which have no place and stay out."""
    nodes, edges = derive.nodes(spark, d), derive.edges(spark, d).where("from_node % 5 <> 0")
    found = quality.check_nodes(quality.node_degree(nodes, edges)).where("code IN ('ORPHAN_NODE', 'NO_OUTGOING_EDGE')")
    nowhere = found.withColumn("location", F.lit(None).cast(found.schema["location"].dataType))
    return text_of(sinks.issues_geojson(found.unionByName(nowhere)))


@query("""SELECT '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || ax || ',' || ay || '],[' || bx || ',' || yb || ']]},"properties":{"route_id":' || route_id || ',"pos":' || pos || ',"edge":' || r.edge || '}}' AS value FROM routes r JOIN lined l ON l.edge = r.edge""")
def k12_geojson_routes(spark, d):
    return text_of(sinks.routes_geojson(derive.routes(spark, d).join(derive.lined_edges(spark, d).select("edge", "points"), "edge")))


@query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || n_nationkey || '.5,1.0]},"properties":{"name":"' || n_name || '"}}' AS value FROM nation WHERE n_nationkey % 4 <> 0""")
def k12_geojson_reference(spark, d):
    n = table(spark, d, "nation")
    at = F.when(F.col("n_nationkey") % 8 == 0, "[]").when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(".5,1.0]")))
    return text_of(sinks.reference_geojson(n.select(F.lit("Point").alias("geom_type"), at.alias("coordinates"), F.struct(F.col("n_name").alias("name")).alias("properties"))))


@query("""WITH steps AS (SELECT vehicle_id, t, sqrt((edge - lag(edge) OVER w) ** 2 + (offset_m - lag(offset_m) OVER w) ** 2) AS step FROM samples WINDOW w AS (PARTITION BY vehicle_id ORDER BY t, edge, offset_m))
SELECT vehicle_id, count(*) AS n_points, round(max(t) - min(t), 6) AS travel_s, round(sum(step), 3) AS distance_m FROM steps GROUP BY vehicle_id HAVING count(*) >= 2""")
def k12_geojson_trajectories(spark, d):
    s = derive.samples(spark, d).select("vehicle_id", "t", F.col("edge").cast("double").alias("x"), F.col("offset_m").alias("y"))
    doc = F.from_json("value", "geometry STRUCT<coordinates: ARRAY<ARRAY<DOUBLE>>>, properties STRUCT<vehicle_id: BIGINT, travel_s: DOUBLE, distance_m: DOUBLE>")
    rows = text_of(sinks.trajectories_geojson(trips.trajectories(s))).select(doc.alias("f"))
    rows = rows.select("f.properties.vehicle_id", F.size("f.geometry.coordinates").cast("long").alias("n_points"), "f.properties.travel_s", "f.properties.distance_m")
    return rounded(rounded(rows, "travel_s"), "distance_m", digits=3)


@query("""WITH v AS (SELECT CAST(user_id // 10 AS VARCHAR) AS run_id, count(DISTINCT user_id) AS vehicles, count(*) AS samples, round(sum(value), 3) AS distance_m FROM events GROUP BY 1),
k AS (SELECT CAST(edge // 10 AS VARCHAR) AS run_id, count(*) AS n, sum(entries) AS entries FROM kpis GROUP BY 1), c AS (SELECT CAST(seq // 10 AS VARCHAR) AS run_id, count(*) AS n FROM controls GROUP BY 1)
SELECT v.*, coalesce(k.n, 0) AS edge_kpis, CAST(coalesce(k.entries, 0) AS BIGINT) AS entries, coalesce(c.n, 0) AS controls FROM v LEFT JOIN k USING (run_id) LEFT JOIN c USING (run_id)""")
def k13_playback(spark, d):
    doc = F.from_json("value", "vehicles ARRAY<STRUCT<distance_m: DOUBLE, samples: ARRAY<ARRAY<DOUBLE>>>>, edge_kpis ARRAY<STRUCT<entries: BIGINT>>, controls ARRAY<STRUCT<action: STRING>>")
    rows = documents(spark, d).select("run_id", doc.alias("f")).select("run_id", "f.*")
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    total = lambda c, zero, of: F.coalesce(F.aggregate(c, F.lit(zero), lambda a, x: a + of(x)), F.lit(zero))
    rows = rows.select(
        "run_id", size("vehicles").alias("vehicles"), total("vehicles", 0, lambda v: F.size(v["samples"])).cast("long").alias("samples"), total("vehicles", 0.0, lambda v: v["distance_m"]).alias("distance_m"),
        F.when(F.col("edge_kpis").isNull(), 0).otherwise(F.size("edge_kpis")).cast("long").alias("edge_kpis"), total("edge_kpis", 0, lambda v: v["entries"].cast("int")).cast("long").alias("entries"), F.when(F.col("controls").isNull(), 0).otherwise(F.size("controls")).cast("long").alias("controls"),
    )
    return rounded(rows, "distance_m", digits=3)


@query("""WITH v AS (SELECT CAST(user_id // 10 AS VARCHAR) AS run_id, count(DISTINCT user_id) AS vehicles FROM events GROUP BY 1), k AS (SELECT CAST(edge // 10 AS VARCHAR) AS run_id, count(*) AS n, sum(entries) AS entries FROM kpis GROUP BY 1),
c AS (SELECT CAST(seq // 10 AS VARCHAR) AS run_id, count(*) AS n FROM controls GROUP BY 1)
SELECT row_number() OVER (ORDER BY run_id) - 1 AS run, 5 + vehicles + coalesce(k.n + 2, 0) + coalesce(c.n + 2, 0) - 1 AS lines, vehicles - 1 + coalesce(k.n - 1, 0) + coalesce(c.n - 1, 0) AS commas, CAST(coalesce(k.entries, 0) AS BIGINT) AS entries FROM v LEFT JOIN k USING (run_id) LEFT JOIN c USING (run_id)""")
def k13_playback_lines(spark, d):
    """The documents in lines: how many a run has, how many follow another of their section, and the entries of its edges."""
    entries = F.when(F.col("section") == 1, F.coalesce(F.get_json_object(F.ltrim(F.col("value"), F.lit(",")), "$.entries").cast("long"), F.lit(0))).otherwise(0)
    rows = sinks.playback_lines(*sections(spark, d)).groupBy("run")
    return rows.agg(F.count("*").alias("lines"), F.count_if((F.col("kind") == 1) & F.col("value").startswith(",")).alias("commas"), F.sum(entries).alias("entries"))


@query("SELECT edge, round(length_m / speed_limit_mps * (1 + lane_count), 6) AS cost FROM edges")
def k14_user_cost(spark, d):
    cost = F.col("length_m") / F.col("speed_limit_mps") * (1 + F.col("lane_count"))
    return rounded(routing.with_user_cost(derive.edges(spark, d), cost).select("edge", "cost"), "cost", digits=6)


# J: streams, each over files derived from the tables, run to their end


def stream(spark, df, what: str, *keys: str):
    """A stream over files of ``df``; the rows of one of the ``keys`` are in one file, in order of time."""
    feeds.configure(spark)
    rows = feeds.with_ts(df)
    if keys:
        rows = rows.repartition(*keys).sortWithinPartitions(*keys, "t")
    rows.write.parquet(path := place(spark, what))
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@query("SELECT count(*) AS n, count(DISTINCT vehicle_id) AS vehicles, round(sum(t), 2) AS t FROM samples")
def j1_samples_source(spark, d):
    rows = feeds.run_available(stream(spark, derive.samples(spark, d), "samples"), place(spark, "j1"))
    return rounded(rows.agg(F.count("*").alias("n"), F.countDistinct("vehicle_id").alias("vehicles"), F.sum("t").alias("t")), "t", digits=2)


# windows that end before the watermark, ten minutes behind the last row, are out
@query("""SELECT CAST(floor(enter_t / 3600) * 3600 AS BIGINT) AS start_s, edge, count(*) AS entries, round(coalesce(sum(distance_m), 0), 3) AS distance_m FROM visits
GROUP BY 1, 2 HAVING start_s + 3600 <= (SELECT max(enter_t) FROM visits) - 600""")
def j2_edge_kpis(spark, d):
    v = visits(spark, d).withColumnRenamed("enter_t", "t")
    s = stream(spark, v, "visits").withColumn("enter_t", F.col("t"))
    rows = feeds.run_available(feeds.edge_kpis(s, "1 hour"), place(spark, "j2"))
    return rounded(rows.select(since("window.start"), "edge", "entries", "distance_m"), "distance_m", digits=3)


def since(c: str):
    """Seconds behind the start that ``feeds.with_ts`` takes."""
    return (F.col(c).cast("long") - F.lit("2020-01-01 00:00:00").cast("timestamp").cast("long")).alias("start_s")


def last_state(df, key: str):
    """The last row of each key of an update stream's output."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct("t", "seq")).alias("r")).select("r.*")


@query("SELECT vehicle_id, round(s.t, 6) AS t, s.edge AS edge FROM (SELECT vehicle_id, max_by({'t': t, 'edge': edge}, {'t': t, 'q': seq}) AS s FROM samples GROUP BY vehicle_id)")
def j3_vehicle_latest(spark, d):
    path = place(spark, "j3")
    latest = feeds.vehicle_latest(stream(spark, derive.samples(spark, d), "samples"))
    # each batch writes the vehicles that changed into a folder of its own, so a batch that runs again replaces its rows
    run = latest.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    run.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")).start().awaitTermination()
    return rounded(last_state(spark.read.parquet(f"{path}/rows").drop("batch"), "vehicle_id").select("vehicle_id", "t", "edge"), "t")


@query("""SELECT scope, target_id, kind, round(t, 6) AS t, action, round(value, 6) AS value FROM (SELECT *, lag({'a': action, 'v': value}) OVER (PARTITION BY scope, target_id, kind ORDER BY t, seq) AS old
FROM (SELECT *, CASE WHEN action IN ('hold', 'release') THEN 'held' WHEN action IN ('close', 'open') THEN 'closed' ELSE action END AS kind FROM controls)) WHERE old IS NULL OR old <> {'a': action, 'v': value}""")
def j4_control_state(spark, d):
    s = stream(spark, derive.controls(spark, d), "controls", "scope", "target_id")
    return rounded(rounded(feeds.run_available(feeds.control_state(s), place(spark, "j4")), "t"), "value", digits=6)


@query(PUBLISHED)
def j5_cost_changes(spark, d):
    c = derive.controls(spark, d).where("action = 'speed_factor'").select(F.col("target_id").alias("edge"), "t", "seq", (1 / F.col("value")).alias("factor"), (F.col("seq") % 5 == 0).alias("explicit"))
    rows = feeds.run_available(feeds.cost_changes(stream(spark, c, "costs", "edge")), place(spark, "j5"))
    return rounded(rounded(rows, "t"), "old", "new", digits=6)


@query(REVERSALS)
def j6_reversals(spark, d):
    return feeds.run_available(feeds.reversals(stream(spark, changes(spark, d), "changes", "vehicle_id")), place(spark, "j6"))


@query("""WITH marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY vehicle_id ORDER BY t) <= 7200 THEN 0 ELSE 1 END AS fresh FROM samples),
runs_of AS (SELECT *, sum(fresh) OVER (PARTITION BY vehicle_id ORDER BY t, fresh DESC ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT vehicle_id, CAST(floor(min(t)) AS BIGINT) AS start_s, count(*) AS samples FROM runs_of GROUP BY vehicle_id, run HAVING max(t) + 7200 <= (SELECT max(t) FROM samples) - 600""")
def j7_trip_sessions(spark, d):
    s = feeds.trip_sessions(stream(spark, derive.samples(spark, d), "samples"), "2 hours")
    return feeds.run_available(s, place(spark, "j7")).select(since("session.start"), "vehicle_id", "samples")


@query("SELECT c.seq, v.vehicle_id, r.edge, CASE WHEN action = 'open' THEN 'route_improved' ELSE 'route_invalidated' END AS reason FROM controls c JOIN routes r ON r.edge = c.target_id JOIN vehicles v ON v.vehicle_id = r.route_id WHERE c.scope = 'edge' AND c.action IN ('close', 'open') AND v.arrive_t IS NULL")
def j8_invalidations(spark, d):
    c = derive.controls(spark, d).where("scope = 'edge' AND action IN ('close', 'open')").select("seq", "t", F.col("target_id").alias("edge"), (F.col("action") == "open").alias("improved"))
    remaining = derive.vehicles(spark, d).where("arrive_t IS NULL").select("vehicle_id").join(derive.routes(spark, d), F.col("vehicle_id") == F.col("route_id")).select("vehicle_id", "edge")
    return feeds.run_invalidations(stream(spark, c, "closures"), remaining, place(spark, "j8")).select("seq", "vehicle_id", "edge", "reason")


@query("SELECT c.seq, v.vehicle_id, r.edge, CASE WHEN action = 'open' THEN 'route_improved' ELSE 'route_invalidated' END AS reason FROM controls c JOIN routes r ON r.edge = c.target_id JOIN vehicles v ON v.vehicle_id = r.route_id WHERE c.scope = 'edge' AND c.action IN ('close', 'open') AND v.depart_t IS NOT NULL AND c.t BETWEEN v.depart_t AND v.depart_t + 86400")
def j8_invalidations_within(spark, d):
    """Closures of a day against routes published when their vehicles depart, both as streams."""
    c = derive.controls(spark, d).where("scope = 'edge' AND action IN ('close', 'open')").select("seq", "t", F.col("target_id").alias("edge"), (F.col("action") == "open").alias("improved"))
    departed = derive.vehicles(spark, d).where("depart_t IS NOT NULL").select("vehicle_id", F.col("depart_t").alias("t"))
    routes = departed.join(derive.routes(spark, d), F.col("vehicle_id") == F.col("route_id")).select("vehicle_id", "edge", "t")
    out = feeds.invalidations_within(stream(spark, c, "closures", "edge"), stream(spark, routes, "routes", "edge"), "1 day", "3650 days")
    return feeds.run_available(out, place(spark, "j8s")).select("seq", "vehicle_id", "edge", "reason")


@query("SELECT DISTINCT vehicle_id, round(t, 6) AS t FROM samples")
def j9_sample_dedupe(spark, d):
    twice = derive.samples(spark, d).select("vehicle_id", "t")
    s = stream(spark, twice.unionByName(twice), "samples", "vehicle_id")
    return rounded(feeds.run_available(feeds.sample_dedupe(s, "3650 days"), place(spark, "j9")).select("vehicle_id", "t"), "t")


