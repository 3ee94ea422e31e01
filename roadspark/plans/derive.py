"""Road, trip and run tables derived from the given ones, in Spark and as SQL views of the same names.

Samples and controls come from ``events``, the grid graph from ``supplier``, points from ``embeddings``, road tags
from ``part``, runs and routes from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.functions.tables import table

#: Nodes in a row of the grid.
WIDTH = 10


def seconds(events: DataFrame) -> DataFrame:
    """``events`` with ``t``, seconds since the first one."""
    start = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t0"))
    return events.join(F.broadcast(start), how="cross").withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("t0")) / 1e6).drop("t0")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seconds(table(spark, sf_dir, "events"))
    edge = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    return e.select(
        F.col("user_id").alias("vehicle_id"), "t", F.col("event_id").alias("seq"), edge.alias("edge"), F.col("value").alias("advance_m"), (F.col("event_id") % 100).cast("double").alias("offset_m")
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seconds(table(spark, sf_dir, "events"))
    return e.groupBy(F.col("user_id").alias("vehicle_id")).agg(
        F.min(F.when(F.col("event_type") != "view", F.col("t"))).alias("depart_t"),
        F.when(F.count("*") % 2 == 0, F.max("t")).alias("arrive_t"),
        F.sum("value").alias("distance_m"),
        (F.count("*") % 7 == 0).alias("unroutable"),
    )


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seconds(table(spark, sf_dir, "events"))
    kind = F.col("event_type")
    scope = F.when(kind.isin("view", "click"), "vehicle").when((kind == "purchase") & (F.col("event_id") % 3 == 0), "junction").otherwise("edge")
    action = F.when(kind == "view", "hold").when(kind == "click", "release").when(kind == "purchase", "close").when(kind == "error", "open")
    action = F.coalesce(action, F.when(F.col("event_id") % 2 == 0, "speed_factor").otherwise("capacity_factor"))
    target = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    return e.select(F.col("event_id").alias("seq"), "t", scope.alias("scope"), target.alias("target_id"), action.alias("action"), ((F.col("event_id") % 59 + 1) * 0.05).alias("value"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return k.select("node", (F.col("node") % WIDTH * 100).cast("double").alias("x"), (F.floor(F.col("node") / WIDTH) * 100).cast("double").alias("y"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of the links to the right and upwards; every link has a row of its own for each direction."""
    n = nodes(spark, sf_dir)
    k = F.col("node")
    steps = F.array(F.struct(F.lit(0).alias("d"), F.when(k % WIDTH < WIDTH - 1, k + 1).alias("other")), F.struct(F.lit(2).alias("d"), (k + WIDTH).alias("other")))
    links = n.select("node", F.explode(steps).alias("s")).select("node", "s.d", "s.other").where("other IS NOT NULL")
    links = links.join(n.select(F.col("node").alias("other")), "other", "left_semi")
    ways = F.array(
        F.struct((k * 4 + F.col("d")).alias("edge"), k.alias("from_node"), F.col("other").alias("to_node")),
        F.struct((k * 4 + F.col("d") + 1).alias("edge"), F.col("other").alias("from_node"), k.alias("to_node")),
    )
    both = links.select((k * 4 + F.col("d")).alias("road_id"), (F.lit(10) + k % 5).cast("double").alias("speed_limit_mps"), (k % 3 + 1).alias("lane_count"), F.explode(ways).alias("w"))
    return both.select("w.edge", "w.from_node", "w.to_node", "road_id", F.lit(100.0).alias("length_m"), "speed_limit_mps", "lane_count")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair of edges at a node: some prohibited, some with a penalty."""
    e = edges(spark, sf_dir)
    a, b = e.select(F.col("edge").alias("from_edge"), F.col("to_node").alias("node")), e.select(F.col("edge").alias("to_edge"), F.col("from_node").alias("node"))
    pairs = a.join(b, "node")
    mark = (F.col("from_edge") * 7 + F.col("to_edge") * 3) % 11
    return pairs.select("from_edge", "to_edge", (mark == 0).alias("prohibited"), F.when(mark == 1, 5.0).otherwise(0.0).alias("penalty_s")).where("prohibited OR penalty_s > 0")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), (F.col("embedding")[0].cast("double") * 400 + 450).alias("x"), (F.col("embedding")[1].cast("double") * 400 + 450).alias("y"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per edge of a route: (route_id, pos, edge)."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    return l.select(F.col("l_orderkey").alias("route_id"), pos.alias("pos"), (F.col("l_partkey") % 50).alias("edge"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("run_id"),
        F.concat("l_returnflag", "l_linestatus").alias("scenario_id"),
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("strategy_id"),
        F.col("l_orderkey").alias("repetition"),
        (F.col("l_discount") > 0.02).alias("success"),
        F.col("l_extendedprice").alias("travel_time_s"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("rejections"),
        F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("route_overlap_ratio"),
    )


def lined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's edges with their lines, source ids and classes."""
    n = nodes(spark, sf_dir)
    e = edges(spark, sf_dir)
    for end in ("from", "to"):
        e = e.join(n.select(F.col("node").alias(f"{end}_node"), F.struct("x", "y").alias(f"{end}_point")), f"{end}_node")
    kind = F.element_at(F.array(*map(F.lit, ("primary", "residential", "tertiary"))), (F.col("road_id") % 3 + 1).cast("int"))
    return e.withColumns({"points": F.array("from_point", "to_point"), "source_id": F.concat(F.lit("w"), F.floor(F.col("road_id") / 8).cast("string")), "road_class": kind}).drop("from_point", "to_point")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source roads that cross: one of three points for each supplier."""
    k = F.col("s_suppkey")
    x, y = (k % 20 * 10).cast("double"), (F.floor(k / 20) * 10).cast("double")
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("road"), F.concat(F.lit("r"), k.cast("string")).alias("source_id"), F.lit("residential").alias("road_class"),
        F.element_at(F.array(*map(F.lit, ("both", "forward", "reverse"))), (k % 3 + 1).cast("int")).alias("direction"),
        (F.lit(5.0) + k % 7).alias("speed_limit_mps"), (k % 3 + 1).cast("int").alias("lane_count"), F.lit(0).alias("z_level"),
        F.array(point(0.0, 0.0), point(14.0, 4.0), point(25.0, -6.0)).alias("points"),
    )


def osm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road features with tags from parts and lines near the equator from their keys."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda c, *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (c % len(values) + 1).cast("int"))
    lon, lat = (k % 100) * 0.001, F.floor(k / 200) * 0.001
    point = lambda d: F.struct((lon + d).alias("x"), lat.cast("double").alias("y"))
    return table(spark, sf_dir, "part").select(
        k.alias("feature_ordinal"), k.cast("string").alias("osm_id"),
        pick(size, "primary", "residential", "footway", "service", "motorway", "Tertiary", None, "track").alias("highway"),
        pick(k % 7, None, "yes", "-1", "no", "reversible").alias("oneway"), pick(k % 9, None, "roundabout").alias("junction"),
        pick(k % 6, None, "50", "30 mph", "50;60", "none", "fast").alias("maxspeed"), pick(k % 4, None, "4", "x3", "2").alias("lanes"),
        pick(k % 10, None, "3").alias("lanes_forward"), pick(k % 11, None, "2").alias("lanes_backward"), pick(k % 8, None, "yes", "no").alias("bridge"),
        pick(k % 12, None, "yes").alias("tunnel"), pick(k % 13, None, "1", "-2", "40").alias("layer"), pick(k % 14, None, "private", "yes").alias("access"),
        pick(k % 5, "LineString", "LineString", "GeometryCollection", "Point").alias("geom_type"),
        F.when(k % 17 == 0, F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(F.array(F.array(point(0.0), point(0.0005), point(0.0000001 * (k % 2) + 0.001)))).alias("parts"),
    )


#: The same derivations in DuckDB SQL.
SQL = """
evt AS (SELECT *, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS t FROM events),
samples AS (SELECT user_id AS vehicle_id, t, event_id AS seq, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS edge, value AS advance_m, CAST(event_id % 100 AS DOUBLE) AS offset_m FROM evt),
vehicles AS (SELECT user_id AS vehicle_id, min(CASE WHEN event_type <> 'view' THEN t END) AS depart_t, CASE WHEN count(*) % 2 = 0 THEN max(t) END AS arrive_t, sum(value) AS distance_m, count(*) % 7 = 0 AS unroutable FROM evt GROUP BY user_id),
controls AS (SELECT event_id AS seq, t,
  CASE WHEN event_type IN ('view', 'click') THEN 'vehicle' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'junction' ELSE 'edge' END AS scope,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS target_id,
  CASE event_type WHEN 'view' THEN 'hold' WHEN 'click' THEN 'release' WHEN 'purchase' THEN 'close' WHEN 'error' THEN 'open'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'speed_factor' ELSE 'capacity_factor' END END AS action,
  (event_id % 59 + 1) * CAST(0.05 AS DOUBLE) AS value FROM evt),
nodes AS (SELECT s_suppkey AS node, CAST(s_suppkey % 10 * 100 AS DOUBLE) AS x, CAST(s_suppkey // 10 * 100 AS DOUBLE) AS y FROM supplier),
links AS (SELECT node, d, other FROM (SELECT node, 0 AS d, CASE WHEN node % 10 < 9 THEN node + 1 END AS other FROM nodes UNION ALL SELECT node, 2, node + 10 FROM nodes) WHERE other IN (SELECT node FROM nodes)),
edges AS (SELECT node * 4 + d + w AS edge, CASE w WHEN 0 THEN node ELSE other END AS from_node, CASE w WHEN 0 THEN other ELSE node END AS to_node, node * 4 + d AS road_id,
  CAST(100 AS DOUBLE) AS length_m, CAST(10 + node % 5 AS DOUBLE) AS speed_limit_mps, node % 3 + 1 AS lane_count FROM links, (VALUES (0), (1)) ways(w)),
turns AS (SELECT * FROM (SELECT a.edge AS from_edge, b.edge AS to_edge, (a.edge * 7 + b.edge * 3) % 11 = 0 AS prohibited, CASE WHEN (a.edge * 7 + b.edge * 3) % 11 = 1 THEN 5.0 ELSE 0.0 END AS penalty_s
  FROM edges a JOIN edges b ON a.to_node = b.from_node) WHERE prohibited OR penalty_s > 0),
points AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) * 400 + 450 AS x, CAST(embedding[2] AS DOUBLE) * 400 + 450 AS y FROM embeddings),
routes AS (SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, l_partkey % 50 AS edge FROM lineitem),
runs AS (SELECT l_orderkey || ':' || l_linenumber AS run_id, l_returnflag || l_linestatus AS scenario_id, 's' || l_linenumber AS strategy_id, l_orderkey AS repetition, l_discount > 0.02 AS success,
  l_extendedprice AS travel_time_s, CASE WHEN l_quantity > 10 THEN l_quantity END AS rejections, CASE WHEN l_tax > 0.01 THEN l_tax END AS route_overlap_ratio FROM lineitem),
visits AS (
  SELECT vehicle_id, visit, edge, enter_t, lead(enter_t) OVER (PARTITION BY vehicle_id ORDER BY visit) AS exit_t, distance_m FROM (
    SELECT vehicle_id, visit, any_value(edge) AS edge, min(t) AS enter_t, sum(advance_m) AS distance_m FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY vehicle_id ORDER BY t, seq) AS visit FROM (
        SELECT *, CASE WHEN lag(edge) OVER (PARTITION BY vehicle_id ORDER BY t, seq) = edge THEN 0 ELSE 1 END AS fresh FROM samples)) GROUP BY vehicle_id, visit)),
kpis AS (SELECT *, CASE WHEN vehicle_seconds > 1e-9 THEN distance_m / vehicle_seconds ELSE 0 END AS mean_speed FROM (
  SELECT edge, count(*) AS entries, coalesce(sum(exit_t - enter_t), 0) AS vehicle_seconds, coalesce(sum(distance_m), 0) AS distance_m FROM visits GROUP BY edge)),
lined AS (SELECT e.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb, 'w' || (road_id // 8) AS source_id, CASE road_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' ELSE 'tertiary' END AS road_class
  FROM edges e JOIN nodes a ON a.node = from_node JOIN nodes b ON b.node = to_node),
features AS (SELECT p_partkey AS k, list_extract(['primary', 'residential', 'footway', 'service', 'motorway', 'Tertiary', NULL, 'track'], p_size % 8 + 1) AS highway, list_extract([NULL, 'yes', '-1', 'no', 'reversible'], p_partkey % 7 % 5 + 1) AS oneway,
  list_extract([NULL, 'roundabout'], p_partkey % 9 % 2 + 1) AS junction, list_extract([NULL, '50', '30 mph', '50;60', 'none', 'fast'], p_partkey % 6 + 1) AS maxspeed, list_extract([NULL, '4', 'x3', '2'], p_partkey % 4 + 1) AS lanes,
  list_extract([NULL, '3'], p_partkey % 10 % 2 + 1) AS lanes_forward, list_extract([NULL, '2'], p_partkey % 11 % 2 + 1) AS lanes_backward, list_extract([NULL, 'yes', 'no'], p_partkey % 8 % 3 + 1) AS bridge,
  list_extract([NULL, 'yes'], p_partkey % 12 % 2 + 1) AS tunnel, list_extract([NULL, '1', '-2', '40'], p_partkey % 13 % 4 + 1) AS layer, list_extract([NULL, 'private', 'yes'], p_partkey % 14 % 3 + 1) AS access,
  list_extract(['LineString', 'LineString', 'GeometryCollection', 'Point'], p_partkey % 5 % 4 + 1) AS geom_type, p_partkey % 17 = 0 AS empty FROM part),
judged AS (SELECT *, lower(highway) AS hw, coalesce(CASE oneway WHEN '-1' THEN 'reverse' WHEN 'yes' THEN 'forward' WHEN 'no' THEN 'both' END, CASE WHEN coalesce(junction, '') = 'roundabout' OR highway = 'motorway' THEN 'forward' ELSE 'both' END) AS direction,
  CASE WHEN highway IS NULL THEN 'missing_highway' WHEN highway = 'service' THEN 'service_disabled' WHEN highway = 'track' THEN 'track_disabled' WHEN highway = 'footway' THEN 'non_drivable_class' WHEN access = 'private' THEN 'access_restricted'
    WHEN geom_type = 'Point' OR (empty AND geom_type = 'GeometryCollection') THEN 'unsupported_geometry' WHEN empty THEN 'empty_geometry' END AS reason FROM features),
midway AS (SELECT max(t) / 2 AS mid FROM evt)
"""


def with_sql(body: str) -> str:
    """``body`` behind the derived views that it names, and those that they need."""
    import re

    views = re.split(r",\n(?=[a-z]+ AS \()", SQL.strip())
    by = {v.split(" AS ", 1)[0]: v for v in views}
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in by:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(by[name])

    need(body)
    views = ",\n".join(v for name, v in by.items() if name in needed)
    if not views:
        return body
    return f"WITH RECURSIVE {views}" + (f",\n{body.strip()[5:]}" if body.strip().upper().startswith("WITH ") else f"\n{body}")
