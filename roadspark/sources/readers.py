"""Readers of road, demand, control and experiment files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.functions.tables import running, stored
from roadspark.operators.topology import numbered

# Column names of a field mapping and what they mean here.
MAPPING_KEYS = (
    "id_field", "oneway_field", "speed_field", "lanes_field", "road_class_field", "z_level_field", "bridge_field", "tunnel_field",
    "target_crs", "default_speed_kph", "snap_tolerance_m", "default_bidirectional",
)
MAPPED = {"id_field": "source_id", "oneway_field": "oneway", "speed_field": "speed_kph", "lanes_field": "lanes", "road_class_field": "road_class", "z_level_field": "z_level", "bridge_field": "bridge", "tunnel_field": "tunnel"}
DEFAULTS = {"target_crs": "auto", "default_speed_kph": 40.0, "snap_tolerance_m": 0.5, "default_bidirectional": True}
TURN_KINDS = ("no", "only", "penalty", "no_via", "only_via")
TRUE = ("1", "true", "yes", "agent")

GEOMETRY = "type STRING, coordinates STRING, geometries ARRAY<STRUCT<type: STRING, coordinates: STRING>>"
FEATURE = f"id STRING, properties MAP<STRING, STRING>, geometry STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in GEOMETRY.split(', ', 2))}>"
POSITION = "array<double>"


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` just read, with where each stands: its file, the block of the file that a task reads, and its place in that."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_at", F.monotonically_increasing_id())


def _in_file_order(placed: DataFrame, name: str) -> DataFrame:
    """Number the rows from 0 by file name, then as they stand in the file, however the files were split among tasks."""
    return numbered(placed, ["_file", "_block", "_at"], name).drop("_file", "_block", "_at")


def _lines(kind, text):
    """Lines of one geometry from its type and the JSON text of its coordinates."""
    line, many = F.from_json(text, f"array<{POSITION}>"), F.from_json(text, f"array<array<{POSITION}>>")
    lines = F.when(kind == "LineString", F.array(line)).when(kind == "MultiLineString", many)
    return F.transform(lines, lambda l: F.transform(l, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))  # noqa: E741


#: Objects of a file that are numbered together.
OBJECTS_A_PART = 100_000


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(feature_ordinal, id, properties, geometry) of the features of one FeatureCollection a file, read by many tasks.

    A file is cut at every closing brace, so tasks read its blocks side by side.  Running counts of quotes tell which braces stand in texts, those of
    braces how deep each piece lies; pieces up to the end of an object one level down make up a feature, or another member of the collection,
    which is left out.  Nothing but pieces and features is ever held as a whole.
    """
    cut = stored(_placed(spark.read.option("lineSep", "}").text(path)), "pieces")
    bare = F.regexp_replace("value", r"\\[\s\S]", "")
    rows = cut.withColumn("bare", bare).withColumn("quotes", F.length("bare") - F.length(F.regexp_replace("bare", '"', "")))
    rows = running(rows, ["_file"], "_block", ["_at"], {"quotes": "quotes_before"})
    out_of_texts = F.regexp_replace(F.when(F.col("quotes_before") % 2 == 1, F.regexp_replace("bare", '^[^"]*"?', "")).otherwise(F.col("bare")), '"[^"]*(?:"|$)', "")
    opened = F.length(out_of_texts) - F.length(F.regexp_replace(out_of_texts, r"\{", ""))
    closed = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0).cast("int")
    rows = rows.withColumns({"step": opened - closed, "closed": closed}).drop("bare", "quotes", "quotes_before")
    rows = running(rows, ["_file"], "_block", ["_at"], {"step": "depth"})
    rows = rows.withColumn("ends", ((F.col("closed") == 1) & (F.col("depth") + F.col("step") == 1)).cast("int"))
    rows = running(rows, ["_file"], "_block", ["_at"], {"ends": "object"})
    listed = rows.groupBy("_file", "object").agg(F.array_sort(F.collect_list(F.struct("_block", "_at", F.concat("value", F.lit("}")).alias("piece")))).alias("pieces"))
    # the text ahead of the object goes: a comma or a name, and for the first one the collection's own brace too
    ahead, text = r'^(?:[^{"]|"(?:[^"\\]|\\.)*+")*+\{', F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    text = F.when(F.col("object") == 0, F.regexp_replace(text, ahead, "")).otherwise(text)
    parsed = F.from_json(F.regexp_replace(text, ahead, "{"), f"type STRING, {FEATURE}")
    found = listed.select("_file", "object", parsed.alias("f")).withColumn("one", F.coalesce((F.col("f.type") == "Feature").cast("int"), F.lit(0)))
    found = running(found.withColumn("part", F.floor(F.col("object") / OBJECTS_A_PART)), ["_file"], "part", ["object"], {"one": "feature_ordinal"})
    return found.where("one = 1").select("feature_ordinal", "f.id", "f.properties", "f.geometry")


def read_roads_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(feature_ordinal, feature_id, properties, geom_type, parts) of a GeoJSON FeatureCollection, or one Feature a line.

    ``parts`` holds all lines, also those in a GeometryCollection; the id falls back to the feature's ordinal, its place in
    its collection, or in the order of the files and their lines.
    """
    if lines:
        rows = _in_file_order(_placed(spark.read.schema(FEATURE).json(path)), "feature_ordinal")
    else:
        rows = read_collection(spark, path)
    g = F.col("geometry")
    inner = F.flatten(F.transform(F.filter(g["geometries"], lambda x: x["type"].isin("LineString", "MultiLineString")), lambda x: _lines(x["type"], x["coordinates"])))
    parts = F.when(g["type"] == "GeometryCollection", inner).otherwise(_lines(g["type"], g["coordinates"]))
    return rows.select("feature_ordinal", F.coalesce("id", F.col("feature_ordinal").cast("string")).alias("feature_id"), "properties", g["type"].alias("geom_type"), F.coalesce(parts, F.array().cast("array<array<struct<x:double,y:double>>>")).alias("parts"))


def tags(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``features`` with a text column for each name, looked up in ``properties`` whatever the case of its keys."""
    low = F.transform_keys("properties", lambda k, _: F.lower(k))
    rows = features.withColumn("_low", low)
    return rows.select(*features.columns, *(F.nullif(F.element_at("_low", n.lower()), F.lit("")).alias(n) for n in names if n not in features.columns))


def read_mapping(spark: SparkSession, path: str) -> dict[str, str]:
    """A field mapping file: ``key=value`` lines, ``#`` comments.  Its few lines are read on the driver."""
    rows = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')").collect()
    return {k.strip(): v.strip() for k, v in (r.value.split("=", 1) for r in rows)}


def apply_mapping(features: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns of ``MAPPED`` from ``properties``, a blank name meaning null; an unknown key raises."""
    unknown = sorted(set(mapping) - set(MAPPING_KEYS))
    if unknown:
        raise ValueError(f"unknown mapping key: {unknown[0]}")
    value = lambda key: F.nullif(F.element_at("properties", mapping[key]), F.lit("")) if mapping.get(key) else F.lit(None).cast("string")
    cols = {name: value(key) for key, name in MAPPED.items()}
    cols["source_id"] = F.coalesce(cols["source_id"], "feature_id")
    default = float(mapping.get("default_speed_kph") or DEFAULTS["default_speed_kph"])
    cols["speed_kph"] = F.coalesce(cols["speed_kph"].try_cast("double"), F.lit(default))
    cols |= {"lanes": cols["lanes"].try_cast("int"), "z_level": cols["z_level"].try_cast("int")}
    return features.withColumns(cols)


def _csv(spark: SparkSession, path: str, names: list[str], placed: bool = False) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).csv(path, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = _placed(rows) if placed else rows
    return rows.withColumns({n: F.nullif(F.col(n), F.lit("")) for n in names})


def number(c: str):
    return F.col(c).try_cast("double")


def read_turn_rules(spark: SparkSession, path: str) -> DataFrame:
    """(from_source_id, via_x, via_y, to_source_id, kind, penalty_s, via_ids, error); ``error`` names what is wrong with a row."""
    rows = _csv(spark, path, ["from_source_id", "via_x", "via_y", "to_source_id", "kind", "extra"])
    via = F.when(F.col("kind").endswith("_via"), F.filter(F.transform(F.split("extra", ";"), lambda s: F.trim(s)), lambda s: s != ""))
    penalty = F.when(F.col("kind") == "penalty", number("extra"))
    rows = rows.withColumns({"via_x": number("via_x"), "via_y": number("via_y"), "penalty_s": penalty, "via_ids": via})
    bad_penalty = (F.col("kind") == "penalty") & ~F.coalesce((penalty >= 0) & (penalty < float("inf")), F.lit(False))
    error = (
        F.when(F.col("from_source_id").isNull() | F.col("to_source_id").isNull() | F.col("via_x").isNull() | F.col("via_y").isNull(), "missing_field")
        .when(~F.coalesce(F.col("kind").isin(*TURN_KINDS), F.lit(False)), "unknown_kind")
        .when(bad_penalty, "invalid_penalty")
        .when(F.col("kind").endswith("_via") & ~F.coalesce(F.size("via_ids").between(1, 16), F.lit(False)), "invalid_via")
    )
    return rows.withColumn("error", error).drop("extra")


def read_od(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, dest_lon, dest_lat, depart_s, algorithm, agent)."""
    rows = _csv(spark, path, ["lon", "lat", "dest_lon", "dest_lat", "depart_s", "algorithm", "agent"])
    agent = F.coalesce(F.lower("agent").isin(*TRUE), F.lit(False))
    return rows.select(*(number(c).alias(c) for c in ("lon", "lat", "dest_lon", "dest_lat", "depart_s")), F.coalesce("algorithm", F.lit("dijkstra")).alias("algorithm"), agent.alias("agent"))


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """(seq, t, scope, target_id, action, value): ``road`` means ``edge``; the value is 1 by default; seq is the order of the files and their lines."""
    rows = _in_file_order(_csv(spark, path, ["time_s", "scope", "target_id", "action", "value"], placed=True), "seq")
    scope = F.when(F.lower("scope") == "road", "edge").otherwise(F.lower("scope"))
    return rows.where(number("time_s").isNotNull()).select("seq", number("time_s").alias("t"), scope.alias("scope"), F.col("target_id").try_cast("long").alias("target_id"), F.lower("action").alias("action"), F.coalesce(number("value"), F.lit(1.0)).alias("value"))


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signal rows with ``consistent``: those of a node agree on offset and pauses, those of a phase on green and flow."""
    names = ["node", "phase", "green_s", "yellow_s", "all_red_s", "offset_s", "from_edge", "to_edge", "saturation_flow_vph"]
    rows = _csv(spark, path, names).where(number("green_s").isNotNull())
    rows = rows.select(*(F.col(c).try_cast("long" if c in ("node", "from_edge", "to_edge") else "int" if c == "phase" else "double").alias(c) for c in names)).fillna(1800.0, ["saturation_flow_vph"])
    agree = lambda cols, *by: F.greatest(*((F.max(c).over(Window.partitionBy(*by)) - F.min(c).over(Window.partitionBy(*by))) for c in cols)) <= 1e-9
    ok = agree(["offset_s", "yellow_s", "all_red_s"], "node") & agree(["green_s", "saturation_flow_vph"], "node", "phase") & (F.col("phase") < 1024)
    return rows.withColumn("consistent", ok)


def read_osm_elements(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The restriction relations, and the ways and via nodes that they name; the others are left out by semi joins."""
    wanted = relations.where(F.element_at("tags", "type") == "restriction")
    members = wanted.select(F.explode("members").alias("m")).select("m.id", "m.type")
    kept_ways = ways.join(members.where("type = 'way'"), "id", "left_semi")
    ends = kept_ways.select(F.explode("nodes").alias("id")).union(members.where("type = 'node'").select("id"))
    return nodes.join(ends, "id", "left_semi"), kept_ways, wanted


MANIFEST = (
    "name STRING, repetitions INT, scenarios ARRAY<STRUCT<id: STRING, vehicles: INT, duration_s: DOUBLE, seed: BIGINT, events: STRING>>, "
    "strategies ARRAY<STRUCT<id: STRING, algorithm: STRING, policy: STRING, source: STRING>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """An experiment manifest; no name, no scenario, no strategy, or repetitions outside 1 to 100 raise."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True)
    ok = F.col("name").isNotNull() & (F.size("scenarios") > 0) & (F.size("strategies") > 0) & F.col("repetitions").between(1, 100)
    return rows.withColumn("name", F.when(F.coalesce(ok, F.lit(False)), F.col("name")).otherwise(F.raise_error(F.lit("invalid manifest"))))


PLAYBACK = (
    "run_id STRING, config MAP<STRING, STRING>, controls ARRAY<STRUCT<time_s: DOUBLE, scope: STRING, target_id: BIGINT, action: STRING, value: DOUBLE>>, "
    "reroutes ARRAY<STRUCT<time_s: DOUBLE, vehicle_id: BIGINT, old_route_id: BIGINT, new_route_id: BIGINT, success: BOOLEAN, changed: BOOLEAN, overlap: DOUBLE, reversal: BOOLEAN>>, "
    "edge_kpis ARRAY<STRUCT<edge: BIGINT, entries: BIGINT, vehicle_seconds: DOUBLE, distance_m: DOUBLE, mean_speed: DOUBLE>>, "
    "vehicles ARRAY<STRUCT<vehicle_id: BIGINT, depart_s: DOUBLE, arrive_s: DOUBLE, distance_m: DOUBLE, samples: ARRAY<ARRAY<DOUBLE>>>>"
)


def read_playback(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sections of playback documents as tables by name; samples are (run_id, vehicle_id, t, x, y) without an edge."""
    doc = spark.read.schema(PLAYBACK).json(path)
    out = {s: doc.select("run_id", F.explode(s).alias("r")).select("run_id", "r.*") for s in ("controls", "reroutes", "edge_kpis", "vehicles")}
    points = out["vehicles"].select("run_id", "vehicle_id", F.explode("samples").alias("s"))
    out["samples"] = points.select("run_id", "vehicle_id", F.col("s")[0].alias("t"), F.col("s")[1].alias("x"), F.col("s")[2].alias("y"))
    out["config"] = doc.select("run_id", F.explode("config").alias("key", "value"))
    return out


def inspect(features: DataFrame) -> DataFrame:
    """One row: features, count by geometry type, field names, what kind of layer it is, and whether it is OSM data."""
    by = features.groupBy("geom_type").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set(F.map_keys("properties")))).alias("fields"))
    one = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("features"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("geom_type", F.lit("none")), "n")))).alias("geometry_types"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"), F.collect_set("geom_type").alias("kinds"))
    only = lambda *names: (F.size("kinds") > 0) & F.forall("kinds", lambda k: k.isin(*names))
    layer = F.when(only("LineString", "MultiLineString"), "road-network").when(only("Polygon", "MultiPolygon", "Point", "MultiPoint"), "reference-layer").otherwise("unsupported")
    return one.select("features", "geometry_types", "fields", layer.alias("layer"), F.array_contains("fields", "highway").alias("osm"))


VERSION = 3


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A compiled map as Parquet tables below ``path``, with a metadata row."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(VERSION).alias("version"), F.array(*map(F.lit, sorted(tables))).alias("tables")).write.mode("overwrite").parquet(f"{path}/metadata")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``write_tables`` wrote; another version raises."""
    meta = spark.read.parquet(f"{path}/metadata").first()
    if meta.version != VERSION:
        raise ValueError(f"map version {meta.version}, expected {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta.tables}


def expand_od(od: DataFrame, count: int, spread: float) -> DataFrame:
    """``count`` vehicles for each pair, leaving evenly over ``spread`` seconds."""
    i = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("vehicle")
    gap = spread / (count - 1) if count > 1 else 0.0
    return od.select("*", i).withColumn("depart_s", F.col("vehicle") * F.lit(gap))
