"""Sinks: reports, GeoJSON features, playback documents."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.functions.tables import stored
from roadspark.operators.topology import numbered


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a CSV can hold the rows."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_report(df: DataFrame, path: str) -> None:
    """The rows as JSON lines below ``path``/json and as flat CSV below ``path``/csv."""
    df.write.mode("overwrite").json(f"{path}/json")
    flat(df).write.mode("overwrite").csv(f"{path}/csv", header=True)


def position(p: Column) -> Column:
    return F.array(p["x"], p["y"])


def feature(geometry_type: str, coordinates: Column, properties: list) -> Column:
    """One GeoJSON feature as text."""
    geometry = F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value")


def line(points: str | Column) -> Column:
    return F.transform(points, position)


def roads_geojson(edges: DataFrame) -> DataFrame:
    """One feature per road: its edges, and whether it runs forward, reverse or both ways."""
    turned = F.col("geometry_reversed")
    ways = F.collect_set(turned)
    head = F.min(F.struct(turned, "edge", F.when(turned, F.reverse("points")).otherwise(F.col("points")).alias("points"))).alias("head")
    roads = edges.groupBy("road_id").agg(F.array_sort(F.collect_list("edge")).alias("edges"), ways.alias("ways"), head, F.first("road_class").alias("road_class"))
    direction = F.when(F.size("ways") == 2, "both").when(F.col("ways")[0], "reverse").otherwise("forward")
    return roads.select(feature("LineString", line(F.col("head.points")), ["road_id", "edges", direction.alias("direction"), "road_class"]))


def nodes_geojson(degrees: DataFrame) -> DataFrame:
    return degrees.select(feature("Point", F.array("x", "y"), ["node", "in_degree", "out_degree"]))


def issues_geojson(issues: DataFrame) -> DataFrame:
    """Only issues that have a place."""
    return issues.where("location IS NOT NULL").select(feature("Point", position(F.col("location")), ["code", "severity", "subject"]))


def routes_geojson(pieces: DataFrame) -> DataFrame:
    """(route_id, pos, edge, points): the pieces of routes."""
    return pieces.select(feature("LineString", line("points"), ["route_id", "pos", "edge"]))


def trajectories_geojson(trajectories: DataFrame) -> DataFrame:
    coordinates = F.transform("line", lambda p: F.array(p["x"], p["y"]))
    return trajectories.select(feature("LineString", coordinates, ["vehicle_id", "depart_t", "arrive_t", "travel_s", "distance_m"]))


def reference_geojson(features: DataFrame) -> DataFrame:
    """Features of any kind with all their attributes; ``coordinates`` is JSON text and rows without it are dropped.  None left raises."""
    kept = features.where("coordinates IS NOT NULL AND coordinates NOT IN ('', '[]')")
    if kept.isEmpty():
        raise ValueError("the reference layer has no geometry")
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), "geom_type", F.lit('","coordinates":'), "coordinates", F.lit('},"properties":'), F.to_json("properties"), F.lit("}"))
    return kept.select(text.alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON."""
    features.select("value").write.mode("overwrite").text(path)


def playback(runs: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per run: (run_id, value); each section's rows of the run in a sorted list."""
    out = runs
    for name, rows in sections.items():
        columns = [c for c in rows.columns if c != "run_id"]
        listed = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(listed, "run_id", "left")
    return out.select("run_id", F.to_json(F.struct(*out.columns)).alias("value"))


def playback_lines(runs: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """The documents of ``playback`` in lines, so that no run is one row: (run, section, kind, number, value).

    ``run`` numbers the runs in the order of ``run_id``.  A run's values in the order of the columns before them are its document: a head with the columns of
    ``runs``, for each section that has rows its name, a line for each row and an end, and the end of the document.  Rows are numbered over sorted
    ranges, so a run may hold all of them.  A null ``run_id`` has no document.
    """
    listed = numbered(runs.where("run_id IS NOT NULL"), ["run_id"], "_run")
    line = lambda section, kind, number, value: [F.col("_run").alias("run"), F.lit(section).alias("section"), F.lit(kind).alias("kind"), number.cast("long").alias("number"), value.alias("value")]
    none = F.lit(0)
    lines = [listed.select(*line(-1, 0, none, F.regexp_replace(F.to_json(F.struct(*runs.columns)), r"\}$", ""))), listed.select(*line(len(sections), 0, none, F.lit("}")))]
    for k, (name, rows) in enumerate(sections.items()):
        columns = [c for c in rows.columns if c != "run_id"]
        rows = rows.select("run_id", F.struct(*columns).alias("row")).join(listed.select("run_id", "_run"), "run_id").select("_run", "row")
        placed = stored(numbered(rows, ["_run", "row"], "number"), "lines")
        first = placed.groupBy("_run").agg(F.min("number").alias("number"))
        comma = F.when(F.col("_first"), F.lit("")).otherwise(F.lit(","))
        marked = placed.join(first.select("number", F.lit(True).alias("_first")), "number", "left")
        lines += [first.select(*line(k, 0, none, F.lit(f",{json.dumps(name)}:["))), marked.select(*line(k, 1, F.col("number"), F.concat(comma, F.to_json("row")))), first.select(*line(k, 2, none, F.lit("]")))]
    return reduce(DataFrame.unionByName, lines)


def write_playback(runs: DataFrame, sections: dict[str, DataFrame], path: str, parts: int | None = None) -> None:
    """Write each run's document into a folder of its own, ``run=0`` and on, over as many tasks as its lines fill: its files in the order of their names are
    the document.  ``parts`` is the number of ranges, which Spark chooses by size if it isn't given."""
    at = ["run", "section", "kind", "number"]
    lines = playback_lines(runs, sections).repartitionByRange(*((parts,) if parts else ()), *at).sortWithinPartitions(*at)
    lines.select("run", "value").write.partitionBy("run").mode("overwrite").text(path)
