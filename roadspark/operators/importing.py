"""Import of source roads: parts, clean points, attributes, projection and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.functions.columns import from_mercator, from_utm, path_length, to_mercator, to_utm, utm_zone

# Direction words.
FORWARD = ("1", "yes", "true", "forward", "ft", "f", "y", "单向")
REVERSE = ("-1", "reverse", "backward", "tf", "r")
BOTH = ("0", "no", "false", "both", "b", "n", "双向")


def explode_parts(roads: DataFrame) -> DataFrame:
    """One row per line of ``parts``; lines behind the first get ``#partN`` after their ``source_id``."""
    rows = roads.select("*", F.posexplode_outer("parts").alias("part", "points")).drop("parts")
    suffix = F.when(F.col("part") > 0, F.concat(F.lit("#part"), F.col("part").cast("string"))).otherwise("")
    return rows.withColumn("source_id", F.concat("source_id", suffix))


def clean_points(points: Column) -> Column:
    """Drop points that aren't finite, and points closer than 1e-8 to the last kept."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.filter(points, lambda p: finite(p["x"]) & finite(p["y"]))

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        far = F.sqrt(F.pow(p["x"] - last["x"], 2) + F.pow(p["y"] - last["y"], 2)) >= 1e-8
        return F.when(far, F.concat(acc, F.array(p))).otherwise(acc)

    rest = F.slice(good, 2, F.greatest(F.size(good) - 1, F.lit(0)))
    return F.when(F.size(good) > 1, F.aggregate(rest, F.slice(good, 1, 1), step)).otherwise(good)


def valid_line(points: Column) -> Column:
    return (F.size(points) >= 2) & (path_length(points) > 1e-6)


def parse_direction(word: Column, default_both: bool = True) -> Column:
    w = F.lower(F.trim(word))
    default = "both" if default_both else "forward"
    return F.when(w.isin(*REVERSE), "reverse").when(w.isin(*FORWARD), "forward").when(w.isin(*BOTH), "both").otherwise(default)


def yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "yes", "true", "t", "y", "是"), F.lit(False))


def road_attributes(speed_kph: Column, lanes: Column, level: Column, bridge: Column, tunnel: Column, default_kph: float = 40.0) -> list[Column]:
    """Columns speed_limit_mps, lane_count and z_level."""
    return [
        (F.greatest(F.lit(0.1), F.coalesce(speed_kph, F.lit(default_kph))) / 3.6).alias("speed_limit_mps"),
        F.least(F.greatest(F.coalesce(lanes, F.lit(1)), F.lit(1)), F.lit(32)).cast("int").alias("lane_count"),
        F.coalesce(level, F.when(yes(bridge), 1).when(yes(tunnel), -1).otherwise(0)).cast("int").alias("z_level"),
    ]


def auto_utm(roads: DataFrame, points: str = "points") -> DataFrame:
    """One row (zone, south, epsg): the UTM zone of the centre of all points in degrees."""
    low = lambda axis: F.min(F.array_min(F.transform(points, lambda p: p[axis])))
    high = lambda axis: F.max(F.array_max(F.transform(points, lambda p: p[axis])))
    centre = roads.agg(((low("x") + high("x")) / 2).alias("lon"), ((low("y") + high("y")) / 2).alias("lat"))
    zone, south = utm_zone(F.col("lon")), F.col("lat") < 0
    return centre.select(zone.alias("zone"), south.alias("south"), (F.when(south, 32700).otherwise(32600) + zone).alias("epsg"))


def to_metres(roads: DataFrame, crs: DataFrame | None, points: str = "points") -> DataFrame:
    """Project ``points`` from degrees: to the UTM zone of ``crs`` (one row), or to web Mercator without it."""
    if crs is None:
        return roads.withColumn(points, F.transform(points, lambda p: to_mercator(p["x"], p["y"])))
    out = roads.join(F.broadcast(crs.select("zone", "south")), how="cross")
    return out.withColumn(points, F.transform(points, lambda p: to_utm(p["x"], p["y"], F.col("zone"), F.col("south")))).drop("zone", "south")


def to_wgs84(roads: DataFrame, crs: DataFrame | None, points: str = "points") -> DataFrame:
    """Back to degrees."""
    if crs is None:
        return roads.withColumn(points, F.transform(points, lambda p: from_mercator(p["x"], p["y"])))
    out = roads.join(F.broadcast(crs.select("zone", "south")), how="cross")
    return out.withColumn(points, F.transform(points, lambda p: from_utm(p["x"], p["y"], F.col("zone"), F.col("south")))).drop("zone", "south")


def import_issues(roads: DataFrame) -> DataFrame:
    """(source_id, code) of rows without usable geometry; ``geom_type``, ``points`` before and ``projected`` after projection."""
    finite = F.forall("projected", lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    code = (
        F.when(F.coalesce(F.size("points"), F.lit(0)) < 1, "EMPTY_GEOMETRY")
        .when(~F.col("geom_type").isin("LineString", "MultiLineString", "GeometryCollection"), "UNSUPPORTED_GEOMETRY")
        .when(~finite, "CRS_TRANSFORM_FAILED")
        .when(~valid_line(clean_points(F.col("projected"))), "INVALID_LINE_GEOMETRY")
    )
    return roads.select("source_id", code.alias("code")).where("code IS NOT NULL")
