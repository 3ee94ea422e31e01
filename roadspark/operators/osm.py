"""OSM road cleaning: which features are roads for cars, and their normalised columns.

A feature has ``feature_ordinal``, the tags as text columns, ``geom_type`` and ``parts`` (array of lines, each an array
of (x = lon, y = lat)).  Missing tag columns are added as null by ``with_tags``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions.columns import geodesic, leading_int, leading_number, path_length, truthy

# Classes, tag words and default speeds.
DRIVABLE = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "road",
)
RESTRICTED = ("no", "private", "agricultural", "forestry")
SPEEDS = {
    "motorway": 100, "motorway_link": 100, "trunk": 80, "trunk_link": 80, "primary": 60, "primary_link": 60, "secondary": 50, "secondary_link": 50,
    "tertiary": 40, "tertiary_link": 40, "residential": 30, "unclassified": 30, "road": 30, "living_street": 10, "service": 20, "track": 15,
}
OTHER_SPEED = 30.0
SPECIAL_SPEEDS = {"none": 120.0, "walk": 5.0, "walking_pace": 5.0, "cn:urban": 50.0, "cn:rural": 70.0, "cn:expressway": 120.0, "cn:motorway": 120.0}
MPH = 1.609344
TAGS = (
    "osm_id", "highway", "name", "ref", "oneway", "junction", "maxspeed", "maxspeed_forward", "maxspeed_backward", "lanes", "lanes_forward",
    "lanes_backward", "bridge", "tunnel", "layer", "motorcar", "motor_vehicle", "vehicle", "access", "service", "surface",
)


@dataclass(frozen=True)
class Options:
    include_service: bool = False
    include_track: bool = False
    include_private: bool = False
    min_length_m: float = 2.0


def with_tags(features: DataFrame) -> DataFrame:
    have = {c.lower() for c in features.columns}
    return features.withColumns({t: F.lit(None).cast("string") for t in TAGS if t not in have})


def low(tag: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(tag))), F.lit(""))


def class_reason(options: Options) -> Column:
    """Why the class isn't drivable, else null."""
    h = low("highway")
    reason = F.when(h.isNull(), "missing_highway").when(h.isin(*DRIVABLE), None)
    reason = reason.when(h == "service", F.lit(None if options.include_service else "service_disabled"))
    return reason.when(h == "track", F.lit(None if options.include_track else "track_disabled")).otherwise("non_drivable_class")


def effective_access() -> Column:
    """The first of motorcar, motor_vehicle, vehicle and access that says something."""
    return F.coalesce(*(low(t) for t in ("motorcar", "motor_vehicle", "vehicle", "access")))


def access_reason(options: Options) -> Column:
    closed = F.coalesce(effective_access().isin(*RESTRICTED), F.lit(False)) & F.lit(not options.include_private)
    return F.when(closed, "access_restricted")


def lineal(features: DataFrame) -> DataFrame:
    """Add ``geometry_reason`` and ``from_collection``: only lines are kept, also those in a collection.

    ``parts`` holds the lines already found in the geometry, one level of nesting resolved by the reader.
    """
    lines = F.filter("parts", lambda p: F.size(p) > 0)
    known = F.col("geom_type").isin("LineString", "MultiLineString", "GeometryCollection")
    empty = F.coalesce(F.size(lines), F.lit(0)) < 1
    collection = F.col("geom_type") == "GeometryCollection"
    reason = F.when(~F.coalesce(known, F.lit(False)), "unsupported_geometry").when(empty & collection, "unsupported_geometry").when(empty, "empty_geometry")
    return features.withColumns({"geometry_reason": reason, "from_collection": F.coalesce(collection, F.lit(False)), "parts": F.coalesce(lines, F.array().cast(features.schema["parts"].dataType))})


def length_m(parts: Column) -> Column:
    """Haversine length of all lines."""
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + path_length(p, geodesic))


def direction() -> Column:
    """(direction, implied): forward, reverse or both; roundabouts and motorways imply forward."""
    o, j, h = low("oneway"), low("junction"), low("highway")
    word = F.when(o.isin("-1", "reverse", "backward"), "reverse").when(o.isin("yes", "1", "true", "forward"), "forward").when(o.isin("no", "0", "false", "both"), "both")
    implied = word.isNull() & (F.coalesce(j.isin("roundabout", "circular"), F.lit(False)) | F.coalesce(h.isin("motorway", "motorway_link"), F.lit(False)))
    return F.struct(F.coalesce(word, F.when(implied, "forward").otherwise("both")).alias("direction"), implied.alias("implied"))


def speed() -> Column:
    """(kph, from_default, mph): the least speed that the tags give between 1 and 250 km/h, else the class's."""
    tags = F.lower(F.trim(F.concat_ws(";", *(F.nullif(F.trim(t), F.lit("")) for t in ("maxspeed", "maxspeed_forward", "maxspeed_backward")))))
    special = F.lit(None).cast("double")
    for word, fixed in SPECIAL_SPEEDS.items():
        special = F.when(tags == word, fixed).otherwise(special)
    tokens = F.transform(F.split(tags, ";"), lambda t: F.trim(t))
    kph = lambda t: leading_number(t) * F.when(t.contains("mph"), MPH).otherwise(1.0)
    found = F.filter(F.transform(tokens, lambda t: F.struct(kph(t).alias("kph"), t.contains("mph").alias("mph"))), lambda s: s["kph"].between(1, 250))
    best = F.array_min(found)
    default = F.lit(OTHER_SPEED)
    for name, fixed in SPEEDS.items():
        default = F.when(low("highway") == name, float(fixed)).otherwise(default)
    none = special.isNull()
    return F.struct(F.coalesce(special, best["kph"], default).alias("kph"), (none & best.isNull()).alias("from_default"), F.coalesce(none & best["mph"], F.lit(False)).alias("mph"))


def lane_count(way: Column) -> Column:
    """Lanes of one direction, 0 to 32."""
    f, b, lanes = (F.coalesce(leading_int(F.col(t)), F.lit(0)) for t in ("lanes_forward", "lanes_backward", "lanes"))
    default = F.when(low("highway").isin("motorway", "trunk", "primary"), 2).otherwise(1)
    halved = F.greatest(F.lit(1), F.floor(lanes / 2).cast("int"))
    n = F.when((f > 0) & (b > 0), F.least(f, b)).when((f > 0) | (b > 0), F.greatest(f, b)).when(lanes > 0, F.when(way == "both", halved).otherwise(lanes)).otherwise(default)
    return F.least(F.greatest(n, F.lit(0)), F.lit(32)).cast("int")


def z_level() -> Column:
    layer = F.least(F.greatest(F.coalesce(leading_int(F.col("layer")), F.lit(0)), F.lit(-20)), F.lit(20))
    return F.when(layer != 0, layer).when(truthy(F.col("bridge")), 1).when(truthy(F.col("tunnel")), -1).otherwise(0).cast("int")


def dedupe_geometry(roads: DataFrame, kept: str = "kept") -> DataFrame:
    """Add ``duplicate``: a kept row whose geometry, class and direction an earlier kept row has.

    A hash of the geometry stands for it in the window; rows that aren't kept spread by their ordinal.
    """
    key = F.when(F.col(kept), F.xxhash64("parts")).otherwise(F.col("feature_ordinal"))
    roads = roads.withColumn("_key", key)
    by = Window.partitionBy(kept, "_key", low("highway"), F.col("dir.direction")).orderBy("feature_ordinal")
    return roads.withColumn("duplicate", F.col(kept) & (F.row_number().over(by) > 1)).drop("_key")


def judged(features: DataFrame, options: Options = Options()) -> DataFrame:
    """All features with ``exclude_reason`` (null if kept) and the normalised columns."""
    rows = lineal(with_tags(features)).withColumns({"dir": direction(), "spd": speed(), "length_m": length_m(F.col("parts"))})
    rows = rows.withColumn("length_m", F.when(F.size("parts") > 0, F.col("length_m")))
    bad_length = F.coalesce(~(F.col("length_m") >= options.min_length_m) | F.isnan("length_m") | (F.col("length_m") == float("inf")), F.lit(True))
    reason = F.coalesce(class_reason(options), access_reason(options), F.col("geometry_reason"), F.when(bad_length, "too_short"))
    rows = dedupe_geometry(rows.withColumn("exclude_reason", reason).withColumn("kept", F.col("exclude_reason").isNull()))
    return rows.withColumn("exclude_reason", F.coalesce("exclude_reason", F.when(F.col("duplicate"), "duplicate_geometry"))).drop("kept", "duplicate")


def clean(features: DataFrame, options: Options = Options()) -> DataFrame:
    """The kept roads in the 16-column schema, with ``parts``; see ``require_rows`` for an empty result."""
    return projected(judged(features, options))


def projected(rows: DataFrame) -> DataFrame:
    kept = rows.where("exclude_reason IS NULL")
    bridge, tunnel = truthy(F.col("bridge")), truthy(F.col("tunnel"))
    return kept.select(
        F.coalesce("osm_id", F.col("feature_ordinal").cast("string")).alias("road_id"),
        "name",
        "ref",
        low("highway").alias("road_class"),
        F.col("dir.direction").alias("oneway"),
        F.col("spd.kph").alias("speed_kph"),
        lane_count(F.col("dir.direction")).alias("lanes"),
        bridge.alias("bridge"),
        tunnel.alias("tunnel"),
        z_level().alias("z_level"),
        effective_access().alias("access"),
        "service",
        "surface",
        F.col("highway").alias("osm_highway"),
        F.col("maxspeed").alias("source_maxspeed"),
        "length_m",
        "parts",
    )


def require_rows(roads: DataFrame) -> DataFrame:
    """Raise if nothing is left to build from."""
    if roads.isEmpty():
        raise ValueError("no drivable roads are left")
    return roads


def clean_report(rows: DataFrame) -> DataFrame:
    """One row of counts over ``judged`` rows: in, out, filtered, normalisations, by reason and by class."""
    kept = F.col("exclude_reason").isNull()
    sums = rows.agg(
        F.count("*").alias("input"),
        F.count_if(kept).alias("output"),
        F.count_if(~kept).alias("filtered"),
        F.count_if(F.col("from_collection") & (kept | F.col("exclude_reason").isin("too_short", "duplicate_geometry"))).alias("collections"),
        F.count_if(kept & F.col("spd.from_default")).alias("default_speed"),
        F.count_if(kept & F.col("spd.mph")).alias("mph"),
        F.count_if(kept & F.col("dir.implied")).alias("implied_oneway"),
        F.count_if(kept & (F.col("dir.direction") == "reverse")).alias("reverse"),
        F.count_if(F.col("exclude_reason") == "duplicate_geometry").alias("duplicates"),
    )
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    reasons = rows.where(~kept).groupBy("exclude_reason").agg(F.count("*").alias("n")).agg(entries("exclude_reason").alias("excluded_by_reason"))
    classes = rows.where(kept).groupBy(low("highway").alias("road_class")).agg(F.count("*").alias("n")).agg(entries("road_class").alias("output_by_class"))
    return sums.crossJoin(F.broadcast(reasons)).crossJoin(F.broadcast(classes))


def retention(rows: DataFrame) -> DataFrame:
    """(exclude_reason, n, retention), the most frequent reason first; retention is kept/max(1, in)."""
    sums = rows.agg((F.count_if(F.col("exclude_reason").isNull()) / F.greatest(F.lit(1), F.count("*"))).alias("retention"))
    reasons = rows.where("exclude_reason IS NOT NULL").groupBy("exclude_reason").agg(F.count("*").alias("n"))
    return reasons.crossJoin(F.broadcast(sums)).orderBy(F.desc("n"), "exclude_reason")
