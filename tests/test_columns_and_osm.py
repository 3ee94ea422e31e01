import random

import pytest
from pyspark.sql import functions as F

from roadspark.functions.columns import fnv1a64, from_utm, haversine, to_utm
from roadspark.operators import osm

#: Expected outcomes of the 13 sample features: tags, geometry type, outcome (direction, km/h, lanes) or reason.
FEATURES = [
    ({"highway": "primary"}, "LineString", ("both", 60.0, 2)),
    ({"highway": "footway"}, "LineString", "non_drivable_class"),
    ({"highway": "service"}, "LineString", "service_disabled"),
    ({"highway": "primary", "access": "private"}, "LineString", "access_restricted"),
    ({"highway": "motorway"}, "LineString", ("forward", 100.0, 2)),
    ({"highway": "residential", "maxspeed": "30 mph"}, "LineString", ("both", 48.28032, 1)),
    ({"highway": "tertiary", "junction": "roundabout"}, "LineString", ("forward", 40.0, 1)),
    ({"highway": "secondary", "oneway": "-1"}, "LineString", ("reverse", 50.0, 1)),
    ({"highway": "unclassified"}, "GeometryCollection", ("both", 30.0, 1)),
    ({"highway": "primary"}, "short", "too_short"),
    ({"highway": "primary"}, "copy", "duplicate_geometry"),
    ({"highway": "track"}, "LineString", "track_disabled"),
    ({"highway": "secondary", "maxspeed": "50;60", "lanes": "4", "lanes_forward": "3", "lanes_backward": "2"}, "LineString", ("both", 50.0, 2)),
]


def features(spark):
    rows = []
    for k, (tags, kind, _) in enumerate(FEATURES, 1):
        lat = 0.01 * (1 if kind == "copy" else k)
        line = [(0.0, lat), (1e-6 if kind == "short" else 0.001, lat)]
        parts = [[{"x": x, "y": y} for x, y in line]]
        rows.append((k, str(k), *(tags.get(t) for t in osm.TAGS[1:]), kind if kind[0].isupper() else "LineString", parts))
    names = ", ".join(f"{t} string" for t in osm.TAGS)
    return spark.createDataFrame(rows, f"feature_ordinal long, {names}, geom_type string, parts array<array<struct<x:double,y:double>>>")


def test_cleaning_golden(spark):
    judged = osm.judged(features(spark))
    reasons = {r.feature_ordinal: r.exclude_reason for r in judged.collect()}
    roads = {r.road_id: (r.oneway, r.speed_kph, r.lanes) for r in osm.projected(judged).collect()}
    for k, (_, _, want) in enumerate(FEATURES, 1):
        if isinstance(want, str):
            assert reasons[k] == want
        else:
            assert roads[str(k)] == (want[0], pytest.approx(want[1]), want[2])
    report = osm.clean_report(judged).first()
    assert (report.input, report.output, report.filtered) == (13, 7, 6)
    assert (report.collections, report.default_speed, report.mph, report.implied_oneway, report.reverse) == (1, 5, 1, 2, 1)
    assert osm.clean(features(spark), osm.Options(include_service=True)).count() == 8


def plain_fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return str(h)


def test_stable_id_is_fnv1a(spark):
    rng = random.Random(1)
    texts = ["", "road:a:0", "é中🎉"] + ["".join(rng.choice("abc:019é") for _ in range(rng.randrange(30))) for _ in range(100)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a64(F.col("t")).alias("h")).collect()
    assert all(r.h == plain_fnv(r.t) for r in rows)


def test_utm_known_point_and_round_trip(spark):
    row = spark.createDataFrame([(3.0, 0.0), (9.0, 48.0), (-70.5, -33.4)], "lon double, lat double")
    zone = (F.floor((F.col("lon") + 180) / 6) + 1).cast("int")
    out = row.withColumn("p", to_utm(F.col("lon"), F.col("lat"), zone, F.col("lat") < 0)).withColumn("b", from_utm(F.col("p.x"), F.col("p.y"), zone, F.col("lat") < 0)).collect()
    assert (out[0].p.x, out[0].p.y) == (pytest.approx(500000, abs=1e-6), pytest.approx(0, abs=1e-6))
    assert (out[1].p.x, out[1].p.y) == (pytest.approx(500000, abs=1e-6), pytest.approx(5316300.1, abs=200))
    assert all(r.b.x == pytest.approx(r.lon, abs=2e-8) and r.b.y == pytest.approx(r.lat, abs=2e-8) for r in out)


def test_haversine(spark):
    d = spark.range(1).select(haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first().d
    assert d == pytest.approx(111195.08, abs=0.1)
