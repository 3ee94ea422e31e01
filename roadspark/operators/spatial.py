"""Spatial queries on the network: matching, poses, slices, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions.columns import geodesic, neighbours, stations
from roadspark.functions.tables import stored
from roadspark.operators.topology import in_leaves, leaf_cells, point_at, sub_line

#: Metres that a full turn against the heading costs twice.
HEADING_WEIGHT = 5.0

#: Points from which on those of a cell are dealt into blocks of as many.
BLOCK = 65_536


def match_points(points: DataFrame, edges: DataFrame, k: int = 5, radius: float = 100.0, enabled: DataFrame | None = None) -> DataFrame:
    """The ``k`` best edges within ``radius`` of each point: (point_id, edge, offset_m, x, y, lateral_m, heading_diff, score, rank).

    ``points`` has (point_id, x, y) and may have ``heading``.  Score is the distance plus a weight times 1 - cos of
    the heading difference; each edge counts with its best segment.  ``enabled`` (edge) is a mask that holds before
    ranking.  Segments are spread over the grid cells (of ``radius``, smaller ones where segments crowd) that they touch, points over those that a
    box of ``radius`` around touches.  Where very many points ask a cell, they are dealt into blocks and its segments, which are few then, go to each.
    """
    if enabled is not None:
        edges = edges.join(enabled.select("edge"), "edge", "left_semi")
    segs = edges.select("edge", stations(F.col("points")).alias("at"), F.posexplode(neighbours(F.col("points"))).alias("idx", "p"))
    segs = segs.select("edge", "idx", F.get("at", F.col("idx")).alias("start_s"), "p.a", "p.b", F.lit(0).alias("z_level"))
    for axis in "xy":
        segs = segs.withColumns({f"low_{axis}": F.least(F.col("a")[axis], F.col("b")[axis]), f"high_{axis}": F.greatest(F.col("a")[axis], F.col("b")[axis])})
    leaf, splits = ["size", "cx", "cy"], []
    segs = leaf_cells(segs.dropna(subset=["low_x", "low_y"]), radius, splits).select("edge", "idx", "start_s", "a", "b", *leaf)
    if "heading" not in points.columns:
        points = points.withColumn("heading", F.lit(None).cast("double"))
    asks = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"), "heading", F.lit(0).alias("z_level")).dropna(subset=["px", "py"])
    reach = radius * (1 + 1e-9)
    asks = asks.withColumns({f"low_{axis}": F.col(f"p{axis}") - reach for axis in "xy"} | {f"high_{axis}": F.col(f"p{axis}") + reach for axis in "xy"})
    asks = in_leaves(asks, radius, splits).select("point_id", "px", "py", "heading", *leaf)
    busy = stored(asks.groupBy(*leaf).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(*leaf, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "busy")
    if busy.isEmpty():
        near = asks.join(segs, leaf)
    else:
        dealt = asks.join(busy, leaf, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("point_id"), F.col("blocks")), F.lit(0).cast("long"))).drop("blocks")
        copied = segs.join(busy, leaf, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks"), F.lit(1)).cast("long") - 1))).drop("blocks")
        near = dealt.join(copied, [*leaf, "block"])
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    along = (F.col("px") - F.col("a.x")) * dx + (F.col("py") - F.col("a.y")) * dy
    near = near.withColumn("t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(along / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)))))
    near = near.withColumns({"x": F.col("a.x") + F.col("t") * dx, "y": F.col("a.y") + F.col("t") * dy})
    near = near.withColumn("lateral_m", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).where(F.col("lateral_m") <= radius)
    turn = F.col("heading") - F.atan2(dy, dx)
    diff = F.abs(F.atan2(F.sin(turn), F.cos(turn)))
    near = near.withColumn("heading_diff", diff).withColumn("score", F.col("lateral_m") + F.coalesce(HEADING_WEIGHT * (1 - F.cos("heading_diff")), F.lit(0.0)))
    offset = F.col("start_s") + F.col("t") * F.hypot(dx, dy)
    best = near.groupBy("point_id", "edge").agg(F.min(F.struct("score", "lateral_m", "idx", offset.alias("offset_m"), "x", "y", "heading_diff")).alias("m"))
    rows = best.select("point_id", "edge", "m.offset_m", "m.x", "m.y", "m.lateral_m", "m.heading_diff", "m.score")
    return pick_match(rows, k)


def pick_match(matches: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` best matches of each point by score, lateral distance and edge, with ``rank`` from 1."""
    by = Window.partitionBy("point_id").orderBy("score", "lateral_m", "edge")
    return matches.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def match_confidence(matches: DataFrame, radius: float = 100.0) -> DataFrame:
    best = F.min("score").over(Window.partitionBy("point_id"))
    return matches.withColumn("confidence", F.exp(-(F.col("score") - best) / 5) * F.exp(-F.col("lateral_m") / max(1.0, 0.25 * radius)))


def pose(rows: DataFrame) -> DataFrame:
    """Add ``pose`` (x, y, heading) of ``offset_m`` along ``points``, ``lateral_m`` to the left; the offset is held inside."""
    at = stations(F.col("points"))
    rows = rows.withColumn("_at", at).withColumn("_s", F.least(F.greatest(F.col("offset_m"), F.lit(0.0)), F.element_at("_at", -1)))
    k = F.greatest(F.lit(1), F.least(F.size(F.filter("_at", lambda v: v <= F.col("_s"))), F.size("_at") - 1))
    a, b = F.get("points", k - 1), F.get("points", k)
    heading = F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    p = point_at(F.col("points"), F.col("_at"), F.col("_s"))
    left = F.coalesce("lateral_m", F.lit(0.0))
    return rows.withColumn("pose", F.struct((p["x"] - F.sin(heading) * left).alias("x"), (p["y"] + F.cos(heading) * left).alias("y"), heading.alias("heading"))).drop("_at", "_s")


def locate_lonlat(rows: DataFrame) -> DataFrame:
    """Add ``place`` (x = lon, y = lat) of ``offset_m`` along ``points`` in degrees; ``reversed`` rows run from the far end."""
    rows = rows.withColumn("_at", stations(F.col("points"), geodesic))
    total = F.element_at("_at", -1)
    s = F.when(F.coalesce("reversed", F.lit(False)), total - F.col("offset_m")).otherwise(F.col("offset_m"))
    return rows.withColumn("place", point_at(F.col("points"), F.col("_at"), F.least(F.greatest(s, F.lit(0.0)), total))).drop("_at")


def slice_line(points: Column, low: Column, high: Column) -> Column:
    """The part of a polyline between two stations."""
    return sub_line(points, stations(points), low, high)


def nearby_hot_edges(vehicles: DataFrame, edges: DataFrame, hot: DataFrame, radius: float = 2000.0, most: int = 64) -> DataFrame:
    """Hot edges near each vehicle (point_id, x, y): nearest first, with occupancy ratio, speed and travel time.

    ``hot`` has (edge, vehicles, effective, mean_speed); without a mean the speed is max(0.5, limit times free share).
    """
    near = match_points(vehicles, edges.join(hot.select("edge"), "edge", "left_semi"), most, radius)
    rows = near.select("point_id", "edge", "lateral_m", "rank").join(hot, "edge").join(edges.select("edge", "length_m", "speed_limit_mps"), "edge")
    ratio = F.col("vehicles") / F.greatest(F.col("effective"), F.lit(1))
    speed = F.coalesce("mean_speed", F.greatest(F.lit(0.5), F.col("speed_limit_mps") * (1 - ratio)))
    return rows.withColumns({"occupancy_ratio": ratio, "speed_mps": speed}).withColumn("travel_s", F.col("length_m") / F.col("speed_mps"))


def bounds(rows: DataFrame, points: str = "points") -> DataFrame:
    """One row (west, south, east, north) of all points; null where there is none."""
    each = lambda fn, axis: fn(F.transform(points, lambda p: p[axis]))
    return rows.agg(F.min(each(F.array_min, "x")).alias("west"), F.min(each(F.array_min, "y")).alias("south"), F.max(each(F.array_max, "x")).alias("east"), F.max(each(F.array_max, "y")).alias("north"))


