"""Topology: source roads to nodes and directed edges.

``roads`` has (road, source_id, road_class, direction, speed_limit_mps, lane_count, z_level, points); ``road`` is the
order of creation and points are in metres.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions.columns import fnv1a64, neighbours, path_length, planar, stations
from roadspark.functions.tables import stored

POINTS = "array<struct<x:double,y:double>>"


def cumulative_length(roads: DataFrame) -> DataFrame:
    """Add ``stations``: the running length at each point."""
    return roads.withColumn("stations", stations(F.col("points")))


def segments(roads: DataFrame) -> DataFrame:
    """One row per segment: (road, idx, z_level, a, b, start_s, length); those up to 1e-8 long are left out."""
    rows = cumulative_length(roads).select("road", "z_level", "stations", F.posexplode(neighbours(F.col("points"))).alias("idx", "p"))
    rows = rows.select("road", "idx", "z_level", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.get("stations", F.col("idx")).alias("start_s"))
    return rows.withColumn("length", planar(F.col("a"), F.col("b"))).where("length > 1e-8")


#: Segments from which on a cell is split, into so many parts each way, and how often at most.
CROWDED, SPLIT, MOST_SPLITS = 4096, 4, 8


def cut(rows: DataFrame, size: float) -> DataFrame:
    """Rows of boxes in cells (cx, cy) of ``size`` once for each of the cell's parts that they touch; the cell becomes (in_x, in_y)."""
    rows = rows.withColumns({"in_x": F.col("cx"), "in_y": F.col("cy")})
    for a in "xy":
        first = F.greatest(F.floor(F.col(f"low_{a}") / (size / SPLIT)), F.col(f"in_{a}") * SPLIT)
        last = F.least(F.floor(F.col(f"high_{a}") / (size / SPLIT)), F.col(f"in_{a}") * SPLIT + SPLIT - 1)
        rows = rows.withColumn(f"c{a}", F.explode(F.sequence(first, last)))
    return rows


def spread(boxes: DataFrame, cell: float) -> DataFrame:
    """``boxes`` once for each cell (cx, cy) of ``cell`` that they touch."""
    spans = {a: F.sequence(F.floor(F.col(f"low_{a}") / cell), F.floor(F.col(f"high_{a}") / cell)) for a in "xy"}
    return boxes.withColumn("cx", F.explode(spans["x"])).withColumn("cy", F.explode(spans["y"]))


def in_leaves(boxes: DataFrame, cell: float, splits: list[DataFrame]) -> DataFrame:
    """``boxes`` (low_x, low_y, high_x, high_y, z_level) once for each leaf that they touch: (size, cx, cy), where ``splits`` are the cells that
    ``leaf_cells`` split for others."""
    at, size, leaves, rows = ["z_level", "cx", "cy"], float(cell), [], spread(boxes, cell)
    for eased in splits:
        leaves.append(rows.join(eased, at, "left_anti").withColumn("size", F.lit(size)))
        rows = cut(rows.join(eased, at, "left_semi"), size).drop("in_x", "in_y")
        size /= SPLIT
    leaves.append(rows.withColumn("size", F.lit(size)))
    return reduce(DataFrame.unionByName, leaves)


def leaf_cells(boxes: DataFrame, cell: float, splits: list[DataFrame] | None = None) -> DataFrame:
    """``boxes`` (low_x, low_y, high_x, high_y, z_level) once for each cell that they touch: (size, cx, cy).

    Cells of ``cell`` with more than ``CROWDED`` boxes are split, and so are their parts, where that halves the pairs at least (boxes that all lie across each
    other stay together).  So where short segments crowd cells are small, and each place lies in one cell.  Sizes are the first divided by powers of
    two, so the cells of a place nest exactly.  The cells that are split (z_level, cx, cy) are put into ``splits``, a table for each size.
    """
    at = ["z_level", "cx", "cy"]
    rows = spread(boxes, cell)
    size, leaves = float(cell), []
    for _ in range(MOST_SPLITS):
        crowded = stored(rows.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > CROWDED), "crowded")
        if crowded.isEmpty():
            break
        parts = cut(rows.join(crowded.drop("n"), at, "left_semi"), size)
        parts = stored(parts, "parts")
        work = parts.groupBy(*at, "in_x", "in_y").agg(F.count("*").alias("m")).groupBy("z_level", F.col("in_x").alias("cx"), F.col("in_y").alias("cy")).agg(F.sum(F.col("m") * F.col("m")).alias("work"))
        eased = stored(crowded.join(work, at).where(F.col("work") * 2 <= F.col("n") * F.col("n")).select(at), "eased")
        if splits is not None:
            splits.append(eased)
        leaves.append(rows.join(eased, at, "left_anti").withColumn("size", F.lit(size)))
        rows = parts.join(eased.select("z_level", F.col("cx").alias("in_x"), F.col("cy").alias("in_y")), ["z_level", "in_x", "in_y"], "left_semi").drop("in_x", "in_y")
        size /= SPLIT
    leaves.append(rows.withColumn("size", F.lit(size)))
    return reduce(DataFrame.unionByName, leaves)


def candidate_pairs(segs: DataFrame, cell: float = 100.0) -> DataFrame:
    """Pairs of segments whose boxes touch, on one level, not neighbours on one road.

    An equi-join on grid cells, which are smaller where segments crowd; a pair that shares several cells comes from the one that holds the lowest
    corner of what its boxes share.
    """
    ends = lambda fn, axis: fn(F.col("a")[axis], F.col("b")[axis])
    boxes = segs.withColumns({"low_x": ends(F.least, "x"), "low_y": ends(F.least, "y"), "high_x": ends(F.greatest, "x"), "high_y": ends(F.greatest, "y")})
    placed, place = leaf_cells(boxes, cell), ("size", "cx", "cy", "z_level")
    left = placed.toDF(*(c if c in place else f"i_{c}" for c in placed.columns))
    right = placed.toDF(*(c if c in place else f"j_{c}" for c in placed.columns))
    pairs = left.join(right, list(place))
    first = (F.col("i_road") < F.col("j_road")) | ((F.col("i_road") == F.col("j_road")) & (F.col("i_idx") + 1 < F.col("j_idx")))
    touch = F.lit(True)
    for axis in "xy":
        touch = touch & (F.col(f"i_low_{axis}") <= F.col(f"j_high_{axis}")) & (F.col(f"j_low_{axis}") <= F.col(f"i_high_{axis}"))
    lowest = (F.col("cx") == F.floor(F.greatest("i_low_x", "j_low_x") / F.col("size"))) & (F.col("cy") == F.floor(F.greatest("i_low_y", "j_low_y") / F.col("size")))
    kept = [f"{s}_{c}" for s in "ij" for c in ("road", "idx", "a", "b", "start_s", "length")]
    return pairs.where(first & touch & lowest).select(*kept)


def intersections(pairs: DataFrame) -> DataFrame:
    """Crossings: ``pairs`` with the station of the crossing on both roads (i_s, j_s); parallel ones have none."""
    dx, dy = F.col("i_b.x") - F.col("i_a.x"), F.col("i_b.y") - F.col("i_a.y")
    ex, ey = F.col("j_b.x") - F.col("j_a.x"), F.col("j_b.y") - F.col("j_a.y")
    ax, ay = F.col("j_a.x") - F.col("i_a.x"), F.col("j_a.y") - F.col("i_a.y")
    cross, eps = dx * ey - dy * ex, 1e-10
    rows = pairs.withColumn("cross", cross).where(F.abs("cross") > eps)
    rows = rows.withColumns({"t": (ax * ey - ay * ex) / F.col("cross"), "u": (ax * dy - ay * dx) / F.col("cross")})
    rows = rows.where(F.col("t").between(-eps, 1 + eps) & F.col("u").between(-eps, 1 + eps))
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    return rows.select("i_road", "j_road", (F.col("i_start_s") + clamp("t") * F.col("i_length")).alias("i_s"), (F.col("j_start_s") + clamp("u") * F.col("j_length")).alias("j_s"))


def split_points(roads: DataFrame, crossings: DataFrame) -> DataFrame:
    """(road, splits): ends and crossings in order of station; one within 1e-6 of the last kept is dropped."""
    ends = roads.select("road", F.explode(F.array(F.lit(0.0), path_length(F.col("points")))).alias("s"))
    at = ends.union(crossings.select("i_road", "i_s")).union(crossings.select("j_road", "j_s"))
    listed = at.groupBy("road").agg(F.array_sort(F.collect_list("s")).alias("all"))
    rest = F.slice("all", 2, F.size("all") - 1)
    kept = F.aggregate(rest, F.slice("all", 1, 1), lambda acc, s: F.when(s - F.element_at(acc, -1) > 1e-6, F.concat(acc, F.array(s))).otherwise(acc))
    return listed.select("road", kept.alias("splits"))


def point_at(points: Column, at: Column, s: Column) -> Column:
    """The point of a polyline at station ``s``; ``at`` holds the stations of its points."""
    k = F.greatest(F.lit(1), F.least(F.size(F.filter(at, lambda v: v <= s)), F.size(at) - 1))
    a, b, low, high = F.get(points, k - 1), F.get(points, k), F.get(at, k - 1), F.get(at, k)
    share = F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - low) / (high - low)))).otherwise(0.0)
    return F.struct((a["x"] + (b["x"] - a["x"]) * share).alias("x"), (a["y"] + (b["y"] - a["y"]) * share).alias("y"))


def sub_line(points: Column, at: Column, low: Column, high: Column, eps: float = 1e-7) -> Column:
    """The part of a polyline between two stations, with its inner points."""
    marked = F.zip_with(points, at, lambda p, s: F.struct(p.alias("p"), s.alias("s")))
    inner = F.transform(F.filter(marked, lambda m: (m["s"] > low + eps) & (m["s"] < high - eps)), lambda m: m["p"])
    return F.concat(F.array(point_at(points, at, low)), inner, F.array(point_at(points, at, high)))


def pieces(roads: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per piece between consecutive splits: ``roads`` with (piece, points)."""
    rows = cumulative_length(roads).join(splits, "road")
    spans = F.zip_with(F.slice("splits", 1, F.size("splits") - 1), F.slice("splits", 2, F.size("splits") - 1), lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    rows = rows.where(F.size("splits") > 1).select("*", F.posexplode(spans).alias("piece", "span"))
    line = sub_line(F.col("points"), F.col("stations"), F.col("span.low"), F.col("span.high"))
    return rows.withColumn("line", line).drop("points", "stations", "splits", "span").withColumnRenamed("line", "points")


#: Rounds after which snapping gives up.
MOST_ROUNDS = 100_000

#: Side of a cell as a share of the tolerance: any two places of a cell are within it, so a cell has one node at most.
CELL = 0.7


def _around(df: DataFrame, reach: int) -> DataFrame:
    """``df`` (cx, cy) once for each cell around: ``at_x``, ``at_y``."""
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    spread = df.withColumn("_i", F.explode(offsets)).withColumn("_j", F.explode(offsets))
    return spread.withColumns({"at_x": F.col("cx") + F.col("_i"), "at_y": F.col("cy") + F.col("_j")}).drop("_i", "_j")


def _near(df: DataFrame, made: DataFrame, tolerance: float, how: str) -> DataFrame:
    """``df`` (x, y, cx, cy) with the nodes ``made`` (node_x, node_y, made_by, cx, cy) within the tolerance of each place."""
    there = _around(made, 2).select("node_x", "node_y", "made_by", "at_x", "at_y")
    dx, dy = F.col("x") - F.col("node_x"), F.col("y") - F.col("node_y")
    return df.join(there, (F.col("cx") == F.col("at_x")) & (F.col("cy") == F.col("at_y")) & (F.sqrt(dx * dx + dy * dy) <= tolerance), how)


def first_independent(places: DataFrame, tolerance: float) -> DataFrame:
    """(node_x, node_y, made_by, cx, cy): the places (x, y, made_by, cx, cy) that make a node when all are met in the order of ``made_by``.

    A place makes a node if no node made before lies within the tolerance.  A round settles the first open place of each cell whose
    neighbouring cells have no earlier open place, and takes all open places near the new nodes out, so a round meets each open place once and
    no pairs of a crowded cell.  Rounds are as many as such waits follow one another; places that stand alone are settled in the first.
    """
    open_places, made = places, None
    for _ in range(MOST_ROUNDS):
        first = open_places.groupBy("cx", "cy").agg(F.min(F.struct("made_by", "x", "y")).alias("f")).select("cx", "cy", "f.*")
        others = _around(first.select("cx", "cy", F.col("made_by").alias("other")), 2).groupBy(F.col("at_x").alias("cx"), F.col("at_y").alias("cy")).agg(F.min("other").alias("earliest"))
        ready = first.join(others, ["cx", "cy"]).where(F.col("made_by") <= F.col("earliest"))
        new = stored(ready.select(F.col("x").alias("node_x"), F.col("y").alias("node_y"), "made_by", "cx", "cy"), "nodes")
        made = new if made is None else stored(made.unionByName(new), "nodes")
        open_places = stored(_near(open_places, new, tolerance, "left_anti"), "open")
        if open_places.isEmpty():
            return made
    raise RuntimeError(f"nodes did not settle in {MOST_ROUNDS} rounds")


def snap_nodes(parts: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(road, piece, end, node_x, node_y, first_road, first_piece, first_end): the node of each piece's ends (0 from, 1 to).

    A point takes the nearest node made before it within the tolerance, else makes one, in the order of road, piece and end; of equally near
    nodes that of the last cell of the tolerance's size, and in it the last made.  Only the first point of a place can make a node there, so
    places decide (``first_independent``); a place has few nodes near, as nodes lie apart, and each point picks from those made before it.
    """
    tolerance = max(tolerance, 1e-6)
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("points")[0].alias("p")), F.struct(F.lit(1).alias("end"), F.element_at("points", -1).alias("p")))
    points = parts.select("road", "piece", F.explode(ends).alias("e")).select("road", "piece", "e.end", "e.p.x", "e.p.y")
    cell = lambda c: F.floor(F.col(c) / (tolerance * CELL))
    places = points.groupBy("x", "y").agg(F.min(F.struct("road", "piece", "end")).alias("made_by"))
    places = stored(places.withColumns({"cx": cell("x"), "cy": cell("y")}), "places")
    made = first_independent(places, tolerance)
    far = F.sqrt((F.col("x") - F.col("node_x")) ** 2 + (F.col("y") - F.col("node_y")) ** 2)
    own = lambda c: -F.floor(F.col(c) / tolerance)
    choice = F.struct(far.alias("far"), own("node_x").alias("i"), own("node_y").alias("j"), "made_by", "node_x", "node_y")
    nodes = _near(places.drop("made_by"), made, tolerance, "inner").groupBy("x", "y").agg(F.collect_list(choice).alias("nodes"))
    met = points.join(nodes, ["x", "y"]).withColumn("me", F.struct("road", "piece", "end"))

    def nearer(best: Column, c: Column) -> Column:
        order = lambda s: F.struct(s["far"], s["i"], s["j"])
        better = best.isNull() | (order(c) < order(best)) | ((order(c) == order(best)) & (c["made_by"] > best["made_by"]))
        return F.when((c["made_by"] <= F.col("me")) & better, c).otherwise(best)

    kind = nodes.schema["nodes"].dataType.elementType
    picked = met.withColumn("n", F.aggregate("nodes", F.lit(None).cast(kind), nearer))
    return picked.select("road", "piece", "end", "n.node_x", "n.node_y", F.col("n.made_by.road").alias("first_road"), F.col("n.made_by.piece").alias("first_piece"), F.col("n.made_by.end").alias("first_end"))


def snap_ends(parts: DataFrame, snapped: DataFrame) -> DataFrame:
    """``parts`` with (from_x, from_y, to_x, to_y, from_key, to_key), end points moved to the nodes, and ``length_m``."""
    key = F.struct("first_road", "first_piece", "first_end")
    node = lambda end, name: snapped.where(F.col("end") == end).select("road", "piece", F.struct(F.col("node_x").alias("x"), F.col("node_y").alias("y")).alias(f"{name}_point"), key.alias(f"{name}_key"))
    rows = parts.join(node(0, "from"), ["road", "piece"]).join(node(1, "to"), ["road", "piece"])
    inner = F.slice("points", 2, F.greatest(F.size("points") - 2, F.lit(0)))
    rows = rows.withColumn("points", F.concat(F.array("from_point"), inner, F.array("to_point")))
    return rows.withColumn("length_m", path_length(F.col("points")))


def collapse_filter(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, issues): pieces whose ends fell together become issues; those up to 1e-6 long vanish."""
    same = F.col("from_key") == F.col("to_key")
    issues = rows.where(same).select("source_id", F.lit("SNAP_COLLAPSED_EDGE").alias("code"), F.col("from_point").alias("location"))
    return rows.where(~same & (F.col("length_m") > 1e-6)), issues


def directed_edges(rows: DataFrame) -> DataFrame:
    """One row per direction: forward as drawn, reverse with the points turned; at least one lane."""
    way = lambda reverse: F.struct(
        F.lit(reverse).alias("geometry_reversed"),
        F.col("to_key" if reverse else "from_key").alias("from_key"),
        F.col("from_key" if reverse else "to_key").alias("to_key"),
        (F.reverse("points") if reverse else F.col("points")).alias("points"),
    )
    ways = F.filter(F.array(way(False), way(True)), lambda w: F.when(w["geometry_reversed"], F.col("direction").isin("both", "reverse")).otherwise(F.col("direction").isin("both", "forward")))
    rows = rows.withColumn("way", F.explode(ways))
    base = F.concat_ws(":", "source_id", F.col("piece").cast("string"))
    return rows.select(
        fnv1a64(F.concat(F.lit("edge:"), base, F.when(F.col("way.geometry_reversed"), ":r").otherwise(":f"))).alias("edge_id"),
        fnv1a64(F.concat(F.lit("road:"), base)).alias("road_id"),
        "road",
        "piece",
        "way.*",
        "length_m",
        "speed_limit_mps",
        F.greatest("lane_count", F.lit(1)).alias("lane_count"),
        "z_level",
        "source_id",
        "road_class",
    )


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in ``order``: sorted ranges are counted first, then numbered inside."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), name)
    sums = placed.groupBy("_range").agg(F.count("*").alias("n"))
    sums = sums.select("_range", (F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("_k", inside).join(sums, "_range").withColumn(name, F.col("_k") + F.col("_before")).drop("_k", "_before", "_range")


def used_nodes(snapped: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, node_id, x, y, key): nodes that an edge uses, numbered in the order of their creation."""
    used = edges.select(F.col("from_key").alias("key")).union(edges.select("to_key"))
    all_nodes = snapped.select(F.struct("first_road", "first_piece", "first_end").alias("key"), F.col("node_x").alias("x"), F.col("node_y").alias("y")).distinct()
    kept = all_nodes.join(used, "key", "left_semi").select("key.*", "x", "y")
    order = ["first_road", "first_piece", "first_end"]
    milli = lambda c: F.round(F.col(c) * 1000).cast("long").cast("string")
    out = numbered(kept, order, "node")
    return out.select("node", fnv1a64(F.concat_ws(":", F.lit("node"), milli("x"), milli("y"))).alias("node_id"), "x", "y", F.struct(*order).alias("key"))


def build(roads: DataFrame, tolerance: float = 0.5, cell: float = 100.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, issues) of ``roads``."""
    parts = stored(pieces(roads, split_points(roads, intersections(candidate_pairs(segments(roads), cell)))), "pieces")
    snapped = stored(snap_nodes(parts, tolerance), "snapped")
    kept, issues = collapse_filter(snap_ends(parts, snapped))
    ways = stored(directed_edges(kept), "ways")
    nodes = stored(used_nodes(snapped, ways), "nodes")
    edges = numbered(ways, ["road", "piece", "geometry_reversed"], "edge")
    for end in ("from", "to"):
        edges = edges.join(nodes.select(F.col("key").alias(f"{end}_key"), F.col("node").alias(f"{end}_node")), f"{end}_key")
    return nodes.drop("key"), edges.drop("from_key", "to_key", "road", "piece"), issues


def find_twin(edges: DataFrame) -> DataFrame:
    """(edge, twin): the opposite edge, one of the same road first, then the lowest."""
    other = edges.select(F.col("edge").alias("twin"), F.col("from_node").alias("to_node"), F.col("to_node").alias("from_node"), F.col("road_id").alias("twin_road"))
    pairs = edges.select("edge", "from_node", "to_node", "road_id").join(other, ["from_node", "to_node"]).where("edge <> twin")
    best = F.min(F.struct((F.col("road_id") != F.col("twin_road")).alias("other_road"), "twin")).alias("best")
    return pairs.groupBy("edge").agg(best).select("edge", "best.twin")
