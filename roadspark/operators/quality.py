"""Quality of a road graph: issues of edges, turns and nodes, counts and a score.

An issue is (code, severity, subject, location); location is null where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions.columns import planar


def issue(code: str, severity: str, subject: Column, location: Column | None = None) -> Column:
    place = F.lit(None).cast("struct<x:double,y:double>") if location is None else location
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), place.alias("location"))


def _listed(df: DataFrame, issues: list[tuple[Column, Column]]) -> DataFrame:
    """One row for each condition that holds."""
    found = F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(True)), i) for cond, i in issues)), lambda i: i.isNotNull())
    return df.select(F.explode(found).alias("i")).select("i.*")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def check_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Issues of single edges; an edge without its nodes has that issue only."""
    have = lambda end: nodes.select(F.col("node").alias(f"{end}_node"), F.lit(True).alias(f"has_{end}"))
    rows = edges.join(have("from"), "from_node", "left").join(have("to"), "to_node", "left")
    lost = F.col("has_from").isNull() | F.col("has_to").isNull()
    ok, e = ~lost, F.col("edge")
    return _listed(
        rows,
        [
            (lost, issue("INVALID_EDGE_NODE", "fatal", e)),
            (ok & (F.col("from_node") == F.col("to_node")), issue("SELF_LOOP", "warning", e)),
            (ok & ~(_finite("length_m") & (F.col("length_m") > 0)), issue("INVALID_EDGE_LENGTH", "fatal", e)),
            (ok & ~(_finite("speed_limit_mps") & (F.col("speed_limit_mps") > 0)), issue("INVALID_SPEED_LIMIT", "error", e)),
            (ok & (F.coalesce("lane_count", F.lit(0)) < 1), issue("INVALID_LANE_COUNT", "error", e)),
            (ok & (F.coalesce(F.size("points"), F.lit(0)) < 2), issue("INVALID_EDGE_GEOMETRY", "fatal", e)),
        ],
    )


def check_geometry_ends(edges: DataFrame, nodes: DataFrame, snap: float = 0.5) -> DataFrame:
    """Edges whose line ends farther than max(1e-4, snap/10) from their nodes."""
    at = lambda end: nodes.select(F.col("node").alias(f"{end}_node"), F.struct("x", "y").alias(f"{end}_point"))
    rows = edges.join(at("from"), "from_node").join(at("to"), "to_node")
    far = F.greatest(planar(F.col("points")[0], F.col("from_point")), planar(F.element_at("points", -1), F.col("to_point")))
    return _listed(rows, [(far > max(1e-4, 0.1 * snap), issue("GEOMETRY_TOPOLOGY_MISMATCH", "error", F.col("edge"), F.col("from_point")))])


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Edges between the same nodes and of the same road as the first edge there."""
    first = F.min_by("road_id", "edge").alias("road_id")
    heads = edges.groupBy("from_node", "to_node").agg(F.min("edge").alias("first_edge"), first)
    rows = edges.join(heads, ["from_node", "to_node", "road_id"]).where("edge <> first_edge")
    return _listed(rows, [(F.lit(True), issue("DUPLICATE_EDGE", "warning", F.col("edge")))])


def check_turns(turns: DataFrame, edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("edge").alias("from_edge"), F.col("to_node").alias("in_node"))
    b = edges.select(F.col("edge").alias("to_edge"), F.col("from_node").alias("out_node"))
    rows = turns.join(a, "from_edge", "left").join(b, "to_edge", "left")
    lost, name = F.col("in_node").isNull() | F.col("out_node").isNull(), F.concat_ws(">", "from_edge", "to_edge")
    return _listed(
        rows,
        [
            (lost, issue("INVALID_TURN_EDGE", "fatal", name)),
            (~lost & (F.col("in_node") != F.col("out_node")), issue("DISCONNECTED_TURN", "error", name)),
            (~lost & ~(_finite("penalty_s") & (F.col("penalty_s") >= 0)), issue("INVALID_TURN_PENALTY", "error", name)),
        ],
    )


def check_sequences(sequences: DataFrame, edges: DataFrame, most: int = 99_999) -> DataFrame:
    """Issues of edge lists (seq_id, edges): 3 to 256 connected edges each, ``most`` in all."""
    steps = sequences.select("seq_id", F.posexplode("edges").alias("pos", "edge")).join(edges.select("edge", "from_node", "to_node"), "edge", "left")
    by = Window.partitionBy("seq_id").orderBy("pos")
    joined = F.coalesce((F.lag("to_node").over(by) == F.col("from_node")) | (F.col("pos") == 0), F.lit(False)) & F.col("to_node").isNotNull()
    state = steps.withColumn("ok", joined).groupBy("seq_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"))
    bad = _listed(state, [(~F.col("ok") | ~F.col("n").between(3, 256), issue("INVALID_TURN_SEQUENCE", "error", F.col("seq_id")))])
    total = state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return bad.unionByName(_listed(total, [(F.col("n") > most, issue("TURN_SEQUENCE_BUDGET", "fatal", F.lit("all")))]))


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, roads) of all nodes."""
    ends = edges.select(F.col("from_node").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"), "road_id").unionByName(edges.select(F.col("to_node").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"), "road_id"))
    by_road = ends.groupBy("node", "road_id").agg(F.sum("in").alias("in"), F.sum("out").alias("out"))
    sums = by_road.groupBy("node").agg(F.sum("in").alias("in_degree"), F.sum("out").alias("out_degree"), F.count("*").alias("roads"))
    return nodes.join(sums, "node", "left").fillna(0, ["in_degree", "out_degree", "roads"])


def check_nodes(degrees: DataFrame) -> DataFrame:
    """Issues of nodes from ``node_degree`` rows with x and y."""
    place, n = F.struct("x", "y"), F.col("node")
    alone = (F.col("in_degree") == 0) & (F.col("out_degree") == 0)
    return _listed(
        degrees,
        [
            (alone, issue("ORPHAN_NODE", "warning", n, place)),
            (~alone & (F.col("roads") == 1), issue("DANGLING_ENDPOINT", "info", n, place)),
            (~alone & (F.col("in_degree") == 0), issue("NO_INCOMING_EDGE", "warning", n, place)),
            (~alone & (F.col("out_degree") == 0), issue("NO_OUTGOING_EDGE", "warning", n, place)),
        ],
    )


def global_checks(nodes: DataFrame, edges: DataFrame, component_summary: DataFrame, crs: str | None) -> DataFrame:
    one = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(component_summary)
    return _listed(
        one,
        [
            (F.lit(not crs), issue("MISSING_RUNTIME_CRS", "error", F.lit("map"))),
            (F.col("nodes") == 0, issue("EMPTY_NODE_SET", "fatal", F.lit("map"))),
            (F.col("edges") == 0, issue("EMPTY_EDGE_SET", "fatal", F.lit("map"))),
            (F.col("components") > 1, issue("DISCONNECTED_NETWORK", "warning", F.lit("map"))),
        ],
    )


def report(nodes: DataFrame, edges: DataFrame, component_summary: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: figures of the graph, issues by severity, and whether one is fatal."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "error", "fatal")]
    one = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(component_summary)
    return one.crossJoin(issues.agg(*counts)).withColumn("has_fatal", F.col("fatal") > 0)


def health_score(counts: DataFrame) -> DataFrame:
    """Add ``score`` (100 less 30 a fatal, 8 an error, 0.8 a warning; 0 at least) and ``health``."""
    score = F.greatest(F.lit(0), F.floor(100 - 30 * F.col("fatal") - 8 * F.col("error") - 0.8 * F.col("warning") + 0.5)).cast("int")
    return counts.withColumn("score", score).withColumn("health", F.when(score >= 90, "good").when(score >= 70, "review").otherwise("risk"))
