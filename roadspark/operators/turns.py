"""Turn rules: resolution, generated penalties, via sequences, and OSM restriction relations.

``edges`` has (edge, from_node, to_node, source_id, road_id, road_class, points).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Penalties in seconds, and ranks of road classes (5 for others).
U_TURN, SHARP_LEFT, MINOR_TO_MAJOR = 5.0, 2.0, 3.0
SHARP = math.radians(100)
MINOR, MAJOR = 4, 2
RANKS = {
    "motorway": 1, "motorway_link": 1, "trunk": 1, "trunk_link": 1, "primary": 2, "primary_link": 2, "secondary": 3, "secondary_link": 3,
    "tertiary": 4, "tertiary_link": 4, "unclassified": 5, "residential": 5, "road": 5, "living_street": 5, "service": 6, "track": 6,
}


def nearest_via(rules: DataFrame, nodes: DataFrame, snap: float = 0.5) -> DataFrame:
    """``rules`` (rule, via_x, via_y, ...) with ``node``: the nearest within max(0.01, 2 snap); null without one.

    At one distance, the last in the order of the 3x3 cells, then of nodes, is taken.
    """
    reach = max(0.01, 2 * snap)
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(3 * (i + 1) + j + 1).alias("o")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    asks = rules.select("rule", "via_x", "via_y", F.explode(around).alias("d")).withColumns({"cx": cell("via_x") + F.col("d.i"), "cy": cell("via_y") + F.col("d.j")})
    near = asks.join(nodes.select("node", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")), ["cx", "cy"])
    far = F.hypot(F.col("x") - F.col("via_x"), F.col("y") - F.col("via_y"))
    near = near.withColumn("far", far).where(F.col("far") <= reach)
    best = near.groupBy("rule").agg(F.min(F.struct("far", (-F.col("d.o")).alias("o"), (-F.col("node")).alias("n"))).alias("b"))
    return rules.join(best.select("rule", (-F.col("b.n")).alias("node")), "rule", "left")


def base_id(source_id: Column) -> Column:
    return F.substring_index(source_id, "#part", 1)


def resolve(rules: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, issues): (rule, kind, penalty_s, node, from_edge, to_edge) of rules that find edges on both sides.

    A rule names roads by source id (any part) or by the id of one part.
    """
    ids = F.array_distinct(F.array(F.col("source_id"), base_id(F.col("source_id"))))
    named = edges.select("edge", "from_node", "to_node", F.explode(ids).alias("name"))
    into = named.select(F.col("edge").alias("from_edge"), F.col("to_node").alias("node"), F.col("name").alias("from_source_id"))
    out = named.select(F.col("edge").alias("to_edge"), F.col("from_node").alias("node"), F.col("name").alias("to_source_id"))
    found = rules.join(into, ["node", "from_source_id"]).join(out, ["node", "to_source_id"])
    pairs = found.select("rule", "kind", "penalty_s", "node", "from_edge", "to_edge").distinct()
    issues = rules.join(pairs, "rule", "left_anti").select("rule", F.lit("TURN_RESTRICTION_UNRESOLVED").alias("code"))
    return pairs, issues


def expand(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_edge, to_edge, prohibited, penalty_s): ``only`` prohibits every other edge that leaves the node."""
    no = pairs.where("kind = 'no'").select("from_edge", "to_edge", F.lit(True).alias("prohibited"), F.lit(0.0).alias("penalty_s"))
    penalty = pairs.where("kind = 'penalty'").select("from_edge", "to_edge", F.lit(False).alias("prohibited"), "penalty_s")
    only = pairs.where("kind = 'only'")
    others = only.select("rule", "node", "from_edge").distinct().join(edges.select(F.col("edge").alias("to_edge"), F.col("from_node").alias("node")), "node")
    others = others.join(only.select("rule", "from_edge", "to_edge"), ["rule", "from_edge", "to_edge"], "left_anti")
    return no.unionByName(penalty).unionByName(others.select("from_edge", "to_edge", F.lit(True).alias("prohibited"), F.lit(0.0).alias("penalty_s")))


def rank(road_class: Column) -> Column:
    out = F.lit(5)
    for name, n in RANKS.items():
        out = F.when(road_class == name, n).otherwise(out)
    return out


def heading(a: Column, b: Column) -> Column:
    """Direction from ``a`` to ``b``; null if they fall together."""
    return F.when(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) > 1e-9, F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def generated_penalties(edges: DataFrame) -> DataFrame:
    """(from_edge, to_edge, prohibited, penalty_s) where turning costs time: U-turn 5 s, else sharp left 2 s, minor to major 3 s."""
    last, first = heading(F.element_at("points", -2), F.element_at("points", -1)), heading(F.col("points")[0], F.col("points")[1])
    side = ["edge", "road_id", "from_node", "to_node"]
    a = edges.select(*(F.col(c).alias(f"a_{c}") for c in side), F.col("to_node").alias("node"), last.alias("inward"), rank(F.col("road_class")).alias("a_rank"))
    b = edges.select(*(F.col(c).alias(f"b_{c}") for c in side), F.col("from_node").alias("node"), first.alias("outward"), rank(F.col("road_class")).alias("b_rank"))
    u_turn = (F.col("a_road_id") == F.col("b_road_id")) & (F.col("a_from_node") == F.col("b_to_node"))
    turn = F.col("outward") - F.col("inward")
    turn = F.when(turn > math.pi, turn - 2 * math.pi).when(turn <= -math.pi, turn + 2 * math.pi).otherwise(turn)
    left = F.when(turn >= SHARP, SHARP_LEFT).otherwise(0.0)
    minor = F.when((F.col("a_rank") >= MINOR) & (F.col("b_rank") <= MAJOR), MINOR_TO_MAJOR).otherwise(0.0)
    penalty = F.when(u_turn, U_TURN).otherwise(F.greatest(left, minor))
    rows = a.join(b, "node").select(F.col("a_edge").alias("from_edge"), F.col("b_edge").alias("to_edge"), F.lit(False).alias("prohibited"), penalty.alias("penalty_s"))
    return rows.where("penalty_s > 0")


def merge(turns: DataFrame) -> DataFrame:
    """One row per pair: prohibited if any row is, the greatest penalty."""
    return turns.groupBy("from_edge", "to_edge").agg(F.bool_or("prohibited").alias("prohibited"), F.max("penalty_s").alias("penalty_s"))


#: Bounds of one rule's expansion.
MOST_SEQUENCES, MOST_ROADS, MOST_STEPS = 64, 256, 20_000


def via_sequences(rules: DataFrame, edges: DataFrame, rounds: int = MOST_ROADS) -> tuple[DataFrame, DataFrame]:
    """(sequences, issues): edge lists of rules over several roads.

    ``rules`` has (rule, from_edge, names [source ids of the via roads, then of the last road], only).  From the first
    edge a list grows along edges of the same or the next road; no node is met twice.  Over budget:
    VIA_WAY_RESTRICTION_BUDGET (fatal); without a list: TURN_RESTRICTION_UNRESOLVED (warning).
    """
    e = edges.select(F.col("edge").alias("next"), F.col("from_node").alias("at"), F.col("to_node").alias("to"), base_id(F.col("source_id")).alias("name"))
    start = rules.join(edges.select(F.col("edge").alias("from_edge"), "from_node", F.col("to_node").alias("at")), "from_edge")
    live = start.select("rule", "only", "names", F.array("from_edge").alias("edges"), F.array("from_node", "at").alias("met"), "at", F.lit(-1).alias("road"))
    done, steps = None, None
    for _ in range(rounds):
        grown = live.join(e, "at").where(~F.array_contains("met", F.col("to")))
        on = F.when((F.col("road") >= 0) & (F.get("names", F.greatest("road", F.lit(0))) == F.col("name")), F.col("road"))
        on = F.coalesce(on, F.when(F.get("names", F.col("road") + 1) == F.col("name"), F.col("road") + 1))
        grown = grown.withColumn("now", on).where("now IS NOT NULL")
        live = grown.select("rule", "only", "names", F.concat("edges", F.array("next")).alias("edges"), F.concat("met", F.array("to")).alias("met"), F.col("to").alias("at"), F.col("now").alias("road"))
        live = live.checkpoint() if live.sparkSession.sparkContext.getCheckpointDir() else live.cache()
        if live.isEmpty():
            break
        ended = live.where(F.col("road") == F.size("names") - 1)
        done = ended if done is None else done.unionByName(ended)
        count = live.groupBy("rule").agg(F.count("*").alias("n"))
        steps = count if steps is None else steps.unionByName(count)
        live = live.where(F.col("road") < F.size("names") - 1)
    if done is None:
        return live.select("rule", "edges", "only"), rules.select("rule", F.lit("TURN_RESTRICTION_UNRESOLVED").alias("code"), F.lit("warning").alias("severity")).distinct()
    over = steps.groupBy("rule").agg(F.sum("n").alias("n")).where(F.col("n") > MOST_STEPS).select("rule")
    over = over.union(done.groupBy("rule").agg(F.count("*").alias("n"), F.max(F.size("edges")).alias("long")).where((F.col("n") > MOST_SEQUENCES) | (F.col("long") > MOST_ROADS)).select("rule")).distinct()
    kept = done.join(over, "rule", "left_anti").select("rule", "edges", "only")
    missing = rules.select("rule").distinct().join(done.select("rule"), "rule", "left_anti")
    issues = over.select("rule", F.lit("VIA_WAY_RESTRICTION_BUDGET").alias("code"), F.lit("fatal").alias("severity")).unionByName(missing.select("rule", F.lit("TURN_RESTRICTION_UNRESOLVED").alias("code"), F.lit("warning").alias("severity")))
    return kept, issues


def parse_relations(relations: DataFrame) -> DataFrame:
    """``relations`` (id, tags, members) that are restrictions: (id, kind, from_way, via_node, via_ways, to_way, skip).

    The motorcar tag wins; kinds start with no_ or only_; one from, one to, and one via node or 1 to 16 via ways.
    """
    tag = lambda k: F.nullif(F.element_at("tags", k), F.lit(""))
    role = lambda name, kind: F.transform(F.filter("members", lambda m: (m["role"] == name) & (m["type"] == kind)), lambda m: m["id"])
    rows = relations.where(F.coalesce(tag("type") == "restriction", F.lit(False)))
    rule = F.coalesce(tag("restriction:motorcar"), tag("restriction:motor_vehicle"), tag("restriction"))
    excepted = F.exists(F.split(F.coalesce(tag("except"), F.lit("")), ";"), lambda t: F.trim(t).isin("motorcar", "motor_vehicle"))
    rows = rows.withColumns({"rule": rule, "f": role("from", "way"), "t": role("to", "way"), "vn": role("via", "node"), "vw": role("via", "way")})
    kind = F.when(F.col("rule").startswith("no_"), "no").when(F.col("rule").startswith("only_"), "only")
    via = ((F.size("vn") == 1) & (F.size("vw") == 0)) | ((F.size("vn") == 0) & F.size("vw").between(1, 16))
    skip = F.when(excepted, "motorcar_excepted").when(kind.isNull(), "unsupported_kind").when((F.size("f") != 1) | (F.size("t") != 1), "unsupported_members").when(~via, "unsupported_via")
    return rows.select("id", kind.alias("kind"), F.get("f", F.lit(0)).alias("from_way"), F.get("vn", F.lit(0)).alias("via_node"), F.col("vw").alias("via_ways"), F.get("t", F.lit(0)).alias("to_way"), skip.alias("skip"))


def relation_report(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("skip", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def order_via_ways(rules: DataFrame, ways: DataFrame) -> DataFrame:
    """``rules`` (id, from_way, via_ways, to_way) with ``ordered`` via ways and ``entry_node``; null unless exactly one order.

    ``ways`` has (id, nodes).  A walk starts at an end of the from way and crosses each via way once, from one of its
    ends to the other, until it reaches an end of the to way.
    """
    ends = ways.where(F.size("nodes") > 1).select(F.col("id").alias("way"), F.explode(F.array(F.struct(F.col("nodes")[0].alias("a"), F.element_at("nodes", -1).alias("b")), F.struct(F.element_at("nodes", -1).alias("a"), F.col("nodes")[0].alias("b")))).alias("e"))
    ends = ends.select("way", F.col("e.a").alias("at"), F.col("e.b").alias("to"))
    live = rules.join(ends.select(F.col("way").alias("from_way"), F.col("to").alias("at")), "from_way").select("id", "via_ways", "to_way", "at", F.col("at").alias("entry_node"), F.array().cast("array<long>").alias("ordered")).distinct()
    done = None
    for k in range(16):
        live = live.join(ends, "at").where(F.array_contains("via_ways", F.col("way")) & ~F.array_contains("ordered", F.col("way")))
        live = live.select("id", "via_ways", "to_way", F.col("to").alias("at"), "entry_node", F.concat("ordered", F.array("way")).alias("ordered"))
        full = live.where(F.size("ordered") == F.size("via_ways"))
        done = full if done is None else done.unionByName(full)
        live = live.where(F.size("ordered") < F.size("via_ways"))
        if k % 4 == 3 and live.isEmpty():
            break
    closed = done.join(ends.select(F.col("way").alias("to_way"), "at").distinct(), ["to_way", "at"], "left_semi")
    one = closed.groupBy("id").agg(F.collect_set(F.struct("ordered", "entry_node")).alias("all")).where(F.size("all") == 1)
    return rules.join(one.select("id", F.col("all")[0]["ordered"].alias("ordered"), F.col("all")[0]["entry_node"].alias("entry_node")), "id", "left")


def sidecar(rules: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(id, line, missing) in order of id: the CSV line of each rule; ``missing`` where the via node has no place.

    ``rules`` has (id, kind, from_way, via_node, ordered, to_way); ``nodes`` (id, lon, lat); ``box`` is (west, south, east, north).
    """
    rows = rules.join(nodes.select(F.col("id").alias("via_node"), "lon", "lat"), "via_node", "left")
    if box:
        rows = rows.where(F.col("lon").isNull() | (F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])))
    kind = F.when(F.size("ordered") > 0, F.concat("kind", F.lit("_via"))).otherwise(F.col("kind"))
    tail = F.when(F.size("ordered") > 0, F.array_join(F.transform("ordered", lambda w: w.cast("string")), ";"))
    line = F.concat_ws(",", "from_way", F.format_string("%.7f", "lon"), F.format_string("%.7f", "lat"), "to_way", kind, tail)
    return rows.select("id", F.when(F.col("lon").isNotNull(), line).alias("line"), F.col("lon").isNull().alias("missing")).orderBy("id")
