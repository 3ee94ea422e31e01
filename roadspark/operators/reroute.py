"""Route changes: covered road, comparison, reversals, decisions and their guards.

``routes`` has (route_id, pos, edge) rows; ``route_ends`` (route_id, start_offset_m, end_offset_m); ``lengths`` (edge, length_m).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(routes: DataFrame, ends: DataFrame, lengths: DataFrame) -> DataFrame:
    """(route_id, edge, low, high): what a route covers of each edge, clipped at its ends; visits in a row each."""
    last = F.max("pos").over(Window.partitionBy("route_id"))
    rows = routes.withColumn("last", last).join(ends, "route_id").join(lengths, "edge")
    low = F.when(F.col("pos") == F.coalesce("from_pos", F.lit(0)), F.greatest(F.lit(0.0), F.col("start_offset_m"))).otherwise(0.0)
    high = F.when(F.col("pos") == F.col("last"), F.least(F.col("length_m"), F.col("end_offset_m"))).otherwise(F.col("length_m"))
    rows = rows.where(F.col("pos") >= F.coalesce("from_pos", F.lit(0)))
    return rows.select("route_id", "edge", low.alias("low"), high.alias("high")).where("high > low")


def coverage(rows: DataFrame) -> DataFrame:
    """Merge the intervals of a route and edge that touch or overlap."""
    by = Window.partitionBy("route_id", "edge").orderBy("low", "high")
    before = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("new", F.when(before.isNull() | (F.col("low") > before), 1).otherwise(0)).withColumn("run", F.sum("new").over(by))
    return runs.groupBy("route_id", "edge", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def compare(reroutes: DataFrame, covered: DataFrame, listed: DataFrame) -> DataFrame:
    """``reroutes`` (reroute_id, old_route_id, new_route_id, valid) with ``changed`` and ``overlap``.

    ``covered`` comes from ``coverage``, ``listed`` has (route_id, edges, start_offset_m, end_offset_m).  Overlap is the
    shared part of what either covers; of nothing at all it is 1 for the same route, else 0.  Evidence that isn't
    valid gives nulls.
    """
    side = lambda name: listed.select(F.col("route_id").alias(f"{name}_route_id"), *(F.col(c).alias(f"{name}_{c}") for c in ("edges", "start_offset_m", "end_offset_m")))
    rows = reroutes.join(side("old"), "old_route_id", "left").join(side("new"), "new_route_id", "left")
    near = lambda c: F.abs(F.col(f"old_{c}") - F.col(f"new_{c}")) <= 1e-8
    same = (F.col("old_edges") == F.col("new_edges")) & near("start_offset_m") & near("end_offset_m")
    size = covered.groupBy("route_id").agg(F.sum(F.col("high") - F.col("low")).alias("size"))
    pairs = reroutes.select("reroute_id", "old_route_id", "new_route_id")
    old = pairs.join(covered.withColumnRenamed("route_id", "old_route_id"), "old_route_id").select("reroute_id", "edge", "new_route_id", F.col("low").alias("a"), F.col("high").alias("b"))
    new = covered.select(F.col("route_id").alias("new_route_id"), "edge", F.col("low").alias("c"), F.col("high").alias("d"))
    shared = old.join(new, ["new_route_id", "edge"]).groupBy("reroute_id").agg(F.sum(F.greatest(F.lit(0.0), F.least("b", "d") - F.greatest("a", "c"))).alias("shared"))
    rows = rows.join(shared, "reroute_id", "left")
    for name in ("old", "new"):
        rows = rows.join(size.select(F.col("route_id").alias(f"{name}_route_id"), F.col("size").alias(f"{name}_size")), f"{name}_route_id", "left")
    both = F.coalesce("shared", F.lit(0.0))
    union = F.coalesce("old_size", F.lit(0.0)) + F.coalesce("new_size", F.lit(0.0)) - both
    known = F.coalesce(F.col("valid"), F.lit(False)) & same.isNotNull()
    overlap = F.when(union > 1e-9, both / union).otherwise(F.when(same, 1.0).otherwise(0.0))
    return rows.select("reroute_id", F.when(known, ~same).alias("changed"), F.when(known, overlap).alias("overlap"))


NEAR = 1e-8


def fold_reversals(state: dict, row: dict) -> bool | None:
    """Whether this route change takes back what is left of the route that the last change left; keeps ``state``.

    ``row`` has success, known, changed, seq, t, old_route_id, new_route_id, old_edges, old_start, old_end, index (place on the old
    route), offset (on its edge), new_edges, new_start, new_end.  A failed row gives null and changes nothing.  One
    without evidence gives null and forgets; so does one that doesn't follow the last, until the next change.  An
    unchanged row keeps what is remembered, as far as the vehicle drove along it.
    """
    if not row["success"]:
        return None
    if not row["known"]:
        state.clear()
        state["lost"] = True
        return None
    old, new, k, offset = list(row["old_edges"]), list(row["new_edges"]), int(row["index"]), row["offset"]
    fits = 0 <= k < len(old) and new and old[k] == new[0] and abs(offset - row["new_start"]) <= NEAR and (k > 0 or offset >= row["old_start"] - NEAR)
    follows = "route" not in state or (state["route"] == row["old_route_id"] and row["t"] >= state["t"])
    if not (fits and follows):
        state["lost"] = True
        state.pop("left", None)
    if "left" in state:
        edges, at, end = state["left"]
        along = k < len(edges) and edges[: k + 1] == old[: k + 1] and (k > 0 or offset >= at - NEAR)
        if along and not (k + 1 == len(edges) and offset > end + NEAR):
            state["left"] = (edges[k:], offset, end)
        else:
            del state["left"]
    back = None
    if not state.get("lost"):
        back = bool(row["changed"] and "left" in state and new == state["left"][0] and abs(row["new_end"] - state["left"][2]) <= NEAR)
    if row["changed"] and fits:
        state["left"] = (old[k:], offset, row["old_end"])
        state["lost"] = False
    state["route"], state["t"] = row["new_route_id"], row["t"]
    return back


def reversals(changes: DataFrame) -> DataFrame:
    """(vehicle_id, seq, reversal): A to B and back to A, in the order of ``seq``; null where the evidence is unknown.

    A state machine by vehicle (see ``fold_reversals``), whose rows go to one task.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        group = group.sort_values("seq")
        out = [fold_reversals(state, row) for row in group.to_dict("records")]
        return pd.DataFrame({"vehicle_id": group["vehicle_id"], "seq": group["seq"], "reversal": pd.Series(out, index=group.index, dtype="boolean")})

    return changes.groupBy("vehicle_id").applyInPandas(run, "vehicle_id long, seq long, reversal boolean")


def candidates_rank(candidates: DataFrame) -> DataFrame:
    """The best valid candidate of each decision: least time, then length (null last), then id."""
    by = Window.partitionBy("decision_id").orderBy("time_s", F.col("length_m").asc_nulls_last(), "candidate_id")
    return candidates.where("valid").withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def rule_decision(decisions: DataFrame, share: float = 0.9) -> DataFrame:
    """``decisions`` (decision_id, invalidated, eta_s, best_id, best_time_s) with ``action`` and ``why``."""
    has, gone = F.col("best_id").isNotNull(), F.coalesce("invalidated", F.lit(False))
    better = F.coalesce(F.col("best_time_s") <= F.col("eta_s") * share, F.lit(False))
    why = F.when(~has, "no_candidate").when(gone, "route_invalidated").when(better, "faster_route").otherwise("keep_route")
    return decisions.withColumns({"action": F.when(has & (gone | better), "commit").otherwise("keep"), "why": why})


def guard(actions: DataFrame, candidates: DataFrame, least_gain: float = 0.1, cooldown: int = 1) -> DataFrame:
    """``actions`` with ``guard``: the first rule that a commit breaks, else allowed.

    It has (run_id, decision_id, action, candidate_id, seen_version, state_version, eta_s, invalidated); decisions of a
    run follow in the order of decision_id.
    """
    mine = candidates.select("decision_id", "candidate_id", F.col("time_s").alias("candidate_s"), F.lit(True).alias("offered"))
    rows = actions.join(mine, ["decision_id", "candidate_id"], "left")
    commit = F.col("action") == "commit"
    by = Window.partitionBy("run_id").orderBy("decision_id")
    rows = rows.withColumn("n", F.row_number().over(by))
    rows = rows.withColumn("since", F.col("n") - F.last(F.when(commit, F.col("n")), True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    gone = F.coalesce("invalidated", F.lit(False))
    gain = (F.col("eta_s") - F.col("candidate_s")) / F.col("eta_s")
    reason = (
        F.when(~commit, "allowed")
        .when(F.col("candidate_id").isNull(), "commit_without_candidate")
        .when(F.col("offered").isNull(), "candidate_not_in_set")
        .when(F.col("seen_version") != F.col("state_version"), "stale_state_version")
        .when(~gone & gain.isNull(), "unknown_benefit")
        .when(~gone & (gain < least_gain), "below_min_improvement")
        .when(~gone & (F.col("since") <= cooldown), "commit_cooldown")
        .otherwise("allowed")
    )
    return rows.withColumn("guard", reason).drop("n", "since", "offered", "candidate_s")


def action_check(actions: DataFrame, observations: DataFrame) -> DataFrame:
    """``actions`` (decision_id, agent_id, state_version, valid_until_s, now_s) with ``verdict``: ok, mismatch, expired or unknown."""
    seen = observations.select("decision_id", F.col("agent_id").alias("o_agent"), F.col("state_version").alias("o_version"), F.col("valid_until_s").alias("o_until"))
    rows = actions.join(seen, "decision_id", "left")
    same = (F.col("agent_id") == F.col("o_agent")) & (F.col("state_version") == F.col("o_version"))
    late = F.col("now_s") > F.least("valid_until_s", "o_until") + 1e-9
    verdict = F.when(F.col("o_agent").isNull(), "unknown").when(~F.coalesce(same, F.lit(False)), "mismatch").when(late, "expired").otherwise("ok")
    return rows.withColumn("verdict", verdict).drop("o_agent", "o_version", "o_until")
