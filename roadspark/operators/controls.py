"""Control-event logs: validity, state of vehicles, edges and junctions over time, costs, and signals.

``controls`` has (seq, t, scope, target_id, action, value); ``seq`` orders events of one time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The actions of each scope and the bounds of their factors.
ACTIONS = {"vehicle": ("hold", "release", "speed_factor"), "edge": ("close", "open", "speed_factor", "capacity_factor"), "junction": ("close", "open")}
FACTORS = {"speed_factor": (0.05, 3.0), "capacity_factor": (0.05, 10.0)}
MOST_EVENTS = 10_000


def validate(controls: DataFrame, duration: float, targets: DataFrame | None = None) -> DataFrame:
    """Add ``reason``: null for a valid event, else the first rule that it breaks.

    ``targets`` (scope, target_id) holds what exists; without it any target will do.
    """
    t, value = F.col("t"), F.col("value")
    allowed = F.lit(False)
    for scope, actions in ACTIONS.items():
        allowed = allowed | ((F.col("scope") == scope) & F.col("action").isin(*actions))
    bounds = F.lit(True)
    for action, (low, high) in FACTORS.items():
        bounds = bounds & ((F.col("action") != action) | F.coalesce(value.between(low, high), F.lit(False)))
    known = F.lit(True)
    if targets is not None:
        controls = controls.join(targets.select("scope", "target_id", F.lit(True).alias("known")).distinct(), ["scope", "target_id"], "left")
        known = F.coalesce("known", F.lit(False))
    reason = (
        F.when(~F.coalesce((t >= 0) & (t < duration), F.lit(False)), "time_out_of_range")
        .when(~F.coalesce(allowed, F.lit(False)), "action_not_allowed")
        .when(~known, "unknown_target")
        .when(~bounds, "value_out_of_range")
    )
    return controls.withColumn("reason", reason).drop("known")


def over_budget(controls: DataFrame) -> DataFrame:
    """One row: the number of events and whether it passes the budget."""
    return controls.agg(F.count("*").alias("events"), (F.count("*") > MOST_EVENTS).alias("over_budget"))


def effective_time(t: Column, step: float) -> Column:
    """The first tick at or after ``t``."""
    return F.greatest(F.lit(0.0), F.ceil((t - 1e-9) / step) * F.lit(step))


def _last(actions: list[str], what: Column) -> Column:
    return F.max_by(F.when(F.col("action").isin(*actions), what), F.when(F.col("action").isin(*actions), F.struct("t", "seq")))


def vehicle_state_at(controls: DataFrame, t: float) -> DataFrame:
    """(vehicle_id, held, speed_factor): the last of each at or before ``t``; not held and 1 by default."""
    past = controls.where((F.col("scope") == "vehicle") & (F.col("t") <= t))
    state = past.groupBy(F.col("target_id").alias("vehicle_id")).agg(_last(["hold", "release"], F.col("action") == "hold").alias("held"), _last(["speed_factor"], F.col("value")).alias("speed_factor"))
    return state.select("vehicle_id", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("speed_factor", F.lit(1.0)).alias("speed_factor"))


def edge_state_at(controls: DataFrame, edges: DataFrame, t: float) -> DataFrame:
    """(edge, closed, speed_factor, capacity_factor, routable) of all ``edges`` (edge, from_node) at ``t``.

    An edge is routable if it is open and so is the junction where it starts.
    """
    past = controls.where(F.col("t") <= t)
    edge = past.where(F.col("scope") == "edge").groupBy(F.col("target_id").alias("edge"))
    edge = edge.agg(_last(["close", "open"], F.col("action") == "close").alias("closed"), _last(["speed_factor"], F.col("value")).alias("sf"), _last(["capacity_factor"], F.col("value")).alias("cf"))
    node = past.where(F.col("scope") == "junction").groupBy(F.col("target_id").alias("from_node")).agg(_last(["close", "open"], F.col("action") == "close").alias("shut"))
    out = edges.select("edge", "from_node").join(edge, "edge", "left").join(node, "from_node", "left")
    closed, shut = F.coalesce("closed", F.lit(False)), F.coalesce("shut", F.lit(False))
    return out.select("edge", closed.alias("closed"), F.coalesce("sf", F.lit(1.0)).alias("speed_factor"), F.coalesce("cf", F.lit(1.0)).alias("capacity_factor"), (~closed & ~shut).alias("routable"))


def kind_of(action: Column) -> Column:
    """What an action sets: hold and release set one state, close and open another."""
    return F.when(action.isin("hold", "release"), "held").when(action.isin("close", "open"), "closed").otherwise(action)


def state_intervals(controls: DataFrame) -> DataFrame:
    """(scope, target_id, kind, valid_from, valid_to, action, value): each state until the next event of its kind."""
    kinds = controls.withColumn("kind", kind_of(F.col("action")))
    latest = kinds.groupBy("scope", "target_id", "kind", "t").agg(F.max(F.struct("seq", "action", "value")).alias("e"))
    by = Window.partitionBy("scope", "target_id", "kind").orderBy("t")
    return latest.select("scope", "target_id", "kind", F.col("t").alias("valid_from"), F.lead("t").over(by).alias("valid_to"), "e.action", "e.value")


def applied_counts(controls: DataFrame, until: float) -> DataFrame:
    """Events applied up to ``until`` by scope, with one more row of null scope for all."""
    return controls.where(F.col("t") <= until).rollup("scope").agg(F.count("*").alias("applied"))


def capacity(length_m: Column, lanes: Column, jam_spacing: float = 7.5) -> Column:
    return F.greatest(F.lit(1), F.floor(length_m / jam_spacing) * lanes).cast("long")


def effective_capacity(cap: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(cap * factor)).cast("long")


def routing_cost_factor(speed_factor: Column, capacity_factor: Column, occupancy: Column, effective: Column, min_ratio: float = 0.1) -> Column:
    """Cost factor of 1 or more from control factors and crowding."""
    free = F.greatest(F.lit(max(min_ratio, 0.01)), F.least(F.lit(1.0), 1 - F.greatest(F.lit(0), occupancy - 1) / effective))
    return F.greatest(F.lit(1.0), (1 / F.greatest(F.lit(0.01), speed_factor)) * (1 / F.least(F.lit(1.0), capacity_factor)) / free)


def exit_headway(occupancy: Column, effective: Column, free: float = 1.4, jam: float = 2.0) -> Column:
    return free + (jam - free) * F.least(F.lit(1.0), occupancy / effective)


#: Ratio at which a periodic scan publishes a cost, and the least change of an explicit event.
PUBLISH_RATIO, LEAST_CHANGE = 1.25, 1e-9


def published_cost_changes(costs: DataFrame) -> DataFrame:
    """(edge, t, old, new, improved): the changes that are published, against the last published value (1 at first).

    ``costs`` has (edge, t, seq, factor, explicit).  A state machine by edge, whose rows are folded in one pass.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        last, out = 1.0, []
        group = group.sort_values(["t", "seq"])
        for t, new, explicit in zip(group["t"], group["factor"], group["explicit"], strict=True):
            if abs(new - last) > LEAST_CHANGE if explicit else max(new / last, last / new) >= PUBLISH_RATIO:
                out.append((group["edge"].iloc[0], t, last, new, new < last))
                last = new
        return pd.DataFrame(out, columns=["edge", "t", "old", "new", "improved"])

    return costs.groupBy("edge").applyInPandas(run, "edge long, t double, old double, new double, improved boolean")


def signal_phases(signals: DataFrame) -> DataFrame:
    """(node, phase, begin_s, green_end_s, cycle_s, offset_s) from rows (node, phase, green_s, yellow_s, all_red_s, offset_s, ...)."""
    phases = signals.groupBy("node", "phase").agg(*(F.first(c).alias(c) for c in ("green_s", "yellow_s", "all_red_s", "offset_s")))
    whole = F.col("green_s") + F.col("yellow_s") + F.col("all_red_s")
    before = F.sum(whole).over(Window.partitionBy("node").orderBy("phase")) - whole
    cycle = F.sum(whole).over(Window.partitionBy("node"))
    return phases.select("node", "phase", before.alias("begin_s"), (before + F.col("green_s")).alias("green_end_s"), cycle.alias("cycle_s"), "offset_s")


def signal_state(signals: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks`` (node, from_edge, to_edge, t) with ``state``: green, red, or open for a node without a plan.

    Yellow and all-red count as red.
    """
    movements = signals.select("node", "phase", "from_edge", "to_edge").distinct()
    plan = movements.join(signal_phases(signals), ["node", "phase"])
    keys = ["node", "from_edge", "to_edge"]
    asked = asks.join(plan, keys, "left")
    place = F.pmod(F.col("t") + F.col("offset_s"), F.col("cycle_s"))
    green = asked.groupBy(*keys, "t").agg(F.coalesce(F.bool_or((place >= F.col("begin_s")) & (place < F.col("green_end_s"))), F.lit(False)).alias("green"))
    planned = signals.select("node", F.lit(True).alias("planned")).distinct()
    out = green.join(planned, "node", "left")
    return out.select(*keys, "t", F.when(F.col("planned").isNull(), "open").when(F.col("green"), "green").otherwise("red").alias("state"))


def saturation(passes: DataFrame) -> DataFrame:
    """``passes`` (from_edge, to_edge, t, saturation_flow_vph) with ``headway_s`` and ``saturated``: sooner than that after the last."""
    headway = 3600 / F.col("saturation_flow_vph")
    last = F.lag("t").over(Window.partitionBy("from_edge", "to_edge").orderBy("t"))
    return passes.withColumns({"headway_s": headway, "saturated": F.coalesce(F.col("t") - last < headway, F.lit(False))})


def validate_signals(signals: DataFrame, edges: DataFrame, turns: DataFrame) -> DataFrame:
    """(node, phase, from_edge, to_edge, reason) of each row that breaks a rule.

    ``edges`` has (edge, from_node, to_node), ``turns`` (from_edge, to_edge, prohibited).
    """
    into = edges.select(F.col("edge").alias("from_edge"), F.col("to_node").alias("in_node"))
    out_of = edges.select(F.col("edge").alias("to_edge"), F.col("from_node").alias("out_node"))
    banned = turns.where("prohibited").select("from_edge", "to_edge", F.lit(True).alias("banned")).distinct()
    rows = signals.join(into, "from_edge", "left").join(out_of, "to_edge", "left").join(banned, ["from_edge", "to_edge"], "left")
    plans = rows.groupBy("node").agg((F.max("offset_s") - F.min("offset_s") > 1e-9).alias("differs"))
    rows = rows.join(plans, "node")
    meets = F.coalesce((F.col("in_node") == F.col("node")) & (F.col("out_node") == F.col("node")), F.lit(False))
    reason = (
        F.when(F.col("differs"), "plans_differ")
        .when(~((F.col("offset_s") >= 0) & (F.col("yellow_s") >= 0) & (F.col("all_red_s") >= 0)), "negative_time")
        .when(~(F.col("green_s") > 0), "no_green")
        .when(~F.col("saturation_flow_vph").between(60, 7200), "flow_out_of_range")
        .when(~meets, "movement_not_at_node")
        .when(F.coalesce("banned", F.lit(False)), "movement_prohibited")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("node", "phase", "from_edge", "to_edge", "reason")


def hot_edges(state: DataFrame, occupied: DataFrame) -> DataFrame:
    """Edges that are occupied, closed, or have a factor other than 1: ``state`` with ``vehicles``."""
    out = state.join(occupied.select("edge", "vehicles"), "edge", "left").withColumn("vehicles", F.coalesce("vehicles", F.lit(0)))
    odd = (F.abs(F.col("speed_factor") - 1) > 1e-9) | (F.abs(F.col("capacity_factor") - 1) > 1e-9)
    return out.where((F.col("vehicles") > 0) | F.col("closed") | odd)


def active_events(hot: DataFrame, most: int = 64) -> DataFrame:
    """(edge, event) of the first ``most`` hot edges: closed, else congested where ``cost_factor`` is above 1."""
    event = F.when(F.col("closed"), "closed").when(F.col("cost_factor") > 1 + 1e-9, "congested")
    return hot.select("edge", event.alias("event")).where("event IS NOT NULL").orderBy("edge").limit(most)
